"""The keyed, versioned table: puts, deletes, reads, snapshots, flushes and compactions."""

from __future__ import annotations

import shutil
import threading
from collections.abc import Callable
from collections import Counter
from contextlib import suppress
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keyfold.functions.keys import as_bytes, is_empty_range, successor
from keyfold.functions.stats import IoStats, payload_bytes
from keyfold.plans import planner, resolve
from keyfold.plans.schema import CHANGELOG, DELETE, LIVE, PUT
from keyfold.sources import manifest as mf
from keyfold.sources import runs as rn
from keyfold.sources import segments as sg
from keyfold.sources.oplog import OVERHEAD, OpLog

FLUSH_THRESHOLD = 100_000
RUN_ENTRIES = 4_000_000
STALL_POLL_S = 0.1
#: The most files that an ordered scan reads one after the other instead of sorting.
MOST_ORDERED_FILES = 64
REFUSED, REPEATED = "null keys, null values of puts, null order or unknown operations", "repeated keys need order_by"


class ClosedTable(Exception):
    """The table has been closed."""


def _bad() -> Column:
    """Whether a row (key, op, value, _seq) is no mutation."""
    return F.col("key").isNull() | ~F.coalesce(F.col("op").isin(PUT, DELETE), F.lit(False)) | ((F.col("op") == PUT) & F.col("value").isNull()) | F.col("_seq").isNull()


class Snapshot:
    """A fixed state of a table: the runs of one manifest version, the log segments and the buffer as they were.

    DataFrames from a snapshot stay readable until the snapshot is released and the
    table is vacuumed, whatever is written or compacted meanwhile.
    """

    def __init__(self, table: KVTable, manifest: mf.Manifest, buffer: dict[bytes, tuple[str, bytes | None]], segments: tuple[sg.Segment, ...] = ()) -> None:
        self._table, self.manifest, self._buffer, self.segments = table, manifest, buffer, segments
        self._held = True

    @property
    def spark(self) -> SparkSession:
        return self._table.spark

    def changes(self, low: bytes | None = None, high: bytes | None = None) -> tuple[DataFrame, bool]:
        """The mutations of [low, high), and whether every key is in it once."""
        chosen = rn.prune(self.manifest.runs, low, high)
        parts = [rn.read_runs(self.spark, self._table.path, chosen, low, high)] if chosen else []
        parts += self.unflushed(low, high)
        if not parts:
            parts.append(self.spark.createDataFrame([], CHANGELOG))
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out, len(parts) == 1 and not self.segments and (not chosen or rn.disjoint(chosen))

    def unflushed(self, low: bytes | None = None, high: bytes | None = None) -> list[DataFrame]:
        """What no run holds yet of [low, high): the log segments, and over them the buffer."""
        seq, parts = self.manifest.next_seq, []
        if self.segments:
            parts.append(rn.ranged(sg.read(self.spark, self._table.path, self.segments, seq), low, high))
            seq += sum(s.records for s in self.segments)
        own = [(k, seq, op, v) for k, (op, v) in self._buffer.items() if (low is None or k >= low) and (high is None or k < high)]
        return [*parts, self.spark.createDataFrame(own, CHANGELOG)] if own else parts

    def winners(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        changes, single = self.changes(low, high)
        return changes if single else resolve.newest(changes)

    def live(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """key, value of the live keys in [low, high), in no particular order."""
        if is_empty_range(low, high):
            return self.spark.createDataFrame([], LIVE)
        return resolve.without_deletes(self.winners(low, high)).select("key", "value")

    def scan(self, low: bytes | str | None = None, high: bytes | str | None = None, limit: int | None = None) -> DataFrame:
        """The live rows of [low, high) in key order; a missing bound is open, a reversed range empty."""
        low, high = (None if x is None else as_bytes(x) for x in (low, high))
        if limit is not None:
            return self.live(low, high).orderBy("key").limit(limit)
        files = self._in_order(low, high)
        if files is None:
            return self.live(low, high).orderBy("key")
        out = files[0]
        for x in files[1:]:
            out = out.unionByName(x)
        return out

    def _in_order(self, low: bytes | None, high: bytes | None) -> list[DataFrame] | None:
        """The live rows by file, in key order, where disjoint sorted files are all there is to read; else None.

        The splits of one file are read in the order of their offsets, so that a scan needs no sort.
        """
        chosen = sorted(rn.prune(self.manifest.runs, low, high), key=lambda r: r.first_key)
        buffered = any((low is None or k >= low) and (high is None or k < high) for k in self._buffer)
        if is_empty_range(low, high) or buffered or self.segments or not 0 < len(chosen) <= MOST_ORDERED_FILES or not rn.disjoint(chosen):
            return None
        read = lambda r: rn.read_runs(self.spark, self._table.path, [r], low, high)
        return [resolve.without_deletes(read(r)).select("key", "value") for r in chosen]

    def prefix_scan(self, prefix: bytes | str) -> DataFrame:
        prefix = as_bytes(prefix)
        return self.scan(prefix, successor(prefix))

    def get(self, key: bytes | str) -> bytes | None:
        """The key's value; None if it is absent or deleted."""
        key = as_bytes(key)
        if key in self._buffer:
            return self._buffer[key][1]
        row = self._table._run(lambda: self.live(key, key + b"\0").where(F.col("key") == F.lit(key)).first())
        return None if row is None else bytes(row["value"])

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """key, value of the given keys that are live."""
        return resolve.multi_get(self.live(), keys)

    def multi_get_misses(self, keys: DataFrame) -> DataFrame:
        return resolve.multi_get_misses(self.live(), keys)

    def size(self) -> int:
        """The number of live keys; values are not read."""
        changes, single = self.changes()
        count = changes.where(F.col("op") == PUT).agg(F.count("*").alias("n")) if single else resolve.live_count(changes)
        return self._table._run(lambda: count.first()["n"])

    def space_amplification(self) -> float:
        """Bytes of the run files over key and value bytes of the live rows."""
        held = self._table._run(lambda: payload_bytes(self.live()))
        return sum(r.size for r in self.manifest.runs) / held if held else float("nan")

    def release(self) -> None:
        if self._held:
            self._held = False
            self._table._release(self.manifest.version, self.segments)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.release()


class KVTable:
    """An ordered key-value table over layers of Parquet runs; one writing process at a time.

    Single mutations go to a log and a buffer, which becomes a level 0 run once it holds
    ``flush_threshold`` distinct keys. ``log_all`` logs a DataFrame of single mutations
    from its tasks, in segments that are read in place of a buffer. ``put_all``,
    ``delete_all`` and ``apply_all`` write a DataFrame as a run directly. The folder has
    to be on a file system with hard links.

    Writers take turns by one lock, which they hold through their Spark jobs. The state
    that readers see is swapped under another one, held for moments only, so no reader
    waits for a job. DataFrames of ``scan``, ``live`` and the like pin the runs they are
    made of until ``release_scans``, and snapshots until they are released.
    """

    def __init__(self, spark: SparkSession, path: Path, flush_threshold: int, run_entries: int, fsync: bool, background: bool) -> None:
        self.spark, self.path = spark, path
        self.flush_threshold, self.run_entries = flush_threshold, run_entries
        self.stats = IoStats()
        self.compactions = self.write_stalls = 0
        self._lock = threading.RLock()
        self._changed = threading.Condition(self._lock)
        self._writer = threading.RLock()
        self._pins: Counter[int] = Counter()
        self._segment_pins: Counter[sg.Segment] = Counter()
        self._scans: list[Snapshot] = []
        self._buffer: dict[bytes, tuple[str, bytes | None]] = {}
        self._closed = False
        self._failure: Exception | None = None
        self._busy = threading.Lock()
        path.mkdir(parents=True, exist_ok=True)
        self._manifest = self._load()
        self._segments = sg.load(path)
        sg.clean(path, self._segments)
        self._log = OpLog(path / "wal.log", fsync)
        for op, key, value in self._log.recover():
            self._buffer[key] = (op, value)
        self._worker = None
        if background:
            self._worker = threading.Thread(target=self._compact_forever, name=f"compact-{path.name}", daemon=True)
            self._worker.start()

    @classmethod
    def open(cls, spark: SparkSession, path: str | Path, flush_threshold: int = FLUSH_THRESHOLD, run_entries: int | None = None, fsync: bool = True, background: bool = False) -> KVTable:
        """Opens or creates a table: newest manifest, then the log over it.

        ``run_entries`` is the most rows of a run file (the flush threshold if that is
        set lower than the default); ``fsync=False`` gives up durability of single
        mutations. Fails, and deletes nothing, if the manifest is damaged or a run it
        names is missing. Run folders that no version names are deleted.
        """
        if run_entries is None:
            run_entries = RUN_ENTRIES if flush_threshold >= FLUSH_THRESHOLD else flush_threshold
        return cls(spark, Path(path), max(1, flush_threshold), max(1, run_entries), fsync, background)

    def _load(self) -> mf.Manifest:
        found = mf.read(self.path)
        folders = mf.run_folders(self.path)
        if found is None:
            metas, top = [], 0
            for name in sorted(folders):
                if level_seq := mf.parse_name(name):
                    metas += rn.describe_folder(self.spark, self.path, name, *level_seq)
                    top = max(top, level_seq[1])
            return mf.commit(self.path, mf.Manifest(1, top + 1, tuple(metas)))
        mf.check(self.path, found)
        for name in folders - mf.named_folders(self.path):
            if mf.parse_name(name):
                shutil.rmtree(self.path / mf.RUNS / name, ignore_errors=True)
        return found

    # ---- reads

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The current state, or that of an older version that vacuum has not dropped (without the buffer)."""
        with self._lock:
            self._check()
            state = self._manifest if version is None else mf.read(self.path, version)
            self._pins[state.version] += 1
            if version is not None:
                return Snapshot(self, state, {})
            self._segment_pins.update(self._segments)
            return Snapshot(self, state, dict(self._buffer), self._segments)

    def _release(self, version: int, segments: tuple[sg.Segment, ...]) -> None:
        with self._lock:
            self._pins[version] -= 1
            self._segment_pins.subtract(segments)

    def _clean_segments(self) -> None:
        """Deletes the segments that are neither logged any more nor pinned."""
        with self._lock:
            sg.clean(self.path, {*self._segments, *(s for s, n in self._segment_pins.items() if n > 0)})
            self._segment_pins = +self._segment_pins

    def _view(self) -> Snapshot:
        """A snapshot whose pin lasts until ``release_scans``, for DataFrames that run later."""
        held = self.snapshot()
        with self._lock:
            self._scans.append(held)
        return held

    def release_scans(self) -> None:
        """Gives up the pins of all DataFrames handed out so far; after the next vacuum they may not run any more."""
        with self._lock:
            held, self._scans = self._scans, []
        for s in held:
            s.release()

    def get(self, key: bytes | str) -> bytes | None:
        key = as_bytes(key)
        with self._lock:
            self._check()
            if key in self._buffer:
                return self._buffer[key][1]
        with self.snapshot() as s:
            return s.get(key)

    def scan(self, low: bytes | str | None = None, high: bytes | str | None = None, limit: int | None = None) -> DataFrame:
        return self._view().scan(low, high, limit)

    def prefix_scan(self, prefix: bytes | str) -> DataFrame:
        return self._view().prefix_scan(prefix)

    def live(self) -> DataFrame:
        return self._view().live()

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return self._view().multi_get(keys)

    def multi_get_misses(self, keys: DataFrame) -> DataFrame:
        return self._view().multi_get_misses(keys)

    def size(self) -> int:
        with self.snapshot() as s:
            return s.size()

    def _run(self, action):
        """Runs a Spark action; a checksum failure becomes an error that names the run."""
        try:
            return action()
        except (PySparkException, Py4JJavaError) as e:
            if known := rn.corruption(e):
                raise known from e
            raise

    # ---- writes

    def put(self, key: bytes | str, value: bytes | str) -> None:
        self._mutate(PUT, as_bytes(key), as_bytes(value, "value"))

    def delete(self, key: bytes | str) -> None:
        """Deletes a key; deleting an absent one is legal."""
        self._mutate(DELETE, as_bytes(key), None)

    def _mutate(self, op: str, key: bytes, value: bytes | None) -> None:
        with self._writer:
            self._check()
            before = self._log.appended
            self._log.append(op, key, value)
            self.stats.wal += self._log.appended - before
            self.stats.logical += len(key) + len(value or b"")
            with self._lock:
                self._buffer[key] = (op, value)
            if len(self._buffer) >= self.flush_threshold:
                self.flush()
        self._after_write()

    def flush(self) -> None:
        """Writes the log segments and the buffer as a level 0 run; does nothing without any."""
        with self._writer:
            self._check()
            if not self._buffer and not self._segments:
                return
            seq = self._manifest.next_seq
            if self._segments:
                logged, *more = Snapshot(self, self._manifest, self._buffer, self._segments).unflushed()
                won = resolve.newest(logged.unionByName(more[0]) if more else logged).withColumn("seq", F.lit(seq).cast("long"))
                files = max(1, -(-sum(s.size for s in self._segments) // rn.RUN_BYTES))
            else:
                won = self.spark.createDataFrame([(k, seq, op, v) for k, (op, v) in sorted(self._buffer.items())], CHANGELOG)
                files = 1
            added = rn.write_run(won, self.path, 0, seq, max(self.run_entries, RUN_ENTRIES), files)
            self._publish(added, seq, {}, empties_buffer=True)
            # the segments first: they are older, and replayed alone they would win over the run
            sg.reset(self.path)
            self._log.reset()
            self._clean_segments()

    def log_all(self, df: DataFrame, order_by: str) -> int:
        """Logs the rows (key, op, value) as single mutations in the order of a column, all or none, and returns their number.

        The tasks of the DataFrame write the log and later replay it; neither rows nor
        keys come to the driver. They become a run by ``flush``, which is called once
        the segments hold ``flush_threshold`` mutations. Of rows with equal order the
        greatest (op, value) is taken last. Refuses what ``apply_all`` refuses.
        """
        with self._writer:
            self._check()
            if self._buffer:
                self.flush()
            value = F.when(F.col("op") == PUT, F.col("value").cast("binary"))
            rows = df.select(F.col("key").cast("binary").alias("key"), "op", value.alias("value"), F.col(order_by).alias("_seq"))
            op = F.when(_bad(), F.raise_error(F.lit(REFUSED)).cast("string")).otherwise(F.col("op"))
            added = self._checked(lambda: sg.write(rows.withColumn("op", op), "_seq", self.path, sg.tasks(rows)))
            size, records = sum(s.size for s in added), sum(s.records for s in added)
            self.stats.wal += size
            self.stats.logical += size - OVERHEAD * records
            with self._lock:
                self._segments = (*self._segments, *added)
            if sum(s.records for s in self._segments) >= self.flush_threshold:
                self.flush()
        self._after_write()
        return records

    def put_all(self, df: DataFrame, order_by: str | None = None) -> int:
        """Puts the rows (key, value) of a DataFrame in one commit and returns their number.

        Of rows with one key the greatest in ``order_by`` wins; without it, repeated keys
        are refused. Null keys and values are refused.
        """
        more = [] if order_by is None else [F.col(order_by).alias("_order")]
        return self.apply_all(df.select("key", F.lit(PUT).alias("op"), "value", *more), None if order_by is None else "_order")

    def delete_all(self, keys: DataFrame) -> int:
        """Deletes the distinct keys of a DataFrame in one commit and returns their number."""
        return self.apply_all(keys.select("key").distinct().select("key", F.lit(DELETE).alias("op"), F.lit(None).cast("binary").alias("value")))

    def apply_all(self, df: DataFrame, order_by: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """Applies mutations (key, op 'P' or 'D', value) in one commit and returns the keys it touched.

        ``batch`` (stream name, number) makes it idempotent: a number at or below the
        last one taken from that stream is skipped.
        """
        with self._writer:
            self._check()
            if batch is not None and batch[1] <= self._manifest.batches.get(batch[0], -1):
                return 0
            self.flush()
            seq = self._manifest.next_seq
            order = F.lit(0) if order_by is None else F.col(order_by)
            value = F.when(F.col("op") == PUT, F.col("value").cast("binary"))
            rows = df.select(F.col("key").cast("binary").alias("key"), "op", value.alias("value"), order.alias("_seq"))
            # counted before the shuffle on the key, which runs once: the stage after it also runs for the ranges
            counted = Observation()
            rows = rows.observe(counted, F.sum(F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))).alias("bytes"))
            won = rows.groupBy("key").agg(F.max(F.struct("_seq", "op", "value")).alias("w"), F.count("*").alias("n"), F.max(_bad().cast("int")).alias("bad"))
            op = F.when(F.col("bad") > 0, F.raise_error(F.lit(REFUSED)).cast("string"))
            if order_by is None:
                op = op.when(F.col("n") > 1, F.raise_error(F.lit(REPEATED)).cast("string"))
            won = won.select("key", F.lit(seq).cast("long").alias("seq"), op.otherwise(F.col("w.op")).alias("op"), F.col("w.value").alias("value"))
            added = self._checked(lambda: rn.write_run(won, self.path, 0, seq, max(self.run_entries, RUN_ENTRIES), rn.estimated_files(rows)))
            batches = {} if batch is None else {batch[0]: batch[1]}
            if added or batches:
                self._publish(added, seq, batches)
            if added:  # without rows the optimizer may leave the observation out of the plan
                self.stats.logical += counted.get["bytes"]
        self._after_write()
        return sum(r.entries for r in added)

    @staticmethod
    def _checked(write: Callable):
        """Runs a write whose plan raises on mutations that are not allowed, as a ValueError."""
        try:
            return write()
        except (PySparkException, Py4JJavaError) as e:
            for message in (REFUSED, REPEATED):
                if message in str(e):
                    raise ValueError(message) from None
            raise

    def _publish(self, added: list, seq: int, batches: dict[str, int], empties_buffer: bool = False) -> None:
        """Commits new level 0 files; readers see them and the emptied buffer at once."""
        with self._lock:
            self.stats.flush += sum(r.size for r in added)
            self._commit(added, set(), next_seq=seq + 1, batches=self._manifest.batches | batches)
            if empties_buffer:
                self._buffer, self._segments = {}, ()
            self._changed.notify_all()

    def _commit(self, added, removed: set[str], **more) -> None:
        self._manifest = mf.commit(self.path, self._manifest.with_runs(added, removed, **more), self._manifest)

    # ---- compaction

    def compact(self) -> None:
        """Works off all that is due, then moves level 0 down whatever its size."""
        self.flush()
        while self._compact_once(force=True):
            pass

    def _compact_once(self, force: bool = False) -> bool:
        """Runs the next job, without the lock while it merges: new runs may arrive meanwhile and stay."""
        with self._busy:
            with self._lock:
                job = planner.plan(self._manifest.runs, force)
                seq = self._manifest.next_seq
            if job is None:
                return False
            changes = rn.read_runs(self.spark, self.path, list(job.inputs), None, None)
            won = changes if rn.disjoint(list(job.inputs)) else resolve.newest(changes)
            if job.drop_tombstones:
                won = resolve.without_deletes(won)
            files = max(-(-sum(r.size for r in job.inputs) // rn.RUN_BYTES), -(-sum(r.entries for r in job.inputs) // self.run_entries))
            added = self._run(lambda: rn.write_run(won, self.path, job.target, seq, self.run_entries, files))
            with self._lock:
                self._commit(added, {r.path for r in job.inputs})
                self.stats.compaction += sum(r.size for r in added)
                self.compactions += 1
                self._changed.notify_all()
            return True

    def _after_write(self) -> None:
        if self._worker is None:
            while planner.plan(self._manifest.runs) is not None and self._compact_once():
                pass
            return
        with self._lock:
            while not self._closed and len({r.seq for r in planner.at_level(self._manifest.runs, 0)}) >= planner.STALL_TRIGGER:
                self._check()
                self.write_stalls += 1
                self._changed.wait(STALL_POLL_S)

    def _compact_forever(self) -> None:
        while True:
            with self._lock:
                while not self._closed and planner.plan(self._manifest.runs) is None:
                    self._changed.wait()
                if self._closed:
                    return
            try:
                self._compact_once()
            except Exception as e:  # kept, and raised by the next call of the table
                with self._lock:
                    self._failure = e
                    self._changed.notify_all()
                return

    def vacuum(self, keep_versions: int = 1) -> int:
        """Deletes old versions that nothing pins, and run folders that no kept version names; returns the folders deleted.

        Snapshots that are not released and DataFrames handed out before the last
        ``release_scans`` keep their files. Files that kept versions are read from stay.
        """
        with self._busy, self._writer, self._lock:
            self._check()
            known = mf.versions(self.path)
            recent = set(known[-max(1, keep_versions) :])
            files, named = mf.needed(self.path, [v for v in known if v in recent or self._pins[v] > 0])
            for v in set(known) - files:
                mf.drop_version(self.path, v)
            gone = [x for x in mf.run_folders(self.path) if x not in named]
            for name in gone:
                shutil.rmtree(self.path / mf.RUNS / name, ignore_errors=True)
            self._clean_segments()
            return len(gone)

    # ---- introspection

    @property
    def version(self) -> int:
        return self._manifest.version

    def run_counts(self) -> dict[int, int]:
        """The number of run files of each populated level."""
        return dict(sorted(Counter(r.level for r in self._manifest.runs).items()))

    def describe(self) -> DataFrame:
        """A row for each run file."""
        rows = [(r.path, r.level, r.seq, r.entries, r.size, bytearray(r.first_key), bytearray(r.last_key), r.tombstones) for r in self._manifest.runs]
        return self.spark.createDataFrame(rows, "path string, level int, run_seq long, entries long, bytes long, first_key binary, last_key binary, tombstones long")

    def overview(self) -> DataFrame:
        """metric, value: version, runs, populated levels, deepest level (-1 without runs), live-or-dead entries, buffered mutations, compactions, stalls."""
        with self._lock:
            runs, counts = self._manifest.runs, self.run_counts()
            rows = [("version", self._manifest.version), ("run_files", len(runs)), ("populated_levels", len(counts)), ("deepest_level", planner.deepest(runs)), ("entries", sum(r.entries for r in runs)), ("tombstones", sum(r.tombstones for r in runs)), ("buffered", len(self._buffer) + sum(s.records for s in self._segments)), ("compactions", self.compactions), ("write_stalls", self.write_stalls)]
        return self.spark.createDataFrame(rows, "metric string, value long")

    def io_stats(self) -> DataFrame:
        return self.spark.createDataFrame(self.stats.rows(), "metric string, value double")

    def verify(self) -> list[str]:
        """The run files that cannot be read whole."""
        bad = []
        for r in self._manifest.runs:
            try:
                rn.read_changelog(self.spark, [rn.uri(self.path, r.path)]).agg(F.count("*"), F.sum(F.crc32("key")), F.sum(F.crc32("value")), F.max("op"), F.max("seq")).collect()
            except (PySparkException, Py4JJavaError):
                bad.append(r.path)
        return bad

    def _check(self) -> None:
        if self._closed:
            raise ClosedTable("the table is closed")
        if self._failure is not None:
            raise RuntimeError("a compaction has failed") from self._failure

    def close(self) -> None:
        """Ends the background thread and closes the log; does not flush, and may be called again."""
        with self._lock:
            if self._closed:
                return
            self._closed = True
            self._changed.notify_all()
        if self._worker is not None:
            self._worker.join()
        with suppress(OSError):
            self._log.close()

    def __enter__(self) -> KVTable:
        return self

    def __exit__(self, *_) -> None:
        self.close()
