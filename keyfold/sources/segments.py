"""Log segments: single mutations that the tasks of a DataFrame write, framed as in the log and replayed by tasks.

A batch of them is a folder of segment files and a commit that names these in order. It
is older than what the log file beside it holds. Segments do not change; a batch without a
commit does not count.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
import zlib
from collections.abc import Collection, Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from keyfold.plans.schema import CHANGELOG
from keyfold.sources import runs as rn
from keyfold.sources.manifest import sync_folder
from keyfold.sources.oplog import decode_records, encode_record, framed_bytes

FOLDER = "wal"
ROOT = str(Path(__file__).resolve().parents[2])
#: About the bytes of a segment, which one task replays, and how many it reads at once.
SEGMENT_BYTES, READ_BYTES = 16 << 20, 1 << 20
#: The most tasks that a batch is dealt out over; with more rows these write more segments each.
MOST_TASKS = 1_000
#: From so many bytes on the optimizer does not know a plan's size.
UNKNOWN_BYTES = 1 << 50
WRITTEN = "place long, part long, name string, records long, size long"


class DamagedSegment(Exception):
    """A segment or a commit of segments that is not as it was written."""


@dataclass(frozen=True)
class Segment:
    """One immutable file of a batch: its name in the folder of segments, its mutations and its bytes."""

    name: str
    records: int
    size: int


def _ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from the place the driver has it in."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    return spark


def _numbers(folder: Path) -> dict[str, int]:
    """The batches and commits in the folder with their numbers."""
    found = (re.fullmatch(r"b(\d{8})(\.json|-[0-9a-f]{32})", p.name) for p in folder.iterdir()) if folder.is_dir() else ()
    return {m[0]: int(m[1]) for m in found if m}


def _commits(folder: Path) -> list[Path]:
    return [folder / x for x in sorted(_numbers(folder)) if x.endswith(".json")]


def load(table: Path) -> tuple[Segment, ...]:
    """The committed segments, oldest first. Damage is an error, never skipped."""
    out = []
    for path in _commits(table / FOLDER):
        body, _, tail = path.read_bytes().rpartition(b"\ncrc ")
        if tail != b"%08x\n" % zlib.crc32(body):
            raise DamagedSegment(f"{path} is damaged")
        out += [Segment(**x) for x in json.loads(body)]
    for s in out:
        if not (path := table / FOLDER / s.name).exists() or path.stat().st_size != s.size:
            raise DamagedSegment(f"{path} is missing or has another length")
    return tuple(out)


def clean(table: Path, used: Collection[Segment]) -> None:
    """Deletes the batches that hold none of the segments in use."""
    named = {s.name.split("/")[0] for s in used}
    for name in _numbers(table / FOLDER):
        if not name.endswith(".json") and name not in named:
            shutil.rmtree(table / FOLDER / name, ignore_errors=True)


def reset(table: Path) -> None:
    """Takes back all commits, the oldest first, so that whatever a crash leaves is newer than what has gone."""
    for path in _commits(table / FOLDER):
        path.unlink()
        sync_folder(path.parent)


def tasks(rows: DataFrame) -> int:
    """How many tasks write a batch: one for each segment by the optimizer's size, the shuffle partitions if it knows none."""
    size = rn.estimated_bytes(rows)
    return rn.shuffle_partitions(rows) if size >= UNKNOWN_BYTES else max(1, min(-(-size // SEGMENT_BYTES), MOST_TASKS))


def write(rows: DataFrame, order: str, table: Path, places: int) -> tuple[Segment, ...]:
    """Writes rows (op, key, value and ``order``) as a batch in their order and commits it; the driver gets a row for each segment.

    Of rows with equal order the greatest (op, value) comes last. If the write fails, no
    folder stays.
    """
    spark = _ready(rows.sparkSession)
    folder = table / FOLDER
    number = 1 + max(_numbers(folder).values(), default=0)
    batch = folder / f"b{number:08d}-{uuid.uuid4().hex}"
    batch.mkdir(parents=True)
    target, name, most = str(batch.absolute()), batch.name, SEGMENT_BYTES

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out, made = TaskContext.get().partitionId(), None, []
        try:
            for b in batches:
                for record in map(encode_record, *(b.column(k).to_pylist() for k in range(3))):
                    if out is None or made[-1][4] >= most:
                        if out is not None:
                            _close(out)
                        made.append([place, len(made), f"{place:05d}-{len(made):05d}-{uuid.uuid4().hex}.log", 0, 0])
                        out = open(f"{target}/{made[-1][2]}", "xb")  # noqa: SIM115
                    out.write(record)
                    made[-1][3] += 1
                    made[-1][4] += len(record)
        finally:
            if out is not None:
                _close(out)
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], ["place", "part", "name", "records", "size"])

    try:
        dealt = rows.repartitionByRange(places, order) if places > 1 else rows.repartition(1)
        made = dealt.sortWithinPartitions(order, "op", "value").select("op", "key", "value").mapInArrow(each, WRITTEN).collect()
        out = tuple(Segment(f"{name}/{r['name']}", r["records"], r["size"]) for r in sorted(made, key=lambda r: (r["place"], r["part"])))
        if out:
            sync_folder(batch)
            _commit(folder, number, out)
    except BaseException:
        shutil.rmtree(batch, ignore_errors=True)
        raise
    if not out:
        shutil.rmtree(batch, ignore_errors=True)
    return out


def _close(file) -> None:
    file.flush()
    os.fsync(file.fileno())
    file.close()


def _commit(folder: Path, number: int, segments: tuple[Segment, ...]) -> None:
    body = json.dumps([asdict(s) for s in segments]).encode()
    temporary = folder / f"{uuid.uuid4().hex}.tmp"
    try:
        with open(temporary, "wb") as f:
            f.write(body + b"\ncrc %08x\n" % zlib.crc32(body))
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, folder / f"b{number:08d}.json")
        sync_folder(folder)
    finally:
        temporary.unlink(missing_ok=True)


def _records(path: str) -> Iterator[list[tuple[str, bytes, bytes | None]]]:
    """The records of a segment, as many at a time as READ_BYTES hold."""
    rest, missing = b"", 0
    with open(path, "rb") as f:
        while missing >= 0 and (more := f.read(max(READ_BYTES, missing))):
            rest += more
            found = list(decode_records(rest))
            rest = rest[found[-1][0] if found else 0 :]
            missing = framed_bytes(rest) - len(rest) if rest else 0  # below 0: whole, and not valid
            if found:
                yield [x[1:] for x in found]
    if rest:
        raise DamagedSegment(f"{path} is damaged")


def read(spark: SparkSession, table: Path, segments: tuple[Segment, ...], seq: int) -> DataFrame:
    """All mutations of the segments (CHANGELOG), a task for each segment; their sequences count up from ``seq``."""
    todo = []
    for s in segments:
        todo.append((str((table / FOLDER / s.name).absolute()), s.records, seq))
        seq += s.records
    schema = pa.schema([("key", pa.binary()), ("seq", pa.int64()), ("op", pa.string()), ("value", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                path, records, at = todo[k]
                last = at + records
                for found in _records(path):
                    ops, keys, values = zip(*found, strict=True)
                    yield pa.record_batch([keys, range(at, at + len(found)), ops, values], schema=schema)
                    at += len(found)
                if at != last:
                    raise DamagedSegment(f"{path} has {at - last:+d} records")

    return _ready(spark).range(0, len(todo), 1, len(todo)).mapInArrow(each, CHANGELOG)
