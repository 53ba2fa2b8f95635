"""Repeat removal with a logarithmic family of sorted gram and window hashes, in place of suffix arrays.

Every byte covered by a LENGTH-byte string that also starts in a document with a smaller
id goes. Documents are laid out in id order and cut into batches. Every LENGTH-byte
window of a text has an anchor: the place in it whose K-byte gram hashes lowest, the
leftmost on a tie. Equal windows have equal anchors, so only suffixes at anchors, about
one in 14, are indexed.

Each batch gets an array of its anchors sorted by their gram's hash, with a hash of the
whole stretch of windows that share the anchor. That is no suffix order: equal grams are
adjacent, which is what matches of a fixed length need, and the hashes split evenly into
buckets. In a bucket the arrays of the batches arrive in id order; each is looked up in the existing
levels and what is new becomes a level itself, equal-sized levels merging geometrically,
so a bucket of b batches has log b levels. A hit on the whole stretch settles all its
windows. Where only the gram is shared, as at the borders of a repeated passage, the same
index family runs once more over single windows.

A batch sends at most one entry of a gram to a bucket, and the index holds a gram once,
with its first stretch; further stretches of it are a set beside it. So a passage in a
third of all documents is as many entries as there are batches, and a gram in differing
surroundings costs a lookup an entry, not one a pair. Matches are equal in 128 bits: gram
and stretch, or two independent hashes of a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import ready, stored, text_slices

LENGTH = 50
K = 24
BATCH_BYTES = 1 << 20
BUCKET_BYTES = 48 << 20
LEAST_BUCKETS = 128
SPREAD_BYTES = 16 << 20
#: Anchors are found a segment of windows at a time; a position in it has to fit in POSITION_BITS.
SEGMENT = 1 << 16
POSITION_BITS = 23
U = np.uint64
_SEED = np.random.default_rng(20240229)
_TABLE = _SEED.integers(1, 1 << 63, 256, np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LANES = -(-LENGTH // 8)
_LANE = _SEED.integers(1, 1 << 63, _LANES, np.uint64) * U(2) + U(1)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(n, U)
    size = 1
    while size < n:
        step = U(pow(base, size, 1 << 64))
        out[size : 2 * size] = out[: min(size, n - size)] * step
        size *= 2
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A finalising bijection of 64-bit numbers, in place."""
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class Batch:
    """The texts of some documents end to end, their windows' anchors and hashes of any substring."""

    def __init__(self, data: bytes, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.data = np.frombuffer(data, np.uint8)
        self.ids = ids
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        n = len(self.data)
        self.inverse = _powers(_INVERSE, n + 1)
        terms = _TABLE[self.data]
        terms *= _powers(_BASE, n)
        self.prefix = np.zeros(n + 1, U)
        np.cumsum(terms, dtype=U, out=self.prefix[1:])
        del terms
        self._anchors()

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the substrings [first, last)."""
        return _mix((self.prefix[last] - self.prefix[first]) * self.inverse[first])

    def checks(self, windows: np.ndarray) -> np.ndarray:
        """Second hashes of LENGTH-byte windows, independent of the first: multilinear in their 8-byte lanes."""
        out = np.zeros(len(windows), U)
        if not len(windows):
            return out
        lanes = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))  # the 8 bytes from each place on; the last lane overlaps
        for i in range(0, len(windows), 1 << 16):
            own = windows[i : i + (1 << 16)]
            total = out[i : i + len(own)]
            for k in range(_LANES):
                x = lanes[own + min(8 * k, LENGTH - 8)]
                x ^= x >> U(32)
                x *= _LANE[k]
                x ^= x >> U(29)
                x *= _LANE[-1 - k]
                total += x
            _mix(total)
        return out

    def _anchors(self) -> None:
        """anchor, low, high: the distinct anchors and the first and last window of each; document of each."""
        n = len(self.data)
        empty = np.zeros(0, np.int64)
        self.anchor = self.low = self.high = self.document = empty
        if n < LENGTH:
            return
        inside = np.zeros(n + 1, np.int8)
        long = self.ends - self.starts >= LENGTH
        np.add.at(inside, self.starts[long], 1)
        np.add.at(inside, self.ends[long] - LENGTH + 1, -1)
        inside = np.cumsum(inside, dtype=np.int8) > 0
        parts: list[list[np.ndarray]] = []
        for first in range(0, n - LENGTH + 1, SEGMENT):
            found = self._segment(first, min(first + SEGMENT, n - LENGTH + 1), inside)
            if found is None:
                continue
            if parts and parts[-1][0][-1] == found[0][0]:  # an anchor whose windows go on from the segment before
                parts[-1][2][-1] = found[2][0]
                found = [x[1:] for x in found]
            if len(found[0]):
                parts.append(found)
        if not parts:
            return
        self.anchor, self.low, self.high, grams = (np.concatenate(x) for x in zip(*parts, strict=True))
        # an anchor's gram hashes low by its choice; hashing again spreads the grams evenly over the buckets
        self.gram = _mix(grams ^ U(_BASE))
        self.document = np.searchsorted(self.ends, self.anchor, "right")
        stretch = self.hashes(self.low, self.high + LENGTH)
        stretch ^= (self.anchor - self.low).astype(U) * U(0x9E3779B97F4A7C15)
        self.stretch = _mix(stretch)

    def _segment(self, first: int, last: int, inside: np.ndarray) -> list[np.ndarray] | None:
        """anchor, low, high and the gram's hash of each anchor of the windows [first, last) that are ``inside`` a document."""
        windows = first + np.flatnonzero(inside[first:last])
        if not len(windows):
            return None
        grams = self.prefix[first + K : last + LENGTH] - self.prefix[first : last + LENGTH - K]
        grams *= self.inverse[first : first + len(grams)]
        _mix(grams)
        least = grams >> U(POSITION_BITS)
        least <<= U(POSITION_BITS)
        least |= np.arange(len(grams), dtype=U)
        span, width = LENGTH - K + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        least &= U((1 << POSITION_BITS) - 1)
        at = first + least[windows - first].astype(np.int64)
        new = np.flatnonzero(np.diff(at, prepend=-1))
        return [at[new], windows[new], windows[np.append(new[1:], len(windows)) - 1], grams[at[new] - first]]

    def classes(self):
        """Anchors of equal gram and stretch: order, first of each class, class of each, and which grams vary."""
        order = np.lexsort((self.stretch, self.gram))  # anchors ascend, so equal ones stay in order
        g, s = self.gram[order], self.stretch[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
        first = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        lead = order[first]
        gram = g[first]
        same = np.zeros(len(first), bool)
        same[1:] = gram[1:] == gram[:-1]
        many = same.copy()
        many[:-1] |= same[1:]
        later = np.zeros(len(self.anchor), bool)
        later[order] = self.ids[self.document[order]] > self.ids[self.document[lead]][number]
        of = np.empty(len(order), np.int64)
        of[order] = number
        return lead, of, later, gram, many, same


def _split(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit key, by its upper part: ascending keys have ascending buckets."""
    return ((keys >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _batch_rows(docs: DataFrame, parts: int) -> DataFrame:
    """Batches in id order: batch, ids, sizes, data (compressed, as it moves twice). Rows of one id stay in one batch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        parts_: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            nonlocal number, held
            sizes = np.array([len(x) for x in parts_], np.int64)
            out = pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary()), pa.array([pa.compress(b"".join(parts_), "zstd", asbytes=True)], pa.binary())], ["batch", "ids", "sizes", "data"]
            )
            number, held = number + 1, 0
            ids.clear()
            parts_.clear()
            return out

        for batch in (x for whole in batches for x in text_slices(whole, "text")):
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if ids and i != ids[-1] and held + len(text) > BATCH_BYTES:
                    yield row()
                ids.append(i)
                parts_.append(text)
                held += len(text)
        if ids:
            yield row()

    ordered = docs.repartitionByRange(parts, "id").sortWithinPartitions("id")
    return ordered.mapInArrow(cut, "batch bigint, ids binary, sizes binary, data binary")


def _open(batch: pa.RecordBatch, i: int) -> Batch:
    get = lambda name: batch.column(name)[i].as_py()
    sizes = np.frombuffer(get("sizes"), np.int64)
    return Batch(pa.decompress(get("data"), int(sizes.sum()), "zstd", asbytes=True), sizes, np.frombuffer(get("ids"), np.int64))


def _numbers(value: bytes | None, kind) -> np.ndarray:
    return np.frombuffer(value or b"", kind)


RUN = "bucket int, batch bigint, key binary, stretch binary, place binary"
REPLY = "batch bigint, hit binary, open binary"


def _runs(batch: int, keys: np.ndarray, stretch: np.ndarray, place: np.ndarray, buckets: int) -> Iterator[dict]:
    """A batch's sorted array as one row for each bucket."""
    of = _split(keys, buckets)
    bounds = np.searchsorted(of, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        x = slice(bounds[b], bounds[b + 1])
        yield {"bucket": b, "batch": batch, "key": keys[x].tobytes(), "stretch": stretch[x].tobytes(), "place": place[x].astype(np.uint32).tobytes()}


_RUN = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("key", pa.binary()), ("stretch", pa.binary()), ("place", pa.binary())])


class Levels:
    """Arrays sorted by their first column, a 64-bit key, whose sizes grow geometrically."""

    def __init__(self) -> None:
        self.levels: list[list[np.ndarray]] = []

    def lookup(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        """For each level with equal keys: which of ``keys``, the level, and the first equal entry."""
        for level in self.levels:
            low = np.searchsorted(level[0], keys, "left")
            found = np.flatnonzero(level[0][np.minimum(low, len(level[0]) - 1)] == keys)
            if len(found):
                yield found, level, low[found]

    def has(self, keys: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Which pairs of key and second key are held; other pairs with an equal key do not hide one."""
        out = np.zeros(len(keys), bool)
        for which, level, low in self.lookup(keys):
            while len(which):
                out[which[level[1][low] == second[which]]] = True
                more = (low + 1 < len(level[0])) & (level[0][np.minimum(low + 1, len(level[0]) - 1)] == keys[which])
                which, low = which[more], low[more] + 1
        return out

    def add(self, run: list[np.ndarray]) -> None:
        """Takes a run in any order."""
        if not len(run[0]):
            return
        if (run[0][1:] < run[0][:-1]).any():
            order = np.argsort(run[0], kind="stable")
            run = [x[order] for x in run]
        self.levels.append(run)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            young, old = self.levels.pop(), self.levels.pop()
            both = [np.concatenate(x) for x in zip(old, young, strict=True)]
            order = np.argsort(both[0], kind="stable")
            self.levels.append([x[order] for x in both])


def _scan_bucket(rows: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]], windows: bool) -> dict[int, list[list[np.ndarray]]]:
    """Replies of one bucket: for each batch the places that are hits, and those that stay open.

    With ``windows`` the entries are windows and nothing stays open. Otherwise they are
    grams and stretches. A gram is held once, with its first stretch and a mark if that
    entry has been told that others differ; its further stretches are held apart. An
    entry of stretch 0 stands for a gram that varies within its batch: it opens others
    and needs no reply itself.
    """
    firsts, others = Levels(), Levels()
    replies: dict[int, list[list[np.ndarray]]] = {}

    def reply(batch: int, kind: int, places: np.ndarray) -> None:
        if len(places):
            replies.setdefault(batch, [[], []])[kind].append(places)

    for batch, keys, second, place in rows:
        if windows:
            seen = firsts.has(keys, second)
            reply(batch, 0, place[seen])
            firsts.add([keys[~seen], second[~seen]])
            continue
        known, seen = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        met = []
        for which, level, low in firsts.lookup(keys):
            known[which] = True
            seen[which] = (level[1][low] == second[which]) & (second[which] != 0)
            met.append((which, level, low))
        whole = second != 0
        ask = np.flatnonzero(known & ~seen & whole)
        seen[ask[others.has(_mix(keys[ask] ^ second[ask]), second[ask])]] = True
        partial = known & ~seen
        for which, level, low in met:
            # the gram's first entry has to show its windows once another stretch of it is there
            told = low[partial[which]]
            told = told[(level[1][told] != 0) & (level[4][told] == 0)]
            level[4][told] = 1
            for b in np.unique(level[2][told]).tolist():
                reply(b, 1, level[3][told[level[2][told] == b]])
        reply(batch, 0, place[seen])
        reply(batch, 1, place[partial & whole])
        new, more = ~known, partial & whole
        firsts.add([keys[new], second[new], np.full(new.sum(), batch), place[new], np.zeros(new.sum(), np.int8)])
        others.add([_mix(keys[more] ^ second[more]), second[more]])
    return replies


def _index(runs: DataFrame, buckets: int, windows: bool = False) -> DataFrame:
    """Runs the index family in each bucket: REPLY rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield tuple(batch.column(k)[i].as_py() for k in range(5))

        def out(replies: dict) -> pa.RecordBatch:
            join = lambda x: np.concatenate(x).tobytes() if x else None
            return pa.RecordBatch.from_arrays([pa.array(list(replies), pa.int64()), pa.array([join(x[0]) for x in replies.values()], pa.binary()), pa.array([join(x[1]) for x in replies.values()], pa.binary())], ["batch", "hit", "open"])

        stream = rows()
        row = next(stream, None)
        while row is not None:
            bucket = row[0]

            def group() -> Iterator[tuple]:
                nonlocal row
                while row is not None and row[0] == bucket:  # noqa: B023
                    yield row[1], _numbers(row[2], U), _numbers(row[3], U), _numbers(row[4], np.uint32)
                    row = next(stream, None)

            replies = _scan_bucket(group(), windows)
            if replies:
                yield out(replies)

    return runs.repartition(buckets, "bucket").sortWithinPartitions("bucket", "batch").mapInArrow(each, REPLY)


def _with_replies(table: DataFrame, replies: DataFrame, names: list[str], parts: int) -> DataFrame:
    """Each batch with the lists of its replies, in ``parts`` partitions: columns hit and open become ``names``.

    The replies to a batch are at most as many as its anchors or windows.
    """
    gathered = replies.repartition(parts, "batch").groupBy("batch").agg(F.collect_list("hit").alias(names[0]), F.collect_list("open").alias(names[1])).withColumnRenamed("batch", "_batch")
    return table.repartition(parts, "batch").join(gathered, F.col("batch") == F.col("_batch"), "left").drop("_batch")


def _flags(value: list[bytes] | None, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for x in value or []:
        out[np.frombuffer(x, np.uint32)] = True
    return out


def _windows(own: Batch, hit: list[bytes] | None, opened: list[bytes] | None):
    """Windows that the first round settles as removed, and the open ones with their two hashes, sorted by these."""
    gone = np.zeros(len(own.data) + 1, np.int32)
    none = np.zeros(0, np.int64)
    if not len(own.anchor):
        return gone[:-1] > 0, none, none.astype(U), none.astype(U)
    lead, of, later, gram, many, _ = own.classes()
    seen = _flags(hit, len(lead))
    settled = later | seen[of]
    np.add.at(gone, own.low[settled], 1)
    np.add.at(gone, own.high[settled] + 1, -1)
    ask = (_flags(opened, len(lead)) | many)[of] & ~settled
    counts = (own.high - own.low + 1)[ask]
    start = np.repeat(own.low[ask] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) if len(counts) else none
    windows = (start + np.arange(counts.sum())).astype(np.int64)
    hashes = own.hashes(windows, windows + LENGTH)
    checks = own.checks(windows)
    order = np.argsort(hashes, kind="stable")  # windows ascend, so equal ones stay in order
    h, c = hashes[order], checks[order]
    if ((h[1:] == h[:-1]) & (c[1:] != c[:-1])).any():
        order = np.lexsort((windows, checks, hashes))
    return np.cumsum(gone[:-1]) > 0, windows[order], hashes[order], checks[order]


def _window_classes(own: Batch, windows: np.ndarray, hashes: np.ndarray, checks: np.ndarray):
    """First of equal open windows, class of each, and those of a document after the first's."""
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])
    first, number = np.flatnonzero(new), np.cumsum(new) - 1
    ids = own.ids[np.searchsorted(own.ends, windows, "right")]
    return first, number, ids > ids[first][number] if len(first) else np.zeros(0, bool)


def _indexed(df: DataFrame, id_column: str, text_column: str, sources: bool, characters: bool) -> DataFrame:
    """The rows with an id, after both rounds of the index."""
    spark = ready(df.sparkSession)
    text = F.coalesce(F.encode(F.col(text_column), "utf-8"), F.lit(b""))
    docs = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), text.alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(1, min(size // (8 * BATCH_BYTES) + 1, 100_000)))
    buckets = int(max(LEAST_BUCKETS, size // BUCKET_BYTES))
    table = stored(_batch_rows(docs, parts), "suffix-batches", "none")

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = _open(batch, i)
                if len(own.anchor):
                    lead, _, _, gram, many, same = own.classes()
                    stretch = np.where(many, U(0), own.stretch[lead] | U(1))
                    keep = ~same
                    yield pa.RecordBatch.from_pylist(list(_runs(batch.column("batch")[i].as_py(), gram[keep], stretch[keep], np.flatnonzero(keep), buckets)), schema=_RUN)

    one = stored(_index(table.mapInArrow(first_round, RUN), buckets), "suffix-replies")
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SPREAD_BYTES)
    known = _with_replies(table, one, ["hit", "open"], spread)

    def second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = _open(batch, i)
                _, windows, hashes, checks = _windows(own, batch.column("hit")[i].as_py(), batch.column("open")[i].as_py())
                if len(windows):
                    first, _, _ = _window_classes(own, windows, hashes, checks)
                    yield pa.RecordBatch.from_pylist(list(_runs(batch.column("batch")[i].as_py(), hashes[first], checks[first], np.arange(len(first)), buckets)), schema=_RUN)

    two = stored(_index(known.mapInArrow(second_round, RUN), buckets, windows=True), "suffix-replies")
    known = _with_replies(known, two, ["hit2", "open2"], spread)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = _open(batch, i)
                gone, windows, hashes, checks = _windows(own, batch.column("hit")[i].as_py(), batch.column("open")[i].as_py())
                if len(windows):
                    first, number, later = _window_classes(own, windows, hashes, checks)
                    gone[windows[later | _flags(batch.column("hit2")[i].as_py(), len(first))[number]]] = True
                cover = np.zeros(len(own.data) + 1, np.int32)
                starts = np.flatnonzero(gone)
                cover[starts] += 1
                np.add.at(cover, starts + LENGTH, -1)
                cover = np.cumsum(cover[:-1]) > 0
                for a in range(0, len(own.ids), 512):
                    rows = [_cut(own.data[x:y], cover[x:y], characters) for x, y in zip(own.starts[a : a + 512], own.ends[a : a + 512], strict=True)]
                    columns = [pa.array(own.ids[a : a + 512]), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True))]
                    if sources:
                        columns.append(pa.array([hashlib.sha256(own.data[x:y]).hexdigest() for x, y in zip(own.starts[a : a + 512], own.ends[a : a + 512], strict=True)], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, _NAMES + ["source_sha256"] * sources)

    return known.select("batch", "ids", "sizes", "data", "hit", "open", "hit2").mapInArrow(apply, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary" + ", source_sha256 string" * sources)


_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
_NAMES = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def _cut(text: np.ndarray, removed: np.ndarray, characters: bool = False) -> tuple[int, int, int, str, bytes]:
    """Bytes, removed bytes, removed runs, and the digest and the bytes of what is left; ``characters`` go whole."""
    if characters and removed.any():
        new = (text & 0xC0) != 0x80
        new[0] = True
        first = np.flatnonzero(new)
        removed = np.repeat(np.logical_or.reduceat(removed, first), np.diff(np.append(first, len(text))))
    kept = text[~removed].tobytes()
    spans = int((np.diff(removed.astype(np.int8), prepend=0) == 1).sum())
    return len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept


def remove_repeats(df: DataFrame, id_column: str, text_column: str, sources: bool = False, characters: bool = False) -> DataFrame:
    """Removes from each whole text what also stands in a document with a smaller id.

    Returns id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) and,
    with ``sources``, source_sha256 of the whole text, which tells texts of one id apart.
    With ``characters`` a character that loses a byte goes whole, so what is left is
    UTF-8; the counts and the digest are of that.
    Texts are UTF-8 bytes, null counts as empty; matches never cross documents; rows with
    one id do not count as repeats of each other; a row with a null id neither removes
    nor loses anything. Other columns are not read; an empty table gives no rows. Rows of
    one id are in one batch, and a batch is held by one task, with about 30 bytes for
    each of its own.
    """
    text = F.coalesce(F.encode(F.col(text_column), "utf-8"), F.lit(b""))
    rest = df.where(F.col(id_column).isNull()).select(F.col(id_column).cast("bigint").alias("id"), text.alias("kept"))
    rest = rest.select("id", F.octet_length("kept").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "kept", *[F.sha2("kept", 256).alias("source_sha256")] * sources)
    return _indexed(df, id_column, text_column, sources, characters).union(rest).withColumnRenamed("id", id_column)
