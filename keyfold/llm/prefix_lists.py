"""Every pair of shingle sets of a least Jaccard similarity, across components that are known already.

Sets of n that are similar enough share at least ceil(least * n) shingles, so in any order
of all shingles the first n - ceil(least * n) + 1 of both have one in common. Only these
are indexed, in an order that puts shingles last that are common in a sample; the order
bears on the length of the lists, never on the result. Of a list those members stay that
have a partner: one in a different component whose size and place allow the similarity if
this shingle is the first that both have.

No row is made for each pair that meets in a list. The members left, not more than were
indexed, get the parities of their set, and the pairs of a list are compared in the task
that holds it: sets whose parities differ in more bits than similar sets have different
shingles are not similar. A pair meets in each shingle that both have indexed; it goes on
from the first, so it is passed over where both have one of the shingles before in common.
What goes on is verified on the whole sets.

A list over LIST members is dealt out in blocks that meet across components only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import drop_stored, stored
from keyfold.llm.components import deal_across

LIST = 1_024
#: Sets of the sample that finds common shingles, the least count there, the most shingles taken.
SAMPLE_SETS, LEAST_COUNT, MOST_COMMON = 10_000, 4, 1 << 16
#: Members of lists and pairs that are handed on at once.
ROWS = 1 << 16
#: The most bits of parities, and words of them compared at once.
MOST_BITS, WORDS = 1 << 14, 1 << 18
#: Members of a list know so many indexed shingles before its own.
BEFORE = 4
SLACK = 1e-9


def indexed(n: int, least: float) -> int:
    """How many shingles of a set of n are indexed."""
    return n - math.ceil(least * n - SLACK) + 1


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets of ascending hashes have a Jaccard similarity of ``least`` or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - SLACK


def first_shingles(own: np.ndarray, common: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The indexed shingles of a set in order: those outside ``common`` by hash, then the others by count and hash."""
    size = indexed(len(own), least)
    if not len(common):
        return own[:size]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    hot = common[at] == own
    rare = own[~hot][:size]
    if len(rare) == size:
        return rare
    rest = np.flatnonzero(hot)
    return np.concatenate([rare, own[rest[np.lexsort((own[rest], counts[at[rest]]))]][: size - len(rare)]])


def _common(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample of sets, ascending, and their counts there; a bounded number."""
    share = min(1.0, SAMPLE_SETS / max(1, sets.count()))
    sample = sets.where(F.pmod(F.xxhash64("own"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("hashes"):
                hashes = pa.array(np.frombuffer(x.as_py(), np.int64))
                yield from (pa.RecordBatch.from_arrays([hashes[i : i + ROWS]], ["h"]) for i in range(0, len(hashes), ROWS))

    counts = sample.select("hashes").mapInArrow(each, "h bigint").groupBy("h").count().where(F.col("count") >= LEAST_COUNT)
    found = counts.orderBy(F.col("count").desc(), "h").limit(MOST_COMMON).collect()
    hashes = np.array([r["h"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["count"] for r in found], np.int64)[order]


def _prefixes(sets: DataFrame, key: str, least: float) -> DataFrame:
    """``key``, own, n and the indexed shingles of each set that is not empty."""
    common, counts = _common(sets)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.frombuffer(x, np.uint64) for x in batch.column("hashes").to_pylist()]
            firsts = [first_shingles(x, common, counts, least).view(np.int64) if len(x) else x.view(np.int64) for x in hashes]
            ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *firsts])))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("own"), pa.array(list(map(len, hashes)), pa.int64()), lists], [key, "own", "n", "firsts"])

    return sets.select(key, "own", "hashes").mapInArrow(each, f"{key} binary, own bigint, n bigint, firsts array<bigint>")


def parities(own: np.ndarray) -> np.ndarray:
    """A bit for each class of shingles, by hash: whether the set has an odd number of them; a bit a shingle or more, up to MOST_BITS.

    Sets differ in at least as many shingles as their bits differ. Half as many bits are
    the halves of these, added.
    """
    size = min(MOST_BITS, max(64, 1 << (len(own) - 1).bit_length()))
    odd = np.bincount((own >> np.uint64(8) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _needed(n: np.ndarray, other: np.ndarray, least: float) -> np.ndarray:
    """How many shingles similar sets of these sizes share at least."""
    return np.ceil(least / (1 + least) * (n + other) - SLACK).astype(np.int64)


def _pairs(group: np.ndarray, component: np.ndarray, n: np.ndarray, place: np.ndarray, apart: np.ndarray | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of each group that may be similar and may have no shingle before in common.

    ``group`` ascends. Of members with equal ``apart`` no pair is made.
    """
    order = np.lexsort((n, group))
    group, component, n, behind = group[order], component[order], n[order], (n - place)[order]
    block = None if apart is None else apart[order]
    at = np.arange(len(group))
    for d in range(1, len(group)):
        at = at[: np.searchsorted(at, len(group) - d)]
        at = at[group[at + d] == group[at]]
        at = at[n[at] >= least * n[at + d] - SLACK]  # sizes ascend, so no later one fits either
        if not len(at):
            return
        other = at + d
        fits = (component[at] != component[other]) & (np.minimum(behind[at], behind[other]) >= _needed(n[at], n[other], least))
        if block is not None:
            fits &= block[at] != block[other]
        if fits.any():
            yield order[at[fits]], order[other[fits]]


def _members(postings: DataFrame, least: float) -> DataFrame:
    """Members of lists that have a partner there, and all (long) of lists over LIST that are not of one component."""
    names = ["key", "component", "own", "n", "place"]
    schema = "long boolean, key bigint, component bigint, own bigint, n bigint, place bigint"

    def rows(long: bool, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(columns[0]), ROWS):
            part = [pa.array(x[i : i + ROWS]) for x in columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), long)), *part], ["long", *names])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long = [np.zeros(0, np.int64)] * 5, None
        for batch in chain(batches, [None]):
            part = held if batch is None else [np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate(held)]
            if long is not None:  # the list that went out as members goes on
                cut = int(np.searchsorted(part[0], long, "right"))
                yield from rows(True, [x[:cut] for x in part])
                part = [x[cut:] for x in part]
            if not len(part[0]):
                held = part
                continue
            cut = len(part[0]) if batch is None else int(np.searchsorted(part[0], part[0][-1]))
            held, part, long = [x[cut:] for x in part], [x[:cut] for x in part], None
            if len(held[0]) > LIST:
                long = held[0][0]
                yield from rows(True, held)
                held = [x[:0] for x in held]
            if not cut:
                continue
            starts = np.flatnonzero(np.append(True, part[0][1:] != part[0][:-1]))
            sizes = np.diff(np.append(starts, cut))
            mixed = np.minimum.reduceat(part[1], starts) != np.maximum.reduceat(part[1], starts)
            over = np.repeat(mixed & (sizes > LIST), sizes)
            yield from rows(True, [x[over] for x in part])
            short = np.repeat(mixed & (sizes <= LIST), sizes)
            key, component, own, n, place = part = [x[short] for x in part]
            stays = np.zeros(len(key), bool)
            for a, b in _pairs(key, component, n, place, None, least):
                stays[a] = stays[b] = True
            yield from rows(False, [x[stays] for x in part])

    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(each, schema)


def _told(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The members with the shingles before, of those that are left, and the parities of their set."""
    names = ["long", "key", "component", "own", "n", "place"]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [parities(np.frombuffer(x, np.uint64)).tobytes() for x in batch.column("hashes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(bits, pa.binary())], ["own", "bits"])

    filled = sets.select("own", "hashes").where(F.length("hashes") > 0)
    heads = filled.mapInArrow(tell, "own bigint, bits binary").select(F.lit(False).alias("long"), *(F.lit(-1).cast("bigint").alias(x) for x in names[1:3]), "own", *(F.lit(-1).cast("bigint").alias(x) for x in names[4:]), "bits")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = heads.union(members.select(*names, F.lit(None).cast("binary").alias("bits")))
    both = both.repartition(parts, "own").sortWithinPartitions("own", "component", "place")
    schema = ", ".join(["long boolean", *(f"{x} bigint" for x in names[1:]), "known bigint", *(f"b{k} bigint" for k in range(BEFORE)), "bits binary"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, last = None, [np.zeros(0, np.int64)] * 3
        for batch in batches:
            head = batch.column("place").to_numpy() < 0
            held = [bits, *batch.column("bits").filter(pa.array(head)).to_pylist()]
            bits = held[-1]
            which = np.cumsum(head)[~head]
            rest = batch.filter(pa.array(~head))
            key, component, own = (rest.column(x).to_numpy() for x in ("key", "component", "own"))
            longer = [np.concatenate(x) for x in zip(last, (key, component, own), strict=True)]
            known, before = np.zeros(len(key), np.int64), []
            for d in range(1, BEFORE + 1):
                shifted = [np.concatenate([np.zeros(d, np.int64), x])[: len(x)][len(longer[0]) - len(key) :] for x in longer]
                there = (np.arange(len(longer[0]) - len(key), len(longer[0])) >= d) & (shifted[1] == component) & (shifted[2] == own)
                known += there
                before.append(shifted[0])
            last = [x[-BEFORE:] for x in longer]
            out = [*(rest.column(x) for x in names), *map(pa.array, [known, *before])]
            step = max(1, ROWS * 32 // max([1, *(len(x) for x in held if x)]))
            for i in range(0, len(key), step):
                yield pa.RecordBatch.from_arrays([*(x[i : i + step] for x in out), pa.array([held[k] for k in which[i : i + step].tolist()], pa.binary())], [*names, "known", *(f"b{k}" for k in range(BEFORE)), "bits"])

    return both.mapInArrow(each, schema)


def _differing(flat: np.ndarray, start: np.ndarray, width: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The parities in which members differ; ``flat`` has ``width`` words of each, of the longer the halves are added."""
    out = np.empty(len(a), np.int64)
    sizes = np.stack([width[a], width[b]], axis=1)
    for wa, wb in np.unique(sizes, axis=0).tolist():
        own, w = np.flatnonzero((sizes[:, 0] == wa) & (sizes[:, 1] == wb)), min(wa, wb)
        step = max(1, WORDS // max(wa, wb))
        for i in range(0, len(own), step):
            at = own[i : i + step]
            x, y = (np.bitwise_xor.reduce(flat[start[k[at], None] + np.arange(size)].reshape(len(at), -1, w), axis=1) for k, size in ((a, wa), (b, wb)))
            out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def _met(dealt: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, ca, cb) of each (key, low, high) that the parities do not tell apart, from the first shingle they share."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high")

    def found(table: pa.Table, group: np.ndarray) -> Iterator[list[np.ndarray]]:
        low, high, block, component, own, n, place = (table.column(x).to_numpy() for x in ("low", "high", "block", "component", "own", "n", "place"))
        known, before = table.column("known").to_numpy(), [table.column(f"b{k}").to_numpy() for k in range(BEFORE)]
        bits = table.column("bits").to_pylist()
        flat = np.frombuffer(b"".join(bits), np.uint64)
        width = np.array([len(x) // 8 for x in bits], np.int64)
        start = np.cumsum(width) - width
        # in a pair of different blocks the members of one block do not meet, as they do in a pair of their own
        apart = np.where(low == high, np.arange(len(low)), block)
        for a, b in _pairs(group, component, n, place, apart, least):
            later = np.zeros(len(a), bool)
            for i, x in enumerate(before):
                for j, y in enumerate(before):
                    later |= (x[a] == y[b]) & (known[a] > i) & (known[b] > j)
            a, b = a[~later], b[~later]
            near = _differing(flat, start, width, a, b) <= n[a] + n[b] - 2 * _needed(n[a], n[b], least)
            a, b = a[near], b[near]
            if len(a):
                a, b = np.where(own[a] < own[b], a, b), np.where(own[a] < own[b], b, a)
                yield [own[a], own[b], component[a], component[b]]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                count += batch.nbytes
                if count < ROWS * 64:
                    continue
            if not held:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = [table.column(x).to_numpy() for x in ("key", "low", "high")]
            new = np.ones(table.num_rows, bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
            cut = table.num_rows if batch is None else int(np.flatnonzero(new)[-1]) if len(new) else 0
            held = table.slice(cut).to_batches()
            count = 0  # a list that goes on is looked at again after as many bytes
            pairs = found(table.slice(0, cut), np.cumsum(new[:cut])) if cut else []
            for part in _gathered(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], ["a", "b", "ca", "cb"])

    return dealt.mapInArrow(each, "a bigint, b bigint, ca bigint, cb bigint")


def _gathered(parts: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """The same rows in parts of about ROWS."""
    held, count = [], 0
    for part in chain(parts, [None]):
        if part is not None:
            held.append(part)
            count += len(part[0])
        if held and (part is None or count >= ROWS):
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, count = [], 0


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose whole sets are similar."""
    needed = pairs.select(F.col("a").alias("needed")).union(pairs.select("b")).distinct()
    held = stored(sets.select("own", "hashes").join(needed, F.col("own") == F.col("needed"), "left_semi").dropDuplicates(["own"]), "simhash-needed")
    both = pairs.join(held.toDF("_a", "x"), F.col("a") == F.col("_a")).join(held.toDF("_b", "y"), F.col("b") == F.col("_b")).select("ca", "cb", "x", "y")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("x"), batch.column("y"), strict=True)
            keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), least) for x, y in sides]
            yield batch.select(["ca", "cb"]).filter(pa.array(keep, pa.bool_())).rename_columns(["a", "b"])

    found = stored(both.mapInArrow(each, "a bigint, b bigint").distinct(), "simhash-rest")
    drop_stored(held)
    return found


def links_across(sets: DataFrame, classes: DataFrame, key: str, least: float) -> DataFrame:
    """Edges (a, b) between the components of all sets of a Jaccard similarity of ``least`` or more.

    ``sets``: ``key`` (binary), own (a digest of the set), hashes (its ascending 64-bit
    hashes, bytes). ``classes``: each ``key`` once, with its component (long). Sets of one
    component are not compared. Repeated sets do no harm; empty ones link with nothing.
    """
    names = classes.select(F.col(key).alias("_key"), "component")
    firsts = _prefixes(sets, key, least).join(names, F.col(key) == F.col("_key")).dropDuplicates(["own", "component"])
    postings = firsts.select("component", "own", "n", F.posexplode("firsts").alias("place", "key"))
    members = stored(_members(postings.select("key", "component", "own", "n", F.col("place").cast("bigint").alias("place")), least), "simhash-members")
    told = stored(_told(members, sets), "simhash-told")
    drop_stored(members)
    columns = ["component", "own", "n", "place", "known", *(f"b{k}" for k in range(BEFORE)), "bits"]
    zero = [F.lit(0).cast("bigint").alias(x) for x in ("low", "high", "block")]
    dealt = told.where("not long").select("key", *zero, *columns)
    if not told.where("long").isEmpty():
        long = deal_across(told.where("long"), "own", columns, LIST)
        dealt = dealt.union(long.select("key", *(F.col(x).cast("bigint") for x in ("low", "high", "block")), *columns))
    met = stored(_met(dealt, least).distinct(), "simhash-met")
    drop_stored(told)
    found = _verified(met, sets, least)
    drop_stored(met)
    return found
