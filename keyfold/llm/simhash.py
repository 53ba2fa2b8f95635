"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most four bits share at least four of their
eight bytes in place. A posting list of single positional bytes would hold one
fingerprint in 256, so lists are keyed by three positional bytes at once: the triples of
a Turan design of the eight positions, of which every four positions contain at least
one. Every pair that shares four bytes thus meets in a list. Within a list the shared
positional bytes of each pair are tallied, pairs with fewer than four are dropped, and
the rest are verified bit by bit.

Equal fingerprints are one entry. A list longer than LIST holds near copies: first its
members are held against a few leaders, and what that links is contracted. Only members in
different components are then compared: those of the largest component are dealt out in
blocks, the others in blocks that meet each of these and one another, each meeting a task
of its own, so no list has to fit in one task and a list of one group costs no pairs.

``keep_one`` serves similarities that 64 bits cannot tell apart: texts whose five-word
shingles have a Jaccard similarity of 0.8 differ in about 15 of 100 bits. Its
fingerprints have WIDE_BYTES positional bytes more, indexed by LISTS triples of positions.
At that distance no number of shared bytes is guaranteed, so the triples are many enough
that about nine in ten pairs at 0.8 meet, and more above; what meets is verified on all
bits. That joins most of what is near. The pairs it leaves out, as they share no triple,
settle elsewhere in a list or have fingerprints beyond the limit, come from the exact way of
``prefix_lists``, which compares the shingles of texts in different components.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from keyfold.llm.common import drop_stored, fresh, ready, stored, text_slices, utf8
from keyfold.llm.components import connected_components, deal_across, label_forest
from keyfold.llm.prefix_lists import links_across

SEED = 42
POSITIONS = 8
LIST = 1_024
SHORT = 24
LEADERS = 4
#: The wide fingerprint: positional bytes of the index, lists of each fingerprint, further bits that screen what meets in a list.
WIDE_BYTES, LISTS, SCREEN_BITS, MOST_SCREENED = 96, 160, 64, 20
PLANES = (WIDE_BYTES * 8 + SCREEN_BITS) // 64
#: Standard errors by which the limit of wide fingerprints lies beyond the least similarity.
LENIENCE = 1.3
CHUNK = 2_048
#: Pairs of wide fingerprints compared at once, and postings handed on at once.
PAIRS, ROWS = 1 << 13, 1 << 16
WIDE = "_wide"
#: Texts are split into words a piece of about this many bytes at a time.
PIECE = 1 << 18
#: Sets that a task remembers, so as to write each once.
MOST_SEEN = 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def turan_triples(n: int = POSITIONS) -> list[tuple[int, int, int]]:
    """Triples of n positions such that any four positions contain one.

    Positions are dealt to three classes in a ring; a triple counts if it lies within a
    class, or has two positions in a class and one in the next.
    """
    out = []
    for t in combinations(range(n), 3):
        classes = [x % 3 for x in t]
        if len(set(classes)) == 1:
            out.append(t)
        elif len(set(classes)) == 2:
            pair = next(c for c in classes if classes.count(c) == 2)
            single = next(c for c in classes if classes.count(c) == 1)
            if single == (pair + 1) % 3:
                out.append(t)
    return out


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """The hashes of a text's word shingles in order, repeats included, a bounded number at a time."""
    digest, held, found, i = xxhash.xxh64_intdigest, [], False, 0
    while i < len(text):
        space = _SPACE.search(text, i + PIECE)
        j = space.start() if space else len(text)
        words = held + text[i:j].translate(_ASCII_LOWER).split()
        i, held = j, words
        if len(words) >= width:
            joined = b" ".join(words)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            bounds = zip((ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
            yield np.array([digest(joined[a:b], SEED) for a, b in bounds], np.uint64)
            held, found = words[len(words) - width + 1 :], True
    if held and not found:
        yield np.array([digest(b" ".join(held), SEED)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many rows have each bit of the row's bytes, the highest bit of a byte first."""
    ones = np.zeros(hashes.shape[1] * 64, np.int64)
    for i in range(0, len(hashes), 4_080):
        bits = np.unpackbits(hashes[i : i + 4_080].view(np.uint8), axis=1).view(np.uint64)  # a byte a bit, added eight at a time
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    return ones


def fingerprint(text: bytes, width: int) -> int:
    """The SimHash of a text: majority of each bit over the hashes of its word shingles."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width):
        ones += bit_counts(hashes.astype(">u8")[:, None])
        n += len(hashes)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big") if n else 0


def fingerprints(df: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """id, fp (the fingerprint as a signed long) of every whole text; null and empty texts have 0."""
    ready(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                out = np.array([fingerprint(t, width) for t in utf8(batch.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out.view(np.int64))], ["id", "fp"])

    return df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(each, f"id {kind}, fp bigint")


def _linked(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which fingerprints link: tally the shared positional bytes, keep those with enough, verify."""
    x = a ^ b
    t = x | x >> np.uint64(4)
    t |= t >> np.uint64(2)
    t |= t >> np.uint64(1)
    differing = np.bitwise_count(t & np.uint64(0x0101010101010101))
    out = differing <= min(bits, POSITIONS)
    out[out] = np.bitwise_count(x[out]) <= bits
    return out


def _forest(fps: np.ndarray, nodes: np.ndarray, bits: int) -> np.ndarray:
    """Edges (node, least node) that join what is linked among the points of one list."""
    order = np.argsort(nodes, kind="stable")
    fps, nodes = fps[order], nodes[order]
    adjacent = np.empty((len(fps), len(fps)), bool)
    for i in range(0, len(fps), 256):
        adjacent[i : i + 256] = _linked(fps[i : i + 256, None], fps[None, :], bits)
    label = label_forest(adjacent, len(fps))
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return np.stack([nodes[moved], nodes[label[moved]]], axis=1)


def links(distinct: DataFrame, bits: int, list_size: int = LIST) -> DataFrame:
    """Edges (a, b) between representatives of ``distinct`` (fp, node) that join all that link.

    The edges have the same components as the full link relation; within a list only a
    spanning forest is returned, never all pairs. A list over ``list_size`` is compared
    across components only.
    """
    if not 0 <= bits <= 4:
        raise ValueError("bits must be 0 to 4: more may leave fewer than four bytes in common")
    ready(distinct.sparkSession)
    byte = lambda k: F.shiftrightunsigned("fp", 8 * (POSITIONS - 1 - k)).bitwiseAND(F.lit(255))
    keys = [byte(a) * 65536 + byte(b) * 256 + byte(c) + F.lit(i << 24) for i, (a, b, c) in enumerate(turan_triples())]
    postings = distinct.select("fp", "node", F.explode(F.array(*keys)).alias("key"))
    lists = stored(postings.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select(F.col("key").alias("list"), "size"), "simhash-lists")
    met = postings.join(lists, F.col("key") == F.col("list"))
    short = met.where(F.col("size") <= list_size).select("key", F.lit(0).alias("low"), F.lit(0).alias("high"), "fp", "node")
    if lists.where(F.col("size") > list_size).isEmpty():
        return _compared(short, bits)
    long = stored(met.where(F.col("size") > list_size).select("key", "fp", "node"), "simhash-long")
    # the leaders of a list are the least by hash of the members, found by partial aggregates
    leaders = long.select("key", F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.xxhash64("key", "fp", F.lit(s)).alias("h")) for s in range(LEADERS)))).alias("x"), "fp", "node")
    leaders = leaders.groupBy("key", "x.s").agg(F.min(F.struct("x.h", "fp", "node")).alias("lead")).groupBy(F.col("key").alias("_key")).agg(F.collect_list("lead").alias("leads"))
    near = long.join(leaders, F.col("key") == F.col("_key")).select("fp", "node", F.explode("leads").alias("lead"))
    near = near.where((F.bit_count(F.col("fp").bitwiseXOR(F.col("lead.fp"))) <= bits) & (F.col("node") != F.col("lead.node")))
    stars = stored(near.select(F.col("node").alias("a"), F.col("lead.node").alias("b")).distinct(), "simhash-stars")
    labels = stored(connected_components(stars), "simhash-labels")
    named = long.join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("key", "fp", "node", F.coalesce("component", "node").alias("component"))
    dealt = deal_across(named, "fp", ["fp", "node"], list_size).drop("block")
    return _compared(short.union(dealt), bits).union(stars)


def _compared(dealt: DataFrame, bits: int) -> DataFrame:
    """Edges (a, b) that join what is linked among the rows (fp, node) of each (key, low, high)."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Whole runs of equal lists: a group number, fingerprints and nodes of each part of the stream."""
        held = None
        for batch in batches:
            part = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part, strict=True)]
            new = np.flatnonzero((np.diff(part[0]) != 0) | (np.diff(part[1]) != 0) | (np.diff(part[2]) != 0)) + 1
            cut = new[-1] if len(new) else 0
            if cut:
                yield np.concatenate(([0], new)), part[3][:cut].view(np.uint64), part[4][:cut]
            held = [x[cut:] for x in part]
        if held is not None and len(held[0]):
            yield np.array([0, len(held[0])]), held[3].view(np.uint64), held[4]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bounds, fps, nodes in runs(batches):
            sizes = np.diff(bounds)
            group = np.repeat(np.arange(len(sizes)), sizes)
            short = np.flatnonzero(np.repeat(sizes <= SHORT, sizes))
            found = []
            g, f, v = group[short], fps[short], nodes[short]
            for d in range(1, SHORT):
                i = np.flatnonzero(g[d:] == g[:-d]) if len(g) > d else short[:0]
                if not len(i):
                    break
                i = i[_linked(f[i], f[i + d], bits)]
                found.append(np.stack([v[i], v[i + d]], axis=1))
            for k in np.flatnonzero(sizes > SHORT).tolist():
                found.append(_forest(fps[bounds[k] : bounds[k + 1]], nodes[bounds[k] : bounds[k + 1]], bits))
            if found and len(e := np.concatenate(found)):
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return dealt.mapInArrow(each, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_column: str, text_column: str, width: int = 5, bits: int = 3) -> DataFrame:
    """id, fp (signed long), component_id: the least id reachable over links of ``bits`` or fewer differing bits.

    The id column is an integer. Null and empty texts have fingerprint 0 and link like any
    other. Rows with a null id get their fingerprint and the least id of their
    component, null if it has none. Repeated ids give a row each. Other columns are not
    read; an empty table gives no rows.
    """
    rows = stored(fingerprints(df, id_column, text_column, width), "simhash-rows")
    distinct = stored(rows.groupBy("fp").agg(F.min("id").cast("bigint").alias("least")), "simhash-distinct")
    # nodes are least ids; an id may lead several fingerprints if it is repeated, which then share the node only if linked
    unique = distinct.groupBy("least").count().where("count > 1 or least is null").limit(1).count() == 0
    if unique:
        nodes = distinct.select("fp", F.col("least").alias("node"))
        names = None
    else:
        nodes = distinct.select("fp", F.col("fp").alias("node"))
        names = distinct.select(F.col("fp").alias("name"), "least")
    components = connected_components(links(nodes, bits))
    found = nodes.join(components.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("fp", F.coalesce("component", "node").alias("component"))
    if names is not None:
        named = found.join(names, F.col("fp") == F.col("name")).groupBy("component").agg(F.min("least").alias("least"))
        found = found.join(named.withColumnRenamed("component", "_component"), F.col("component") == F.col("_component")).select("fp", F.col("least").alias("component"))
    found = stored(found, "simhash-classes")
    out = rows.join(found.withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp")).select(F.col("id").alias(id_column), "fp", F.col("component").alias("component_id"))
    return out


# ---- wide fingerprints


_random = np.random.default_rng(1729)
_PLANE = _random.integers(1, 1 << 63, PLANES, np.uint64) * np.uint64(2) + np.uint64(1)
#: Triples of positions: permutations of all positions, each cut into disjoint triples.
_TRIPLES = np.concatenate([_random.permutation(WIDE_BYTES).reshape(-1, 3) for _ in range(-(-LISTS * 3 // WIDE_BYTES))])[:LISTS]


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The ascending hashes of a text's distinct shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width)]))


def wide_fingerprint(text: bytes, width: int) -> bytes:
    """The SimHash of a text's distinct shingles, with as many hashes of each as PLANES; zero without words."""
    return wide_of(shingle_set(text, width))


def wide_of(own: np.ndarray) -> bytes:
    """The wide fingerprint of a set of shingle hashes."""
    if not len(own):
        return bytes(PLANES * 8)
    ones = np.zeros(PLANES * 64, np.int64)
    for i in range(0, len(own), 1 << 14):
        x = own[i : i + (1 << 14), None] * _PLANE
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        ones += bit_counts(x)
    return np.packbits(ones * 2 > len(own)).tobytes()


def most_bits(least: float) -> int:
    """The differing bits up to which wide fingerprints link, for a Jaccard similarity of ``least``.

    Sets of that similarity have a cosine of about 2 * least / (1 + least), and a bit
    differs with the angle over pi; LENIENCE standard errors more, so that sampling
    error loses about one in ten pairs that are just similar enough.
    """
    n = PLANES * 64
    p = float(np.arccos(2 * least / (1 + least)) / np.pi)
    return int(n * p + LENIENCE * (n * p * (1 - p)) ** 0.5)


def _stars(key: np.ndarray, node: np.ndarray, near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(member, leader) positions of lists: ``key`` ascends, ``near`` tells which members are near their leaders.

    The member that hashes least leads; who is near it is settled, the others get the
    next leader. So each member has one pair at most, and leaders differ by list.
    """
    at = np.arange(len(key))
    while len(at):
        new = np.flatnonzero(np.diff(key[at], prepend=-1))
        sizes = np.diff(np.append(new, len(at)))
        at = at[np.repeat(sizes > 1, sizes)]
        if not len(at):
            return
        new = np.flatnonzero(np.diff(key[at], prepend=-1))
        sizes = np.diff(np.append(new, len(at)))
        rank = (node[at] ^ key[at] * 0x9E3779B1).astype(np.uint64) * _PLANE[0]
        rank ^= rank >> np.uint64(31)
        rank *= _PLANE[1]
        order = np.lexsort((rank, np.repeat(np.arange(len(new)), sizes)))
        lead = np.repeat(at[order[new]], sizes)
        hit = near(at, lead) | (at == lead)
        moved = hit & (at != lead)
        yield at[moved], lead[moved]
        at = at[~hit]


def _differing(wide: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bits in which rows ``a`` and ``b`` of the fingerprints differ, in blocks: lists name a row many times."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), PAIRS):
        out[i : i + PAIRS] = np.bitwise_count(wide[a[i : i + PAIRS]] ^ wide[b[i : i + PAIRS]]).sum(axis=1, dtype=np.int64)
    return out


def wide_links(nodes: DataFrame, limit: int) -> DataFrame:
    """Edges (a, b) between nodes of ``nodes`` (node long, WIDE) whose fingerprints differ in ``limit`` bits or fewer.

    Each task first settles the lists of its own CHUNKs, so that of a group of near
    copies mostly leaders are shuffled. What meets in a list after the shuffle is
    screened on SCREEN_BITS bits that are in the posting, and verified on the whole
    fingerprints in a join. All pairs within a list are never made.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            nodes_, wide = (np.concatenate(x) for x in zip(*held, strict=True))
            keys = np.arange(LISTS, dtype=np.int64) << 24
            for j, shift in enumerate((16, 8, 0)):
                keys = keys | wide.view(np.uint8)[:, _TRIPLES[:, j]].astype(np.int64) << shift
            order = np.argsort(keys.ravel(), kind="stable")
            key, owner = keys.ravel()[order], order // LISTS
            stays = np.ones(len(key), bool)
            edges = [np.zeros((0, 2), np.int64)]
            for member, lead in _stars(key, nodes_[owner], lambda a, b: _differing(wide, owner[a], owner[b]) <= limit):
                stays[member] = False
                edges.append(np.stack([nodes_[owner[member]], nodes_[owner[lead]]], axis=1))
            edges = np.unique(np.concatenate(edges), axis=0)
            key, owner = key[stays], owner[stays]
            screen = wide.view(np.int64)[:, -1]
            # a verified edge travels as a row with a negative key
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((key, -1 - (edges[:, 0] & 0xFFFF)), (nodes_[owner], edges[:, 0]), (screen[owner], edges[:, 1]))], ["key", "node", "screen"])
            yield from (out.slice(i, ROWS) for i in range(0, out.num_rows, ROWS))

        for batch in batches:
            wide = np.frombuffer(b"".join(batch.column("wide").to_pylist()), np.uint64).reshape(-1, PLANES)
            held.append((batch.column("node").to_numpy(), wide))
            count += len(wide)
            if count >= CHUNK:
                yield from rows()
                held, count = [], 0
        if held:
            yield from rows()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(a: np.ndarray, b: np.ndarray, sure: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), sure))], ["a", "b", "sure"])

        held = [np.zeros(0, np.int64)] * 3
        for batch in chain(batches, [None]):
            part = held
            if batch is not None:
                part = [np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate(held)]
            cut = len(part[0]) if batch is None else int(np.searchsorted(part[0], part[0][-1])) if len(part[0]) else 0
            key, node, screen = (x[:cut] for x in part)
            held = [x[cut:] for x in part]
            edges = int(np.searchsorted(key, 0))
            if edges:
                yield pairs(node[:edges], screen[:edges], True)
            key, node, screen = key[edges:], node[edges:], screen[edges:]
            for member, lead in _stars(key, node, lambda a, b: np.bitwise_count(screen[a] ^ screen[b]) <= MOST_SCREENED):  # noqa: B023
                yield pairs(node[member], node[lead], False)

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = nodes.select("node", F.col(WIDE).alias("wide")).mapInArrow(deal, "key bigint, node bigint, screen bigint")
    met = postings.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(meet, "a bigint, b bigint, sure boolean")
    met = stored(met.groupBy("a", "b").agg(F.max("sure").alias("sure")), "simhash-pairs")
    side = lambda name: nodes.select(F.col("node").alias(f"_{name}"), F.col(WIDE).alias(f"w{name}"))
    both = met.where("not sure").join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b")).select("a", "b", "wa", "wb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate([np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, PLANES) for k in ("wa", "wb")])
            own = np.arange(batch.num_rows)
            yield batch.select(["a", "b"]).filter(pa.array(_differing(both, own, own + batch.num_rows) <= limit))

    return met.where("sure").select("a", "b").union(both.mapInArrow(verify, "a bigint, b bigint"))


def keep_one(df: DataFrame, id_column: str, text_column: str, width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``df`` that remain if of each group of near duplicates exactly one row stays.

    Texts link if their distinct runs of ``width`` words have a Jaccard similarity of
    ``least`` or more; all such pairs do. Texts a little less similar link as well if their
    wide fingerprints are as near as at ``least`` (see ``most_bits``) and the index finds
    them. Groups are what links join. Texts without words, null and empty ones, are one group; a text of fewer than
    ``width`` words is one shingle. Of a group the row with the least id stays, a null id
    coming after all others, and among rows of one id the one whose row hashes least.
    Ids need not be distinct; all columns are kept, whatever their names; an empty table
    gives no rows. Texts are read whole.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    ready(df.sparkSession)
    names = df.columns
    nulls = F.concat(*(F.when(F.col(x).isNull(), "1").otherwise("0") for x in names))
    hashes = [F.xxhash64(F.lit(seed), nulls, *names) for seed in range(2)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in text_slices(whole, "text"):
                wide, owns, sets = [], [], []
                for text in utf8(batch.column("text")):
                    own = shingle_set(text, width)
                    wide.append(wide_of(own))
                    held = own.tobytes()
                    digest = xxhash.xxh64_intdigest(held, SEED) - (1 << 63)
                    owns.append(digest)
                    sets.append(None if digest in seen or not held else held)
                    if len(seen) < MOST_SEEN:
                        seen.add(digest)
                new = [pa.array(wide, pa.binary()), pa.array(owns, pa.int64()), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays([*new, *(batch.column(k) for k in ("id", "h0", "h1"))], [WIDE, "own", "hashes", "id", "h0", "h1"])

    source = df.select(F.col(text_column).alias("text"), F.col(id_column).alias("id"), hashes[0].alias("h0"), hashes[1].alias("h1"))
    schema = StructType().add(WIDE, BinaryType()).add("own", LongType()).add("hashes", BinaryType()).add("id", df.schema[id_column].dataType).add("h0", LongType()).add("h1", LongType())
    rows = stored(source.mapInArrow(mark, schema), "simhash-rows", group_bytes=16 << 20)
    nodes = stored(rows.select(WIDE).distinct().withColumn("node", F.monotonically_increasing_id()), "simhash-nodes")
    links = stored(wide_links(nodes, most_bits(least)), "simhash-links")
    found = connected_components(links)
    near = stored(nodes.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(WIDE, F.coalesce("component", "node").alias("component")), "simhash-near")
    rest = links_across(rows.where("hashes is not null").select(WIDE, "own", "hashes"), near, WIDE, least)
    joined = connected_components(rest).select("node", F.col("component").alias("_component"))
    classes = near.join(joined, F.col("component") == F.col("node"), "left").select(F.col(WIDE).alias("_w"), F.coalesce("_component", "component").alias("group"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h0", "h1")
    equal = rows.join(classes, F.col(WIDE) == F.col("_w")).groupBy("group", "id", "h0", "h1").agg(F.count("*").alias("n"))
    least_row = equal.groupBy("group").agg(F.min(F.struct(order.alias("order"), "n")).alias("least"))
    own = [fresh(x, names) for x in ("_h0", "_h1", "_k0", "_k1", "_kn")]
    kept = stored(least_row.select("least.order.h0", "least.order.h1", "least.n").toDF(*own[2:]), "simhash-kept")
    for old in (rows, nodes, links, near, rest):
        drop_stored(old)
    # rows that are equal in all columns have one place in the order, and one of them stays; only such rows are shuffled for that
    marked = df.withColumns(dict(zip(own[:2], hashes, strict=True)))
    chosen = lambda which: marked.join(kept.where(which), (F.col(own[0]) == F.col(own[2])) & (F.col(own[1]) == F.col(own[3])), "left_semi")
    return chosen(F.col(own[4]) == 1).select(*names).union(chosen(F.col(own[4]) > 1).dropDuplicates(own[:2]).select(*names))
