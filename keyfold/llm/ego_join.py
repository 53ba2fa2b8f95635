"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors link at cosine c exactly if they are at most epsilon = sqrt(2 - 2c) apart.
They are rotated to principal axes and sorted by the grid cells (edge epsilon) of the
leading ones. The sorted sequence is cut at cell borders into blocks; blocks make up
partitions, and partitions larger intervals: a tree of sequence intervals, each with the
bounding box of its leading coordinates and of the length they leave out. Starting from
the whole sequence joined with itself, interval pairs further apart than epsilon are
skipped and the others split, level by level as DataFrame joins, and inside a pair of
blocks by the same recursion in numpy down to leaves. What is left is compared in double
precision. The axes only decide what can be skipped.

Nothing can be skipped where the vectors spread alike in all directions and epsilon is
large against their spread along the leading axes; then all pairs are compared, and the
number of blocks, not their size, is fixed until a block has BLOCK_BYTES, so what moves
grows with the number of vectors.

Equal vectors are one entry with a count. A pair of blocks returns link counts and a
spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from keyfold.llm.common import ready, stored
from keyfold.llm.components import connected_components, label_forest

#: The sequence is cut into about BLOCKS blocks, of BLOCK_BYTES of vectors at most, and these into leaves of LEAF rows at most.
BLOCKS = 16
BLOCK_BYTES = 8 << 20
LEAST_BLOCK = 64
LEAF = 128
LEADING = 16
FANOUT_BITS = 5
SLACK = 1e-9


def _clean(df: DataFrame, id_column: str, vector_column: str, kind: str) -> DataFrame:
    """id, v: the vector's bytes as numbers of ``kind``, null for vectors that link with nothing."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("v"):
                y = None
                if x.is_valid and x.values.null_count == 0 and len(x.values):
                    y = x.values.to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)
                    y = y.tobytes() if np.isfinite(y).all() and y.any() else None
                out.append(y)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "v"])

    return df.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v")).mapInArrow(each, f"id {df.schema[id_column].dataType.simpleString()}, v binary")


def _unit_rows(data: bytes, dim: int, kind: str) -> np.ndarray:
    """The vectors at unit length, in double precision."""
    rows = np.frombuffer(data, kind).reshape(-1, dim).astype("<f8")
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return rows


def _units(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return _unit_rows(b"".join(column.to_pylist()), dim, kind)


def _axes(vectors: DataFrame, dim: int, kind: str) -> np.ndarray:
    """The leading principal axes of all unit vectors, from sums made on the executors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            x = _units(batch.column("v"), dim, kind)
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        if total[-1, -1]:
            i, j = np.divmod(np.arange((dim + 1) ** 2), dim + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "x"])

    # sums of single entries, which partial aggregation adds up: no task holds more than a matrix
    found = vectors.select("v").mapInArrow(partial, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    moments = np.zeros((dim + 1, dim + 1))
    for r in found:
        moments[r["i"], r["j"]] = r["x"]
    n = moments[-1, -1]
    mean = moments[-1, :-1] / n
    _, axes = np.linalg.eigh(moments[:-1, :-1] / n - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1][:, :LEADING])


def coordinates(units: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """What the distances of boxes are taken from: the leading coordinates, and the length of what they leave out.

    Points are at least as far apart as these: the rest of a vector is no longer than
    its length, and two rests differ by no less than their lengths do.
    """
    leading = units @ axes
    rest = np.sqrt(np.maximum(0.0, 1.0 - (leading * leading).sum(axis=1)))
    return np.concatenate([leading, rest[:, None]], axis=1)


def _border(cells: np.ndarray, low: int, high: int, aim: int) -> int:
    """A place of [low, high] to cut the sequence at: the coarsest cell border, of equal ones that next to ``aim``."""
    differ = cells[low : high + 1] != cells[low - 1 : high]
    column = np.where(differ.any(axis=1), differ.argmax(axis=1), cells.shape[1])
    at = low + np.flatnonzero(column == column.min())
    return int(at[np.abs(at - aim).argmin()])


def leaves(cells: np.ndarray, size: int) -> np.ndarray:
    """Bounds of the leaves of a sequence: halves of halves, cut at cell borders, until ``size`` rows are left."""
    out, todo = [0], [(0, len(cells))]
    while todo:
        a, b = todo.pop()
        if b - a <= size:
            out.append(b)
            continue
        middle, most = (a + b) // 2, max(1, (b - a) // 4)
        cut = _border(cells, max(a + 1, middle - most), min(b - 1, middle + most), middle)
        todo += [(cut, b), (a, cut)]
    return np.array(out)


def _cells(units: np.ndarray, axes: np.ndarray, epsilon: float) -> np.ndarray:
    return np.floor(units @ axes / epsilon).astype(np.int32)


def _blocks(vectors: DataFrame, dim: int, kind: str, axes: np.ndarray, epsilon: float) -> DataFrame:
    """Blocks of the sequence in epsilon grid order, cut at cell borders: block, n, ids, copies, data, lo, hi."""
    k = axes.shape[1]
    count = vectors.count()
    size = int(max(1, min(max(LEAST_BLOCK, -(-count // BLOCKS)), BLOCK_BYTES // (dim * np.dtype(kind).itemsize))))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _cells(_units(batch.column("v"), dim, kind), axes, epsilon)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copies"), batch.column("v"), *(pa.array(cells[:, j]) for j in range(k))], ["id", "copies", "v", *(f"c{j}" for j in range(k))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def block(rows: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal number
            data = b"".join(rows.column("v").to_pylist())
            box = coordinates(_unit_rows(data, dim, kind), axes)
            number += 1
            row = {"block": number - 1, "n": len(box), "ids": rows.column("id").to_numpy().tobytes(), "copies": rows.column("copies").to_numpy().tobytes(), "data": data, "lo": box.min(axis=0).tolist(), "hi": box.max(axis=0).tolist()}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("block", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("copies", pa.binary()), ("data", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))]))

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) <= size:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            while rows.num_rows > size:
                cells = np.stack([rows.column(3 + j).to_numpy()[: size + 1] for j in range(k)], axis=1)
                end = _border(cells, max(1, size // 2), size, size)
                yield block(rows.slice(0, end))
                rows = rows.slice(end)
            held = [rows]
        if held and sum(x.num_rows for x in held):
            yield block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    cells = vectors.mapInArrow(project, "id bigint, copies bigint, v binary, " + ", ".join(f"c{j} int" for j in range(k)))
    order = [f"c{j}" for j in range(k)] + ["id"]
    parts = max(1, -(-count // (4 * size)))
    sequence = cells.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return sequence.mapInArrow(cut, "block bigint, n int, ids binary, copies binary, data binary, lo array<double>, hi array<double>")


def _near(epsilon: float, dims: int):
    """The condition that two boxes are at most epsilon apart."""
    gap = lambda a, b, c, d: F.greatest(F.lit(0.0), c - b, a - d)
    parts = [gap(F.col("lo")[j], F.col("hi")[j], F.col("lo2")[j], F.col("hi2")[j]) for j in range(dims)]
    squares = [x * x for x in parts]
    return sum(squares[1:], squares[0]) <= F.lit((epsilon + SLACK) ** 2)


def _pairs(blocks: DataFrame, epsilon: float, dims: int) -> DataFrame:
    """The pairs of blocks (low, high) whose boxes are near: the tree of intervals, level by level."""
    boxes = stored(blocks.select(F.col("block").alias("node"), "lo", "hi"), "ego-boxes")
    box = [F.array(*(f(F.col(c)[j]) for j in range(dims))).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"))]
    levels, shift = [boxes], 32
    most = boxes.agg(F.max("node")).first()[0]
    if most is None:
        return blocks.sparkSession.createDataFrame([], "low long, high long")
    while True:
        levels.append(boxes.groupBy(F.shiftright("node", shift).alias("node")).agg(*box))
        if most >> shift == 0:
            break
        shift += FANOUT_BITS
    pairs = None
    shifts = [0, *range(32, shift + 1, FANOUT_BITS)]
    for level in reversed(range(len(levels))):
        up = shifts[level + 1] - shifts[level] if level + 1 < len(levels) else 63
        nodes = levels[level].select("node", "lo", "hi", F.shiftright("node", up).alias("up"))
        second = nodes.toDF("node2", "lo2", "hi2", "up2")
        if pairs is None:
            met = nodes.join(second, F.col("up") == F.col("up2"))
        else:
            met = pairs.join(nodes, F.col("low") == F.col("up")).join(second, F.col("high") == F.col("up2"))
        pairs = stored(met.where((F.col("node") <= F.col("node2")) & _near(epsilon, dims)).select(F.col("node").alias("low"), F.col("node2").alias("high")), "ego-pairs")
    return pairs


def join_intervals(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], epsilon: float, same: bool) -> Iterator[tuple[int, int]]:
    """Pairs of leaves of two sequences that may hold links, by recursive halving of intervals of leaves and the distance of their boxes (lo, hi)."""
    todo = [(0, len(x[0]), 0, len(y[0]))]
    while todo:
        a, b, c, d = todo.pop()
        if same and d <= a:
            continue
        gap = np.maximum(0, np.maximum(y[0][c:d].min(axis=0) - x[1][a:b].max(axis=0), x[0][a:b].min(axis=0) - y[1][c:d].max(axis=0)))
        if gap @ gap > (epsilon + SLACK) ** 2:
            continue
        if b - a == 1 and d - c == 1:
            yield a, c
            continue
        xs = [(a, b)] if b - a == 1 else [(a, (a + b) // 2), ((a + b) // 2, b)]
        ys = [(c, d)] if d - c == 1 else [(c, (c + d) // 2), ((c + d) // 2, d)]
        todo.extend((*p, *q) for p in xs for q in ys)


class Block:
    """A block as its task holds it: ids, copies, unit vectors, and the bounds and boxes of its leaves."""

    def __init__(self, row: dict, dim: int, kind: str, axes: np.ndarray, epsilon: float, leaf: int) -> None:
        self.ids, self.copies = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["copies"], "<i8")
        self.units = _unit_rows(row["data"], dim, kind)
        self.bounds = leaves(_cells(self.units, axes, epsilon), leaf)
        place = coordinates(self.units, axes)
        self.boxes = np.minimum.reduceat(place, self.bounds[:-1], axis=0), np.maximum.reduceat(place, self.bounds[:-1], axis=0)


def join_blocks(left: Block, right: Block, epsilon: float, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Link counts (id, n) and forest edges (id, id) of a pair of blocks, or of one with itself, and the leaf pairs compared; an entry counts as its copies."""
    same = left is right
    n = [np.zeros(len(left.ids), np.int64), np.zeros(len(right.ids), np.int64)]
    edges, compared = [np.zeros((0, 2), np.int64)], 0
    for i, j in join_intervals(left.boxes, right.boxes, epsilon, same):
        if same and j < i:
            continue
        compared += 1
        (a, b), (c, d) = left.bounds[i : i + 2], right.bounds[j : j + 2]
        linked = left.units[a:b] @ right.units[c:d].T >= threshold
        if same and i == j:
            np.fill_diagonal(linked, False)
        if not linked.any():
            continue
        n[0][a:b] += linked @ right.copies[c:d]
        if not (same and i == j):
            n[1][c:d] += linked.T @ left.copies[a:b]
        rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        own = np.concatenate([left.ids[a:b][rows], right.ids[c:d][columns]])
        adjacent = np.zeros((len(own), len(own)), bool)
        adjacent[: len(rows), len(rows) :] = linked[np.ix_(rows, columns)]
        adjacent |= adjacent.T
        label = label_forest(adjacent, len(own))
        moved = np.flatnonzero(label != np.arange(len(own)))
        edges.append(np.stack([own[moved], own[label[moved]]], axis=1))
    counts = [np.stack([left.ids, n[0] + n[1] if same else n[0]], axis=1)]
    if not same:
        counts.append(np.stack([right.ids, n[1]], axis=1))
    counts = np.concatenate(counts)
    return counts[counts[:, 1] > 0], np.concatenate(edges), compared


def _links(vectors: DataFrame, dim: int, kind: str, threshold: float) -> DataFrame:
    """a, b, n: a link count of a (b null) or a forest edge (n null) for vectors of one dimension.

    Of each pair of blocks one is the owner, in turn; an owner's task gets its block once
    and then its partners, one at a time.
    """
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    cell = max(epsilon, 1e-6)
    axes = _axes(vectors, dim, kind)
    blocks = stored(_blocks(vectors, dim, kind, axes, cell), "ego-blocks")
    pairs = _pairs(blocks, epsilon, axes.shape[1] + 1)
    turn = (F.col("low") + F.shiftright("low", 32) + F.col("high") + F.shiftright("high", 32)) % 2 == 0
    met = pairs.select(F.when(turn, F.col("low")).otherwise(F.col("high")).alias("owner"), F.when(turn, F.col("high")).otherwise(F.col("low")).alias("partner"))
    owners = met.select("owner").distinct().select("owner", F.col("owner").alias("partner"), F.lit(0).alias("turn"))
    wanted = owners.union(met.select("owner", "partner", F.lit(1)))
    own = blocks.select("block", "ids", "copies", "data")
    joined = wanted.join(own, F.col("partner") == F.col("block")).select("owner", "turn", "partner", "ids", "copies", "data")
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * BLOCKS)
    joined = joined.repartition(parts, "owner").sortWithinPartitions("owner", "turn", "partner")
    leaf = LEAF

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["turn"] == 0:
                    number, block = row["owner"], Block(row, dim, kind, axes, cell, leaf)
                    continue
                other = block if row["partner"] == number else Block(row, dim, kind, axes, cell, leaf)
                counts, edges, _ = join_blocks(block, other, epsilon, threshold)
                none = np.zeros(len(counts) + len(edges), bool)
                none[: len(counts)] = True
                flat = np.concatenate([counts, edges])
                if len(flat):
                    yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1], mask=none), pa.array(flat[:, 1], mask=~none)], ["a", "b", "n"])

    return joined.mapInArrow(each, "a bigint, b bigint, n bigint")


def near_duplicates(df: DataFrame, id_column: str, vector_column: str, threshold: float = 0.95) -> DataFrame:
    """Links vectors with a cosine of ``threshold`` or more, in double precision.

    Returns id, n_links (other rows linked directly), component_id (least id reachable),
    kept (the id is that least id). A vector that is null, empty, zero, or holds a null
    or non-finite component links with nothing. Vectors of different dimensions do not
    link. A cosine of exactly ``threshold``, as computed from vectors at unit length,
    links. The id column is an integer; repeated ids count as rows and share a node. Rows
    with a null id have no links and a null component, and are not kept. An empty table
    gives no rows; other columns are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    spark = ready(df.sparkSession)
    kind = "<f4" if isinstance(df.schema[vector_column].dataType.elementType, FloatType) else "<f8"
    width = np.dtype(kind).itemsize
    rows = stored(_clean(df, id_column, vector_column, kind), "ego-rows")
    usable = rows.where("v is not null and id is not null")
    vectors = stored(usable.groupBy("v").agg(F.min("id").cast("bigint").alias("id"), F.count("*").alias("copies")), "ego-vectors")
    dims = sorted(r[0] // width for r in vectors.select(F.octet_length("v")).distinct().collect())
    found = [_links(vectors.where(F.octet_length("v") == width * d), d, kind, threshold) for d in dims]
    links = spark.createDataFrame([], "a long, b long, n long")
    for x in found:
        links = links.union(x) if len(found) > 1 else x
    links = stored(links, "ego-links")
    counts = links.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    components = connected_components(links.where("b is not null").select("a", "b"))
    classes = vectors.join(counts.withColumnRenamed("a", "_a"), F.col("id") == F.col("_a"), "left").join(components, F.col("id") == F.col("node"), "left")
    classes = stored(classes.select(F.col("v").alias("_v"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "ego-classes")
    out = rows.join(classes, (F.col("v") == F.col("_v")) & F.col("id").isNotNull(), "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", F.col("id").cast("bigint")).alias("component_id"))
    return out.select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
