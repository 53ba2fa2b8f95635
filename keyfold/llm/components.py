"""Connected components by alternating large-star and small-star steps.

Each step replaces a node's links by links to the least node in its neighbourhood.
Minima are taken with partial aggregation and written down before they are joined back,
so the join's two sides come from files and Spark can split a hot node's rows. Nothing
but two sums goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import drop_stored, stored

MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for the nodes of ``edges`` (a, b: long).

    Order, repeats and self-links of the edges do not matter; an edge with a null end is
    ignored. Nodes without a link to another node are not in the result.
    """
    links = edges.where("a is not null and b is not null and a != b")
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    before = _state(links)
    for _ in range(MOST_ROUNDS if before[0] else 0):
        both = links.union(links.select("b", "a"))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-least")
        # a node's larger neighbours now link to the least node around it; a > b in links, so these are the rows (b, a)
        large = links.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, F.col("u") == least["a"]).select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a != b").distinct(), "cc-large")
        least2 = stored(large.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
        joined = large.join(least2.withColumnRenamed("a", "u"), F.col("a") == F.col("u"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least2.select("a", F.col("m").alias("b")))
        small = stored(small.where("a != b").distinct(), "cc-small")
        after = _state(small)
        for old in (links, least, large, least2):
            drop_stored(old)
        links = small
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())


def deal_across(members: DataFrame, point: str, columns: list[str], size: int) -> DataFrame:
    """Deals lists (key, component, ``columns``) out to (key, low, high), each of two blocks of about ``size`` members.

    Members of different components meet in one of these at least. The largest component
    of a list is cut into blocks of its own, which meet no other block of it, so that a
    list of one component gives no rows. ``block`` is a member's own, by a hash of ``point``.
    """
    counts = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    mains = counts.groupBy(F.col("key").alias("_key")).agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("size")).where("m.n < size")
    blocks = lambda n: F.ceil(n / size).cast("int")
    mains = mains.select("_key", F.col("m.component").alias("_main"), blocks(F.col("m.n")).alias("_mains"), blocks(F.col("size") - F.col("m.n")).alias("_rests"))
    split = members.join(mains, F.col("key") == F.col("_key"))
    inside = F.col("component") == F.col("_main")
    own = F.pmod(F.xxhash64(point), F.when(inside, F.col("_mains")).otherwise(F.col("_rests"))).cast("int")
    split = split.select("key", *columns, inside.alias("_inside"), own.alias("_own"), "_mains", "_rests")
    among = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("_other")
    dealt = lambda rows, n, low, high, block: rows.select("key", *columns, "_own", among(n)).select("key", low.alias("low"), high.alias("high"), block.alias("block"), *columns)
    rest, own, other = split.where("not _inside"), F.col("_own"), F.col("_other")
    of_main = dealt(split.where("_inside"), "_rests", -1 - own, other, -1 - own)
    return of_main.union(dealt(rest, "_mains", -1 - other, own, own)).union(dealt(rest, "_rests", F.least("_own", "_other"), F.greatest("_own", "_other"), own))


def label_forest(adjacent, n: int):
    """Least index reachable from each of ``n`` points by a symmetric boolean matrix, in numpy."""
    import numpy as np

    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(adjacent, label[None, :], n).min(axis=1, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new
