"""Newest-wins resolution of changelogs: the plan behind every read and compaction.

A key's mutation with the greatest sequence wins; only then are deletes dropped. The
aggregate combines on the map side and shuffles on the key once; a range condition on the
key passes through it to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.plans.schema import DELETE, PUT


def newest(changes: DataFrame) -> DataFrame:
    """key, seq, op, value of each key's newest mutation, deletes included.

    Sequences of a key are distinct in a table; where they are not, the greatest
    (seq, op, value) wins, so the result does not depend on row order.
    """
    won = changes.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("w"))
    return won.select("key", "w.seq", "w.op", "w.value")


def without_deletes(winners: DataFrame) -> DataFrame:
    return winners.where(F.col("op") == PUT)


def live(changes: DataFrame) -> DataFrame:
    """key, value of the keys whose newest mutation is a put."""
    return without_deletes(newest(changes)).select("key", "value")


def live_count(changes: DataFrame) -> DataFrame:
    """n: the number of live keys; values are not read."""
    return changes.groupBy("key").agg(F.max(F.struct("seq", "op")).alias("w")).where("w.op = 'P'").agg(F.count("*").alias("n"))


def tombstones(changes: DataFrame) -> DataFrame:
    """key, seq of the keys whose newest mutation is a delete."""
    return newest(changes).where(F.col("op") == DELETE).select("key", "seq")


def prefix_state(changes: DataFrame, before: int) -> DataFrame:
    """The live table as of all mutations with a sequence below ``before``."""
    return live(changes.where(F.col("seq") < before))


def multi_get(state: DataFrame, keys: DataFrame) -> DataFrame:
    """The live rows of the given keys; Spark broadcasts the keys if they are few."""
    return state.join(keys.select("key").distinct(), "key", "left_semi")


def multi_get_misses(state: DataFrame, keys: DataFrame) -> DataFrame:
    """The given keys that are not live."""
    return keys.select("key").distinct().join(state, "key", "left_anti")


def layer_stats(changes: DataFrame, layer) -> DataFrame:
    """layer, entries, tombstones, first_key, last_key of each layer of a changelog."""
    return changes.groupBy(layer.alias("layer")).agg(F.count("*").alias("entries"), F.sum((F.col("op") == DELETE).cast("bigint")).alias("tombstones"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))
