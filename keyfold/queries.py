"""The registered queries of the key-value engine and their SQL.

The changelog comes from ``events``: event_id is the sequence, errors are deletes. The
queries marked table write it through a table in the shared folder and read it back.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions.keys import fixed_width_key, in_range, text_key
from keyfold.functions.stats import nearest_rank
from keyfold.operators.table import KVTable
from keyfold.plans import resolve
from keyfold.sources.oplog import OVERHEAD
from keyfold.streaming.sink import table_sink

LAYERS = 4
#: Commits that do not set off a compaction yet.
FEW = 3


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, seq, op, value of the events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    deleted = F.col("event_type") == "error"
    key = F.encode(F.format_string("u%05d/%03d", "user_id", F.col("event_id") % 37), "utf-8")
    value = F.encode(F.format_string("%s:%d", "event_type", F.round(F.col("value") * 100).cast("bigint")), "utf-8")
    return events.select(key.alias("key"), F.col("event_id").alias("seq"), F.when(deleted, "D").otherwise("P").alias("op"), F.when(~deleted, value).alias("value"))


def shown(df: DataFrame) -> DataFrame:
    """Binary columns as text."""
    return df.select(*(F.decode(c, "utf-8").alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes))


def _ranged(low: bytes | None, high: bytes | None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        changes = changelog(spark, sf_dir)
        if low is not None and high is not None and low >= high:
            changes = changes.where("false")
        return shown(resolve.live(changes.where(in_range(F.col("key"), low, high))).orderBy("key"))

    return query


def _get(key: bytes):
    return lambda spark, sf_dir: shown(resolve.live(changelog(spark, sf_dir).where(F.col("key") == F.lit(key))))


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    return users.select(F.encode(F.format_string("u%05d/%03d", "user_id", F.col("user_id") % 40), "utf-8").alias("key"))


def kv_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resolve.multi_get(resolve.live(changelog(spark, sf_dir)), _wanted(spark, sf_dir)))


def kv_multi_get_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resolve.multi_get_misses(resolve.live(changelog(spark, sf_dir)), _wanted(spark, sf_dir)))


def kv_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.live_count(changelog(spark, sf_dir))


def kv_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resolve.tombstones(changelog(spark, sf_dir)))


def kv_compact_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resolve.newest(changelog(spark, sf_dir)))


def kv_compact_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resolve.without_deletes(resolve.newest(changelog(spark, sf_dir))))


def _layer(changes: DataFrame, layers: int = LAYERS):
    """The layer of a row: contiguous spans of the sequence."""
    last = changes.agg(F.max("seq")).first()[0] or 0
    return (F.col("seq") * layers / F.lit(last + 1)).cast("int")


def kv_layered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = changelog(spark, sf_dir)
    layer = _layer(changes)
    layers = [resolve.newest(changes.where(layer == k)) for k in range(LAYERS)]
    together = layers[0]
    for x in layers[1:]:
        together = together.unionByName(x)
    return shown(resolve.live(together))


def kv_layer_of_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = changelog(spark, sf_dir)
    return shown(resolve.newest(changes).select("key", _layer(changes).alias("layer"), "op"))


def _cut(changes: DataFrame) -> int:
    """The sequence that seven tenths of the sequence span lie below."""
    return -(-7 * (changes.agg(F.max("seq")).first()[0] or 0) // 10)


def kv_prefix_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = changelog(spark, sf_dir)
    return shown(resolve.prefix_state(changes, _cut(changes)))


def kv_replay_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = changelog(spark, sf_dir)
    return shown(resolve.live(changes.unionByName(changes.where(F.col("seq") < _cut(changes)))))


def kv_overwrite_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = changelog(spark, sf_dir).groupBy("key").agg(F.count("*").alias("mutations"), F.max(F.struct("seq", "op")).alias("w"))
    return shown(counts.where("w.op = 'P'").select("key", "mutations"))


def kv_layer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = changelog(spark, sf_dir)
    return shown(resolve.layer_stats(changes, _layer(changes)))


def kv_range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = changelog(spark, sf_dir)
    a = resolve.layer_stats(changes, _layer(changes)).select("layer", "first_key", "last_key")
    b = a.toDF("other", "first2", "last2")
    return a.join(b, (F.col("layer") < F.col("other")) & (F.col("first_key") <= F.col("last2")) & (F.col("first2") <= F.col("last_key"))).select("layer", "other")


def _total(column) -> Column:
    """The sum of a column, 0 without rows."""
    return F.coalesce(F.sum(column), F.lit(0).cast("bigint"))


def kv_io_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return changelog(spark, sf_dir).agg(_total(size).alias("logical"), _total(size + OVERHEAD).alias("wal"))


def kv_space_amp(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = changelog(spark, sf_dir)
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    held = resolve.live(changes).agg(_total(size).alias("live_bytes"))
    ratio = F.when(F.col("live_bytes") > 0, F.col("all_bytes") / F.col("live_bytes")).when(F.col("all_bytes") > 0, float("inf")).otherwise(float("nan"))
    return changes.agg(_total(size).alias("all_bytes")).join(held, F.lit(True)).select("all_bytes", "live_bytes", F.round(ratio, 6).alias("amplification"))


def kv_orders_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    value = text_key(F.concat_ws("|", "o_orderstatus", "o_orderpriority"))
    changes = orders.select(fixed_width_key("o", F.col("o_orderkey")).alias("key"), F.col("o_orderkey").alias("seq"), F.lit("P").alias("op"), value.alias("value"))
    return shown(resolve.live(changes).orderBy("key"))


def kv_customer_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    changes = customers.select(fixed_width_key("c", F.col("c_custkey")).alias("key"), F.col("c_custkey").alias("seq"), F.lit("P").alias("op"), text_key(F.col("c_name")).alias("value"))
    return shown(resolve.live(changes.where(F.col("key") == F.lit(b"c0000000000042"))))


def kv_latency_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null")
    return events.groupBy("event_type").agg(*(nearest_rank("value", p).alias(f"p{name}") for p, name in ((0.5, "50"), (0.99, "99"), (0.999, "999"))))


def table_folder(spark: SparkSession) -> str:
    """A new folder for a table, in the shared folder; a session on one machine may have none and gets a temporary one."""
    base = urlparse(spark.conf.get("spark.checkpoint.dir", None) or "")
    root = base.path if base.scheme in ("", "file") else ""
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise RuntimeError("a table needs spark.checkpoint.dir on a file system that all machines mount")
        root = tempfile.gettempdir()
    return os.path.join(root, f"table-{uuid.uuid4().hex}")


def _folder(spark: SparkSession) -> str:
    folder = table_folder(spark)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _load(table: KVTable, changes: DataFrame, commits: int = LAYERS) -> list[int]:
    """Applies the changelog as so many commits, oldest first; the version after each."""
    layer, versions = _layer(changes, commits), []
    for k in range(commits):
        table.apply_all(changes.where(layer == k), order_by="seq")
        versions.append(table.version)
    return versions


def _written(read, compacted: bool = True):
    """Writes the changelog as commits through a table, compacts it, and returns what ``read`` makes of it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        with KVTable.open(spark, _folder(spark)) as table:
            _load(table, changelog(spark, sf_dir), LAYERS if compacted else FEW)
            if compacted:
                table.compact()
            return shown(read(table, spark, sf_dir))

    return query


def _key_value(low: bytes | None, high: bytes | None):
    return lambda table, spark, sf_dir: table.scan(low, high)


def _gets(table: KVTable, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, table.get(k)) for k in (b"u00001/003", b"u00002/004", b"u00001/099")]
    return spark.createDataFrame(rows, "key binary, value binary")


def kv_table_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after half of the commits, read by its version after the others and a compaction."""
    with KVTable.open(spark, _folder(spark)) as table:
        versions = _load(table, changelog(spark, sf_dir))
        table.compact()
        return shown(table.snapshot(versions[LAYERS // 2 - 1]).live())


def kv_table_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single mutations that only the log holds when the table is closed; the state after it is opened again."""
    folder = _folder(spark)
    with KVTable.open(spark, folder, flush_threshold=1 << 40, fsync=False) as table:
        table.log_all(changelog(spark, sf_dir), order_by="seq")
    with KVTable.open(spark, folder) as table:
        return shown(table.live())


def kv_table_flush_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crash after a flush was committed and before its log was emptied: the log is replayed over the run."""
    folder = _folder(spark)
    log = os.path.join(folder, "wal")
    with KVTable.open(spark, folder, flush_threshold=1 << 40, fsync=False) as table:
        table.log_all(changelog(spark, sf_dir), order_by="seq")
        shutil.copytree(log, log + ".kept", copy_function=os.link, dirs_exist_ok=True)
        table.flush()
    shutil.copytree(log + ".kept", log, copy_function=os.link, dirs_exist_ok=True)
    with KVTable.open(spark, folder) as table:
        return shown(table.live())


def kv_table_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changelog as micro-batches of a stream; the last two are sent again, as after a restart."""
    changes = changelog(spark, sf_dir)
    layer = _layer(changes)
    with KVTable.open(spark, _folder(spark)) as table:
        sink = table_sink(table, "events", "seq")
        for k in [*range(LAYERS), LAYERS - 2, LAYERS - 1]:
            sink(changes.where(layer == k), k)
        return shown(table.live())


def kv_table_delete_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    with KVTable.open(spark, _folder(spark)) as table:
        _load(table, changelog(spark, sf_dir))
        table.delete_all(_wanted(spark, sf_dir))
        table.compact()
        return shown(table.live())


def kv_table_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crash after a compaction wrote its run and before it was committed: the old state, without the orphan."""
    folder, copy = _folder(spark), _folder(spark)
    with KVTable.open(spark, folder) as table:
        _load(table, changelog(spark, sf_dir), FEW)
        shutil.copytree(folder, copy)
        table.compact()
    shutil.copytree(os.path.join(folder, "runs"), os.path.join(copy, "runs"), dirs_exist_ok=True)
    with KVTable.open(spark, copy) as table:
        return shown(table.live())


QUERIES = {
    "kv_live_scan": _ranged(None, None),
    "kv_range_scan": _ranged(b"u00003", b"u00009/010"),
    "kv_range_scan_open_from": _ranged(None, b"u00004"),
    "kv_range_scan_open_to": _ranged(b"u00010/005", None),
    "kv_range_scan_reversed": _ranged(b"u00009", b"u00003"),
    "kv_get_hit": _get(b"u00001/003"),
    "kv_get_deleted": _get(b"u00002/004"),
    "kv_get_miss": _get(b"u00001/099"),
    **{q.__name__: q for q in (kv_multi_get, kv_multi_get_misses, kv_size, kv_tombstones, kv_compact_keep, kv_compact_drop, kv_layered_scan, kv_layer_of_winner, kv_prefix_state, kv_replay_idempotent, kv_overwrite_counts, kv_layer_stats, kv_range_overlap, kv_io_bytes, kv_space_amp, kv_orders_scan, kv_customer_get, kv_latency_pct)},
    "kv_table_scan": _written(_key_value(None, None)),
    "kv_table_range": _written(_key_value(b"u00003", b"u00009/010")),
    "kv_table_size": _written(lambda t, *_: t.live().agg(F.count("*").alias("n"))),
    "kv_table_size_uncompacted": _written(lambda t, spark, _: spark.createDataFrame([(t.size(),)], "n long"), compacted=False),
    "kv_table_scan_uncompacted": _written(_key_value(None, None), compacted=False),
    "kv_table_get": _written(_gets),
    "kv_table_get_uncompacted": _written(_gets, compacted=False),
    "kv_table_multi_get": _written(lambda t, spark, sf_dir: t.multi_get(_wanted(spark, sf_dir))),
    "kv_table_multi_get_misses": _written(lambda t, spark, sf_dir: t.multi_get_misses(_wanted(spark, sf_dir)), compacted=False),
    "kv_table_prefix": _written(lambda t, *_: t.prefix_scan("u00003/")),
    "kv_table_range_reversed": _written(_key_value(b"u00009", b"u00003"), compacted=False),
    "kv_table_entries": _written(lambda t, *_: t.describe().agg(_total("entries").alias("entries"), _total("tombstones").alias("tombstones"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))),
    "kv_table_tombstones": _written(lambda t, *_: resolve.tombstones(t._view().changes()[0]).select("key"), compacted=False),
    **{q.__name__: q for q in (kv_table_snapshot, kv_table_log_replay, kv_table_flush_crash, kv_table_stream, kv_table_delete_all, kv_table_orphans)},
}

_L = """WITH l AS (
  SELECT printf('u%05d/%03d', user_id, event_id % 37) AS key, event_id AS seq,
    CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END AS op,
    CASE WHEN event_type <> 'error' THEN printf('%s:%d', event_type, cast(round(value * 100) AS bigint)) END AS value
  FROM events
), w AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
live AS (SELECT key, value FROM w WHERE op = 'P'),
k AS (SELECT DISTINCT printf('u%05d/%03d', user_id, user_id % 40) AS key FROM events),
y AS (SELECT *, cast(floor(seq * 4.0 / ((SELECT max(event_id) FROM events) + 1)) AS int) AS layer FROM l),
s AS (SELECT layer, count(*) AS entries, count(*) FILTER (WHERE op = 'D') AS tombstones, min(key) AS first_key, max(key) AS last_key FROM y GROUP BY layer)
"""
_LIVE = _L + "SELECT key, value FROM live"
_GETS = _L + "SELECT g.key, live.value FROM (VALUES ('u00001/003'), ('u00002/004'), ('u00001/099')) AS g(key) LEFT JOIN live ON live.key = g.key"
_SIZES = "coalesce(sum(strlen(key) + coalesce(strlen(value), 0)), 0)"

SQL = {
    "kv_live_scan": _LIVE,
    "kv_range_scan": _LIVE + " WHERE key >= 'u00003' AND key < 'u00009/010'",
    "kv_range_scan_open_from": _LIVE + " WHERE key < 'u00004'",
    "kv_range_scan_open_to": _LIVE + " WHERE key >= 'u00010/005'",
    "kv_range_scan_reversed": _LIVE + " WHERE key >= 'u00009' AND key < 'u00003'",
    "kv_get_hit": _LIVE + " WHERE key = 'u00001/003'",
    "kv_get_deleted": _LIVE + " WHERE key = 'u00002/004'",
    "kv_get_miss": _LIVE + " WHERE key = 'u00001/099'",
    "kv_multi_get": _LIVE + " WHERE key IN (SELECT key FROM k)",
    "kv_multi_get_misses": _L + "SELECT key FROM k WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.key = k.key)",
    "kv_size": _L + "SELECT count(*) AS n FROM live",
    "kv_tombstones": _L + "SELECT key, seq FROM w WHERE op = 'D'",
    "kv_compact_keep": _L + "SELECT key, seq, op, value FROM w",
    "kv_compact_drop": _L + "SELECT key, seq, op, value FROM w WHERE op = 'P'",
    "kv_layered_scan": _LIVE,
    "kv_layer_of_winner": _L + "SELECT w.key, y.layer, w.op FROM w JOIN y ON y.seq = w.seq",
    "kv_prefix_state": _L + "SELECT key, value FROM l WHERE seq * 10 < 7 * (SELECT max(event_id) FROM events) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1 AND op = 'P'",
    "kv_replay_idempotent": _LIVE,
    "kv_overwrite_counts": _L + "SELECT key, count(*) AS mutations FROM l WHERE key IN (SELECT key FROM live) GROUP BY key",
    "kv_layer_stats": _L + "SELECT * FROM s",
    "kv_range_overlap": _L + "SELECT a.layer, b.layer AS other FROM s a JOIN s b ON a.layer < b.layer AND a.first_key <= b.last_key AND b.first_key <= a.last_key",
    "kv_io_bytes": _L + f"SELECT cast({_SIZES} AS bigint) AS logical, cast({_SIZES} + 17 * count(*) AS bigint) AS wal FROM l",
    "kv_space_amp": _L + f", b AS (SELECT {_SIZES} AS n FROM l), c AS (SELECT {_SIZES} AS n FROM live) SELECT cast(b.n AS bigint) AS all_bytes, cast(c.n AS bigint) AS live_bytes, round(b.n / c.n, 6) AS amplification FROM b, c",
    "kv_orders_scan": "SELECT printf('o%013d', o_orderkey) AS key, o_orderstatus || '|' || o_orderpriority AS value FROM orders",
    "kv_customer_get": "SELECT printf('c%013d', c_custkey) AS key, c_name AS value FROM customer WHERE c_custkey = 42",
    "kv_latency_pct": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99, quantile_disc(value, 0.999) AS p999 FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "kv_table_scan": _LIVE,
    "kv_table_range": _LIVE + " WHERE key >= 'u00003' AND key < 'u00009/010'",
    "kv_table_size": _L + "SELECT count(*) AS n FROM live",
    "kv_table_size_uncompacted": _L + "SELECT count(*) AS n FROM live",
    "kv_table_scan_uncompacted": _LIVE,
    "kv_table_get": _GETS,
    "kv_table_get_uncompacted": _GETS,
    "kv_table_multi_get": _LIVE + " WHERE key IN (SELECT key FROM k)",
    "kv_table_multi_get_misses": _L + "SELECT key FROM k WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.key = k.key)",
    "kv_table_prefix": _LIVE + " WHERE starts_with(key, 'u00003/')",
    "kv_table_range_reversed": _LIVE + " WHERE key >= 'u00009' AND key < 'u00003'",
    "kv_table_entries": _L + "SELECT count(*) AS entries, cast(0 AS bigint) AS tombstones, min(key) AS first_key, max(key) AS last_key FROM live",
    "kv_table_tombstones": _L + "SELECT key FROM w WHERE op = 'D'",
    "kv_table_snapshot": _L + "SELECT key, value FROM y WHERE layer < 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1 AND op = 'P'",
    "kv_table_log_replay": _LIVE,
    "kv_table_flush_crash": _LIVE,
    "kv_table_stream": _LIVE,
    "kv_table_delete_all": _LIVE + " WHERE key NOT IN (SELECT key FROM k)",
    "kv_table_orphans": _LIVE,
}
