"""What the operators of this subpackage share: scratch tables, batch iteration and model storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROOT = str(Path(__file__).resolve().parents[2])
#: The most bytes of labelled texts that the driver takes to fit a model on.
SAMPLE_BYTES = 96 << 20
#: Arrow batches are bounded by bytes as well as by rows, so that long texts make smaller batches.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Environment of the Python workers: large arrays go back to the system when they are freed, as a worker outlives its task.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from the place the driver has it in, and give memory back.

    Bounds the bytes of an Arrow batch, and has Spark delete the shuffle files of a query
    when it ends, where the session has no setting of its own.
    """
    for name, value in ((BATCH_LIMIT, str(BATCH_BYTES)), (SHUFFLE_CLEANUP, "true")):
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a session on one machine gets a temporary folder; a
    cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="keyfold-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_folder(spark)}/keyfold-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, codec: str = "snappy", group_bytes: int = 128 << 20) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later stages start from the files; a task holds ``group_bytes`` while it writes."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", codec).option("parquet.block.size", str(group_bytes)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`stored` wrote; only for tables nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/keyfold-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes every scratch table of this application; results that still read them become unreadable."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/keyfold-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that is not among ``taken``, in any case."""
    known = {x.lower() for x in taken}
    while name.lower() in known:
        name += "_"
    return name


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies ``function`` to each Arrow batch; it keeps nothing between batches."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return df.mapInArrow(each, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The texts of a string column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def text_slices(batch: pa.RecordBatch, text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Splits a batch where its texts pass ``most`` bytes, so Python holds few texts at once; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size + 64
    if start < batch.num_rows:
        yield batch.slice(start)


def fold(id_column: str, parts: int):
    """crc32 of the id as text modulo ``parts``: the folds that the query contracts fix."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % F.lit(parts)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(df: DataFrame, id_column: str, text_column: str, labels: DataFrame, label: str, allowed, per_class: int, most_bytes: int = SAMPLE_BYTES) -> list[tuple[bytes, int, float]]:
    """About ``per_class`` whole labelled texts of each class, chosen by a hash of the id: (UTF-8, label, weight).

    The weight is how many labelled rows of its class a row stands for. Rows with a null
    label or id, and rows that the condition ``allowed`` on the id excludes, are not
    used. Of rows with one id one counts, the one whose text hashes least. The chosen
    labels are at most a few times ``per_class`` rows, so they are broadcast; first only
    the sizes of their texts come to the driver, then whole texts, in the order of the
    hash, as far as ``most_bytes`` go.
    """
    rows = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label")).where(allowed(F.col("id")) & F.col("id").isNotNull() & F.col("label").isin(0, 1)).distinct()
    counts = dict(rows.groupBy("label").count().collect())
    share = {c: min(1.0, per_class / n) for c, n in counts.items()}
    chance = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 24)) / float(1 << 24)
    chosen = rows.where(chance < F.when(F.col("label") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)))
    source = df.select(F.col(id_column).alias("id"), F.encode(F.coalesce(F.col(text_column), F.lit("")), "utf-8").alias("text"))
    own = F.struct(F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"))
    sizes = source.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min(own).alias("own")).select("id", "label", "own.hash", "own.size", F.xxhash64(F.lit("order"), "id").alias("rank"))
    picked, held = [], 0
    for r in sorted(sizes.collect(), key=lambda r: (r["rank"], r["id"], r["label"])):
        if held + r["size"] <= most_bytes:
            picked.append(r)
            held += r["size"]
    if not picked:
        return []
    wanted = df.sparkSession.createDataFrame([(r["id"], r["label"], r["hash"]) for r in picked], StructType([chosen.schema["id"], chosen.schema["label"]]).add("hash", "long"))
    found = source.withColumn("hash", F.xxhash64("text")).join(F.broadcast(wanted), ["id", "hash"]).select("id", "label", "text").dropDuplicates(["id", "label"]).collect()
    found.sort(key=lambda r: (r["id"], r["label"]))
    return [(bytes(r["text"]), r["label"], 1.0 / share[r["label"]]) for r in found]
