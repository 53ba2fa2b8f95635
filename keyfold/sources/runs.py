"""Runs: immutable sorted Parquet files, written by range and read with their keys pruned."""

from __future__ import annotations

import re
import shutil
from collections.abc import Iterable
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions.keys import in_range
from keyfold.plans.schema import CHANGELOG, DELETE, RunMeta
from keyfold.sources import manifest

PAGE_ROWS = 1_000
#: About the bytes of a run file.
RUN_BYTES = 64 << 20
WRITE_OPTIONS = {
    "parquet.bloom.filter.enabled#key": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.page.write-checksum.enabled": "true",
}
READ_OPTIONS = {"parquet.page.verify-checksum.enabled": "true"}


class CorruptRun(Exception):
    """A run whose data do not match their checksums."""


def uri(table: Path, path: str) -> str:
    return (table / manifest.RUNS / path).absolute().as_uri()


def read_changelog(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(CHANGELOG).options(**READ_OPTIONS).parquet(*paths)


def estimated_files(df: DataFrame) -> int:
    """How many files the optimizer's size of a plan makes, at most one for each shuffle partition."""
    return max(1, min(-(-estimated_bytes(df) // RUN_BYTES), shuffle_partitions(df)))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size of a plan; exabytes where it knows none."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def write_run(changes: DataFrame, table: Path, level: int, seq: int, run_entries: int, files: int) -> list[RunMeta]:
    """Writes rows with unique keys as one or more disjoint sorted files and describes each file.

    Rows are dealt out by ``files`` ranges of the key, and a file has at most
    ``run_entries`` rows; a hot range of keys is split like any other, since keys are
    unique. The descriptions come from one aggregate over the files' keys, a row for each
    file. Without rows, and if the write fails, no folder stays.
    """
    spark = changes.sparkSession
    folder = manifest.folder_name(level, seq)
    rows = changes.select("key", "seq", "op", "value")
    rows = rows.repartitionByRange(files, "key") if files > 1 else rows.repartition(1)
    try:
        rows.sortWithinPartitions("key").write.options(**WRITE_OPTIONS).option("maxRecordsPerFile", run_entries).parquet(uri(table, folder))
        out = describe_folder(spark, table, folder, level, seq)
    except BaseException:
        shutil.rmtree(table / manifest.RUNS / folder, ignore_errors=True)
        raise
    if not out:
        shutil.rmtree(table / manifest.RUNS / folder, ignore_errors=True)
    return out


def per_file(changes: DataFrame) -> DataFrame:
    """A row for each file of runs: file, size, entries, tombstones, first, last.

    The list of first keys has Spark aggregate by hash: the least and greatest keys alone
    would be found by a sort of all rows, each with the path of its file.
    """
    first = F.collect_list(F.when(F.col("_metadata.row_index") == 0, F.col("key")))
    return changes.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).agg(
        F.count("*").alias("entries"), F.sum((F.col("op") == DELETE).cast("bigint")).alias("tombstones"), F.element_at(first, 1).alias("first"), F.max("key").alias("last")
    )


def describe_folder(spark: SparkSession, table: Path, folder: str, level: int, seq: int) -> list[RunMeta]:
    """The descriptions of the files of a run folder, in key order; empty files do not count."""
    out = []
    for r in per_file(read_changelog(spark, [uri(table, folder)])).collect():
        name = Path(unquote(urlparse(r["file"]).path)).name
        out.append(RunMeta(f"{folder}/{name}", level, seq, r["entries"], r["tombstones"], r["size"], bytes(r["first"]), bytes(r["last"])))
    return sorted(out, key=lambda r: r.first_key)


def prune(runs: Iterable[RunMeta], low: bytes | None, high: bytes | None) -> list[RunMeta]:
    """The runs that may hold keys of [low, high); by key range only, never by age."""
    return [r for r in runs if r.meets(low, high)]


def disjoint(runs: list[RunMeta]) -> bool:
    """Whether no key can be in two of the runs, so that reading them needs no resolution."""
    ordered = sorted(runs, key=lambda r: r.first_key)
    return all(a.last_key < b.first_key for a, b in zip(ordered, ordered[1:], strict=False))


def read_runs(spark: SparkSession, table: Path, runs: list[RunMeta], low: bytes | None, high: bytes | None) -> DataFrame:
    """The mutations of the runs in [low, high): one scan over all files, with the range pushed down."""
    return ranged(read_changelog(spark, [uri(table, r.path) for r in runs]), low, high)


def ranged(changes: DataFrame, low: bytes | None, high: bytes | None) -> DataFrame:
    """The mutations in [low, high)."""
    return changes.where(in_range(F.col("key"), low, high)) if low is not None or high is not None else changes


def corruption(error: Exception) -> CorruptRun | None:
    """The error that names the damaged run, if that is what a failed read says."""
    text = str(error)
    if not re.search(r"(?i)checksum|crc|could not (read|verify) page|FAILED_READ_FILE|not a parquet file|CANNOT_READ_FILE", text):
        return None
    m = re.search(r"run-\d{2}-\d{10}-[0-9a-f]{8}/[\w.\-]+", text)
    return CorruptRun(f"run {m[0] if m else '(unknown)'} is damaged")
