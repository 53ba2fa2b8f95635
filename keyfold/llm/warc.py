"""Web archives, index first.

Writing puts each record in a gzip member of its own and returns an index row for it:
file, offset, length, URL, payload digest. Reading starts from index rows, whichever are
selected: they are sorted by file and offset, neighbouring byte ranges are coalesced into
one read, and each record is cut out of it.

A payload that an earlier record has already is a revisit of it. Files go to a folder
that all executors share, under names that a repeated task does not reuse: a file counts
only if the index names it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm.common import ready, scratch_path, stored

#: The folder beside the archives that holds their index.
INDEX_FOLDER = "index"

LEAST_REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 256 << 20
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id bigint, url string, digest string, payload_bytes bigint, record_type string, refers_to bigint, file string, offset bigint, length bigint"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def header_value(text: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: WARC headers, HTTP headers with the payload's length, and the payload unless it is a revisit."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record; raises ValueError if it is damaged."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    size = int(headers["Content-Length"])
    if not mark or version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return headers, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _squeeze(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archive(df: DataFrame, id_column: str, url_column: str, html_column: str, folder: str | None = None) -> DataFrame:
    """Writes a record for each row and returns the index (INDEX columns), read from its own files.

    The payload is the html in UTF-8, null counts as empty. Of equal payloads of at least
    100 bytes the one with the least id is the response, rows with a larger id revisit
    it; a row with a null id is a response. Rows that repeat the least id are responses
    too; if id and payload are equal they are the same record twice and share its
    WARC-Record-ID. A null URL leaves its header out. Other columns are not read; an
    empty table gives an empty index and no archives. The index stays beside the
    archives, for ``read_index``.
    """
    spark = ready(df.sparkSession)
    folder = folder or scratch_path(spark, "warc")
    payload = F.coalesce(F.encode(F.col(html_column), "utf-8"), F.lit(b""))
    rows = df.select(F.col(id_column).cast("bigint").alias("page_id"), F.col(url_column).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"))
    large = rows.where(F.octet_length("payload") >= LEAST_REVISIT_BYTES)
    leaders = large.groupBy("digest").agg(F.min("page_id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    leaders = stored(leaders.select(F.col("digest").alias("_digest"), "leader"), "warc-leaders")
    joined = rows.join(leaders, F.col("digest") == F.col("_digest"), "left")
    joined = joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") > F.col("leader"), F.col("leader")).alias("refers_to"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = pafs.FileSystem.from_uri(folder)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                index = []
                for page_id, url, payload, digest, refers_to in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    if out is None or offset >= FILE_BYTES:
                        if out is None:
                            system.create_dir(place, recursive=True)
                        else:
                            out.close()
                        name, offset = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{place}/{name}", compression=None)
                    member = _squeeze(encode_record(page_id, url, payload, digest, refers_to, refers_to is not None))
                    out.write(member)
                    index.append((page_id, url, digest, len(payload), "revisit" if refers_to is not None else "response", refers_to, f"{folder}/{name}", offset, len(member)))
                    offset += len(member)
                columns = list(zip(*index, strict=True))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    joined.mapInArrow(each, INDEX).write.parquet(f"{folder}/{INDEX_FOLDER}")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of the archives in ``folder``."""
    return spark.read.schema(INDEX).parquet(f"{folder}/{INDEX_FOLDER}")


def dangling(index: DataFrame) -> DataFrame:
    """The revisits of an index whose response it does not name with the same digest: none in a whole one."""
    responses = index.where("record_type = 'response'").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest")).distinct()
    return index.where("record_type = 'revisit'").join(responses, (F.col("refers_to") == F.col("_page")) & (F.col("digest") == F.col("_digest")), "left_anti")


def _ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, int, int]]:
    """Coalesces sorted (file, offset, length) to reads: file, first byte, one past the last, first row, one past the last."""
    i = 0
    while i < len(rows):
        file, low, size = rows[i]
        high, j = low + size, i + 1
        while j < len(rows) and rows[j][0] == file and rows[j][1] <= high + GAP_BYTES and max(high, rows[j][1] + rows[j][2]) - low <= READ_BYTES:
            high, j = max(high, rows[j][1] + rows[j][2]), j + 1
        yield file, low, high, i, j
        i = j


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """Reads the records that the rows of ``index`` (file, offset, length) name.

    Returns page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact
    (the payload of a response has the digest and length its headers state) and, with
    ``payload``, the payload (null for a revisit; it is the response's). Columns of the
    index other than the three are not used. A damaged record is an error.
    """
    ready(index.sparkSession)
    rows = index.select("file", "offset", "length").where("file is not null")
    size = rows.agg(F.sum("length")).first()[0] or 0
    parts = int(max(1, min(size // (16 << 20) + 1, 50_000)))
    ordered = rows.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            for file, low, high, i, j in _ranges(wanted):
                system, place = pafs.FileSystem.from_uri(file)
                with system.open_input_file(place) as f:
                    data = f.read_at(high - low, low)
                out = []
                for _, offset, length in wanted[i:j]:
                    warc, http, body = decode_record(zlib.decompress(data[offset - low : offset - low + length], 31))
                    digest, n = warc["WARC-Payload-Digest"].removeprefix("sha256:"), int(http["Content-Length"])
                    response = warc["WARC-Type"] == "response"
                    intact = not response or len(body) == n and hashlib.sha256(body).hexdigest() == digest
                    number = lambda k: int(warc[k]) if k in warc else None  # noqa: B023, E731
                    out.append((number("X-Page-Id"), warc.get("WARC-Target-URI"), warc["WARC-Type"], number("X-Refers-To-Page-Id"), n, digest, intact, body if response else None))
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary())
                names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)][: 8 if payload else 7], names[: 8 if payload else 7])

    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, intact boolean"
    return ordered.mapInArrow(each, schema + ", payload binary" * payload)
