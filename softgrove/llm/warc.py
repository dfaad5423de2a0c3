"""WARC archives: writing captures, reading records, assembling transactions.

A capture is written as three records: a request, a response (or a revisit of an
earlier response with an equal payload) and metadata. Request and metadata name
the response in WARC-Concurrent-To. Spark's text writer writes the files: a row
is one record, and the two line ends that close a record are the line separator,
so commits, retries and any file system work as for other tables.

Reading parses every file by Content-Length (plain or gzip members), so payloads
may hold anything. Transactions are put together by joins on record ids: requests
and metadata are first brought to one row per response they name, so repeated
records do not multiply a capture. Payloads are not shuffled unless they are
asked for, as their digest and length are taken while parsing.

Equal payloads are found by digest with map-side counting; only digests that
several pages share are kept, and the pages are joined with that table by
broadcast only if its written size is small.

A null payload is empty. Rows that repeat a page id are captures of their own; of
rows with the same smallest id each is a response. A null id never makes a row
the one that others revisit unless all of the group are null; then all are
responses. An empty table gives empty archives and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from softgrove.llm.common import small_batches, written

MIN_REVISIT_BYTES = 100
RECORDS_PER_FILE = 3000
EOL = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: profile that the WARC 1.1 standard names for revisits of an identical payload
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("concurrent_to", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("block", T.BinaryType())])


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    at = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, s, n) for s, n in at]), F.lit(">"))


def _one_line(value: Column) -> Column:
    """A header value: line ends and control characters become blanks."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x00-\x1F\x7F]+", " ")


def _record(kind: Column | str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id),
             F.lit(f"WARC-Date: {DATE}")]
    # concat with a null value is null, and concat_ws leaves it out
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(EOL, *lines), F.lit(EOL + EOL), block)


def first_of_payload(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """digest, first_id of payloads that several pages share."""
    payload = F.coalesce(pages[payload_col], F.lit(""))
    rows = pages.select(pages[id_col].alias("id"), F.sha2(payload, 256).alias("digest"),
                        F.octet_length(payload).alias("bytes")).filter(F.col("bytes") >= min_bytes)
    shared = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return written(shared.filter("n > 1").select(F.col("digest").alias("__shared"), "first_id"), "warc-shared")


def records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
            min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """One row ``value`` per record, without the two line ends that close it."""
    shared = first_of_payload(pages, id_col, payload_col, min_bytes)
    payload = F.coalesce(pages[payload_col], F.lit(""))
    id_text = F.coalesce(pages[id_col].cast("string"), F.lit(""))
    rows = pages.select(
        pages[id_col].alias("id"), id_text.alias("id_text"), _one_line(pages[uri_col]).alias("uri"),
        payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.monotonically_increasing_id().alias("place"))
    rows = rows.join(shared, rows["digest"] == shared["__shared"], "left")
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    # several rows may have the same id, so the place of the row is part of a record id, but not of the id referred to
    place = F.when(revisit | F.col("first_id").isNull(), F.col("place").cast("string")).otherwise(F.lit("first"))
    own = _uuid(F.lit("response"), F.col("id_text"), F.col("digest"), place)
    first = _uuid(F.lit("response"), F.col("first_id").cast("string"), F.col("digest"), F.lit("first"))
    target = [("WARC-Target-URI", F.col("uri"))]
    concurrent = [("WARC-Concurrent-To", own)]
    http = F.concat(F.lit("HTTP/1.1 200 OK" + EOL + "Content-Type: text/html; charset=utf-8" + EOL + "Content-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(EOL + EOL))
    response = _record(
        F.when(revisit, "revisit").otherwise("response"), own,
        [*target, ("Content-Type", F.lit("application/http; msgtype=response")), ("WARC-Payload-Digest", digest),
         ("WARC-Refers-To", F.when(revisit, first)), ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE)))],
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))))
    request = _record(
        "request", _uuid(F.lit("request"), F.col("id_text"), F.col("digest"), F.col("place").cast("string")),
        [*target, *concurrent, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.col("uri"), F.lit(" HTTP/1.1" + EOL + EOL)))
    metadata = _record(
        "metadata", _uuid(F.lit("metadata"), F.col("id_text"), F.col("digest"), F.col("place").cast("string")),
        [*target, *concurrent, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.when(F.col("id").isNull(), "").otherwise(F.concat(F.lit("page-id: "), F.col("id_text"), F.lit(EOL)))))
    return rows.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_archives(recs: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Archives of at most ``records_per_file`` records."""
    recs.write.option("lineSep", EOL + EOL).option("maxRecordsPerFile", records_per_file).text(path)


def _parse(data: bytes) -> Iterator[tuple]:
    """Records of one archive, in order; a block is cut by its Content-Length."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split(EOL)
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}
        block = data[end + 4:end + 4 + int(headers.get("content-length", 0))]
        at = end + 4 + len(block)
        yield headers, block


def _row(headers: dict[str, str], block: bytes) -> dict:
    kind, digest, size = headers.get("warc-type"), None, None
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        else:
            digest = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
            fields = dict(x.lower().split(b":", 1) for x in http.split(b"\r\n")[1:] if b":" in x)
            size = int(fields[b"content-length"]) if b"content-length" in fields else None
    return {"record_id": headers.get("warc-record-id"), "type": kind, "target_uri": headers.get("warc-target-uri"),
            "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"),
            "payload_digest": digest, "payload_bytes": size, "headers": headers, "block": block}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder, columns of RECORD.

    A task holds the archives of its partition, which Spark packs up to spark.sql.files.maxPartitionBytes.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    small_batches(spark)
    kinds = {"payload_bytes": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "block": pa.binary()}
    schema = pa.schema([(f.name, kinds.get(f.name, pa.string())) for f in RECORD])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                rows: list[dict] = []
                for headers, block in _parse(data):
                    rows.append(_row(headers, block) | {"headers": list(headers.items())})
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, RECORD)


def captures(recs: DataFrame) -> DataFrame:
    """One nested row per capture: ``response`` with the ``request`` and ``metadata`` that are concurrent to it."""

    def concurrent(kind: str) -> DataFrame:
        rows = recs.filter((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        whole = F.struct("record_id", "target_uri", "headers", "block")
        return rows.groupBy(F.col("concurrent_to").alias(f"{kind}_of")).agg(
            F.min_by(whole, F.col("record_id")).alias(kind))

    requests, metadata = concurrent("request"), concurrent("metadata")
    responses = recs.filter(F.col("type").isin("response", "revisit")).select(
        "record_id", F.struct("record_id", "type", "target_uri", "refers_to", "payload_digest", "payload_bytes",
                              "headers", "block").alias("response"))
    return responses.join(requests, F.col("record_id") == F.col("request_of"), "left").join(
        metadata, F.col("record_id") == F.col("metadata_of"), "left").select("response", "request", "metadata")
