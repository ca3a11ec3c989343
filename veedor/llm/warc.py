"""WARC archives: writing, reading, and replacing repeated payloads by revisit records.

``write_archive`` writes one response record per page. ``resolve_revisits`` reads an archive's headers,
shuffles them by payload digest, joins every record whose payload was seen elsewhere to the original
response, and writes a new archive with fresh headers, in which each such payload stands once.
Of equal payloads of at least ``MIN_BYTES`` bytes the record with the largest page id stays a
response (a NULL id is smallest; of rows that share that id, the last by file and place).

Archives are folders of gzip files of about ``FILE_BYTES`` bytes before compression, each record as
the format prescribes (a file is one gzip member, not one per record); files are read whole and
parsed by Content-Length, so payloads may hold anything. A NULL payload is empty; an empty table
gives an archive without records; other columns play no part.
"""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veedor.runtime import new_path, stage

MIN_BYTES = 1000
FILE_BYTES = 16 << 20
#: Assumed for the headers of a record when files are counted.
HEAD_BYTES = 600
PAYLOAD = ["payload_digest", "payload_bytes"]
# Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "1970-01-01T00:00:00Z"

SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, file string, place long"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _address(url: Column) -> Column:
    """One header line whatever the url holds: control characters become escapes."""
    escaped = url
    for code in (*range(32), 127):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return escaped


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _record() -> Column:
    """Text of a record but for the two line ends after it, from page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, payload."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}"),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit(CRLF),
    )
    head = F.concat(
        F.lit(f"{VERSION}{CRLF}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(CAPTURED)),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(_line("WARC-Target-URI", _address(F.col("url")))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _record_id(F.col("refers_to"))))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length(F.col("payload")))).cast("string")),
        F.lit(CRLF),
    )
    return F.concat(head, http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))


def _write(records: DataFrame, name: str) -> str:
    """Records (columns of ``_record``) as archive files; the text writer's line end is the record's end."""
    path = new_path(records.sparkSession, name)
    records.select(_record().alias("value")).write.option("lineSep", CRLF * 2).text(path, compression="gzip")
    return path


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> str:
    """Write a response record per row; returns the folder."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload).alias("payload_digest"),
        payload.alias("payload"),
    )
    total = pages.agg(F.sum(F.octet_length(payload) + HEAD_BYTES)).first()[0] or 0
    return _write(rows.repartition(1 + total // FILE_BYTES), "warc")


def parse(body: memoryview):
    """Records of one archive file: (place, header fields, HTTP fields, payload)."""
    at, size = 0, len(body)
    raw = body.obj
    while at < size:
        split = raw.index(b"\r\n\r\n", at)
        fields = _fields(raw[at:split])
        start, stop = split + 4, split + 4 + int(fields["content-length"])
        inner = raw.index(b"\r\n\r\n", start)
        yield at, fields, _fields(raw[start:inner]), body[inner + 4 : stop]
        at = stop + 4


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in head.decode(errors="replace").split(CRLF)[1:] if line)
    return {name.lower(): value for name, value in pairs}


def _number(record_id: str | None) -> int | None:
    digits = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of an archive (see ``SCHEMA``); a response's digest and size are taken from its payload.

    ``payloads=False`` leaves the payload NULL, so that only headers are passed on.
    """

    def run(batches):
        schema = pa.schema(
            [
                ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("place", pa.int64()),
            ]
        )
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for place, warc, http, payload in parse(memoryview(gzip.decompress(content.as_py()))):
                    kind = warc["warc-type"]
                    refers = _number(warc.get("warc-refers-to"))
                    digest, n = warc["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                    if kind == "response":
                        digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
                    body = bytes(payload) if payloads and kind == "response" else None
                    rows.append((_number(warc["warc-record-id"]), warc.get("warc-target-uri"), kind, refers, n, digest, body, name, place))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def resolve_revisits(spark: SparkSession, path: str, min_bytes: int = MIN_BYTES) -> str:
    """Write the archive at ``path`` anew with revisit records for repeated payloads; returns the folder."""
    headers = stage(read_archive(spark, path).drop("payload"), "warc-headers")
    large = headers.where(F.col("payload_bytes") >= min_bytes)
    # aggregated before the shuffle: a digest that many records share is one row per task
    best = F.max(F.struct("page_id", "file", "place")).alias("best")
    originals = stage(large.groupBy(*PAYLOAD).agg(best), "warc-originals")
    revisits = stage(
        large.join(originals, PAYLOAD)
        .where((F.col("file") != F.col("best.file")) | (F.col("place") != F.col("best.place")))
        .select("file", "place", F.col("best.page_id").alias("original"), F.lit(True).alias("revisit")),
        "warc-revisits",
    )
    records = (
        read_archive(spark, path, payloads=True)
        .join(revisits, ["file", "place"], "left")
        .withColumn("record_type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")))
        .withColumn("refers_to", F.when(F.col("revisit"), F.col("original")))
        .withColumn("payload", F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload").cast("string")))
    )
    return _write(records, "warc-deduplicated")
