"""WARC archives with revisit resolution.

Headers (record id, payload digest, length) are shuffled by payload digest to find the record
that each repeated payload refers to; archives are then written with fresh headers through
Spark's own committed file writer, on any file system that Spark reaches, and read back.

A record ends in CRLF CRLF, so an archive is the text file whose "lines" are records and whose
line separator is CRLF CRLF: writing stays in the JVM and a lost executor leaves no partial file.
Each part file is one gzip member. There is no warcinfo record.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_spans, materialise, scratch_path, utf8

#: Payloads below this many bytes are never revisits.
MIN_REVISIT_BYTES = 1000
#: Records per file, at most, of payloads of up to ``SHORT_BYTES``; of up to 16 times that a 16th, and so on.
FILE_RECORDS = 8192
SHORT_BYTES = 1 << 16
#: Most revisits whose keys are broadcast when archives are written; more are joined by shuffling.
BROADCAST_REVISITS = 200_000
#: Bytes that are unpacked at once when archives are read.
READ_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _record_key(page, digest):
    return F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("null")), digest))


def _urn(key):
    parts = [F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def heads_of(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """The small header table: record key, page, payload digest (SHA-1, hex) and length."""
    digest = F.sha1(F.encode(utf8(payload_col), "UTF-8"))
    return pages.select(F.col(id_col).alias("page"), digest.alias("digest"), F.octet_length(utf8(payload_col)).cast("long").alias("bytes")).withColumn(
        "record_key", _record_key(F.col("page"), F.col("digest"))
    )


def revisits_of(heads: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``(record_key, refers_key)`` of every record whose payload a record of a larger page id holds."""
    long = heads.where(F.col("bytes") >= min_bytes)
    # A table of its own, so that the join is of two plain shuffles and the rows of a common payload can be split.
    originals = materialise(long.groupBy("digest").agg(F.max("page").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null"), "warc_originals")
    found = long.join(originals, "digest").where("page is null or page <> original")
    return found.select("record_key", _record_key(F.col("original"), F.col("digest")).alias("refers_key")).distinct()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write one WARC record per row of ``pages`` to files below ``path``.

    Of records with equal payloads of at least ``min_bytes`` bytes, that of the largest id is the
    response and the others are revisits of it; all others are responses. A null payload is empty;
    a row without an id is written under the id ``null`` and never the original of another; rows
    that repeat id and payload are equal records; an empty table gives an archive without records; a payload of any
    length is one record; other columns are ignored, whatever their names. Longer payloads share a file with fewer others, in a
    folder of their size class, so a file holds at most 512 MB of payloads unless one is larger; each class that there is takes a scan.
    """
    spark = pages.sparkSession
    heads = materialise(heads_of(pages, id_col, payload_col), "warc_heads")
    # Times 16 above SHORT_BYTES, as a whole number from 0.
    step_of = lambda size: F.greatest(F.lit(0), F.ceil(F.log(16.0, F.greatest(size, F.lit(1)) / F.lit(float(SHORT_BYTES))))).cast("int")
    steps = sorted(r[0] for r in heads.select(step_of(F.col("bytes"))).distinct().collect()) or [0]
    revisits = materialise(revisits_of(heads, min_bytes), "warc_revisits")
    digest = F.sha1(F.encode(utf8(payload_col), "UTF-8"))
    rows = pages.select(
        _record_key(F.col(id_col), digest).alias("record_key"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("page"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("urn:page:unknown")), r"[\x00-\x20\x7F]", "%20").alias("url"),
        utf8(payload_col).alias("payload"),
        digest.alias("digest"),
    )
    # Two keys of 32 letters a revisit: while they are few, pages stay where they are.
    few = revisits.count() <= BROADCAST_REVISITS
    joined = rows.join(F.broadcast(revisits) if few else revisits, "record_key", "left")
    again = F.col("refers_key").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF * 2))
    block = F.when(again, F.col("http")).otherwise(F.concat("http", "payload"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "),
        _urn(F.col("record_key")),
        F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "),
        F.col("url"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit(f"{CRLF}X-Page-Id: "),
        F.col("page"),
        F.when(again, F.concat(F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), _urn(F.col("refers_key")))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(CRLF * 2),
    )
    for step in steps:
        own = joined.where(step_of(F.octet_length("payload")) == step) if len(steps) > 1 else joined
        records = own.withColumn("http", http).withColumn("block", block).select(F.concat(head, "block").alias("value"))
        records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", max(1, FILE_RECORDS >> (4 * step))).text(f"{path.rstrip('/')}/size={step}")


def _unpacked(archive: memoryview) -> Iterator[bytes]:
    """The bytes of one archive file, gzip or plain, in parts of about ``READ_BYTES``."""
    if bytes(archive[:2]) != b"\x1f\x8b":
        yield from (bytes(archive[a : a + READ_BYTES]) for a in range(0, len(archive), READ_BYTES))
        return
    at = 0
    while at < len(archive):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(archive):
                raise ValueError("an archive ends within a gzip member")
            data = archive[at : at + READ_BYTES // 4]
            at += len(data)
            while data and not member.eof:
                yield member.decompress(data, READ_BYTES)
                data = member.unconsumed_tail
            at -= len(member.unused_data)


def parse_records(archive: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of one archive file, gzip or plain; one record is held at a time."""
    parts, held, at = _unpacked(memoryview(archive)), bytearray(), 0

    def need(end: int) -> bool:
        """Read on until the record held has ``end`` bytes."""
        nonlocal at
        while len(held) < end:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while need(1):
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not need(seen + 1):
                raise ValueError(f"no WARC record at byte {at}")
        lines = held[:end].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        if not need(end + 4 + size):
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, bytes(memoryview(held)[end + 4 : end + 4 + size])
        need(end + 8 + size)
        del held[: end + 8 + size]
        at += end + 8 + size


FIELDS = [("page", pa.string()), ("url", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("payload", pa.binary())]


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = byte_spans(batch.column(0))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            rows: list[tuple] = []
            held = 0
            for h, block in parse_records(data[a:b]):
                top, _, payload = block.partition(b"\r\n\r\n")
                size = next(int(x.split(b":")[1]) for x in top.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                if h["warc-type"] == "response" and (size != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
                rows.append((h["x-page-id"], h["warc-target-uri"], h["warc-record-id"], h["warc-type"], h.get("warc-refers-to"), digest, size, payload if with_payload else None))
                held += len(payload) if with_payload else 0
                if len(rows) >= 10_000 or held > 8 << 20:
                    yield _table(rows)
                    rows, held = [], 0
            yield _table(rows)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS)], names=[n for n, _ in FIELDS])


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record; digests of response payloads are checked. Revisits give the length and digest of the payload that they stand for."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    schema = "page string, url string, record_id string, record_type string, refers_to_id string, digest string, bytes long, payload binary"
    return files.mapInArrow(lambda b: _read(b, with_payload), schema)


def resolve(records: DataFrame) -> DataFrame:
    """Join each revisit to its response: ``refers_to`` is that record's page."""
    responses = materialise(records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page").alias("refers_to")), "warc_responses")
    # Responses refer to nothing: in the join, all their null keys would meet in one task.
    found = records.where("refers_to_id is not null").join(responses, "refers_to_id", "left").select(*records.columns, "refers_to")
    return found.unionByName(records.where("refers_to_id is null").withColumn("refers_to", F.lit(None).cast("string")))


def op3_warc(spark, sf_dir):
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from the archives of all pages."""
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = resolve(materialise(read_archives(spark, path).drop("payload"), "warc_records"))
    return records.select(
        F.expr("try_cast(page as bigint)").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.expr("try_cast(refers_to as bigint)").alias("refers_to"),
    )


OP3_SQL = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages),
o as (select d, max(page_id) as original from p where n >= 1000 group by d)
select p.page_id, p.n as payload_bytes, p.d as payload_digest,
       case when p.n >= 1000 and p.page_id <> o.original then 'revisit' else 'response' end as record_type,
       case when p.n >= 1000 and p.page_id <> o.original then o.original end as refers_to
from p left join o on p.d = o.d
"""
