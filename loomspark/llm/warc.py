"""WARC revisits: headers are shuffled by payload digest, revisit records joined to the original response, and one
response for each payload is written, with fresh headers, to new archives.

Payloads move once, by digest and combined before the shuffle, so that copies of a page aren't sent; revisits and
repeated responses travel as headers alone. Archives are written by Spark's own text sink (a record ends in two line
ends, which is its line separator), so the output committer keeps lost or repeated tasks from leaving anything behind."""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = ("record_id", "warc_type", "target_uri", "warc_date", "payload_digest", "refers_to", "refers_to_target_uri", "refers_to_date", "content_length")
_END = "\r\n\r\n"
#: Records that a task that reads archives hands on at once, and bytes of their payloads from which on it hands them on.
BATCH_ROWS, BATCH_BYTES = 2000, 4_000_000


@dataclass(frozen=True)
class WarcParams:
    #: An archive holds this many records at most; the next file begins there.
    records_per_file: int = 20000
    http_header: str = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"


def _fresh_id(record_id, digest):
    """A new record id that follows from the old one and the payload."""
    h = F.md5(F.concat_ws("|", F.coalesce(record_id, F.lit("")), F.coalesce(digest, F.lit(""))))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def _hexadecimal(digest):
    """A SHA-1 without its prefix, in lower-case hexadecimal; crawlers mostly write it in base32, 8 characters for 5 bytes."""
    bare = F.upper(F.regexp_replace(F.trim(digest), "(?i)^sha1:", ""))
    radix = F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    parts = [F.lpad(F.conv(F.substring(radix, at, 8), 32, 16), 10, "0") for at in (1, 9, 17, 25)]
    return F.lower(F.when(bare.rlike("^[A-Z2-7]{32}$"), F.concat(*parts)).otherwise(bare))


def _headers(records: DataFrame) -> DataFrame:
    """(_type, _uri, _date, _id, _digest, _payload) of responses and revisits; the digest of a response is computed anew,
    that of a revisit without one is its original's, where records has refers_to."""
    said = _hexadecimal(F.col("payload_digest"))
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary"))
    digest = F.when(F.col("warc_type") == "response", F.sha1(payload)).otherwise(said)
    names = ["_type", "_uri", "_date", "_id", "_digest", "_payload"]
    refers = F.col("refers_to") if "refers_to" in records.columns else F.lit(None).cast("string")
    heads = records.where("warc_type IN ('response', 'revisit')").select(
        F.col("warc_type").alias("_type"), F.col("target_uri").alias("_uri"), F.col("warc_date").alias("_date"), F.col("record_id").alias("_id"), digest.alias("_digest"), payload.alias("_payload"), refers.alias("_refers")
    )
    if "refers_to" not in records.columns:
        return heads.select(*names)
    lacking = F.col("_digest").isNull() & F.col("_refers").isNotNull()
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    named = heads.where("_digest IS NOT NULL AND _id IS NOT NULL").groupBy(bare("_id").alias("_refers")).agg(F.min("_digest").alias("_found"))
    filled = heads.where(lacking).withColumn("_refers", bare("_refers")).join(named, "_refers", "left").withColumn("_digest", F.col("_found"))
    return heads.where(~lacking).select(*names).unionByName(filled.select(*names))


def _originals(headers: DataFrame, *more) -> DataFrame:
    """One row for each digest: the first response by date, URI and id, nulls last."""
    rank = F.struct(*[x for c in ("_date", "_uri", "_id") for x in (F.col(c).isNull().alias(f"no{c}"), F.col(c))])
    return headers.where("_type = 'response'").groupBy("_digest").agg(F.min(rank).alias("_first"), *more).select("_digest", "_first._date", "_first._uri", "_first._id", *[c for c in ("_payload",) if more])


def resolve(records: DataFrame) -> DataFrame:
    """The headers of the new archive: COLUMNS without content_length.

    records has (record_id, warc_type, target_uri, warc_date, payload_digest, payload). A digest's first response (by
    date, URI, id; nulls last) stays a response; all others of that payload, and the revisits, become revisits that refer
    to it. Digests may be hexadecimal or base32; a revisit without one goes by refers_to, if there is such a column. One
    with neither, or whose original isn't among the records, stays with null refers_to. A null
    payload counts as an empty one; rows whose five header fields repeat count once; records of other types are left
    out; further columns are ignored; an empty table gives an empty result."""
    heads = _headers(records).drop("_payload").distinct()
    first = _originals(_headers(records).drop("_payload")).select("_digest", *[F.col(c).alias("o" + c) for c in ("_date", "_uri", "_id")], F.lit(True).alias("o_known"))
    same = (F.col("_type") == "response") & F.col("_date").eqNullSafe(F.col("o_date")) & F.col("_uri").eqNullSafe(F.col("o_uri")) & F.col("_id").eqNullSafe(F.col("o_id"))
    known = F.coalesce("o_known", F.lit(False))
    refer = lambda c: F.when(known & ~same, c)
    digest = F.concat(F.lit("sha1:"), F.col("_digest"))
    return heads.join(first, "_digest", "left").select(
        _fresh_id(F.col("_id"), F.col("_digest")).alias("record_id"),
        F.when(known & same, F.lit("response")).otherwise(F.lit("revisit")).alias("warc_type"),
        F.col("_uri").alias("target_uri"),
        F.col("_date").alias("warc_date"),
        digest.alias("payload_digest"),
        refer(_fresh_id(F.col("o_id"), F.col("_digest"))).alias("refers_to"),
        refer(F.col("o_uri")).alias("refers_to_target_uri"),
        refer(F.col("o_date")).alias("refers_to_date"),
    )


def _text(block) -> list:
    """A record's lines before its block, and the block."""
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(c, "[\\r\\n]+", " "), F.lit("\r\n"))).otherwise(F.lit(""))
    named = (
        ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Payload-Digest", "payload_digest"),
        ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "refers_to_target_uri"), ("WARC-Refers-To-Date", "refers_to_date"),
    )
    wrap = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("<"), F.col(c), F.lit(">")))
    lines = [line(n, wrap(c) if c in ("record_id", "refers_to") else F.col(c)) for n, c in named]
    profile = F.when(F.col("warc_type") == "revisit", F.lit(f"WARC-Profile: {PROFILE}\r\n")).otherwise(F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\n"), *lines, profile, F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END))
    return F.concat(head.cast("binary"), block)


def write_archive(records: DataFrame, path: str, params: WarcParams = WarcParams()) -> None:
    """Write the resolved records as gzipped WARC files below path. Rules as in resolve."""
    http = lambda size: F.concat(F.lit(params.http_header + "\r\nContent-Length: "), size.cast("string"), F.lit(_END)).cast("binary")
    own = _originals(_headers(records), F.first("_payload").alias("_payload")).select(
        _fresh_id(F.col("_id"), F.col("_digest")).alias("record_id"), F.lit("response").alias("warc_type"), F.col("_uri").alias("target_uri"), F.col("_date").alias("warc_date"),
        F.concat(F.lit("sha1:"), F.col("_digest")).alias("payload_digest"), *[F.lit(None).cast("string").alias(c) for c in ("refers_to", "refers_to_target_uri", "refers_to_date")], F.concat(http(F.octet_length("_payload")), F.col("_payload")).alias("_block"),
    )
    rest = resolve(records).where("warc_type = 'revisit'").withColumn("_block", F.lit("HTTP/1.1 304 Not Modified" + _END).cast("binary"))
    out = own.unionByName(rest).select(_text(F.col("_block")).cast("string").alias("value"))
    out.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", params.records_per_file).text(path)


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-cased name, block) of every record of an archive, by Content-Length."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head.get("content-length", 0))
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"record {head.get('warc-record-id')} is cut short")
        yield head, block


def _batches(content: pa.Buffer, payload: bool) -> Iterator[pa.RecordBatch]:
    """The records of one archive, with their payloads if those are asked for: BATCH_ROWS at a time, or fewer where payloads are large."""
    names = ("warc-record-id", "warc-type", "warc-target-uri", "warc-date", "warc-payload-digest", "warc-refers-to", "warc-refers-to-target-uri", "warc-refers-to-date")
    schema = pa.schema([*[(c, pa.int64() if c == "content_length" else pa.string()) for c in COLUMNS], *[("payload", pa.binary())] * payload])
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    plain = pa.BufferReader(content)
    stream = gzip.open(plain) if content.slice(0, 2).to_pybytes() == b"\x1f\x8b" else io.BufferedReader(plain)
    rows, held = [], 0
    for head, block in parse_records(stream):  # type: ignore[arg-type]
        values = [head.get(n) for n in names]
        values[0], values[5] = (v.strip("<>") if v else None for v in (values[0], values[5]))
        row = (*values, len(block))
        if payload:
            row = (*row, block.partition(_END.encode())[2] if values[1] != "revisit" else None)
            held += len(block)
        rows.append(row)
        if len(rows) == BATCH_ROWS or held >= BATCH_BYTES:
            yield out(rows)
            rows, held = [], 0
    if rows:
        yield out(rows)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """COLUMNS and, unless it isn't wanted, payload (what follows the HTTP header; null for a revisit) of every record of
    the archives below path, one archive a row of work, read record by record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _batches(content.as_buffer(), payload)

    kinds = ", ".join(f"{c} {'bigint' if c == 'content_length' else 'string'}" for c in COLUMNS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{*.gz,*.warc}").load(path).select("content")
    return files.mapInArrow(run, kinds + ", payload binary" * payload)


def crawl(pages: DataFrame) -> DataFrame:
    """Two crawls of pages as records: every page fetched, and found unchanged a month later (a revisit without payload).
    Rows with a null page_id or html are left out."""
    some = pages.select(F.col("page_id").alias("_p"), F.col("url").alias("_u"), F.col("html").alias("_h")).where("_p IS NOT NULL AND _h IS NOT NULL")
    name = lambda n: F.concat(F.lit("urn:page:"), F.col("_p").cast("string"), F.lit(f":{n}")).alias("record_id")
    digest = F.concat(F.lit("sha1:"), F.sha1(F.col("_h").cast("binary"))).alias("payload_digest")
    row = lambda n, kind, date, payload: [name(n), F.lit(kind).alias("warc_type"), F.col("_u").alias("target_uri"), F.lit(date).alias("warc_date"), digest, payload.alias("payload")]
    first = some.select(*row(1, "response", "2024-01-01T00:00:00Z", F.col("_h")))
    return first.unionByName(some.select(*row(2, "revisit", "2024-02-01T00:00:00Z", F.lit(None).cast("string"))))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the written archive of both crawls holds, read from its files: a row for each record."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(crawl(table(spark, sf_dir, "pages")), path)
    return read_archive(spark, path, payload=False)


QUERIES = {"op6_warc": op6_warc}
ORACLE = {
    "op6_warc": """
WITH captured AS (SELECT page_id, url, html, sha1(html) AS digest FROM pages WHERE page_id IS NOT NULL AND html IS NOT NULL),
heads AS (
  SELECT DISTINCT 'urn:page:' || page_id || ':' || n AS id, CASE n WHEN 1 THEN 'response' ELSE 'revisit' END AS kind, url,
         CASE n WHEN 1 THEN '2024-01-01T00:00:00Z' ELSE '2024-02-01T00:00:00Z' END AS seen, digest
  FROM captured, (VALUES (1), (2)) AS crawls(n)),
firsts AS (
  SELECT digest, id AS o_id, url AS o_url, seen AS o_at FROM (
    SELECT *, row_number() OVER (PARTITION BY digest ORDER BY seen, url NULLS LAST, id) AS k FROM heads WHERE kind = 'response') WHERE k = 1),
sizes AS (SELECT DISTINCT digest, strlen(html) AS size FROM captured),
named AS (
  SELECT *, md5(id || '|' || digest) AS m, md5(o_id || '|' || digest) AS om, id = o_id AND kind = 'response' AS own
  FROM heads JOIN firsts USING (digest) JOIN sizes USING (digest))
SELECT 'urn:uuid:' || concat_ws('-', substr(m, 1, 8), substr(m, 9, 4), substr(m, 13, 4), substr(m, 17, 4), substr(m, 21, 12)) AS record_id,
       CASE WHEN own THEN 'response' ELSE 'revisit' END AS warc_type, url AS target_uri, seen AS warc_date, 'sha1:' || digest AS payload_digest,
       CASE WHEN NOT own THEN 'urn:uuid:' || concat_ws('-', substr(om, 1, 8), substr(om, 9, 4), substr(om, 13, 4), substr(om, 17, 4), substr(om, 21, 12)) END AS refers_to,
       CASE WHEN NOT own THEN o_url END AS refers_to_target_uri, CASE WHEN NOT own THEN o_at END AS refers_to_date,
       CAST(CASE WHEN own THEN size + length('' || size) + 77 ELSE 29 END AS BIGINT) AS content_length
FROM named"""
}
