"""WARC archives: writing, reading back, and revisit resolution.

Archives are written by Spark's own text sink, so they land on any file system Spark can reach and commit
atomically per task. Each record of a ``.warc.gz`` file is a gzip member of its own, so that readers can seek to it;
``.warc`` files are plain. Reading splits on the record boundary inside the JVM, as a stream; payloads that would
read as a boundary are chunked. Compressed files are read by a task each, so ``max_records_per_file`` bounds a task.
"""

from __future__ import annotations

import gzip
import zlib
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from lexspark.llm.common import fresh_path, written

VERSION = "WARC/1.1"
CRLF = "\r\n"
END = CRLF + CRLF
#: What stands between two records of a file.
BOUNDARY = END + VERSION + CRLF
#: The sink puts a mark behind each row; behind a gzip member it is a member without content.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def record_id(page_id: Column, digest: Column) -> Column:
    """A stable record URI for (page, payload)."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *part))


def to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One record per row: (id, uri, digest, n_bytes, payload). A null payload is an empty one."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    return pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("uri"), F.sha1(payload.cast("binary")).alias("digest"),
        F.octet_length(payload).cast("long").alias("n_bytes"), payload.alias("payload"),
    )


def resolve_revisits(records: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Adds ``refers_to`` and ``refers_uri``: the record with the largest id among equal payloads.

    Only headers (id, digest, length) are shuffled by digest, and their maxima are combined before the
    shuffle, so a payload that a third of all records share costs one row per task. Payloads move once,
    by (id, digest), which no hot payload can skew.

    Payloads under ``min_bytes`` are never revisits. Records that repeat the winning id stay responses.
    A null id never wins over another id, and revisits the winner where there is one.
    """
    heads = records.where(F.col("n_bytes") >= min_bytes).select("id", "digest", "uri")
    winners = heads.groupBy("digest").agg(F.max("id").alias("win"), F.max_by("uri", "id").alias("win_uri"), F.count("*").alias("n")).where("n > 1")
    losers = (
        heads.select("id", "digest").distinct().join(winners, "digest")
        .where(F.coalesce(F.col("id") < F.col("win"), F.col("win").isNotNull()))
        .select(F.col("id").alias("l_id"), F.col("digest").alias("l_digest"), F.col("win").alias("refers_to"), F.col("win_uri").alias("refers_uri"))
    )
    on = F.col("id").eqNullSafe(F.col("l_id")) & (F.col("digest") == F.col("l_digest"))
    return records.join(losers, on, "left").drop("l_id", "l_digest")


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; control characters cannot end it early."""
    clean = F.regexp_replace(value, r"[\x00-\x20\x7f]", "%20")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def _fixed(name: str, value: str) -> Column:
    return F.lit(f"{name}: {value}{CRLF}")


def _chunked(payload: Column) -> Column:
    """The payload in HTTP chunks, cut inside each text that would read as a record boundary."""
    parts = F.split(payload, r"(?<=WARC)(?=/1\.1(?:\r\n|\z))")
    chunk = F.transform(parts, lambda p: F.concat(F.lower(F.hex(F.octet_length(p))), F.lit(CRLF), p, F.lit(CRLF)))
    return F.concat(F.array_join(chunk, ""), F.lit("0" + END))


@F.pandas_udf(BinaryType())
def _member(records: pd.Series) -> pd.Series:
    """Each record as a gzip member."""
    return records.map(lambda text: gzip.compress(text.encode(), 6, mtime=0))


def _warcinfo(date: str) -> str:
    body = f"software: lexspark{CRLF}format: WARC File Format 1.1{CRLF}"
    head = f"{VERSION}{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <urn:uuid:{zlib.crc32(date.encode()):08x}-0000-4000-8000-000000000000>{CRLF}WARC-Date: {date}{CRLF}"
    return f"{head}Content-Type: application/warc-fields{CRLF}Content-Length: {len(body)}{END}{body}"


def _named(spark: SparkSession, path: str, ending: str) -> None:
    """Gives the part files below ``path`` the ending of archives."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(status.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name[:-4]}{ending}"))


def write_warc(records: DataFrame, path: str, date: str | None = None, compression: str = "gzip", max_records_per_file: int = 20_000) -> str:
    """Writes records with fresh headers: full responses, and body-less revisits where ``refers_to`` is set.

    ``compression`` is gzip (a member per record, ``.warc.gz``) or none (``.warc``). Each task's first file begins with a
    warcinfo record. ``date`` is that of writing unless given. A table without rows makes a folder without records.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    plain = compression == "none"
    revisit = F.col("refers_to").isNotNull()
    hides = F.contains(F.concat(F.lit(END), "payload", F.lit(END)), F.lit(BOUNDARY))  # END goes before and after the payload
    body = F.when(hides, _chunked(F.col("payload"))).otherwise(F.col("payload"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        F.when(hides, F.lit(f"Transfer-Encoding: chunked{CRLF}")).otherwise(_header("Content-Length", F.col("n_bytes").cast("string"))), F.lit(CRLF),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, body))
    head = F.concat(
        F.lit(VERSION + CRLF),
        F.when(revisit, _fixed("WARC-Type", "revisit")).otherwise(_fixed("WARC-Type", "response")),
        _header("WARC-Record-ID", F.concat(F.lit("<"), record_id(F.col("id"), F.col("digest")), F.lit(">"))),
        _fixed("WARC-Date", date), _header("WARC-Target-URI", F.col("uri")), _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(
            _fixed("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            _header("WARC-Refers-To", F.concat(F.lit("<"), record_id(F.col("refers_to"), F.col("digest")), F.lit(">"))),
            _header("WARC-Refers-To-Target-URI", F.col("refers_uri")),
        )).otherwise(F.lit("")),
        _header("X-Page-ID", F.col("id").cast("string")), _fixed("Content-Type", "application/http;msgtype=response"),
        _header("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF),
    )
    rows = records.select(F.concat(head, block).alias("value"), (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0).alias("opens"))
    rows = rows.select(F.explode(F.when(F.col("opens"), F.array(F.lit(_warcinfo(date)), "value")).otherwise(F.array("value"))).alias("value"))
    if plain:
        out = rows.write.option("lineSep", END)
    else:
        out = rows.select(_member(F.concat("value", F.lit(END))).cast("string").alias("value")).write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
    out.option("maxRecordsPerFile", max_records_per_file).text(path)
    _named(records.sparkSession, path, ".warc" if plain else ".warc.gz")
    return path


@F.pandas_udf(StringType())
def _unchunked(bodies: pd.Series) -> pd.Series:
    """Payloads of chunked bodies; nulls (bodies that are not chunked) pass through."""

    def plain(body: str | None) -> str | None:
        if body is None:
            return None
        raw, at, out = body.encode(), 0, []
        while True:
            end = raw.index(b"\r\n", at)
            size = int(raw[at:end].split(b";")[0], 16)
            if not size:
                return b"".join(out).decode()
            out.append(raw[end + 2 : end + 2 + size])
            at = end + 4 + size

    return bodies.map(plain, na_action="ignore")


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*?)\r?$", 1)
    return F.when(found != "", found)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path``, without warcinfo: (record_id, type, id, uri, digest, refers_id, payload)."""
    lines = spark.read.option("lineSep", BOUNDARY).text(path)
    part = F.split(F.col("value"), END, 3)
    raw = lines.select(F.get(part, F.lit(0)).alias("head"), F.coalesce(F.get(part, F.lit(1)), F.lit("")).alias("http"), F.coalesce(F.get(part, F.lit(2)), F.lit("")).alias("rest"))
    raw = raw.where(_field(F.col("head"), "WARC-Type").isin("response", "revisit"))
    # Content-Length, not the separator, says where the last record of a file ends
    size = _field(F.col("head"), "Content-Length").cast("long") - F.octet_length("http") - len(END)
    body = F.substr(F.col("rest").cast("binary"), F.lit(1), F.greatest(size, F.lit(0)).cast("int")).cast("string")
    chunked = F.contains(F.lower("http"), F.lit("transfer-encoding: chunked"))
    bare = lambda c: F.regexp_replace(c, "[<>]", "")
    return raw.select(
        bare(_field(F.col("head"), "WARC-Record-ID")).alias("record_id"), _field(F.col("head"), "WARC-Type").alias("type"), _field(F.col("head"), "X-Page-ID").cast("long").alias("id"),
        _field(F.col("head"), "WARC-Target-URI").alias("uri"), F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        bare(_field(F.col("head"), "WARC-Refers-To")).alias("refers_id"), body.alias("body"), chunked.alias("chunked"),
    ).withColumn("payload", F.when(F.col("chunked"), _unchunked(F.when(F.col("chunked"), F.col("body")))).otherwise(F.col("body"))).drop("body", "chunked")


def resolved(records: DataFrame) -> DataFrame:
    """Records read back, with the payload length and id of the response that each revisit refers to.

    Digests of responses are taken anew from the payload that was read. Archives are parsed once; only headers are joined,
    and only those of revisits, with both sides written first, so that Spark can split a payload that many revisit.
    """
    full = records.select(
        "record_id", "type", "id", "refers_id", F.when(F.col("type") == "revisit", F.col("digest")).otherwise(F.sha1(F.col("payload").cast("binary"))).alias("digest"),
        F.octet_length("payload").cast("long").alias("n_bytes"),
    )
    full = written(full, "headers")
    whole = full.where("type = 'response'").groupBy(F.col("record_id").alias("refers_id")).agg(F.max("id").alias("refers_to"), F.max("n_bytes").alias("whole_bytes"))
    again = full.where("type = 'revisit'").join(written(whole, "responses"), "refers_id", "left").select("id", F.col("whole_bytes").alias("n_bytes"), "digest", "type", "refers_to")
    return full.where("type = 'response'").select("id", "n_bytes", "digest", "type", F.lit(None).cast("long").alias("refers_to")).union(again)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as deduplicated archives, read back: one row per page.

    A null html is an empty payload; a null url leaves the target out; no pages give no rows.
    """
    records = resolve_revisits(to_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    path = write_warc(records, fresh_path(spark, "warc"))
    return resolved(read_warc(spark, path)).select(
        F.col("id").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"
    )


#: DuckDB has no table of SHA-1 over bytes of its own; its ``sha1`` takes the UTF-8 text.
OP4_SQL = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN w IS NULL THEN 'response' ELSE 'revisit' END AS record_type, w AS refers_to
FROM (
  SELECT page_id, payload_bytes, payload_digest,
         CASE WHEN payload_bytes >= 1000 AND top IS NOT NULL AND (page_id IS NULL OR page_id < top) THEN top END AS w
  FROM (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
           max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
    FROM pages))
"""
