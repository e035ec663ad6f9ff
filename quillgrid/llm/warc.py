"""WARC archives without repeated payloads: revisit records resolved by payload digest.

Headers (id, digest, length), not payloads, are grouped by digest; of equal payloads one record is the
response, the others become revisits that name it. Archives are written by Spark's text writer with the
record separator of the format (two line ends) as its line separator, so they are plain WARC/1.1 files in any
store that Spark reaches, committed by its protocol. Reading parses whole files record by record, checks
payloads against their digests, and joins revisits to their responses by digest.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import uuid
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, shared_dir, written

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive file, about, and at most; a file is read as a whole. Pages over LARGE go to files of their own kind.
FILE_BYTES, MOST_BYTES, LARGE = 16 << 20, 1 << 30, 1 << 18
MIN_BYTES = 0

READ = "record_type string, id string, record_id string, refers_to string, url string, digest string, payload_bytes long"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a payload in upper-case base 32: five hexadecimal digits make four of base 32."""
    digits = F.sha1(payload)
    four = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*four), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws(" ", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def resolved(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages with ``digest``, ``n_bytes`` and ``original``: the largest id of an equal payload, or its own."""
    payload = F.coalesce(col(payload_col).cast("binary"), F.lit("").cast("binary"))
    heads = pages.select(col(id_col).alias("id"), base32_sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    groups = heads.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("id").alias("original"), F.count("*").alias("times")).where("times > 1")
    groups = written(groups.select(F.col("digest").alias("__digest"), "original"), "originals")
    rows = pages.withColumn("digest", base32_sha1(payload)).withColumn("n_bytes", F.octet_length(payload).cast("long"))
    return rows.join(groups, F.col("digest") == F.col("__digest"), "left").drop("__digest").withColumn("original", F.coalesce("original", col(id_col)))


def records(found: DataFrame, id_col: str, url_col: str, payload_col: str, date: str | None = None) -> DataFrame:
    """One text column: whole records but for the separator that ends them.

    Ids are written as in a form (url_encode), so that any text, blanks and line ends included, comes back as it
    was; a null id has no header. date: of all records, by default the time of the call.
    """
    date = date or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    name = lambda x: F.url_encode(x.cast("string"))
    page, digest = F.coalesce(name(col(id_col)), F.lit("")), F.concat(F.lit("sha1:"), F.col("digest"))
    url = F.translate(F.coalesce(col(url_col).cast("string"), F.lit("")), "\r\n", "  ")
    first = col(id_col).eqNullSafe(F.col("original"))
    body = F.coalesce(col(payload_col).cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    block = F.when(first, F.concat(http, body)).otherwise(http)
    head = [F.lit("WARC/1.1\r\nWARC-Type: "), F.when(first, "response").otherwise("revisit"), F.lit("\r\nWARC-Record-ID: "), record_id(page, F.col("digest"))]
    head += [F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Payload-Digest: "), digest, F.when(col(id_col).isNotNull(), F.concat(F.lit("\r\nX-Page-ID: "), page)).otherwise("")]
    other = F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), record_id(name(F.col("original")), F.col("digest")), F.lit("\r\nX-Refers-To-Page: "), name(F.col("original")))
    head += [F.when(first, "").otherwise(other), F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block]
    return found.select(F.concat(*head).alias("value"))


def write(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> str:
    """Writes archives of pages and returns their folder (by default in the shared folder)."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    n = F.octet_length(col(payload_col).cast("binary"))
    size, most = pages.agg(F.coalesce(F.avg(F.when(n <= LARGE, n)), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    found = resolved(pages.select(*map(col, dict.fromkeys([id_col, url_col, payload_col]))), id_col, payload_col, min_bytes)
    kinds = [(F.col("n_bytes") <= LARGE, min(FILE_BYTES / (size + 600), MOST_BYTES / LARGE))]
    if most > LARGE:
        kinds.append((F.col("n_bytes") > LARGE, MOST_BYTES / most))
    for which, per_file in kinds:
        some = records(found.where(which), id_col, url_col, payload_col)
        some.write.option("lineSep", END).option("maxRecordsPerFile", max(1, int(per_file))).mode("append").text(path)
    return path


def parse(content: bytes):
    """(headers, block) of each record of an archive; header names in lower case."""
    at, end = 0, END.encode()
    while at < len(content):
        stop = content.index(end, at)
        version, *lines = content[at:stop].split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        heads = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
        at = stop + 4 + int(heads["content-length"])
        yield heads, memoryview(content)[stop + 4 : at]
        if content[at : at + 4] != end:
            raise ValueError(f"a record does not end at byte {at}")
        at += 4


def _rows(batches):
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for heads, block in parse(content.as_py()):
                digest = heads["warc-payload-digest"].partition(":")[2]
                n = None
                if heads["warc-type"] == "response":
                    payload = block[bytes(block[:4096]).index(END.encode()) + 4 :]
                    n = len(payload)
                    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{heads['warc-record-id']}: the payload does not have its digest")
                page, original = (None if x is None else unquote_plus(x) for x in map(heads.get, ("x-page-id", "x-refers-to-page")))
                rows.append((heads["warc-type"], page, heads["warc-record-id"], original, heads.get("warc-target-uri"), digest, n))
            names = [x.split()[0] for x in READ.split(", ")]
            kinds = [pa.string()] * 6 + [pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)


def read(spark, path: str) -> DataFrame:
    """The records of the archives of a folder, revisits with the length of their response's payload.

    One response per digest is enough for the join, however many archives hold it.
    """
    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_rows, READ)
    found = written(found, "records")
    known = found.where("record_type = 'response'").join(found.where("record_type = 'revisit'").select("digest").distinct(), "digest", "left_semi")
    known = known.groupBy("digest").agg(F.max("payload_bytes").alias("__n")).withColumnRenamed("digest", "__digest")
    joined = found.where("record_type = 'revisit'").join(known, F.col("digest") == F.col("__digest"), "left")
    return found.where("record_type = 'response'").unionByName(joined.withColumn("payload_bytes", F.col("__n")).drop("__n", "__digest"))


def deduplicated(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes pages as archives and reads them back, a row for each page.

    Null payloads are empty; null ids refer to the largest id of their payload, or are responses where there is
    none; rows that repeat the largest id are the same page and all responses. Line ends in a URL become spaces, ids
    come back as they are. Columns of pages besides the three are not read, whatever their names.
    """
    path = write(pages, None, id_col, url_col, payload_col, min_bytes)
    kind = dict(pages.dtypes)[id_col]
    found = read(pages.sparkSession, path)
    return found.withColumn("id", F.col("id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
