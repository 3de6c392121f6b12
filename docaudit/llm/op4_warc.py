"""WARC archives: a record for each page, revisits of equal payloads, and an external merge of the index into capture histories.

Every record is a gzip member of its own, so offset and length of the index address it in its file. The rows of a file,
sorted, are a run of the index. Runs are written to the shared folder and cut by ranges of the key; each range gets a
slice of every run that has rows there, and merges the slices k ways by a loser tree. Ranges hold a bounded number of
rows and follow one another, so the histories are in global order and no task's memory grows with the index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.llm.common import Workspace, read, small_batches
from docaudit.llm.loser_tree import merged

# Line ends of the format, the profile of a revisit, the alphabet of base32.
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payload bytes of an archive file on average, and records of one at most; a task reads a file at once.
FILE_BYTES, FILE_RECORDS = 64 << 20, 100_000
#: Index rows of a range that a task merges, some 300 bytes each.
MERGE_ROWS = 200_000
INDEX = "url_key string, captured string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long, length long"
#: Page n is captured so many seconds after this time where a table has no times.
EPOCH = 1_700_000_000
#: The last byte of a gzip member is the highest of the content's length, which is this one below 16 MiB.
MEMBER_END = "\0"


def base32_sha1(data: Column) -> Column:
    digest = F.sha1(data)

    def letters(i: Column) -> Column:
        v = F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letters), "")


def plan_records(ws: Workspace, pages: DataFrame, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """pages (page_id, url, payload, captured) with payload_bytes, payload_digest and refers_to, dealt out in partitions of about file_bytes.

    Of pages with equal payloads of at least min_bytes bytes, refers_to of all but the smallest page_id is that page_id.
    Digests alone are grouped, and joined as written tables, which adaptive execution splits where one payload is hot;
    payloads are dealt out by page and digest, so that copies do not meet in one task.
    """
    data = F.col("payload").cast("binary")
    rows = pages.withColumns({"payload_bytes": F.octet_length(data).cast("long"), "payload_digest": base32_sha1(data)})
    keys = ["page_id", "payload_digest", "payload_bytes"]
    digests = ws.keep(rows.select(*keys), "digests")
    firsts = ws.keep(digests.filter(F.col("payload_bytes") >= min_bytes).groupBy(*keys[1:]).agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").drop("last"), "firsts")
    revisits = ws.keep(digests.join(firsts, keys[1:]).filter("page_id <> first").select(*keys, F.col("first").alias("refers_to")).distinct(), "revisits")
    total = digests.agg(F.sum("payload_bytes")).first()[0] or 0
    parts = max(-(-total // file_bytes), int(ws.spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *keys).join(revisits.hint("shuffle_hash"), keys, "left")


def _record(r: str = "record") -> Column:
    """A record without the two line ends that follow it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(CRLF),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Date", F.col("captured")),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    return F.concat(head, block).alias(r)


@F.pandas_udf(T.BinaryType())
def _member(records: pd.Series) -> pd.Series:
    """Each record as a gzip member without its last byte; from 16 MiB on an empty member follows, so that MEMBER_END is right."""

    def packed(record: str) -> bytes:
        data = record.encode("utf-8")
        return (gzip.compress(data, 6, mtime=0) + (gzip.compress(b"", mtime=0) if len(data) >> 24 else b""))[:-1]

    return records.map(packed)


def write_archives(ws: Workspace, pages: DataFrame, name: str, min_bytes: int = 0, file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES) -> None:
    """WARC files, a gzip member for each record, in the table `name` of ws, which any Spark file system can hold.

    pages has page_id, url and html, and captured (ISO 8601 text) or none; other columns are not read. Null html is an
    empty payload, a null url an empty one; rows without a page_id are left out. A page_id that repeats is written again
    for each row. Files are bounded by file_records, and by file_bytes of payload on average.
    """
    small_batches(ws.spark)
    captured = F.coalesce(F.col("captured"), F.lit("")) if "captured" in pages.columns else F.date_format(F.timestamp_seconds(F.col("page_id") % 1_000_000_000 + EPOCH), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.filter("page_id IS NOT NULL").select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"), captured.alias("captured"))
    out = plan_records(ws, rows, min_bytes, file_bytes).select(F.concat(_record(), F.lit(CRLF + CRLF)).alias("record"))
    # Spark's text writer writes strings as the bytes they are.
    out.select(_member("record").cast("string").alias("member")).write.mode("overwrite").option("lineSep", MEMBER_END).option("compression", "none").option("maxRecordsPerFile", file_records).text(ws.path(name))


def url_key(url: str) -> str:
    """Host labels from the last to the first, then path and query, in lower case, without scheme, user, port 80 or 443, www and fragment."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^#]*)", url.lower())
    if not m:
        return url.lower().partition("#")[0]
    host = re.sub(r"^www\d*\.|:(?:80|443)$", "", m[1])
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + (m[2] or "/")


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member that is not empty, one after another."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, pos, parts = zlib.decompressobj(wbits=31), at, []
        while not member.eof:
            if pos >= len(view):
                raise ValueError(f"the member at byte {at} does not end")
            parts.append(member.decompress(view[pos : pos + 8_192]))
            pos = min(pos + 8_192, len(view))
        end = pos - len(member.unused_data)
        if content := b"".join(parts):
            yield at, end - at, content
        at = end


def record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record."""
    if data[:5] != b"WARC/":
        raise ValueError("no record")
    end = data.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in data[:end].decode("utf-8").split(CRLF)[1:])
    start, size = end + 4, int(head["Content-Length"])
    if data[start + size :] != b"\r\n\r\n":
        raise ValueError("the record does not end where its length says")
    return head, data[start : start + size]


#: File and offset make the key of every row its own, so that ranges can be cut anywhere.
_ORDER = ("url_key", "captured", "page_id", "file", "offset")


def _page(urn: str) -> int:
    return int(urn[len("<urn:page:") : -1])


def _index(file: str, data: bytes) -> list[tuple]:
    """The records of one archive in the order of the index: a sorted run."""
    rows = []
    for offset, length, content in members(data):
        head, block = record(content)
        http, _, payload = block.partition(b"\r\n\r\n")
        digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(http.rpartition(b"Content-Length: ")[2])
        revisit = head["WARC-Type"] == "revisit"
        if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"{file}: the payload at byte {offset} is not what its digest says")
        url = head["WARC-Target-URI"]
        rows.append((url_key(url), head["WARC-Date"], _page(head["WARC-Record-ID"]), url, head["WARC-Type"], size, digest, _page(head["WARC-Refers-To"]) if revisit else None, file, offset, length))
    return sorted(rows, key=lambda r: (*r[:3], r[9]))


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"refers_to": "Int64"})


NAMES = [c.split()[0] for c in INDEX.split(", ")]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The index of the archives under path: a row for each record, and one sorted run for each file; digests are verified."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                rows = _index(file.rpartition("/")[2], data)
                for k in range(0, len(rows), 10_000):
                    yield _frame(rows[k : k + 10_000], NAMES)

    small_batches(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, INDEX)


def merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one range in the order of the index, and runs, the number of slices they came in.

    A slice goes on as long as rows come from one file and in order.
    """
    got = list(batches)
    if not got:
        return
    rows = pa.Table.from_batches(got).combine_chunks()
    keys = list(zip(*[rows[c].to_pylist() for c in _ORDER], strict=True))
    cuts = [0, *[k for k in range(1, len(keys)) if keys[k][3] != keys[k - 1][3] or keys[k] < keys[k - 1]], len(keys)]
    slices = [iter(range(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    order = pa.array(merged(slices, keys.__getitem__), pa.int64())
    out = rows.take(order).append_column("runs", pa.array([len(slices)] * len(keys), pa.int32()))
    yield from out.to_batches(max_chunksize=10_000)


def merge_index(ws: Workspace, runs: DataFrame, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """The rows of runs in global order of URL key, time and page, with runs (slices merged in the row's range).

    Partitions hold ranges of keys, one after another, of about merge_rows rows each. A URL with a third of all captures
    is cut by time and page into many ranges; repeated pages are cut by file and offset.
    """
    kept = ws.keep(runs, "runs")  # the ranges are sampled from it
    parts = max(1, -(-kept.count() // merge_rows), int(ws.spark.conf.get("spark.sql.shuffle.partitions")))
    return kept.repartitionByRange(parts, *_ORDER).mapInArrow(merge_range, f"{INDEX}, runs int")


def archive_pages(pages: DataFrame, min_bytes: int = 0, file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pages written as WARC archives to the shared folder, read back, and their index in capture order."""
    ws = Workspace(pages.sparkSession, "warc")
    write_archives(ws, pages, "archives", min_bytes, file_records, file_bytes)
    return merge_index(ws, read_archives(ws.spark, ws.path("archives")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_pages(read(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, octet_length(encode(p.html)) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, CAST(1 + (i // 4) * 5 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p JOIN f ON p.html = f.html
"""
