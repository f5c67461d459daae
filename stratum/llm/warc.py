"""WARC archives of pages, and their index by external merge.

``write_archives`` writes one WARC/1.1 record a page (gzip, one member a file) to the shared folder, a
payload that occurs again as a revisit record.  ``read_archives`` reads the files back and yields one
sorted run of captures for each.  ``merge_index`` range-partitions the runs by (URL key, timestamp,
page) and merges what each partition gets of every run with a loser tree, which gives the captures in
global order: the partitions, in order, hold ascending keys, and ``capture_order`` counts the captures
through all of them from 0 without gaps.

Records are text in UTF-8, so Spark's text writer writes them with the record separator as line
separator; nothing opens a file by a local path.  A file takes as many records as make ARCHIVE_BYTES by the
mean size, and a task reads one file at a time as a whole: what a reader needs is the largest file, which
grows with the longest pages that stand in it.

Defined results: a null html is the empty payload; a null URL leaves out the target header and sorts
first; white space and control characters in URLs are percent-encoded; repeated rows give one record
each, and where several rows share the largest page_id of a payload all of them are responses; an empty
table gives an empty index; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, materialize, scratch_path, table

CRLF = "\r\n"
SEPARATOR = CRLF * 2
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:x-page:"
#: Payload bytes of one archive file, and captures of one merge partition, about.
ARCHIVE_BYTES, MERGE_ROWS = 32 << 20, 50_000
#: Start of the capture clock of pages that carry no capture time.
CLOCK = 1_704_067_200
CAPTURE = "url_key string, ts string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, position long"


def base32_of_hex(digest: Column) -> Column:
    """RFC 4648 base32 of a hexadecimal digest of 40 digits: 5 of them make 4 letters."""

    def letter(i: Column) -> Column:
        group = F.conv(F.substring(digest, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
        place = F.floor(group / F.pow(F.lit(32), 3 - i % 4)).cast("int") % 32
        return F.substring(F.lit(ALPHABET), place + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def _safe_url(url: Column) -> Column:
    out = url
    for c in "\t\n\x0b\x0c\r ":
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def write_archives(pages: DataFrame, least_bytes: int = 0, captured: Column | None = None) -> str:
    """Write ``pages`` (page_id, url, html) as WARC files; their folder.  Payloads of fewer than ``least_bytes`` are never revisits."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    size = F.octet_length(payload)
    when = captured if captured is not None else F.timestamp_seconds(F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9)) + CLOCK)
    rows = pages.select("page_id", "url", "html", F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    rows = rows.withColumn("digest", F.sha1(F.encode(payload, "UTF-8")))
    repeated = rows.filter(size >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = materialize(repeated, "warc-repeated")
    rows = rows.join(repeated, "digest", "left")
    revisit = F.coalesce(F.col("newest") != F.col("page_id"), F.lit(False)) | (F.col("newest").isNotNull() & F.col("page_id").isNull())

    def urn(page: str) -> Column:
        return F.concat(F.lit(f"<{PAGE_URN}"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(">"))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(SEPARATOR))
    body = F.when(revisit, http).otherwise(F.concat(http, payload))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), urn("page_id"), F.lit(f"{CRLF}WARC-Date: "), F.col("date"),
        F.coalesce(F.concat(F.lit(f"{CRLF}WARC-Target-URI: "), _safe_url(F.col("url"))), F.lit("")),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Refers-To: "), urn("newest"), F.lit(f"{CRLF}WARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(SEPARATOR), body,
    )
    mean = rows.agg(F.avg(size)).first()[0] or 1
    path = scratch_path(spark, "warc")
    rows.select(record.alias("value")).write.option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(ARCHIVE_BYTES // (mean + 600)))).text(path)
    return path


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then path and query."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return f"{key}){parts.path.lower() or '/'}" + (f"?{parts.query.lower()}" if parts.query else "")


def records(data: bytes) -> Iterator[tuple[dict[str, str], memoryview, int]]:
    """Headers, block and position of each record of one archive file, gzip or not."""
    if data[:2] == b"\x1f\x8b":
        out = []
        while data:
            d = zlib.decompressobj(31)
            out.append(d.decompress(data))
            data = d.unused_data
        data = b"".join(out)
    view, at, n = memoryview(data), 0, len(data)
    while at < n:
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        yield headers, view[end + 4 : end + 4 + size], at
        at = end + 4 + size + 4


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix(f"<{PAGE_URN}").removesuffix(">")
    return int(text) if text else None


def captures(data: bytes, archive: str) -> list[tuple]:
    """The captures of one file as a run in order; payloads are held against their digests."""
    out = []
    for headers, block, at in records(data):
        raw = bytes(block)
        head, _, payload = raw.partition(b"\r\n\r\n")
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        size = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
        if headers["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"payload of the record at {at} of {archive} differs from its digest")
        url = headers.get("warc-target-uri")
        ts = "".join(c for c in headers["warc-date"] if c.isdigit())
        out.append((url_key(url), ts, _page(headers["warc-record-id"]), url, headers["warc-type"], _page(headers.get("warc-refers-to")), size, digest, archive, at))
    return sorted(out, key=order)


def order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


_KINDS = {"string": pa.string(), "long": pa.int64()}
_NAMES = [x.split()[0] for x in CAPTURE.split(", ")]
_TYPES = [_KINDS[x.split()[1]] for x in CAPTURE.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all files below ``path``; those of one file are one sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                rows = captures(data.as_py(), name.as_py().rpartition("/")[2])
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(run, CAPTURE)


class LoserTree:
    """K-way merge of sorted runs: each inner node keeps the loser of its match, the winner moves up."""

    def __init__(self, runs: Iterable[Iterable[tuple]], key=order):
        self.sources = [iter(r) for r in runs]
        self.key, self.k = key, max(1, len(self.sources))
        self.heads: list[tuple | None] = [None] * self.k  # (key, source, row); None once a run has ended
        for i in range(len(self.sources)):
            self._advance(i)
        self.losers = [-1] * self.k
        self.winner = self._build(1)

    def _advance(self, i: int) -> None:
        row = next(self.sources[i], None)
        self.heads[i] = None if row is None else (self.key(row), i, row)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] <= y[:2])

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if self._before(a, b):
            self.losers[node] = b
            return a
        self.losers[node] = a
        return b

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.winner]) is not None:
            yield head[2]
            i = self.winner
            self._advance(i)
            node = (i + self.k) // 2
            while node:
                if self._before(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def merge_index(runs: DataFrame, rows_per_partition: int = MERGE_ROWS) -> DataFrame:
    """``runs`` in global order of (url_key, ts, page_id), with ``capture_order``."""
    runs = materialize(runs, "warc-runs")
    parts = max(1, -(-runs.count() // rows_per_partition))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(row[8], []).append(row)
        merged, part = list(LoserTree(held.values())), TaskContext.get().partitionId()
        for at in range(0, len(merged), 10_000):
            rows = merged[at : at + 10_000]
            places = [pa.array([part] * len(rows), pa.int64()), pa.array(range(at, at + len(rows)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*_batch(rows).columns, *places], [*_NAMES, "part", "place"])

    dealt = runs.repartitionByRange(parts, "url_key", "ts", "page_id", "archive", "position").sortWithinPartitions("archive", "url_key", "ts", "page_id", "position")
    merged = materialize(dealt.mapInArrow(run, f"{CAPTURE}, part long, place long"), "warc-index")
    discard(runs)
    # One row a partition, so the running sum sees rows_per_partition times fewer rows than there are captures.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = merged.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("first"))
    return merged.join(starts, "part").select(*_NAMES, (F.col("first") + F.col("place")).alias("capture_order"))


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives, read them back and merge their index."""
    return merge_index(read_archives(pages.sparkSession, write_archives(pages, least_bytes)))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "capture_order")


#: For pages with an id of their own each, and URLs of host, path and query.
ORACLE_SQL = f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS newest,
  lower(regexp_extract(url, '^[^/?#]*://([^/?#]*)', 1)) AS host, lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)) AS path, lower(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1)) AS args,
  strftime(make_timestamp((page_id % 1000000000 + {CLOCK}) * 1000000), '%Y%m%d%H%M%S') AS ts FROM p),
k AS (SELECT *, CASE WHEN url = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END
  || CASE WHEN args = '' THEN '' ELSE '?' || args END END AS url_key FROM q)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{ALPHABET}', CAST((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) % 32 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = newest THEN NULL ELSE newest END AS refers_to,
  url_key, ts, row_number() OVER (ORDER BY url_key, ts, page_id) - 1 AS capture_order FROM k"""
