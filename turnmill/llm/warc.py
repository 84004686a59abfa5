"""Operator 4: WARC archives of pages, and an index of their captures merged from sorted runs."""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm.common import fresh_path, saved, small_or_shuffled

#: Payloads of at least so many bytes are written once and then referred to.
LEAST_BYTES = 0
#: No archive file grows beyond this many bytes (unless one record does). Records are written by classes of size, each
#: some times as large as the one before, so that a table's longest page leaves the files of the others full.
FILE_BYTES, FIRST_CLASS, CLASS_STEP = 64 << 20, 16 << 10, 16
#: Captures of one range of the merged index.
PER_RANGE = 50_000
END = "\r\n\r\n"


class LoserTree:
    """Merges sorted lists: inner node i holds the loser of its match, node 0 the winner; a step replays one path."""

    def __init__(self, runs: list[list], key: Callable) -> None:
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.heads = [key(r[0]) if r else None for r in runs]
        self.nodes = [-1] * max(1, self.k)
        for run in range(self.k):
            self.replay(run)

    def beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def replay(self, run: int) -> None:
        winner, node = run, (run + self.k) // 2
        while node > 0:
            other = self.nodes[node]
            if other < 0:  # while the tree is filled: wait here for the other side
                self.nodes[node] = winner
                return
            if self.beats(other, winner):
                self.nodes[node], winner = winner, other
            node //= 2
        self.nodes[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.heads[run := self.nodes[0]] is not None:
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            left = self.runs[run][self.at[run]:self.at[run] + 1]
            self.heads[run] = self.key(left[0]) if left else None
            self.replay(run)


def url_key(url: str) -> str:
    """The host's labels reversed, then path and query: captures of a site sort together."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.strip().lower()
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + port + ")" + path.lower()


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1, five hex digits (four letters) at a time."""
    hexed = F.sha1(data)
    four = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*four), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, captured: Column | None = None, least_bytes: int = LEAST_BYTES) -> None:
    """One record for each row of ``pages``, into files of concatenated WARC/1.1 records under ``path``.

    Of equal payloads of at least ``least_bytes`` bytes, that of the smallest page_id is a response; the others
    are revisits, without a block, that refer to it. ``captured`` is the time, by default page_id seconds into 2024.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    when = captured if captured is not None else F.timestamp_seconds(F.coalesce(F.col("page_id"), F.lit(0)) % 31_536_000 + 1_704_067_200)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.regexp_replace("url", r"[\x00-\x1F\x7F]", ""), F.lit("")).alias("url"), html.alias("html"),
                        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.octet_length(html).alias("bytes"), base32_sha1(html.cast("binary")).alias("digest"))
    copies = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    size_class = F.greatest(F.lit(0), F.ceil(F.log(F.col("bytes") / FIRST_CLASS) / math.log(CLASS_STEP))).cast("int")
    rows = rows.withColumn("class", F.when(F.col("bytes") > FIRST_CLASS, size_class).otherwise(0))
    classes = [r["class"] for r in rows.select("class").distinct().collect()]  # a handful
    rows = rows.join(small_or_shuffled(copies), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    uid = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", F.coalesce(uid(F.col("page_id")), F.lit("<urn:page:>"))),
        line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(again, line("WARC-Refers-To", uid(F.col("first")))).otherwise(""), F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.when(again, "0").otherwise(F.col("bytes").cast("string")), F.lit(END), F.when(again, "").otherwise(F.col("html")),
    )
    for c in sorted(classes) or [0]:
        per_file = max(1, FILE_BYTES // (FIRST_CLASS * CLASS_STEP**c + 1000))
        of_class = rows.where(F.col("class") == c).select(record.alias("value"))
        of_class.write.mode("append").option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


def records(content: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """(offset, headers, block) of each record; the block's length is what its header says, whatever bytes it has."""
    at, view = 0, memoryview(content)
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        n = int(headers["Content-Length"])
        yield at, headers, view[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The captures of the archives under ``path``, each file's sorted by URL key, time and page: one run a file.

    A response's length and digest are computed from its block and checked against the headers.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured_at string, archive string, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = lambda s: int(s[10:-1]) if len(s) > 11 else None
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                out = []
                for at, h, block in records(content.as_py()):
                    digest, n = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                    if h["WARC-Type"] == "response":
                        found = base64.b32encode(hashlib.sha1(block).digest()).decode()
                        if (found, len(block)) != (digest, n):
                            raise ValueError(f"{name}: the record at byte {at} doesn't match its digest")
                    out.append((page(h["WARC-Record-ID"]), n, digest, h["WARC-Type"], page(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None, url_key(h["WARC-Target-URI"]), h["WARC-Date"], name.as_py(), at))
                out.sort(key=order_of)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)], NAMES) if out else pa.RecordBatch.from_arrays([pa.array([], k) for k in KINDS], NAMES)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(run, schema)


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "archive", "offset"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]


def order_of(row: tuple) -> tuple:
    """URL key, time, page; a missing page comes first."""
    return row[5], row[6], -1 if row[0] is None else row[0], row[7], row[8]


def merge_captures(captures: DataFrame) -> DataFrame:
    """``captures`` in global order of URL key, time and page, with (index_part, index_pos) as their places.

    Ranges of the order, of about ``PER_RANGE`` captures whatever the table's size, go to tasks, also within one URL;
    each task merges its slices of the runs, one for each archive, by a loser tree and passes the winners on.
    """
    fields = ", ".join(f"{n} {t}" for n, t in captures.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs.setdefault(row[7], []).append(row)
        part, merged, at = TaskContext.get().partitionId(), iter(LoserTree(list(runs.values()), order_of)), 0
        while rows := list(islice(merged, 5_000)):
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(rows), pa.int32()), pa.array(range(at, at + len(rows)), pa.int64())], [*NAMES, "index_part", "index_pos"])
            at += len(rows)

    order = ["url_key", "captured_at", "page_id", "archive", "offset"]
    captures = saved(captures.select(*NAMES), "captures")
    dealt = captures.repartitionByRange(max(1, -(-captures.count() // PER_RANGE)), *order).sortWithinPartitions("archive", *order)
    return dealt.mapInArrow(run, f"{fields}, index_part int, index_pos long")


def archive_pages(pages: DataFrame, path: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as WARC files, reads them back and returns the merged index.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured_at, archive, offset,
    index_part, index_pos), one row for each page; lengths and digests are those of the full payload.

    Nulls: a null html is the empty payload, a null url the empty one; a null page_id is never referred to unless
    all copies lack one, and then all are responses. Rows that repeat the response's page_id and payload are
    responses too. Other columns are ignored; an empty table gives no rows. Texts of any length and with any
    characters, record separators included, come back as written.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_warc(pages, path, least_bytes=least_bytes)
    return merge_captures(read_warc(spark, path))


#: Base32 by 40 digits of five bits, from the hex digits of the SHA-1.
ORACLE = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, octet_length(encode(h)) AS n, sha1(h) AS x FROM p),
f AS (SELECT x, min(page_id) AS first FROM d GROUP BY x)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
    ((instr('0123456789abcdef', substr(x, CAST(1 + (5 * i) // 4 AS BIGINT), 1)) - 1) * 16 + greatest(0, instr('0123456789abcdef', substr(x || '0', CAST(2 + (5 * i) // 4 AS BIGINT), 1)) - 1))
    >> CAST(3 - (5 * i) % 4 AS BIGINT)) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN d.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id <> f.first THEN f.first END AS refers_to
FROM d JOIN f USING (x)
"""
