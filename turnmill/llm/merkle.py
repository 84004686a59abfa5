"""Operator 6: document fingerprints by a Merkle tree over sections, paragraphs and spans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A span ends at a word whose checksum is 0 modulo this, a section at a paragraph whose digest is.
SPAN, SECTION = 6, 8
#: Rows of one bucket of neighbouring ids, the most buckets (a larger table has larger ones, read as a stream from a
#: spilling sort), rows of the sample that a bucket's bounds are taken from, and words that a task remembers.
PER_BUCKET, MOST_BUCKETS, OF_SAMPLE, REMEMBER = 500, 20_000, 20, 200_000


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


@dataclass(frozen=True)
class Tree:
    """root: of the text; sections: (digest, its paragraphs' digests); spans: the leaves' digests with their lengths."""

    root: str
    sections: tuple[tuple[bytes, tuple[bytes, ...]], ...]
    leaves: dict[bytes, int]

    def likeness(self, other: Tree) -> float:
        """Shared leaf characters, twice, over the characters of both; 1 for equal roots."""
        if self.root == other.root:
            return 1.0
        few, many = sorted((self.leaves, other.leaves), key=len)
        total = sum(few.values()) + sum(many.values())
        return 2.0 * sum(min(n, many[d]) for d, n in few.items() if d in many) / total if total else 0.0

    def differing(self, other: Tree) -> list[int]:
        """Numbers of the paragraphs that ``other`` doesn't have; equal sections are passed over whole."""
        if self.root == other.root:
            return []
        theirs = {d for d, _ in other.sections}
        paragraphs = {p for _, ps in other.sections for p in ps}
        at, out = 0, []
        for d, ps in self.sections:
            out += [at + i for i, p in enumerate(ps) if p not in paragraphs] if d not in theirs else []
            at += len(ps)
        return out


def ends_here(word: str) -> bool:
    """Hangs on the word's letters alone, so that an edit moves no boundary but those beside it."""
    return (sum(map(ord, word[-3:])) + 7 * len(word)) % SPAN == 0


def tree(text: str, known: dict[str, bool] | None = None) -> Tree:
    """Paragraphs are lines; sections end at paragraphs, spans at words, that their own content picks."""
    known = {} if known is None else known
    leaves: dict[bytes, int] = {}
    sections: list[tuple[bytes, tuple[bytes, ...]]] = []
    open_section: list[bytes] = []
    for paragraph in text.split("\n"):
        span: list[str] = []
        parts: list[bytes] = []
        words = paragraph.split(" ")
        last = len(words) - 1
        for i, word in enumerate(words):
            span.append(word)
            end = known.get(word)
            if end is None:
                end = known[word] = ends_here(word)
            if end or i == last:
                leaf = " ".join(span)
                d = digest(leaf.encode("utf-8", "surrogatepass"))
                leaves[d] = leaves.get(d, 0) + len(leaf) + 1
                parts.append(d)
                span = []
        d = digest(b"p" + b"".join(parts))
        open_section.append(d)
        if d[0] % SECTION == 0:
            sections.append((digest(b"s" + b"".join(open_section)), tuple(open_section)))
            open_section = []
    if open_section:
        sections.append((digest(b"s" + b"".join(open_section)), tuple(open_section)))
    return Tree(digest(b"d" + b"".join(s for s, _ in sections)).hex(), tuple(sections), leaves)


def edited(text: str, following: str) -> str:
    """The last third (rounded down, in code points) replaced by as much of the start of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def bucket_of(bounds: list[tuple[int, int]]) -> Column:
    """How many of the sorted bounds aren't after a row's (k, h), by two steps of about the root of their number each."""
    step = max(1, round(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    lits = lambda pairs: F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(h).cast("long").alias("h")) for k, h in pairs])
    reached = lambda list_: F.size(F.filter(list_, lambda b: (b["k"] < F.col("k")) | ((b["k"] == F.col("k")) & (b["h"] <= F.col("h")))))
    if not parts:
        return F.lit(0)
    part = reached(lits([p[0] for p in parts]))
    return F.when(part == 0, 0).otherwise((part - 1) * step + reached(F.get(F.array(*map(lits, parts)), part - 1))).cast("int")


def neighbours(docs: DataFrame, id_col: str, text_col: str, per_bucket: int) -> DataFrame:
    """(bucket, guest, k, h, doc_id, text): buckets of rows that follow one another by descending id, then by the text's hash.

    k and h say the order. A bucket holds its own rows and, marked as guests, the first rows of the next one, so that
    every row's successor is at hand; the last bucket's guests are the very first rows. The bounds are quantiles of
    a sample of (k, h) by hash; what a bucket's first row is, is found over all rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    picked = docs.select(F.bitwise_not(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))).alias("k"), F.xxhash64(text).alias("h"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    places = picked.select("k", "h")
    cuts = min(MOST_BUCKETS, max(1, -(-(n := docs.count()) // per_bucket)))
    bounds: list[tuple[int, int]] = []
    if cuts > 1:
        every = max(1, n // (OF_SAMPLE * cuts))
        sample = places.where(F.pmod(F.xxhash64("k", "h", F.lit(3)), F.lit(every)) == 0).groupBy("k", "h").count().collect()  # about OF_SAMPLE rows a bucket
        rows, seen = sum(r["count"] for r in sample), 0
        for r in sorted(sample):
            if seen * cuts // rows > len(bounds):
                bounds.append((r.k, r.h))
            seen += r["count"]
    firsts = places.groupBy(bucket_of(bounds).alias("bucket")).agg(F.min(F.struct("k", "h")).alias("first")).orderBy("bucket").collect()  # one row a bucket
    own = picked.withColumn("bucket", bucket_of(bounds)).withColumn("guest", F.lit(False))
    if not firsts:
        return own
    to = [(r.first.k, r.first.h, firsts[i - 1].bucket) for i, r in enumerate(firsts)]  # the bucket before it, the last one for the first
    guests = docs.sparkSession.createDataFrame(to, "k long, h long, bucket int")
    guests = picked.join(F.broadcast(guests), ["k", "h"]).withColumn("guest", F.lit(True))  # MOST_BUCKETS rows at most
    return own.unionByName(guests)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = PER_BUCKET) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, differing) of every row.

    fingerprint is the hex root of the text's tree; the edited text has the last floor(n_chars / 3) code points
    replaced by the first as many of the next document by descending id (after the last comes the first).
    near_edited and near_next are the likeness of the tree to the edited text's and the next document's, from 0
    to 1; differing lists the paragraphs of the text that the edited one lacks.

    Nulls: a null text counts as empty; a null id sorts last and stays null. Rows of one id are ordered by the text's
    hash, identical rows follow one another (in one task, which holds two of them at a time). A lone row is its own successor. An empty table gives no rows. Texts of
    any length are read whole; a task holds two at a time.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, differing array<int>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, int | None, str]]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), (t.as_py() for t in batch.column(3)), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        out: list[tuple] = []
        now: tuple | None = None  # bucket, id, text, tree of the row that waits for its successor

        def done(nxt: str, nxt_tree: Tree) -> None:
            _, doc_id, text, own = now
            other = edited(text, nxt)
            t = tree(other, known)
            out.append((doc_id, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), own.root, t.root, own.likeness(t), own.likeness(nxt_tree), own.differing(t)))

        for bucket, guest, doc_id, text in rows(batches):
            if now is None and guest:
                continue
            t = tree(text, known)
            if now is not None:
                done(text, t)
            now = None if guest else (bucket, doc_id, text, t)
            if len(known) > REMEMBER:
                known.clear()
            if len(out) >= 500:
                yield as_batch(out)
                out = []
        if out:
            yield as_batch(out)

    def as_batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int32())]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "differing"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    dealt = neighbours(docs, id_col, text_col, per_bucket).repartition("bucket")
    sorted_rows = dealt.sortWithinPartitions("bucket", "guest", "k", "h", "text").select("bucket", "guest", "doc_id", "text")
    return sorted_rows.mapInArrow(run, schema)
