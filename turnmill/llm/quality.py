"""Operator 5: importance resampling by hashed n-gram models of target and raw text, drawn by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import saved, small_or_shuffled

#: Hash bins of the two bag-of-n-grams models, the share of rows drawn, and how many bins a refinement has.
BINS, SHARE, CUTS = 10_000, 0.8, 4_096
REMEMBER = 200_000


class Grams:
    """Bins of a text's words and word pairs, lower-cased."""

    def __init__(self, bins: int) -> None:
        self.bins = bins

        class Hashes(dict):
            def __missing__(self, word: str) -> int:
                h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
                return h

        self.known = Hashes()

    def of(self, text: str) -> np.ndarray:
        words = text.lower().split()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        if len(self.known) > REMEMBER:
            self.known.clear()
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        return (np.concatenate([h, pairs ^ (pairs >> np.uint64(29))]) % np.uint64(self.bins)).astype(np.int64)


def gram_counts(docs: DataFrame, bins: int) -> DataFrame:
    """(target, bin, n): how often each bin occurs in all rows (target false) and in the target's rows (true)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, totals = Grams(bins), np.zeros((2, bins), np.int64)
        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1), strict=True):
                n = np.bincount(grams.of(text.as_py()), minlength=bins)
                totals[0] += n
                if target.as_py():
                    totals[1] += n
        for kind in (0, 1):
            at = np.flatnonzero(totals[kind])
            yield pa.RecordBatch.from_arrays([pa.array([bool(kind)] * len(at), pa.bool_()), pa.array(at, pa.int32()), pa.array(totals[kind][at], pa.int64())], ["target", "bin", "n"])

    partial = docs.select("text", "target").mapInArrow(run, "target boolean, bin int, n long")
    return partial.groupBy("target", "bin").agg(F.sum("n").alias("n"))


def log_ratios(docs: DataFrame, bins: int) -> np.ndarray:
    """log p_target - log p_raw of each bin, add-one smoothed; ``2 * bins`` numbers at most come to the driver."""
    totals = np.ones((2, bins))
    for r in gram_counts(docs, bins).collect():
        totals[int(r.target), r.bin] += r.n
    p = np.log(totals / totals.sum(axis=1, keepdims=True))
    return p[1] - p[0]


def kth_largest(keys: DataFrame, k: int, most: int = 10_000) -> tuple[float, int] | None:
    """The k-th largest (key, id) of ``keys(key, id)``, by ever finer counts; never more than ``most`` rows are collected."""
    if k < 1:
        return None
    low, high, above = (*keys.agg(F.min("key"), F.max("key")).first(), 0)
    while low < high and keys.where(F.col("key").between(low, high)).count() > most:
        width = (high - low) / CUTS
        if low + width == low or high - width == high:
            break
        cell = F.least(F.floor((F.col("key") - low) / width), F.lit(CUTS - 1)).alias("cell")
        cells = keys.where(F.col("key").between(low, high)).groupBy(cell).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for c in sorted(cells, key=lambda c: -c.cell):
            if above + c.n >= k:
                low, high = c.low, c.high
                break
            above += c.n
    last = keys.where(F.col("key").between(low, high)).orderBy(F.desc("key"), F.desc("id")).limit(k - above).select(F.min(F.struct("key", "id"))).first()[0]
    return last.key, last.id


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = 11, bins: int = BINS) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, kept): kept marks the ``round(share * rows)`` rows drawn without replacement.

    Two bag-of-n-grams models (words and word pairs in ``bins`` hash bins) are counted over all rows: one of the
    rows that ``labels.quality`` confirms as good, one of everything. A row's log weight is the log of the
    models' ratio over its n-grams; adding seeded Gumbel noise and taking the largest keys draws in proportion
    to the weights. The noise hangs on the seed and the id alone.

    Nulls: a null text counts as empty, with log weight 0; a null id has noise of its own and counts as the
    smallest. Several labels of an id count as good if one is. Equal keys are ordered by id; rows that repeat an
    id at the cut are kept together. An empty table gives no rows; without labels all ratios are 0 up to smoothing.
    """
    good = labels.where("quality > 0").select(F.col("doc_id").alias("good_id")).distinct()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(good, F.col("doc_id") == F.col("good_id"), "left_semi").distinct(), "good")
    marked = base.join(small_or_shuffled(ids.withColumn("target", F.lit(True))), "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    ratio = log_ratios(marked, bins)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(bins)
        for batch in batches:
            w = [float(ratio[grams.of(t.as_py())].sum()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.float64())], ["doc_id", "log_weight"])

    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1))), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    scored = base.mapInArrow(weigh, "doc_id long, log_weight double").withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    scored = saved(scored, "weights")
    keys = scored.select(F.col("gumbel_key").alias("key"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))
    cut = kth_largest(keys, round(share * keys.count()))
    kept = F.lit(False) if cut is None else (F.col("gumbel_key") > cut[0]) | ((F.col("gumbel_key") == cut[0]) & (F.coalesce("doc_id", F.lit(-(1 << 63))) >= cut[1]))
    return scored.withColumn("kept", kept)
