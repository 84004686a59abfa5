"""Operator 9: toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import saved, small_or_shuffled

#: The documented bound of the labelled rows that are fitted: toxic ones. Words that fewer of all toxic documents hold aren't tried.
MAX_TOXIC, LEAST_TOXIC = 6_000, 3
FOLDS = 5
#: Weights of the penalties on the sum of weights (while words are picked) and on half the sum of their squares (while
#: the picked ones are fitted), as multiples of the class prior: the gradients that they stand against shrink with
#: the prior, so a word is judged by its shares alone, however rare the toxic class is.
PICK, KEEP = 9e-3, 1e-3
#: No word alone takes a text from the prior to odds of more than e to this.
MOST_ODDS = 4.0
WORD = re.compile(r"[^\W_]+")
#: A word is tried if so many times as large a share of the toxic documents hold it as of the others.
LIFT = 1.5
#: Standard errors by which an estimate may be on the wrong side by chance.
ERRORS = 2.0


@dataclass(frozen=True)
class Model:
    """score = sigmoid(bias + sum of the weights of the distinct known words)."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        found = set(WORD.findall(text.lower())) & self.weights.keys()
        return float(1 / (1 + np.exp(-(self.bias + sum(self.weights[w] for w in sorted(found))))))


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


#: The word numbers of all rows in a row, where each row starts, and how many documents each row stands for.
Side = tuple[np.ndarray, np.ndarray, np.ndarray]


def tied_bias(sums: np.ndarray, prior: float, times: np.ndarray | None = None) -> float:
    """The bias at which the mean score of rows with these sums of weights is the prior, by bisection."""
    low, high = -40.0 - float(sums.max(initial=0.0)), 40.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.average(1 / (1 + np.exp(-np.clip(sums + mid, -40, 40))), weights=times) < prior else (low, mid)
    return (low + high) / 2


def negative_part(toxic: np.ndarray, other: np.ndarray, prior: float, prior_error: float, n_p: np.ndarray, n_u: np.ndarray) -> tuple[float, float]:
    """E_other[l(-)] - prior * E_toxic[l(-)] of the margins, l being the logistic loss, and its standard error; ``n_p`` and ``n_u`` count each margin's documents."""
    p, u = np.logaddexp(0, toxic), np.logaddexp(0, other)
    mean_p, mean_u = np.average(p, weights=n_p), np.average(u, weights=n_u)
    var_p, var_u = np.average((p - mean_p) ** 2, weights=n_p), np.average((u - mean_u) ** 2, weights=n_u)
    error = np.sqrt(var_u / n_u.sum() + prior**2 * var_p / n_p.sum() + (mean_p * prior_error) ** 2)
    return float(mean_u - prior * mean_p), float(error)


def nnpu(toxic: tuple, other: tuple, n_words: int, prior: float, prior_error: float = 0.0, epochs: int = 200, rate: float = 0.1, l1: float = 0.0, l2: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights, none below 0 or above what ``MOST_ODDS`` allows, and the bias of least class-prior-corrected risk, by proximal Adam steps.

    Each side is a ``Side``; without counts each row is one document. The risk is prior * E_toxic[l(+)] plus
    ``negative_part``, plus ``l1`` * prior times the sum of the weights and ``l2`` * prior / 2 times that of their
    squares. The negative part of a true risk is never below 0: where its estimate is, by more than ``ERRORS`` standard
    errors, chance was fitted, and its gradient alone is followed upwards. The bias is tied to the weights: the mean
    score of the unlabelled rows is the prior, as at the least of the risk, so it can't drift, and a text without a
    known word scores the prior at most. The iterate of least risk among those that aren't below 0 so far is returned,
    not the last one.
    """
    w, most = np.zeros(n_words), MOST_ODDS - float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_words), np.zeros(n_words)
    best = (np.inf, w, float(np.log(prior / (1 - prior))))
    n_p, n_u = (side[2] if len(side) > 2 else np.ones(len(side[1]) - 1) for side in (toxic, other))

    def sums(side: tuple) -> np.ndarray:
        words, starts = side[:2]
        total = np.concatenate([[0.0], np.cumsum(w[words])])
        return total[starts[1:]] - total[starts[:-1]]

    def pulled(side: tuple, g: np.ndarray) -> np.ndarray:
        words, starts = side[:2]
        return np.bincount(words, np.repeat(g, np.diff(starts)), n_words)

    for t in range(1, epochs + 1):
        s_p, s_u = sums(toxic), sums(other)
        b = tied_bias(s_u, prior, n_u)
        negative, error = negative_part(s_p + b, s_u + b, prior, prior_error, n_p, n_u)
        sound = negative >= -ERRORS * error
        risk = prior * float(np.average(np.logaddexp(0, -s_p - b), weights=n_p)) + negative + prior * float(l1 * w.sum() + l2 / 2 * (w * w).sum())
        if sound and risk < best[0]:
            best = (risk, w.copy(), b)
        p, u = (1 / (1 + np.exp(-np.clip(s + b, -40, 40))) for s in (s_p, s_u))
        down = pulled(other, n_u * u / n_u.sum()) - pulled(toxic, prior * n_p * p / n_p.sum())
        grad = pulled(toxic, prior * n_p * (p - 1) / n_p.sum()) + down + prior * (l1 + l2 * w) if sound else -down
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = np.clip(w - rate * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8 * prior), 0, most)
    return best[1], best[2]


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """A batch's rows in smaller batches, so that only their words are held at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        rows = [sorted(set(WORD.findall(t.as_py().lower()))) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], ["toxic", "words"])


def clear_words(rows: DataFrame, prior: float) -> list[str]:
    """The words worth a weight, in order: held by at least ``LEAST_TOXIC`` confirmed toxic documents, and by a clearly larger share of them than of the clean ones.

    ``rows`` (toxic, text) are all training documents; counts are over all of them. Larger means ``LIFT`` times, and by so
    much that no word of all that are tried would reach it by chance: the likelihood ratio of two shares against one
    is above the number of distinct words of all training documents, by a sketch. The clean documents' share is that of the ones which aren't confirmed as toxic,
    less what toxic ones among them bring by the prior, of which a standard error is spared.
    """
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_p, n_free = max(1, sizes.get(True, 0)), max(1, sizes.get(False, 0))
    each = lambda some: some.select("toxic", "text").mapInArrow(distinct_words, "toxic boolean, words array<string>").select(F.explode("words").alias("word"))
    held = saved(each(rows.where("toxic")).groupBy("word").agg(F.count("*").alias("p")).where(F.col("p") >= LEAST_TOXIC), "toxic-words")
    others = each(rows.where("NOT toxic")).join(small_or_shuffled(held.select("word")), "word", "left_semi").groupBy("word").agg(F.count("*").alias("u"))
    counts = saved(held.join(others, "word", "left").withColumn("u", F.coalesce("u", F.lit(0))), "word-counts")
    hidden = max(0.0, prior * (n_p + n_free) - n_p)  # toxic rows among those that aren't confirmed
    tried = max(2, each(rows).agg(F.approx_count_distinct("word", 0.02)).first()[0])
    n_c = max(1.0, n_free - hidden)
    share = F.col("p") / n_p
    clean = F.greatest(F.lit(0.0), F.col("u") - hidden * share + F.least(F.sqrt(hidden * share), hidden * share))
    of_clean, of_both = F.least(F.lit(1.0), clean / n_c), F.least(F.lit(1.0), (F.col("p") + clean) / (n_p + n_c))
    times_log = lambda n, x: F.when(n > 0, n * F.log(x)).otherwise(0.0)
    fit = lambda k, n, x: times_log(k, x) + times_log(n - k, F.greatest(F.lit(1e-12), 1 - x))
    clear = fit(F.col("p"), F.lit(n_p), share) + fit(clean, F.lit(n_c), of_clean) - fit(F.col("p"), F.lit(n_p), of_both) - fit(clean, F.lit(n_c), of_both)
    likely = counts.where((share >= LIFT * of_clean) & (clear >= float(np.log(tried))))
    return [r.word for r in likely.orderBy(F.desc("p"), "word").collect()]


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, seed: int = 5) -> Model:
    """A model from the confirmed toxic rows and unlabelled text, both outside the held-out fold.

    The class prior is the share of toxic rows among all labelled training rows. Words are picked by ``clear_words`` from
    counts over all training documents. The fit is over at most ``max_toxic`` toxic documents, those with the smallest
    seeded hashes, and over the same share of all training documents, the toxic ones included, so that they hold the
    prior's share of toxic ones as the risk assumes. That share follows from the labelled rows alone and is all of
    them while there are ``max_toxic`` toxic ones or fewer. Documents with the same picked words are one row with their number, so
    what reaches the driver grows with the kinds of documents. Labels of 0 enter as unlabelled text and in the
    prior. Without a toxic row, or without a word that is clear enough, every score is the prior.
    """
    kept = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = kept.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0))).first()
    prior = (n_toxic + 0.5) / (n + 1)
    error = float(np.sqrt(prior * (1 - prior) / (n + 1)))
    known = docs.select("doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    confirmed = saved(kept.where("toxic > 0").select("doc_id", F.lit(True).alias("toxic")), "toxic-ids")
    rows = known.join(small_or_shuffled(confirmed), "doc_id", "left").withColumn("toxic", F.coalesce("toxic", F.lit(False)))
    vocabulary = clear_words(rows, prior)
    number = {word: i for i, word in enumerate(vocabulary)}
    if not vocabulary:
        return Model({}, float(np.log(prior / (1 - prior))))
    share = min(1.0, max_toxic / max(1, n_toxic))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) < F.lit(int(share * (1 << 52))))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [sorted({number[w] for w in WORD.findall(t.as_py().lower()) if w in number}) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["toxic", "at"])

    kinds = drawn.select("toxic", "text").mapInArrow(numbered, "toxic boolean, at array<int>").groupBy("at").agg(F.count_if("toxic").alias("p"), F.count("*").alias("u"))
    found = sorted((r.at, r.p, r.u) for r in kinds.collect())  # in order, so no sum hangs on the partitions
    sides = []
    for count in (1, 2):
        some = [r for r in found if r[count]]
        sides.append((np.array([i for r in some for i in r[0]], np.int64), np.cumsum([0, *(len(r[0]) for r in some)]), np.array([r[count] for r in some], float)))
    w, b = np.zeros(len(vocabulary)), float(np.log(prior / (1 - prior)))
    if all(len(side[2]) for side in sides):
        w, b = nnpu(*sides, len(vocabulary), prior, error, l1=PICK)  # the penalty on the sum picks the words
        used = np.flatnonzero(w > 0)
        to = np.full(len(vocabulary), -1)
        to[used] = np.arange(len(used))
        narrow = [(to[words][(on := to[words] >= 0)], np.concatenate([[0], np.cumsum(on)])[starts], times) for words, starts, times in sides]
        w[:] = 0
        w[used], b = nnpu(*narrow, len(used), prior, error, epochs=600, l2=KEEP)  # and their weights are fitted without it
    return Model({word: float(w[i]) for word, i in number.items() if w[i]}, b)


def toxicity_scores(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    A score sees the text alone. Nulls: a null text is scored as the empty one, by the bias alone; a null id is
    held out if the empty text's checksum says so. Repeated rows repeat; other columns are ignored; empty
    documents give no rows; without labels all scores are the smoothed prior.
    """
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [model.score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], ["doc_id", "held_out", "score"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return picked.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more; same columns, order of columns kept."""
    model = train(docs, labels)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py() or "") for t in texts], pa.float64())

    return docs.where(score(F.col("text").cast("string")) < 0.5)
