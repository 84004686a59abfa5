"""Operator 12: importance resampling towards a target's n-gram distribution, in built-in expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import saved

#: Bins of hashed features, the least number of words of a document that may be drawn, the share drawn, and the seed.
BINS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The position within a partition in ``monotonically_increasing_id``.
PLACES = 33


def words_of(text: Column) -> Column:
    """Runs of digits, letters and all that isn't ASCII, A to Z in small letters. A null text has none."""
    small = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, CAPITALS, SMALL))
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), small)


def features(words: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` consecutive words, joined by a space; ``words`` must be a column, not an expression over one."""
    if (low, high) == (1, 1):
        return words
    run = lambda k: F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
    runs = [F.when(F.size(words) >= k, run(k)).otherwise(F.array().cast("array<string>")) for k in range(low, high + 1)]
    return F.concat(*runs)


def bucket(feature: str, bins: int) -> Column:
    return (F.crc32(F.col(feature).cast("binary")) % bins).cast("int")


def bucket_counts(docs: DataFrame, low: int, high: int, bins: int, name: str) -> DataFrame:
    """(bucket, name): how many features of all rows are in each bucket; ``bins`` rows at most."""
    words = docs.select(words_of(F.col("text")).alias("words"))
    return words.select(F.explode(features(F.col("words"), low, high)).alias("feature")).groupBy(bucket("feature", bins).alias("bucket")).agg(F.count("*").alias(name))


def gain_table(docs: DataFrame, target: DataFrame, low: int, high: int, bins: int) -> DataFrame:
    """(bucket, gain) of every bucket from 0 to ``bins - 1``."""
    counts = bucket_counts(docs, low, high, bins, "s").join(bucket_counts(target, low, high, bins, "t"), "bucket", "full")
    sums = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    of = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    ratio = (of(F.col("t")) + 1) * (of(F.col("all_s")) + float(bins)) / ((of(F.col("s")) + 1) * (of(F.col("all_t")) + float(bins)))
    every = counts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(counts), "bucket", "left")
    return every.join(F.broadcast(sums)).select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain"))


def weights(docs: DataFrame, gains: DataFrame, low: int, high: int, bins: int) -> DataFrame:
    """(doc_id, digest, copies, n_words, n_features, weight): one row for each id and text.

    Features are joined to the gains, a table of ``bins`` rows, by a broadcast and summed before anything is shuffled:
    all features of a row are in one task, so the shuffle has one small row for each document.
    """
    cut = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), words_of(F.col("text")).alias("words"),
    ).withColumn("n_words", F.size("words").cast("long"))
    found = cut.select("doc_id", "digest", "n_words", F.posexplode_outer(features(F.col("words"), low, high)).alias("place", "feature"))
    found = found.withColumn("bucket", bucket("feature", bins)).join(F.broadcast(gains), "bucket", "left")
    summed = found.groupBy("doc_id", "digest", "n_words").agg(
        F.count_if(F.coalesce("place", F.lit(0)) == 0).alias("copies"), F.count("feature").alias("n_all"), F.sum(F.coalesce("gain", F.lit(0))).alias("w_all"),
    )
    return summed.select("doc_id", "digest", "copies", "n_words", (F.col("n_all") / F.col("copies")).cast("long").alias("n_features"), (F.col("w_all") / F.col("copies")).cast("long").alias("weight"))


def with_score(rows: DataFrame, seed: int) -> DataFrame:
    """Adds the weight plus a Gumbel noise in thousandths that hangs on seed and id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")
    return rows.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, bins: int = BINS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; rank is null where the row isn't drawn.

    Words are runs of digits, letters and non-ASCII characters with A-Z lower-cased; features are the runs of ``low`` to
    ``high`` words, repeats counted. With s of S features of ``docs`` and t of T features of ``target`` in a bucket, its
    gain is floor(1000 ln((t + 1)(S + bins) / ((s + 1)(T + bins)))); a document's weight is the sum over its features,
    its score that plus Gumbel noise. Of the N rows with ``min_words`` words or more, floor(percent N / 100) of the
    highest scores are drawn: rows are sorted by ranges over all tasks, and a rank is the place within its range plus the
    sizes of the ranges before, one small row a range.

    Nulls: a null text has no words; a null id is hashed as the empty text and comes after all ids in ties. Repeated rows
    are drawn one by one, rows of one id and score in order of their texts' hashes. An empty table gives no rows, an
    empty target has T = 0. Other columns are ignored. No Python code runs on rows.
    """
    gains = saved(gain_table(docs, target, low, high, bins), "gains")
    rows = saved(with_score(weights(docs, gains, low, high, bins), seed), "scores")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("digest"), F.asc("copy")]
    fit = rows.where(F.col("n_words") >= min_words).select("doc_id", "n_features", "weight", "score", "digest", "copy")
    placed = saved(fit.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("place", PLACES)
    ranges = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # one row a range: an array of their sizes, in which the ones before are added up
    sizes = ranges.agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("sizes"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    before = F.aggregate(F.filter("sizes", lambda r: r["part"] < F.col("part")), F.lit(0).cast("long"), lambda n, r: n + r["n"])
    offsets = ranges.join(F.broadcast(sizes)).select("part", before.alias("before"), F.floor(F.col("total") * percent / 100).cast("long").alias("drawn"))
    rank = F.col("before") + (F.col("place") - F.shiftleft(F.col("part"), PLACES)) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= F.col("drawn"), rank).alias("rank"))
    rest = rows.where(F.col("n_words") < min_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)


#: The checksum is folded over the bytes by a table that its polynomial makes.
ORACLE = r"""
WITH bits AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
f AS (SELECT row, unnest(words) AS w FROM d),
g AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
x AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM (SELECT w FROM f UNION ALL SELECT w FROM g))),
b AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket FROM x, bits),
s AS (SELECT bucket, count(*) AS s FROM f JOIN b USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM g JOIN b USING (w) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM g) + 10000)::DOUBLE))) AS gain FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT row, sum(gain)::BIGINT AS weight FROM f JOIN b USING (w) JOIN gains USING (bucket) GROUP BY row),
scored AS (SELECT row, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weighed USING (row)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END::BIGINT AS rank FROM ranked
"""
