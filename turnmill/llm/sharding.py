"""Operator 8: proportional stratified interleaving of documents into shards, law ``rows``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnmill.llm.common import bucket_count, hash_key, running_offsets, saved

SEED = "17"


def interleave(docs: DataFrame, n_shards: int = 16, seed: str = SEED, id_col: str = "doc_id", stratum: str = "source", text: str = "text", per_bucket: int = 50_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, source): every row in one of ``n_shards``.

    Rows of a source are ranked by a seeded hash of their id; rank r of n becomes the fraction (r - 0.5) / n;
    all rows are ordered by it and cut into runs whose lengths differ by one at most, so each shard holds each
    source in its share of the whole, to within a row or two. The ranks are exact and made in buckets of the
    hash (then of the fraction), so no source, however large, is in one task.

    Nulls: a null text has size 1 and checksum 0; a null source is a source of its own; a null id hashes as the
    empty string. Repeated rows are placed one by one; equal hashes are ordered by id, checksum and size.
    An empty table gives no rows. Other columns are ignored. Every operand is a built-in expression.
    """
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumn("k", hash_key(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    total = docs.count()
    n_buckets = bucket_count(total, per_bucket)
    base = base.withColumn("b", F.floor(F.col("k") / F.lit(float(1 << 60)) * n_buckets).cast("long"))
    cells = running_offsets(base.groupBy("source", "b").agg(F.count("*").alias("n")), ["source"], "b")
    cells = cells.withColumn("of_source", F.sum("n").over(Window.partitionBy("source"))).drop("n").withColumnsRenamed({"source": "cell_source", "b": "cell_b"})
    rank = F.row_number().over(Window.partitionBy("source", "b").orderBy("k", "doc_id", "text_crc32", "size"))
    ranked = (
        base.withColumn("r", rank)
        .join(cells, F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("b") == F.col("cell_b")))
        .withColumn("part", (F.col("r") + F.col("before") - F.lit(0.5)) / F.col("of_source"))
        .select("doc_id", "source", "size", "text_crc32", "k", "part", F.floor(F.col("part") * n_buckets).cast("long").alias("b"))
    )
    ranked = saved(ranked, "ranked")
    cuts = running_offsets(ranked.groupBy("b").agg(F.count("*").alias("n")), [], "b").drop("n")
    place = F.row_number().over(Window.partitionBy("b").orderBy("part", "k", "doc_id", "source", "text_crc32", "size"))
    least, more = divmod(total, n_shards)
    edge = more * (least + 1)
    at = F.col("place")
    shard = F.when(at < edge, F.floor(at / (least + 1))).otherwise(more + F.floor((at - edge) / max(1, least)))
    start = F.when(F.col("shard") < more, F.col("shard") * (least + 1)).otherwise(edge + (F.col("shard") - more) * least)
    return (
        ranked.withColumn("in_b", place).join(cuts, "b")
        .withColumn("place", F.col("in_b") + F.col("before") - 1)
        .withColumn("shard", shard.cast("int")).withColumn("slot", (at - start).cast("long"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
    )


#: The checksum is folded over the bytes by a table that its polynomial makes.
ORACLE = r"""
WITH bits AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS x FROM documents),
base AS (SELECT doc_id, source, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, size), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32,
  CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k FROM d, bits),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY k, doc_id, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS part, count(*) OVER () AS total FROM base),
placed AS (SELECT *, row_number() OVER (ORDER BY part, k, doc_id, source, text_crc32, size) - 1 AS pos, total // 16 AS least, total % 16 AS more FROM ranked),
cut AS (SELECT *, CASE WHEN pos < more * (least + 1) THEN pos // (least + 1) ELSE more + (pos - more * (least + 1)) // greatest(1, least) END AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(pos - CASE WHEN shard < more THEN shard * (least + 1) ELSE more * (least + 1) + (shard - more) * least END AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM cut
"""
