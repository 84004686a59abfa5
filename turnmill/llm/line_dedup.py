"""Operator 10: lines that spread over many sites are kept once and removed everywhere else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import free_names, saved

#: A line of fewer words is never removed; of this many and more it is, once it stands on ``MIN_SITES`` sites.
MIN_WORDS, MIN_SITES = 4, 2
#: log2 of the sketch's registers, and the share by which its estimate may be off (over three standard errors).
LG_K, MARGIN = 12, 0.06
#: A line on more than this share of all line rows is joined by a broadcast: there are at most this many such lines.
HOT_LINES = 10_000
BLANK = r"[\x20\x09-\x0D]+"


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_key, site, pos, h1, h2) of every line of at least ``min_words`` words."""
    line = F.trim(F.regexp_replace("line", BLANK, " "))
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("source", F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    cut = cut.withColumn("line", line).where((F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))) >= min_words - 1)
    return cut.where("line <> ''").select("doc_id", "text_key", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))


def site_spread(lines: DataFrame, min_sites: int, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """(h1, h2, n, first) of the lines that stand on at least ``min_sites`` sites, with their number and first place.

    A HyperLogLog sketch of the sites is built for each line hash, partial sketches merging in the aggregation.
    Lines whose estimate is farther from the threshold than the sketch's error are settled by it; the rest get
    an exact distinct count, over those lines alone.
    """
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sites"), F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "pos")).alias("first"))
    spread = sketches.select("h1", "h2", "n", "first", F.hll_sketch_estimate("sites").alias("about"))
    low, high = min_sites * (1 - margin) - 0.5, min_sites * (1 + margin) + 0.5
    spread = saved(spread.where(F.col("about") >= low), "spread")
    near = spread.where(F.col("about") <= high)
    places = lines.select("h1", "h2", "site").distinct()  # first of all: of a line on very many rows each task passes one row a site on
    exact = places.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    sure = spread.where(F.col("about") > high).select("h1", "h2", "n", "first")
    return sure.unionByName(near.join(exact.where(F.col("sites") >= min_sites), ["h1", "h2"]).select("h1", "h2", "n", "first"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_sites: int = MIN_SITES) -> DataFrame:
    """The rows of ``docs`` with cross-site lines removed from ``text``, and ``n_lines`` and ``n_removed``.

    A line (its blanks squeezed) of at least ``min_words`` words that stands on at least ``min_sites`` distinct
    values of ``source`` stays at its first place, the smallest (doc_id, text hash, line number), and goes from
    all others. Shorter lines and lines of one site stay. Line breaks are "\\n"; what remains is joined by it.

    Nulls: a null text stays null with 0 lines; a null source counts as one site; null ids sort first.
    Identical rows are one document here: they keep or lose the same lines. All other columns are kept as they
    are; columns named n_lines or n_removed are replaced. An empty table gives no rows.
    """
    lines = saved(lines_of(docs, min_words), "lines")
    spread = saved(site_spread(lines, min_sites), "cross-site")
    hot = spread.where(F.col("n") > max(HOT_LINES, lines.count() // HOT_LINES))  # HOT_LINES rows at most
    of_hot = lines.join(F.broadcast(hot), ["h1", "h2"])
    of_rest = lines.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").join(spread.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti"), ["h1", "h2"])
    drop_id, drop_key, drop_at = free_names(docs, "drop_id", "drop_key", "drop_at")
    here = F.struct("doc_id", "text_key", "pos")
    drops = (
        of_hot.unionByName(of_rest).where(~here.eqNullSafe(F.col("first")))
        .groupBy(F.col("doc_id").alias(drop_id), F.col("text_key").alias(drop_key)).agg(F.collect_set("pos").alias(drop_at))
    )
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    cut, gone = F.split("text", "\n"), F.col(drop_at)
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), gone), lambda i: cut[i])
    joined = docs.select(*kept).join(drops, F.col("doc_id").eqNullSafe(F.col(drop_id)) & (F.xxhash64("text") == F.col(drop_key)), "left")
    out = {c: F.col(c) for c in kept} | {"text": F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))}
    return joined.select(
        *[v.alias(k) for k, v in out.items()],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(cut)).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )


ORACLE = r"""
WITH cut AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
norm AS (SELECT doc_id, source, line, pos, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS l FROM cut),
spread AS (SELECT l, min(struct_pack(d := doc_id, p := pos)) AS first FROM norm
  WHERE l <> '' AND len(l) - len(replace(l, ' ', '')) >= 3 GROUP BY l HAVING count(DISTINCT coalesce(source, '')) >= 2),
marked AS (SELECT n.*, s.l IS NOT NULL AND s.first <> struct_pack(d := n.doc_id, p := n.pos) AS gone FROM norm n LEFT JOIN spread s ON n.l = s.l)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
FROM marked GROUP BY doc_id
"""
