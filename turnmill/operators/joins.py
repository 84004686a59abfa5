"""Interval joins on buckets of the interval, so that both sides meet by an equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Starts that one row holds in a pass over pairs.
BLOCK = 512


def cells(low: Column, high: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long")))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """All pairs of ``left`` (lo, hi) and ``right`` (r_lo, r_hi), closed intervals with equal ``keys``, that overlap.

    Each interval is put in the cells of ``width`` that it touches; a pair counts in the first cell they share.
    """
    a = left.withColumn("cell", cells(F.col("lo"), F.col("hi"), width))
    b = right.withColumn("cell", cells(F.col("r_lo"), F.col("r_hi"), width))
    first = F.floor(F.greatest("lo", "r_lo") / width).cast("long")
    return a.join(b, [*keys, "cell"]).where((F.col("r_hi") >= F.col("lo")) & (F.col("r_lo") <= F.col("hi")) & (F.col("cell") == first)).drop("cell")


def overlapping_pairs(spans: DataFrame, keys: list[str], width: int, block: int = BLOCK) -> DataFrame:
    """(a, b): each two of ``spans`` (keys, owner, span, lo, hi) with equal ``keys`` and unlike ``owner`` that overlap, ids ``a < b``.

    Of two closed intervals that overlap, the one that starts later does so within the other. So only starts are gathered,
    in order, by blocks of ``block`` rows at most within a cell of ``width``, and an interval meets the blocks that reach
    into it: few comparisons give no pair, and no pair is found twice. A task holds one block at a time, and a crowded
    cell is many blocks on many tasks. ``hi`` is ``lo`` at least; a row with a null has no pairs.
    """
    spark = spans.sparkSession
    # as few bytes give many pairs, adaptive execution would join too few partitions
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    known = spans.select(*keys, "owner", "span", "lo", "hi").dropna()
    in_order = Window.partitionBy(*keys, "cell").orderBy("lo", "span")
    starts = known.withColumn("cell", F.floor(F.col("lo") / width).cast("long")).withColumn("block", F.floor((F.row_number().over(in_order) - 1) / block))
    grouped = starts.groupBy(*keys, "cell", "block").agg(F.min("lo").alias("first"), F.max("lo").alias("last"), F.collect_list(F.struct("lo", "span", "owner")).alias("rows"))
    blocks = grouped.select(*keys, "cell", "block", F.col("rows.lo").alias("los"), F.col("rows.span").alias("others"), F.col("rows.owner").alias("owners"))
    asked = known.withColumn("cell", cells(F.col("lo"), F.col("hi"), width)).join(grouped.select(*keys, "cell", "block", "first", "last"), [*keys, "cell"]).where("last >= lo AND first <= hi").drop("first", "last")
    met = asked.repartition(parts, *keys, "cell", "block").join(blocks, [*keys, "cell", "block"])
    each = met.select("owner", "span", "lo", "hi", "los", "owners", F.posexplode("others").alias("n", "other"))
    later = each.where("los[n] <= hi AND (los[n] > lo OR los[n] = lo AND other > span) AND other <> span AND owners[n] <> owner")
    return later.select(F.least("span", "other").alias("a"), F.greatest("span", "other").alias("b"))


def first_of(choices: dict[str, Column], none: str = "none") -> list[Column]:
    """(origin, value) of the first choice that isn't null, after outer joins."""
    origin = F.coalesce(*[F.when(v.isNotNull(), k) for k, v in choices.items()], F.lit(none))
    return [origin.alias("origin"), F.coalesce(*choices.values()).alias("value")]
