"""Small helpers that several operators share: tables, the shared folder, ordinals and components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

from turnmill.storage import fresh_path, saved, shared_dir

__all__ = ["bucket_count", "components", "counted_bytes", "free_names", "fresh_path", "hash_key", "running_offsets", "saved", "shared_dir", "small_or_shuffled", "table"]

#: Counted bytes of a side that may be broadcast; larger sides are joined by a shuffle.
BROADCAST_BYTES = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with underscores added until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def counted_bytes(df: DataFrame) -> int:
    """Rows times 16 bytes a column, and the lengths of arrays of numbers (8 bytes an item) and of strings, by one aggregation."""
    sizes = [F.sum(F.greatest(F.size(f.name), F.lit(0)).cast("long")) * 8 for f in df.schema if isinstance(f.dataType, ArrayType)]
    sizes += [F.sum(F.octet_length(f.name).cast("long")) for f in df.schema if isinstance(f.dataType, StringType | BinaryType)]
    rows, *more = df.agg(F.count("*"), *sizes).first()
    return rows * 16 * len(df.columns) + sum(n or 0 for n in more)


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if its counted size is at most ``limit`` bytes, no hint (a shuffled join) otherwise."""
    return F.broadcast(df) if counted_bytes(df) <= limit else df


def hash_key(*parts: Column | str) -> Column:
    """60 bits of md5, the same in every SQL engine that has md5."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def bucket_count(rows: int, per_bucket: int = 50_000) -> int:
    """A power of two that keeps buckets of an evenly spread key near ``per_bucket`` rows."""
    return 1 << max(0, math.ceil(math.log2(max(1, rows) / per_bucket)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node that the undirected edges reach. Nodes without edges aren't listed.

    Alternating large-star and small-star steps; each round is written to the shared folder, and the loop
    ends when a round changes no edge. No edge list, label or group is ever collected. A node with very many
    edges is a hot key of the star's join, whose other side has one row for it: adaptive execution splits it.
    """
    def star(pairs: DataFrame, few: bool) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(F.broadcast(least) if few else least, "u")

    e = saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    tally = F.struct(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)))
    was = e.agg(tally).first()[0]
    while was.n:
        few = was.n * 64 <= BROADCAST_BYTES
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, few).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = star(large, few)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e = saved(small.where("u <> v").distinct(), "edges")
        now = e.agg(tally).first()[0]
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def running_offsets(cells: DataFrame, by: list[str], order: str, n: str = "n") -> DataFrame:
    """Adds ``before``: the sum of ``n`` over the earlier cells of the same ``by``; cells are few (one a bucket)."""
    w = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
    return cells.withColumn("before", F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
