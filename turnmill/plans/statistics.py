"""Queries on recodes, scales, tests and regressions, over customers and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.operators import statistics as S
from turnmill.registry import query, table

RECODE = {1: 1, 2: 2, 5: 3, 3: 4, 4: 5}


@query("SELECT p_partkey, CASE p_size % 10 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 5 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 END AS scale, CASE WHEN p_size < 40 THEN p_size END AS size, 6 - p_size % 5 AS reversed FROM part")
def recode_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey codes to a scale, missing codes to null, a scale turned round."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", S.recode(size % 10, RECODE).alias("scale"), S.unless_above(size, 40).alias("size"), S.reversed_scale(size % 5).cast("int").alias("reversed"))


@query("SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / ((SELECT max(c_acctbal) FROM customer) - (SELECT min(c_acctbal) FROM customer)), 6) AS scaled FROM customer")
def minmax_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances from 0 to 1."""
    return S.rescaled(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("scaled")), "scaled").select("c_custkey", F.round("scaled", 6).alias("scaled"))


@query("SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS z FROM customer")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard scores."""
    return S.zscores(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("z")), ["z"]).select("c_custkey", F.round("z", 6).alias("z"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE least(a, b) END AS low, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE round((coalesce(a, 0) + coalesce(b, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT), 6) END AS mean
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 40 THEN l_quantity END AS a, CASE WHEN l_discount < 0.08 THEN l_discount END AS b FROM lineitem)""")
def row_min_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-wise least (null if any is) and mean (of those there are)."""
    a, b = F.when(F.col("l_quantity") < 40, F.col("l_quantity")), F.when(F.col("l_discount") < 0.08, F.col("l_discount"))
    mean = S.row_mean(a, b)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.row_min(a, b).alias("low"), F.round(F.when(~F.isnan(mean), mean), 6).alias("mean"))


VARS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in VARS for b in VARS))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlation matrix in long form."""
    r, _ = S.correlations(table(spark, sf_dir, "lineitem"), VARS)
    return spark.createDataFrame([(a, b, round(float(r[i, j]), 6)) for i, a in enumerate(VARS) for j, b in enumerate(VARS)], "a string, b string, r double")


@query("""WITH g AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), a AS (SELECT * FROM g ORDER BY g LIMIT 1), b AS (SELECT * FROM g ORDER BY g DESC LIMIT 1)
SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 3) AS df FROM a, b""")
def welch_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test of two means with unequal variances."""
    r = S.welch(table(spark, sf_dir, "lineitem"), "l_quantity", "l_linestatus")
    return spark.createDataFrame([(round(r["t"], 6), round(r["df"], 3))], "t double, df double")


@query("""WITH g AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), a AS (SELECT * FROM g ORDER BY g LIMIT 1), b AS (SELECT * FROM g ORDER BY g DESC LIMIT 1),
w AS (SELECT a.m - b.m AS diff, sqrt(a.v / a.n + b.v / b.n) AS error, (a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)) AS df FROM a, b),
q AS (SELECT *, 1.959963984540054 AS z FROM w)
SELECT round(diff - error * (z + (z ** 3 + z) / (4 * df) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * df ** 2)), 6) AS low, round(diff + error * (z + (z ** 3 + z) / (4 * df) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * df ** 2)), 6) AS high FROM q""")
def welch_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95 % interval of the difference; the SQL takes the quantile by its expansion in 1 / df."""
    r = S.welch(table(spark, sf_dir, "lineitem"), "l_quantity", "l_linestatus")
    return spark.createDataFrame([(round(r["low"], 6), round(r["high"], 6))], "low double, high double")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def ols_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Gaussian model of price by quantity."""
    rows = {r["term"]: r["estimate"] for r in S.glm(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])}
    return spark.createDataFrame([(round(rows["l_quantity"], 4), round(rows["(Intercept)"], 3))], "slope double, intercept double")


@query("""WITH m AS (SELECT l_returnflag AS term, avg(l_quantity) AS estimate, stddev_samp(l_quantity) / sqrt(count(*)) AS std_error FROM lineitem GROUP BY 1)
SELECT term, round(estimate - 1.645 * std_error, 6) AS low_90, round(estimate + 1.645 * std_error, 6) AS high_90, round(estimate - 1.96 * std_error, 6) AS low_95, round(estimate + 1.96 * std_error, 6) AS high_95,
round(estimate - 2.576 * std_error, 6) AS low_99, round(estimate + 2.576 * std_error, 6) AS high_99 FROM m""")
def ci_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of three confidence intervals."""
    means = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("term")).agg(F.avg("l_quantity").alias("estimate"), (F.stddev_samp("l_quantity") / F.sqrt(F.count("*"))).alias("std_error"))
    rows = S.with_intervals(means)
    return rows.select("term", *[F.round(f"{side}_{level}", 6).alias(f"{side}_{level}") for level in (90, 95, 99) for side in ("low", "high")])


@query()
def logit_glm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binomial model of return by quantity and discount."""
    rows = table(spark, sf_dir, "lineitem").withColumn("returned", (F.col("l_returnflag") == "R").cast("double"))
    found = S.glm(rows, "returned", ["l_quantity", "l_discount"], "binomial")
    return spark.createDataFrame([tuple(r.values()) for r in found], "term string, estimate double, std_error double, statistic double, p_value double")


@query()
def factor_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three factors of line items and sums of them."""
    rows = table(spark, sf_dir, "lineitem")
    names = ["q", "q2", "d", "d2", "t", "t2", "e"]
    noise = lambda seed: (F.pmod(F.xxhash64("l_orderkey", "l_linenumber", F.lit(seed)), F.lit(1000)) / 1000.0)
    rows = rows.select(F.col("l_quantity").alias("q"), (F.col("l_quantity") + 9 * noise(1)).alias("q2"), F.col("l_discount").alias("d"), (F.col("l_discount") + 0.03 * noise(2)).alias("d2"), F.col("l_tax").alias("t"), (F.col("l_tax") + 0.02 * noise(3)).alias("t2"), F.col("l_extendedprice").alias("e"))
    r, _ = S.correlations(rows, names)
    load, unique = S.factors(r, 3)
    kept = set(S.loading_variables(load, names))
    return spark.createDataFrame([(n, *map(float, row), float(u), n in kept) for n, row, u in zip(names, load, unique, strict=True)], "variable string, f1 double, f2 double, f3 double, uniqueness double, kept boolean")


@query("SELECT p_brand, CAST(row_number() OVER (ORDER BY avg(-p_size) DESC, p_brand) AS INTEGER) AS level FROM part GROUP BY p_brand")
def factor_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as levels of a factor, turned round: in falling order of the mean of the negated size."""
    return S.levels(table(spark, sf_dir, "part"), "p_brand", -F.col("p_size"), descending=True)


@query("SELECT 'F' AS model, o_orderstatus AS term, round(avg(o_totalprice), 4) AS estimate FROM orders GROUP BY 2 UNION ALL SELECT 'P', o_orderpriority, round(avg(o_totalprice), 4) FROM orders GROUP BY 2")
def union_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' rows in one frame."""
    rows = table(spark, sf_dir, "orders")
    one = lambda name, by: rows.groupBy(F.col(by).alias("term")).agg(F.round(F.avg("o_totalprice"), 4).alias("estimate")).select(F.lit(name).alias("model"), "term", "estimate")
    return one("F", "o_orderstatus").unionByName(one("P", "o_orderpriority"))
