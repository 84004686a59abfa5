"""Recodes, scales, tests, regressions and factors over survey frames.

Data are reduced to counts, means and cross products on Spark; only matrices of the variables' number reach the driver.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recode(value: Column, table: dict, other=None) -> Column:
    out = F.lit(other)
    for k, v in reversed(table.items()):
        out = F.when(value == k, v).otherwise(out)
    return out


def unless_above(value: Column, limit: float) -> Column:
    """Null for missing codes from ``limit`` on."""
    return F.when(value < limit, value)


def reversed_scale(value: Column, low: float = 1, high: float = 5) -> Column:
    return F.lit(low + high) - value


def row_min(*columns: Column) -> Column:
    """Null if any is null, unlike ``least``."""
    out = F.least(*columns)
    for c in columns:
        out = F.when(c.isNotNull(), out)
    return out


def row_mean(*columns: Column) -> Column:
    """The mean of those that aren't null; NaN if all are."""
    n = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0)) / F.nullif(n, F.lit(0))).otherwise(F.lit(float("nan")))


def levels(df: DataFrame, factor: str, by: Column, descending: bool = False) -> DataFrame:
    """(factor, level): the values of ``factor`` numbered from 1 by the mean of ``by``, equal means by value; a value without any comes last. One row a value."""
    means = df.where(F.col(factor).isNotNull()).groupBy(factor).agg(F.avg(by).alias("mean"))
    order = F.desc_nulls_last("mean") if descending else F.asc_nulls_last("mean")
    return means.select(factor, F.row_number().over(Window.orderBy(order, factor)).alias("level"))


def with_summary(df: DataFrame, **aggregates: Column) -> DataFrame:
    """``df`` with each aggregate of the whole as a column: one row, broadcast."""
    return df.join(F.broadcast(df.agg(*[v.alias(k) for k, v in aggregates.items()])))


def zscores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less its mean, over its sample deviation; null without any spread."""
    rows = with_summary(df, **{f"_m{i}": F.avg(c) for i, c in enumerate(columns)}, **{f"_s{i}": F.stddev_samp(c) for i, c in enumerate(columns)})
    return rows.select(*[(F.col(c) - F.col(f"_m{columns.index(c)}")) / F.nullif(F.col(f"_s{columns.index(c)}"), F.lit(0.0)) if c in columns else F.col(c) for c in df.columns]).toDF(*df.columns)


def rescaled(df: DataFrame, column: str) -> DataFrame:
    """``column`` brought to 0 to 1; null without any spread."""
    rows = with_summary(df, _lo=F.min(column), _hi=F.max(column))
    return rows.withColumn(column, (F.col(column) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))).drop("_lo", "_hi")


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, covariances) of the complete rows, by one aggregation of about half the square of the columns."""
    complete = df.select(*[F.col(c).cast("double") for c in columns]).dropna("any")
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = complete.agg(F.count("*"), *[F.avg(c) for c in columns], *[F.covar_samp(columns[i], columns[j]) for i, j in pairs]).first()
    cov = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, row[1 + len(columns) :], strict=True):
        cov[i, j] = cov[j, i] = v if v is not None else np.nan
    return row[0], np.array(row[1 : 1 + len(columns)], float), cov


def correlations(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, eigenvalues from the largest)."""
    _, _, cov = moments(df, columns)
    d = np.sqrt(np.diag(cov))
    r = cov / np.outer(d, d)
    return r, np.sort(np.linalg.eigvalsh(r))[::-1]


def beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            t = 1.0
        elif i % 2 == 0:
            t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            t = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + t * d or 1e-300)
        c = 1 + t / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return beta_tail(df / 2, 0.5, df / (df + t * t))


def beta_quantile(a: float, b: float, p: float) -> float:
    """x with ``beta_tail(a, b, x) = p``: Newton's steps where they stay within the bracket, else its middle."""
    if not 0 < p < 1:
        return float(p >= 1)
    low, high, x = 0.0, 1.0, a / (a + b)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    for _ in range(200):
        off = beta_tail(a, b, x) - p
        low, high = (x, high) if off < 0 else (low, x)
        slope = math.exp(log_front + (a - 1) * math.log(x) + (b - 1) * math.log1p(-x))
        step = x - off / slope if slope > 0 else -1.0
        new = step if low < step < high else (low + high) / 2
        if abs(new - x) <= 1e-16 * x or new in (low, high):
            return new
        x = new
    return x


def t_quantile(p: float, df: float) -> float:
    """The value that a t of ``df`` degrees of freedom stays below with probability ``p``."""
    if p == 0.5:
        return 0.0
    tail = 2 * min(p, 1 - p)
    if tail <= 0:
        return math.copysign(math.inf, p - 0.5)
    if df > 1e8:  # the normal's, to within its own precision
        return NormalDist().inv_cdf(p)
    # of x = df / (df + t^2) and 1 - x the smaller one keeps its digits
    x = beta_quantile(df / 2, 0.5, tail)
    if x > 0.5:
        y = beta_quantile(0.5, df / 2, 1 - tail)
        return math.copysign(math.sqrt(df * y / (1 - y)), p - 0.5)
    return math.copysign(math.sqrt(df * (1 - x) / x) if x > 0 else math.inf, p - 0.5)


def welch(df: DataFrame, value: str, group: str, level: float = 0.95) -> dict[str, float | None]:
    """t, df, p_value, both means and the interval (low, high) of their difference: a two-sided test of unequal variances.

    Rows without value or group are left out; ``group`` must have two values. A group of one row has no variance and
    without any spread there is no error to divide by: in both cases t, df, p_value, low and high are None.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).orderBy(group).limit(3).collect()
    if len(rows) != 2:
        raise ValueError(f"{group} has {len(rows) if len(rows) < 3 else 'more than two'} values; a test compares two")
    (_, n1, m1, v1), (_, n2, m2, v2) = rows
    means = {"mean_1": m1, "mean_2": m2}
    if n1 < 2 or n2 < 2 or not v1 + v2 > 0:
        return dict.fromkeys(("t", "df", "p_value", "low", "high")) | means
    a, b = v1 / n1, v2 / n2
    error = math.sqrt(a + b)
    t, free = (m1 - m2) / error, (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
    reach = t_quantile((1 + level) / 2, free) * error
    return {"t": t, "df": free, "p_value": t_two_sided(t, free), "low": m1 - m2 - reach, "high": m1 - m2 + reach} | means


def glm(df: DataFrame, outcome: str, predictors: list[str], family: str = "gaussian") -> list[dict]:
    """term, estimate, std_error, statistic and p_value of a generalised linear model of the complete rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = df.select(F.col(outcome).cast("double").alias("label"), *[F.col(p).cast("double") for p in predictors]).dropna("any")
    model = GeneralizedLinearRegression(family=family, solver="irls", maxIter=50).fit(VectorAssembler(inputCols=predictors, outputCol="features").transform(rows))
    s = model.summary
    names, at = [*predictors, "(Intercept)"], [len(predictors), *range(len(predictors))]
    values = [*model.coefficients.toArray().tolist(), model.intercept]
    return [{"term": names[i], "estimate": values[i], "std_error": s.coefficientStandardErrors[i], "statistic": s.tValues[i], "p_value": s.pValues[i]} for i in at]


#: Quantiles of the usual levels, as tables of coefficients round them.
ROUNDED = {90: 1.645, 95: 1.96, 99: 2.576}


def with_intervals(rows: DataFrame, levels: tuple[float, ...] = (90, 95, 99), df: float | None = None) -> DataFrame:
    """Adds the ends of the intervals of ``estimate``: by the normal's quantile, for the usual levels rounded as in ``ROUNDED``, or by that of a t of ``df``."""
    for level in levels:
        p = 0.5 + level / 200
        z = ROUNDED.get(level, NormalDist().inv_cdf(p)) if df is None else t_quantile(p, df)
        rows = rows.withColumn(f"low_{level}", F.col("estimate") - z * F.col("std_error")).withColumn(f"high_{level}", F.col("estimate") + z * F.col("std_error"))
    return rows


def gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by its series below ``a + 1`` and its continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 10_000):
        t = -i * (i - a)
        b += 2
        d = 1 / (t * d + b or 1e-300)
        c = b + t / c or 1e-300
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def factor_test(r: np.ndarray, k: int, n: int) -> dict[str, float]:
    """fit, statistic, df and p_value of the hypothesis that ``k`` factors are enough for a correlation matrix of ``n`` complete rows.

    ``fit`` is the discrepancy between the matrix and what the model implies; the statistic is it times n with Bartlett's
    correction, and has a chi-square distribution under the hypothesis.
    """
    p = len(r)
    df = ((p - k) ** 2 - p - k) / 2
    if df <= 0:
        raise ValueError(f"{k} factors of {p} variables leave nothing to test")
    load, psi = unrotated(r, k)
    implied = load @ load.T + np.diag(psi)
    fit = float(np.linalg.slogdet(implied)[1] - np.linalg.slogdet(r)[1] + np.trace(np.linalg.solve(implied, r)) - p)
    statistic = (n - 1 - (2 * p + 5) / 6 - 2 * k / 3) * fit
    return {"fit": fit, "statistic": statistic, "df": df, "p_value": gamma_tail(df / 2, statistic / 2)}


def factors(r: np.ndarray, k: int = 3, tries: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(promax-rotated loadings, uniquenesses) of a maximum-likelihood factor analysis of a correlation matrix.

    Factors stand in falling order of the sum of their squared loadings, each turned so that this sum's larger part is positive.
    """
    load, psi = unrotated(r, k, tries)
    load = promax(varimax(load)) if k > 1 else load
    load = load[:, np.argsort(-(load**2).sum(axis=0), kind="stable")]
    return load * np.where((load * np.abs(load)).sum(axis=0) < 0, -1.0, 1.0), psi


def unrotated(r: np.ndarray, k: int, tries: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(loadings, uniquenesses) of the greatest likelihood, climbed by expectation steps: the uniquenesses rise to what the factors leave unexplained."""
    p = len(r)
    psi = 1 / np.diag(np.linalg.pinv(r))
    values, vectors = np.linalg.eigh(r)
    load = vectors[:, -k:] * np.sqrt(np.maximum(values[-k:] - psi.mean(), 1e-3))
    for _ in range(tries):
        inv = np.linalg.inv(load @ load.T + np.diag(psi))
        beta = load.T @ inv
        ezz = np.eye(k) - beta @ load + beta @ r @ beta.T
        new = r @ beta.T @ np.linalg.inv(ezz)
        new_psi = np.maximum(np.diag(r - new @ beta @ r), 5e-3)
        done = np.abs(new_psi - psi).max() < 1e-7
        load, psi = new, new_psi
        if done:
            break
    return load, psi


def varimax(load: np.ndarray, tries: int = 200) -> np.ndarray:
    """Orthogonal rotation with Kaiser's normalisation."""
    scale = np.sqrt((load**2).sum(axis=1, keepdims=True))
    x, turn, before = load / scale, np.eye(load.shape[1]), 0.0
    for _ in range(tries):
        z = x @ turn
        u, s, v = np.linalg.svd(x.T @ (z**3 - z * (z**2).mean(axis=0)))
        turn = u @ v
        if s.sum() < before * (1 + 1e-9):
            break
        before = s.sum()
    return x @ turn * scale


def promax(load: np.ndarray, power: int = 4) -> np.ndarray:
    """Oblique rotation towards the powered loadings."""
    target = load * np.abs(load) ** (power - 1)
    u = np.linalg.lstsq(load, target, rcond=None)[0]
    return load @ (u * np.sqrt(np.diag(np.linalg.inv(u.T @ u))))


def loading_variables(load: np.ndarray, names: list[str], least: float = 0.3) -> list[str]:
    return [n for n, row in zip(names, load, strict=True) if np.abs(row).max() >= least]
