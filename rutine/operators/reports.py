"""Pivots, totals, correlations, bins: the data behind reports."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rutine.functions.scalars import latex_name
from rutine.operators.evaluation import scores

TOTALS = ("total_tp", "total_fp", "total_fn")


def pivot_with_count(df: DataFrame, index: str) -> DataFrame:
    """Sums of the totals and the number of rows with a tp, with scores."""
    out = df.groupBy(index).agg(*[F.sum(c).alias(c) for c in TOTALS], F.count(TOTALS[0]).alias("count"))
    return scores(out, *TOTALS)


def grouping_sets(df: DataFrame, indexes: list[str]) -> DataFrame:
    """Sums of the totals by each index in one pass: (index_name, index_value, totals, scores). A null value is a value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("index_name"), F.col(i).cast("string").alias("index_value")) for i in indexes]))
    out = df.select(pairs.alias("_i"), *TOTALS).groupBy("_i.index_name", "_i.index_value").agg(*[F.sum(c).alias(c) for c in TOTALS])
    return scores(out, *TOTALS)


def overall(df: DataFrame) -> DataFrame:
    """One row: totals over all logs and their scores."""
    return scores(df.agg(*[F.sum(c).alias(c) for c in TOTALS]), *TOTALS)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f, tiny = 1.0, 0.0, 1.0, 1e-300
    for i in range(400):
        m = i // 2
        n = 1.0 if not i else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or tiny)
        c = 1 + n / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return scale * (f - 1)


def p_value(r: float, n: int) -> float:
    """Two-sided, of a correlation r of n pairs, by Student's t with n - 2 degrees."""
    if n < 3 or math.isnan(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return _incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def average_rank(c: str) -> Column:
    """Rank from 1, ties sharing their mean. The window has no partition: for tables of results, a row for each log."""
    order = Window.partitionBy(F.lit(0)).orderBy(c)
    ties = Window.partitionBy(F.lit(0), c)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, pearson, spearman) over finite pairs; null with fewer than 3 of them or without variance."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    some = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(fine("x") & fine("y"))
    some = some.withColumn("rx", average_rank("x")).withColumn("ry", average_rank("y"))
    ok = (F.count("*") >= 3) & (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0)
    return some.agg(F.count("*").alias("n"), F.when(ok, F.corr("x", "y")).alias("pearson"), F.when(ok, F.corr("rx", "ry")).alias("spearman"))


def correlation_table(df: DataFrame, xs: list[str], ys: list[str]) -> list[dict]:
    """Rounded coefficients and p-values of each pair of columns."""
    out = []
    for x in xs:
        for y in ys:
            r = correlations(df, x, y).first()
            row = {"x": x, "y": y, "n": r.n}
            for name in ("pearson", "spearman"):
                value = math.nan if r[name] is None else r[name]
                row |= {name: round(value, 3), f"{name}_p": round(p_value(value, r.n), 4)}
            out.append(row)
    return out


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts and percentages of values in [0, 1] in right-closed bins, 0 in the first: (bin, count, percent)."""
    at = F.greatest(F.ceil(F.round(F.col(column) * bins, 9)), F.lit(1)).cast("int")
    n = df.where(F.col(column).between(0, 1)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    return n.withColumn("percent", 100 * F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0))))


def quantile_bins(df: DataFrame, column: str, q: int = 10) -> DataFrame:
    """df with the number of the right-closed bin between linear quantiles; equal edges are one."""
    edges = df.agg(F.array_distinct(F.expr(f"percentile({column}, array({', '.join(str(i / q) for i in range(q + 1))}))")).alias("_edges"))
    out = df.crossJoin(F.broadcast(edges))  # one row
    number = F.greatest(F.size(F.filter("_edges", lambda e: e < F.col(column))), F.lit(1))
    return out.withColumn("bin", F.when(F.col(column).isNotNull(), number)).drop("_edges")


def group_means(df: DataFrame, by: str, *columns: str) -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def density_distribution(log: DataFrame, column: str = "rule_density_count") -> DataFrame:
    """(value, count, cumulative count and share) of a log's densities."""
    n = log.groupBy("log_id", F.col(column).alias("value")).agg(F.count("*").alias("count"))
    run = Window.partitionBy("log_id").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("log_id")
    return n.withColumn("cumulative", F.sum("count").over(run)).withColumn("share", F.col("cumulative") / F.sum("count").over(whole))


def density_quantiles(log: DataFrame, column: str = "rule_density_count") -> DataFrame:
    marks = (25, 50, 75, 90, 99)
    return log.groupBy("log_id").agg(*[F.expr(f"percentile({column}, {p / 100})").alias(f"p{p}") for p in marks])


def covariance_stats(df: DataFrame, vector: str = "vector") -> dict:
    """Total and mean variance, determinant and Frobenius norm of the covariance of standardised dimensions.

    Sums of products are aggregated by pairs of dimensions; the driver gets a matrix as large as the vectors are long."""
    d = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    pairs = d.select(F.size("v").alias("n"), F.posexplode("v").alias("i", "x"), "v").select("i", "x", F.posexplode("v").alias("j", "y"))
    rows = pairs.groupBy("i", "j").agg(F.count("*").alias("n"), F.covar_samp("x", "y").alias("c")).collect()
    size = max((r.i for r in rows), default=-1) + 1
    c = np.zeros((size, size))
    for r in rows:
        c[r.i, r.j] = r.c
    with np.errstate(invalid="ignore", divide="ignore"):
        scale = np.sqrt(np.diag(c))
        c = c / np.outer(scale, scale)
    return {"total_variance_trace": float(np.trace(c)), "mean_dimension_variance": float(np.trace(c) / size) if size else math.nan, "generalized_variance": float(np.linalg.det(c)) if size and np.isfinite(c).all() else math.nan, "frobenius_norm": float(np.linalg.norm(c))}


def latex_definitions(df: DataFrame, index: str, prefix: str) -> DataFrame:
    """A line of LaTeX for each score of a pivot."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).alias("v")) for n in ("precision", "recall", "f1")]))
    rows = df.select(F.col(index).cast("string").alias("_i"), each.alias("_m"))
    name = latex_name(F.concat(F.lit(prefix + "_"), F.col("_i"), F.lit("_"), F.col("_m.n")))
    return rows.select(F.format_string("\\def\\%s{%.2f}", name, F.col("_m.v")).alias("line"))
