"""Correlation reports, p-values and scores of binary predictions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .columns import finite
from .ranks import RANGES, average_rank, average_ranks


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def p_value(r: float | None, n: int | None) -> float | None:
    """Two-sided p-value of a correlation of n pairs, by Student's t with n - 2 degrees of freedom."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return incomplete_beta(df / 2, 0.5, df / (df + t2))


def p_value_column(r: str, n: str) -> Column:
    """:func:`p_value` over a report's few rows."""

    def run(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([p_value(None if pd.isna(a) else float(a), None if pd.isna(b) else int(b)) for a, b in zip(r, n, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(r, n)


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, pearson_r, spearman_r) over rows where both are finite; null under three rows."""
    good = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(finite(F.col("x")) & finite(F.col("y")))
    ranked = average_ranks(good, ("x", "rx", False), ("y", "ry", False))
    made = ranked.agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson_r"), F.corr("rx", "ry").alias("spearman_r"))
    return made.select("n", *[F.when((F.col("n") >= 3) & ~F.isnan(c), F.col(c)).alias(c) for c in ("pearson_r", "spearman_r")])


def correlation_report(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pair, n, pearson_r, pearson_p, spearman_r, spearman_p) for each pair of columns."""
    out = None
    for x, y in pairs:
        row = correlations(df, x, y).withColumn("pair", F.lit(f"{x} vs {y}"))
        out = row if out is None else out.unionByName(row)
    return out.select("pair", "n", "pearson_r", p_value_column("pearson_r", "n").alias("pearson_p"), "spearman_r", p_value_column("spearman_r", "n").alias("spearman_p"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row (n_pos, n_neg, auc) by the rank formula, exact under ties; 0 with one class."""
    ranked = average_rank(df.select(F.col(score).alias("s"), F.col(label).cast("int").alias("l")), "s", "r")
    sums = ranked.agg(F.count_if(F.col("l") == 1).alias("n_pos"), F.count_if(F.col("l") == 0).alias("n_neg"), F.sum(F.when(F.col("l") == 1, F.col("r"))).alias("s"))
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return sums.select("n_pos", "n_neg", F.when((p > 0) & (n > 0), (F.col("s") - p * (p + 1) / 2) / (p * n)).otherwise(F.lit(0.0)).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row (average_precision): sum of recall steps times precision over distinct thresholds.

    Thresholds are dealt into ranges of scores, as for ranks; running sums inside ranges start from the ranges' totals.
    """
    per = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    cuts = per.agg(F.percentile_approx("s", F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])).alias("cuts"))
    dealt = per.crossJoin(F.broadcast(cuts)).withColumn("k", F.size(F.filter("cuts", lambda c: c < F.col("s")))).drop("cuts")
    totals = dealt.groupBy("k").agg(F.sum("n").alias("kn"), F.sum("p").alias("kp"))
    above = W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("k", F.coalesce(F.sum("kn").over(above), F.lit(0)).alias("bn"), F.coalesce(F.sum("kp").over(above), F.lit(0)).alias("bp"), F.sum("kp").over(W.partitionBy(F.lit(1))).alias("all_p"))
    down = W.partitionBy("k").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, W.currentRow)
    at = dealt.join(F.broadcast(base), "k").select("p", "all_p", (F.col("bn") + F.sum("n").over(down)).alias("cn"), (F.col("bp") + F.sum("p").over(down)).alias("cp"))
    return at.agg(F.coalesce(F.sum(F.col("p") / F.nullif(F.col("all_p"), F.lit(0)) * F.col("cp") / F.col("cn")), F.lit(0.0)).alias("average_precision"))


def classification_report(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """(name, precision, recall, f1, support) for classes 0 and 1, accuracy, macro and weighted means; 0 where undefined."""
    p, l = F.col(predicted), F.col(label)  # noqa: E741
    cells = df.agg(*[F.count_if((p == i) & (l == j)).cast("double").alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)])
    n = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")

    def ratio(a, b):
        return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))

    rows = []
    for k in (0, 1):
        hit, said, true = F.col(f"c{k}{k}"), F.col(f"c{k}0") + F.col(f"c{k}1"), F.col(f"c0{k}") + F.col(f"c1{k}")
        precision, recall = ratio(hit, said), ratio(hit, true)
        rows.append((precision, recall, ratio(2 * precision * recall, precision + recall), true))
    accuracy = ratio(F.col("c00") + F.col("c11"), n)
    macro = [(rows[0][i] + rows[1][i]) / 2 for i in range(3)]
    weighted = [ratio(rows[0][i] * rows[0][3] + rows[1][i] * rows[1][3], n) for i in range(3)]
    named = [("0", *rows[0]), ("1", *rows[1]), ("accuracy", accuracy, accuracy, accuracy, n), ("macro avg", *macro, n), ("weighted avg", *weighted, n)]
    made = F.array(*[F.struct(F.lit(a).alias("name"), b.alias("precision"), c.alias("recall"), d.alias("f1"), e.alias("support")) for a, b, c, d, e in named])
    return cells.select(F.explode(made).alias("r")).select("r.*")
