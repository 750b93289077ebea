"""Combining metrics by rank, and holding them against advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import key, severity
from ..functions.ranks import average_rank, average_ranks, minmax
from ..session import materialize


def merge_metrics(importance: DataFrame, replacement: DataFrame, activity: DataFrame) -> DataFrame:
    """Inner join on crate_name of the three metric tables, with numbers only; required columns are checked."""
    wanted = {"importance": importance, "replacement_metric": replacement, "activity_probability": activity}
    parts = []
    for column, df in wanted.items():
        if missing := {"crate_name", column} - set(df.columns):
            raise ValueError(f"missing columns: {sorted(missing)}")
        value = F.col(column).try_cast("double") if dict(df.dtypes)[column] == "string" else F.col(column).cast("double")
        parts.append(df.select("crate_name", value.alias(column)))
    return parts[0].join(parts[1], "crate_name").join(parts[2], "crate_name").dropna()


def combine(merged: DataFrame, method: str = "both") -> DataFrame:
    """Ranks of importance, risk (1 - activity) and irreplaceability, their geometric and arithmetic means, scaled and chosen by ``method``."""
    base = materialize(merged, "merged")
    ranked = average_ranks(base, ("importance", "rank_importance", False), ("activity_probability", "rank_risk", True), ("replacement_metric", "rank_irreplaceability", True))
    a, b, c = F.col("rank_importance"), F.col("rank_risk"), F.col("rank_irreplaceability")
    scored = materialize(ranked.withColumn("geo_rank_raw", F.pow(a * b * c, F.lit(1 / 3))).withColumn("avg_rank_raw", (a + b + c) / 3), "ranked")
    scored = minmax(minmax(scored, "geo_rank_raw", "geo_rank_score"), "avg_rank_raw", "avg_rank_score")
    chosen, name = {"geo": ("geo", "geometric_mean_rank"), "avg": ("avg", "average_rank"), "both": ("geo", "both_geo_default")}[method]
    return scored.withColumns({"combined_score": F.col(f"{chosen}_rank_score"), "combined_score_raw": F.col(f"{chosen}_rank_raw"), "combined_method": F.lit(name)})


def with_severity(advisories: DataFrame, since: str | None = None) -> DataFrame:
    """Advisories (package, cvss, label, published) from a date on, with severity and lower-cased package."""
    rows = advisories.filter(F.col("published") >= F.to_timestamp(F.lit(since))) if since else advisories
    return rows.withColumn("package", key(F.col("package").cast("string"))).withColumn("severity", severity(F.col("cvss"), F.col("label")))


def worst_advisory(advisories: DataFrame, tie: str) -> DataFrame:
    """The most severe advisory of each package, the newest on ties; nulls last."""
    order = W.partitionBy("package").orderBy(F.desc_nulls_last("severity"), F.desc_nulls_last("published"), F.col(tie))
    return advisories.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) of the row of each key that comes last in ``order``."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def attach_ranks(advisories: DataFrame, metrics: dict[str, tuple[DataFrame, bool]], required: str | None = None) -> DataFrame:
    """Percentile ranks of metrics (package, value) joined to advisories as {name}_rank_pct; rows without ``required`` go."""
    out = advisories
    for name, (df, descending) in metrics.items():
        ranked = average_rank(df, "value", f"{name}_rank_pct", descending, percent=True).select("package", f"{name}_rank_pct")
        out = out.join(ranked, "package", "inner" if name == required else "left")
    return out.filter(F.col(f"{required}_rank_pct").isNotNull()) if required else out


def substitute_score(df: DataFrame, value: str, method: str = "log") -> DataFrame:
    """``df`` with substitute_score: scaled log1p, scaled, or percentile rank; null where a scale is constant."""
    if method == "percentile":
        return average_rank(df, value, "substitute_score", percent=True)
    if method not in ("log", "linear"):
        raise ValueError(f"unknown method {method!r}")
    source = df.withColumn("_x", F.log1p(F.col(value).cast("double")) if method == "log" else F.col(value).cast("double"))
    return minmax(source, "_x", "substitute_score", None).drop("_x")


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (slope, intercept, n) of least squares."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def box_stats(df: DataFrame, bucket: str, value: str) -> DataFrame:
    """(bucket, n, lo, q25, q50, q75, hi) of the absolute values in each bucket."""
    v = F.abs(value)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(bucket).agg(F.count(v).alias("n"), F.min(v).alias("lo"), q.alias("q"), F.max(v).alias("hi")).select(bucket, "n", "lo", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "hi")
