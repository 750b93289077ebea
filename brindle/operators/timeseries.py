"""Gap-filled series, lags, rolling windows, sequences and labels over (repo_key, period)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ranks import rank_table, with_scalars
from ..session import materialize


def spine(features: DataFrame, periods: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Every repo with every period (a small, stated list): (repo_key, period)."""
    known = (repos if repos is not None else features).select("repo_key").distinct()
    return known.crossJoin(F.broadcast(periods.select("period").distinct()))


def zero_fill(features: DataFrame, periods: DataFrame, columns: list[str], repos: DataFrame | None = None) -> DataFrame:
    """All repos by all periods; missing measures are 0."""
    full = spine(features, periods, repos).join(features.select("repo_key", "period", *columns), ["repo_key", "period"], "left")
    return full.select("repo_key", "period", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])


def forward_fill(features: DataFrame, periods: DataFrame, columns: list[str]) -> DataFrame:
    """All repos by all periods; a missing period repeats the last whole row, leading gaps are zeros."""
    full = spine(features, periods).join(features.select("repo_key", "period", F.struct(*columns).alias("_v")), ["repo_key", "period"], "left")
    over = W.partitionBy("repo_key").orderBy("period").rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = full.withColumn("_v", F.last("_v", ignorenulls=True).over(over))
    return filled.select("repo_key", "period", *[F.coalesce(F.col(f"_v.{c}"), F.lit(0)).alias(c) for c in columns])


def lags(df: DataFrame, column: str, steps: tuple[int, ...] = (1, 2, 3, 6, 12)) -> DataFrame:
    over = W.partitionBy("repo_key").orderBy("period")
    return df.withColumns({f"{column}_lag_{k}": F.lag(column, k).over(over) for k in steps})


def rolling(df: DataFrame, column: str, windows: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """Mean, sample deviation, largest and least over the last w rows; null until a window is full."""
    place = F.row_number().over(W.partitionBy("repo_key").orderBy("period"))
    out = df.withColumn("_place", place)
    for w in windows:
        over = W.partitionBy("repo_key").orderBy("period").rowsBetween(1 - w, 0)
        for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max), ("min", F.min)):
            out = out.withColumn(f"{column}_rolling_{name}_{w}", F.when(F.col("_place") >= w, f(column).over(over)))
    return out.drop("_place")


def latest_features(df: DataFrame, columns: list[str], least: int = 12) -> DataFrame:
    """Lags 1, 2, 3, 6 and rolling 3, 6 of the last present row of each repo with at least ``least`` rows; nulls are 0."""
    made = df
    for c in columns:
        made = rolling(lags(made, c, (1, 2, 3, 6)), c, (3, 6))
    by = W.partitionBy("repo_key")
    last = made.withColumn("_n", F.count("*").over(by)).withColumn("_r", F.row_number().over(by.orderBy(F.desc("period")))).filter(f"_n >= {least} AND _r = 1").drop("_n", "_r")
    return last.na.fill(0)


def sequences(filled: DataFrame, columns: list[str], length: int) -> DataFrame:
    """(repo_key, sequence): the last ``length`` periods' vectors in order, zeros in front of shorter series."""
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    rows = filled.groupBy("repo_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("period", vector.alias("v")))), lambda e: e["v"]).alias("all"))
    zeros = F.array_repeat(F.array(*[F.lit(0.0)] * len(columns)), F.greatest(F.lit(0), length - F.size("all")))
    return rows.select("repo_key", F.slice(F.concat(zeros, "all"), -length, length).alias("sequence"))


def future_activity(features: DataFrame, label_periods: DataFrame, repos: DataFrame, activity: Column) -> DataFrame:
    """(repo_key, label): 1 if any row of the label periods shows activity; absent repos are 0."""
    seen = features.join(F.broadcast(label_periods.select("period")), "period", "left_semi").groupBy("repo_key").agg(F.max(F.when(activity, 1).otherwise(0)).alias("label"))
    return repos.select("repo_key").distinct().join(seen, "repo_key", "left").select("repo_key", F.coalesce("label", F.lit(0)).alias("label"))


def last_periods(features: DataFrame, n: int) -> DataFrame:
    """The last n distinct periods."""
    return features.select("period").distinct().orderBy(F.desc("period")).limit(n)


def calendar(first: str, last: str) -> Column:
    """First days of the months from ``first`` to ``last`` as one array column."""
    return F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("INTERVAL 1 MONTH"))


def scaler(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the least value and the range of each column (range 1 where it is constant)."""
    span = lambda c: F.coalesce(F.nullif(F.max(c) - F.min(c), F.lit(0)), F.lit(1)).cast("double")
    return train.agg(*[F.min(c).cast("double").alias(f"{c}_min") for c in columns], *[span(c).alias(f"{c}_range") for c in columns])


def scaled(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """Columns by the fitted scaler, not clipped."""
    return df.crossJoin(F.broadcast(fitted)).select(*[c for c in df.columns if c not in columns], *[((F.col(c) - F.col(f"{c}_min")) / F.col(f"{c}_range")).alias(c) for c in columns])


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with part: in each class, ``test`` of the keys are test, ``test`` of the rest validation, the others train.

    Keys of a class are taken in order of a hash, so the shares are exact (rounded) and repeatable; ranks are distributed ones.
    """
    hashed = df.select(F.col(key), F.col(label), F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("bigint").alias("_h")).distinct()
    hashed = materialize(hashed, "split")
    classes = sorted(r[0] for r in hashed.select(label).distinct().filter(F.col(label).isNotNull()).collect())  # classes of a prediction: a few
    made = None
    for c in classes:
        own = hashed.filter(F.col(label) == F.lit(c))
        ranked = own.join(rank_table(own, "_h", "_r"), own["_h"] == F.col("_v")).select(key, label, "_r")
        ranked = with_scalars(ranked, _n=F.count("*"))
        first = F.round(F.col("_n") * test)
        part = F.when(F.col("_r") <= first, "test").when(F.col("_r") <= first + F.round((F.col("_n") - first) * test), "validation").otherwise("train")
        each = ranked.select(key, label, part.alias("part"))
        made = each if made is None else made.unionByName(each)
    if made is None:
        return df.withColumn("part", F.lit(None).cast("string"))
    return df.join(made, [key, label], "left")
