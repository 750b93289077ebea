"""Ranks, scaling and distributions that stay distributed: no window over all rows in one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Ranges that distinct values are dealt into for a global rank.
RANGES = 64


def rank_table(df: DataFrame, value: str, out: str, descending: bool = False, percent: bool = False) -> DataFrame:
    """(_v, out): the average rank of each distinct value (ties share their mean place), or that over the number of values.

    Distinct values with their counts are dealt into ranges at approximate quantiles; a running sum inside each range and
    the ranges' totals give places. Only the totals, a row a range, meet in one task.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    cuts = counted.agg(F.percentile_approx("_v", F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])).alias("_cuts"))
    dealt = counted.crossJoin(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    totals = dealt.groupBy("_range").agg(F.sum("_n").alias("_in"))
    over = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("_range", F.coalesce(F.sum("_in").over(over), F.lit(0)).alias("_before"), F.sum("_in").over(W.partitionBy(F.lit(1))).alias("_all"))
    running = W.partitionBy("_range").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = dealt.join(F.broadcast(before), "_range").withColumn("_to", F.col("_before") + F.sum("_n").over(running))
    up = F.col("_to") - (F.col("_n") - 1) / F.lit(2.0)
    rank = (F.col("_all") + 1 - up) if descending else up
    return placed.select(F.col("_v"), (rank / F.col("_all") if percent else rank).cast("double").alias(out))


def average_ranks(df: DataFrame, *specs: tuple[str, str, bool], percent: bool = False) -> DataFrame:
    """``df`` with a rank column for each (value, out, descending); every rank table is made from ``df`` itself, so plans don't nest. Null for null."""
    joined = df
    for value, out, descending in specs:
        found = rank_table(df, value, out, descending, percent)
        joined = joined.join(found, joined[value] == found["_v"], "left").drop("_v")
    return joined


def average_rank(df: DataFrame, value: str, out: str, descending: bool = False, percent: bool = False) -> DataFrame:
    """``df`` with the average rank of one column."""
    return average_ranks(df, (value, out, descending), percent=percent)


def with_scalars(df: DataFrame, **aggregates: Column) -> DataFrame:
    """``df`` with aggregates over all its rows as columns (a one-row broadcast)."""
    return df.crossJoin(F.broadcast(df.agg(*[a.alias(n) for n, a in aggregates.items()])))


def minmax(df: DataFrame, value: str, out: str, on_constant: float | None = 0.0) -> DataFrame:
    """``value`` scaled to 0..1 over all rows; ``on_constant`` where all values are equal."""
    x = F.when(F.isnan(value), F.lit(None)).otherwise(F.col(value)) if dict(df.dtypes)[value] in ("double", "float") else F.col(value)
    scaled = with_scalars(df, _lo=F.min(x), _hi=F.max(x))
    constant = F.lit(on_constant).cast("double")
    return scaled.withColumn(out, F.when(x.isNull(), None).when(F.col("_hi") <= F.col("_lo"), constant).otherwise((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")


def histogram(df: DataFrame, value: str, bins: int = 80) -> DataFrame:
    """(bin, low, high, n) of equal-width bins, the last one closed; empty bins are kept."""
    edges = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / F.nullif(step, F.lit(0.0)))).cast("int")
    counts = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(F.coalesce(at, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
    spine = edges.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    return spine.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * step).alias("low"), (F.col("lo") + (F.col("bin") + 1) * step).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def describe(df: DataFrame, value: str) -> DataFrame:
    """One row: count, mean, sample deviation, least, quartiles, largest."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("lo"), q.alias("q"), F.max(value).alias("hi")).select(
        "n", "mean", "std", "lo", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "hi"
    )
