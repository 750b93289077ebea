"""Connected components of an edge list by large-star and small-star rounds; every round is one written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each vertex's neighbours (larger ones only, or smaller ones only) to the least of them and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        linked = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        linked = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return linked.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> tuple[DataFrame, common.Tables]:
    """(id, component) for every vertex of ``edges`` (a, b), and the table it lies in; component is the least id reachable. Vertices without edges aren't listed."""
    tables = common.Tables()
    now = tables.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    n = now.count()
    while True:
        step = common.Tables()
        new = step.write(_star(_star(now, True), False), "edges")
        same = new.count() == n and not new.join(now, ["a", "b"], "left_anti").limit(1).count()
        n = new.count()
        tables.drop(new.sparkSession)
        now, tables = new, step
        if same:
            break
    labels = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return tables.only(labels.union(now.select("b", "b").distinct()).distinct(), "components"), tables
