"""The five stages of the risk ranking, from tables to the validation report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import graph, model, ranking, timeseries, vectors
from .runner import Pipeline, Stage

#: Months of activity that the maintenance stage needs, those that it looks back on, and those that its labels come from.
MONTHS, SEQUENCE, LABELS = 24, 12, 12
#: Measures that a sequence holds.
MEASURES = ["push_events", "prs_merged", "active_contributors_count"]

Tables = dict[str, DataFrame]


def criticality(spark: SparkSession, t: Tables) -> DataFrame:
    """(crate_name, importance) from crates (id, name), versions, dependencies (kind 0) and downloads."""
    edges = graph.materialize(graph.dependency_edges(t["dependencies"], t["versions"], t["crates"], kind=F.col("kind") == 0), "graph")
    weight = graph.weights(t["crates"], graph.recent_downloads(t["downloads"], t["versions"]))
    scored = graph.importance(graph.decay_scores(t["crates"], edges, weight))
    return t["crates"].join(scored, "id").select(F.col("name").alias("crate_name"), "importance")


def maintenance(spark: SparkSession, t: Tables) -> DataFrame:
    """(crate_name, activity_probability) from months (repo_key, period, measures) and repositories (repo_key, name, place)."""
    months = t["months"].select("repo_key", "period", *MEASURES)
    late = timeseries.last_periods(months, LABELS)
    early = months.join(F.broadcast(late), "period", "left_anti")
    active = timeseries.future_activity(months, late, months, F.greatest(*MEASURES) > 0)
    sequences = timeseries.sequences(timeseries.forward_fill(early, early, MEASURES), MEASURES, SEQUENCE).join(active, "repo_key")
    split = graph.materialize(timeseries.stratified_split(sequences, "repo_key", "label"), "sequences")
    scored = model.fit_predict(split.filter("part = 'train'"), split, "logistic")
    return model.predictions_by_crate(scored, t["repositories"])


def replaceability(spark: SparkSession, t: Tables) -> DataFrame:
    """(crate_name, replacement_metric) from embeddings (id, name, embedding)."""
    return t["embeddings"].join(vectors.replacement_metric(t["embeddings"].select("id", "embedding")), "id").select(F.col("name").alias("crate_name"), "replacement_metric")


def combine(spark: SparkSession, t: Tables) -> DataFrame:
    """All three metrics, their ranks and combined scores."""
    return ranking.combine(ranking.merge_metrics(t["criticality"], t["replaceability"], t["maintenance"]))


def validate(spark: SparkSession, t: Tables) -> DataFrame:
    """Correlation of the combined score with the worst advisory of each package."""
    worst = ranking.worst_advisory(ranking.with_severity(t["advisories"]), "ghsa_id")
    rows = worst.join(t["combine"].select(F.lower("crate_name").alias("package"), "combined_score"), "package")
    return stats.correlation_report(graph.materialize(rows.select("combined_score", "severity"), "validation"), [("combined_score", "severity")])


def enough_months(t: Tables) -> None:
    n = t["months"].select("period").distinct().count()
    if n < MONTHS:
        raise ValueError(f"maintenance needs {MONTHS} months of activity, there are {n}")


def pipeline(tables: Tables) -> Pipeline:
    """Criticality, maintenance, replaceability, combination and validation over the given input tables."""
    return Pipeline(
        [
            Stage("criticality", ["crates", "versions", "dependencies", "downloads"], criticality), Stage("maintenance", ["months", "repositories"], maintenance, enough_months),
            Stage("replaceability", ["embeddings"], replaceability), Stage("combine", ["criticality", "maintenance", "replaceability"], combine), Stage("validate", ["combine", "advisories"], validate),
        ],
        dict(tables),
    )
