"""Registered queries over metrics, ranks, advisories, scalers and prediction scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..api import Scores
from ..functions import ranks, stats
from ..functions.columns import severity_bucket
from ..operators import ranking
from ..session import materialize
from . import tables as t

SINCE = "1995-01-01 00:00:00"


def _parts(spark, sf):
    m = t.metrics(spark, sf)
    return [m.select("crate_name", c) for c in ("importance", "replacement_metric", "activity_probability")]


def merged(spark, sf):
    return ranking.merge_metrics(*_parts(spark, sf))


def metric_ranks(spark, sf):
    return ranking.combine(merged(spark, sf)).select("crate_name", "rank_importance", "rank_risk", "rank_irreplaceability")


def _combine(method):
    def run(spark, sf):
        out = ranking.combine(merged(spark, sf), method)
        rounded = [F.round(c, 6).alias(c) for c in ("geo_rank_raw", "avg_rank_raw", "geo_rank_score", "avg_rank_score", "combined_score", "combined_score_raw")]
        return out.select("crate_name", "importance", "replacement_metric", "activity_probability", *rounded, "combined_method")

    return run


def combine_topk(spark, sf):
    return ranking.combine(merged(spark, sf)).orderBy(F.desc("combined_score"), "crate_name").limit(20).select("crate_name", F.round("combined_score", 6).alias("combined_score"))


def _advisories(spark, sf):
    return ranking.with_severity(t.advisories(spark, sf))


def severity_numeric(spark, sf):
    return _advisories(spark, sf).groupBy("package").agg(F.count("severity").alias("n"), F.round(F.sum("severity"), 4).alias("total"))


def severity_bucket_counts(spark, sf):
    return _advisories(spark, sf).groupBy(severity_bucket(F.col("severity")).alias("bucket")).agg(F.count("*").alias("n"))


def severity_boxstats(spark, sf):
    a = _advisories(spark, sf).select("severity", F.col("row.l_extendedprice").alias("value"))
    return ranking.box_stats(a.withColumn("bucket", severity_bucket(F.col("severity"))), "bucket", "value").withColumns({c: F.round(c, 4) for c in ("lo", "q25", "q50", "q75", "hi")})


def _worst(spark, sf):
    return ranking.worst_advisory(ranking.with_severity(t.advisories(spark, sf), SINCE), "row")


def advisory_dedupe(spark, sf):
    return _worst(spark, sf).select("package", "severity", "published")


def _rank_maps(spark, sf):
    m = materialize(t.metrics(spark, sf).withColumn("package", F.col("id").cast("string")), "metrics")
    maps = {n: (m.select("package", F.col(c).alias("value")), d) for n, c, d in (("importance", "importance", True), ("maintenance", "activity_probability", False), ("replacement", "replacement_metric", True))}
    return ranking.attach_ranks(_worst(spark, sf), maps, required="maintenance")


def rank_pct_maps(spark, sf):
    return _rank_maps(spark, sf).select("package", *[F.round(f"{c}_rank_pct", 9).alias(f"{c}_rank_pct") for c in ("importance", "maintenance", "replacement")])


def combined_validation(spark, sf):
    rows = materialize(_rank_maps(spark, sf).withColumn("combined", F.col("importance_rank_pct") * F.col("maintenance_rank_pct") * F.col("replacement_rank_pct")), "validation")
    return stats.correlations(rows, "combined", "severity").select("n", F.round("pearson_r", 6).alias("pearson_r"), F.round("spearman_r", 6).alias("spearman_r"))


def dimension_correlations(spark, sf):
    rows = _rank_maps(spark, sf)
    names = ("importance_rank_pct", "maintenance_rank_pct", "replacement_rank_pct")
    return rows.agg(*[F.round(F.corr(a, b), 6).alias(f"{a[0]}{b[0]}") for i, a in enumerate(names) for b in names[i + 1 :]])


def correlation_p_values(spark, sf):
    report = stats.correlation_report(materialize(t.metrics(spark, sf), "metrics"), [("importance", "replacement_metric"), ("importance", "activity_probability")])
    return report.select("pair", "n", *[F.round(c, 6).alias(c) for c in ("pearson_r", "pearson_p", "spearman_r", "spearman_p")])


def linear_fit(spark, sf):
    return ranking.linear_fit(t.metrics(spark, sf), "replacement_metric", "importance").select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


def histogram(spark, sf):
    return ranks.histogram(t.metrics(spark, sf), "activity_probability", 80).withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


def describe(spark, sf):
    return ranks.describe(t.metrics(spark, sf), "activity_probability").select("n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "lo", "q25", "q50", "q75", "hi")])


def _minmax(on_constant):
    def run(spark, sf):
        m = ranks.minmax(t.metrics(spark, sf).withColumn("same", F.lit(1.0)), "same", "constant", on_constant)
        return ranks.minmax(m, "importance", "scaled", on_constant).select("crate_name", F.round("scaled", 9).alias("scaled"), "constant")

    return run


def _predicted(spark, sf):
    m = ranks.minmax(t.metrics(spark, sf), "activity_probability", "score")
    return m.select("id", F.round("score", 3).alias("score"), (F.col("importance") > 1_500_000).cast("int").alias("label"))


def roc_auc(spark, sf):
    return stats.roc_auc(_predicted(spark, sf), "score", "label").withColumn("auc", F.round("auc", 9))


def average_precision(spark, sf):
    return stats.average_precision(_predicted(spark, sf), "score", "label").withColumn("average_precision", F.round("average_precision", 9))


def classification_report(spark, sf):
    rows = _predicted(spark, sf).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return stats.classification_report(rows, "predicted", "label").withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


def label_distribution(spark, sf):
    return _predicted(spark, sf).groupBy("label").agg(F.count("*").alias("n"))


def _scores(spark, sf):
    return ranking.combine(merged(spark, sf)).select("crate_name", F.round("combined_score", 6).alias("score"))


def score_lookup(spark, sf):
    return Scores(_scores(spark, sf)).lookup("CUSTOMER#000000007")


def score_limit(spark, sf):
    top = _scores(spark, sf).orderBy("crate_name")
    return top.limit(25)


def _substitute(method):
    def run(spark, sf):
        return ranking.substitute_score(t.metrics(spark, sf), "replacement_metric", method).select("crate_name", F.round("substitute_score", 9).alias("substitute_score"))

    return run


QUERIES = {
    "metric_merge": merged, "metric_ranks": metric_ranks, **{f"combine_{m}": _combine(m) for m in ("geo", "avg", "both")}, "combine_both_topk": combine_topk, "severity_numeric": severity_numeric,
    "severity_bucket_counts": severity_bucket_counts, "severity_boxstats": severity_boxstats, "advisory_dedupe": advisory_dedupe, "rank_pct_maps": rank_pct_maps,
    "combined_validation": combined_validation, "dimension_correlations": dimension_correlations, "correlation_p_values": correlation_p_values, "linear_fit": linear_fit, "histogram": histogram,
    "describe": describe, "minmax_zero": _minmax(0.0), "minmax_half": _minmax(0.5), "roc_auc": roc_auc, "average_precision": average_precision, "classification_report": classification_report,
    "label_distribution": label_distribution, "score_lookup": score_lookup, "score_limit": score_limit, **{f"substitute_score_{m}": _substitute(m) for m in ("log", "linear", "percentile")},
}

_M = f"WITH {t.METRICS}"
_S = f"{_M}, {t.RANKED}"
_COLUMNS = "crate_name, importance, replacement_metric, activity_probability, round(geo_rank_raw, 6) AS geo_rank_raw, round(avg_rank_raw, 6) AS avg_rank_raw, round(geo_rank_score, 6) AS geo_rank_score, round(avg_rank_score, 6) AS avg_rank_score"
_WORST = f"""worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY severity DESC NULLS LAST, published DESC NULLS LAST, row) AS n FROM advisories WHERE published >= TIMESTAMP '{SINCE}') WHERE n = 1)"""
_PCT = """pct AS (SELECT CAST(id AS VARCHAR) AS package, (rank() OVER (ORDER BY importance DESC) + (count(*) OVER (PARTITION BY importance) - 1) / 2) / count(*) OVER () AS importance_rank_pct,
  (rank() OVER (ORDER BY activity_probability) + (count(*) OVER (PARTITION BY activity_probability) - 1) / 2) / count(*) OVER () AS maintenance_rank_pct,
  (rank() OVER (ORDER BY replacement_metric DESC) + (count(*) OVER (PARTITION BY replacement_metric) - 1) / 2) / count(*) OVER () AS replacement_rank_pct FROM metrics)"""
_JOINED = f"{_M}, {t.ADVISORIES}, {_WORST}, {_PCT}"
_PRED = f"{_M}, p AS (SELECT id, round((activity_probability - min(activity_probability) OVER ()) / (max(activity_probability) OVER () - min(activity_probability) OVER ()), 3) AS score, CAST(importance > 1500000 AS INT) AS label FROM metrics)"
_REPORT = """cells AS (SELECT CAST(k AS VARCHAR) AS name, count(*) FILTER (pr = k AND label = k) AS hit, count(*) FILTER (pr = k) AS said, count(*) FILTER (label = k) AS support FROM (SELECT *, CAST(score >= 0.5 AS INT) AS pr FROM p) CROSS JOIN (VALUES (0), (1)) v(k) GROUP BY k),
r AS (SELECT name, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, hit, CAST(support AS DOUBLE) AS support FROM cells),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r)"""


def _minmax_sql(constant: str) -> str:
    return f"{_M} SELECT crate_name, round((importance - min(importance) OVER ()) / (max(importance) OVER () - min(importance) OVER ()), 9) AS scaled, CAST({constant} AS DOUBLE) AS constant FROM metrics"


def _p(r: str) -> str:
    """SQL of the two-sided p-value of a correlation ``r`` of n pairs: the finite series of Student's distribution, whose angle is asin(r)."""
    even = f"abs({r}) * list_sum(list_transform(range(CAST((n - 2) // 2 AS BIGINT)), lambda k: exp(coalesce(list_sum(list_transform(range(1, k + 1), lambda j: ln((2.0 * j - 1) / (2 * j)))), 0) + k * ln(1 - {r} * {r}))))"
    odd = f"2 / pi() * (asin(abs({r})) + abs({r}) * sqrt(1 - {r} * {r}) * list_sum(list_transform(range(CAST((n - 3) // 2 AS BIGINT)), lambda k: exp(coalesce(list_sum(list_transform(range(1, k + 1), lambda j: ln(2.0 * j / (2 * j + 1)))), 0) + k * ln(1 - {r} * {r})))))"
    return f"round(1 - CASE WHEN n % 2 = 0 THEN {even} ELSE {odd} END, 6)"


ORACLE = {
    "correlation_p_values": f"""{_M}, two AS (SELECT 'importance vs replacement_metric' AS pair, importance AS x, replacement_metric AS y FROM metrics UNION ALL SELECT 'importance vs activity_probability', importance, activity_probability FROM metrics),
k AS (SELECT *, rank() OVER (PARTITION BY pair ORDER BY x) + (count(*) OVER (PARTITION BY pair, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY pair ORDER BY y) + (count(*) OVER (PARTITION BY pair, y) - 1) / 2 AS ry FROM two),
c AS (SELECT pair, count(*) AS n, corr(x, y) AS p, corr(rx, ry) AS s FROM k GROUP BY 1)
SELECT pair, n, round(p, 6) AS pearson_r, {_p("p")} AS pearson_p, round(s, 6) AS spearman_r, {_p("s")} AS spearman_p FROM c""",
    "metric_merge": f"{_M} SELECT crate_name, importance, replacement_metric, activity_probability FROM metrics",
    "metric_ranks": f"{_S} SELECT crate_name, rank_importance, rank_risk, rank_irreplaceability FROM ranked",
    **{f"combine_{m}": f"{_S} SELECT {_COLUMNS}, round({c}_rank_score, 6) AS combined_score, round({c}_rank_raw, 6) AS combined_score_raw, '{n}' AS combined_method FROM scored" for m, c, n in (("geo", "geo", "geometric_mean_rank"), ("avg", "avg", "average_rank"), ("both", "geo", "both_geo_default"))},
    "combine_both_topk": f"{_S} SELECT crate_name, round(geo_rank_score, 6) AS combined_score FROM scored ORDER BY geo_rank_score DESC, crate_name LIMIT 20",
    "severity_numeric": f"WITH {t.ADVISORIES} SELECT package, count(severity) AS n, round(sum(severity), 4) AS total FROM advisories GROUP BY 1",
    "severity_bucket_counts": f"WITH {t.ADVISORIES} SELECT {t.BUCKET} AS bucket, count(*) AS n FROM advisories GROUP BY 1",
    "severity_boxstats": f"WITH {t.ADVISORIES}, b AS (SELECT {t.BUCKET} AS bucket, abs(row[5]) AS v FROM advisories) SELECT bucket, count(*) AS n, round(min(v), 4) AS lo, round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.75), 4) AS q75, round(max(v), 4) AS hi FROM b GROUP BY 1",
    "advisory_dedupe": f"WITH {t.ADVISORIES}, {_WORST} SELECT package, severity, published FROM worst",
    "rank_pct_maps": f"{_JOINED} SELECT package, round(importance_rank_pct, 9) AS importance_rank_pct, round(maintenance_rank_pct, 9) AS maintenance_rank_pct, round(replacement_rank_pct, 9) AS replacement_rank_pct FROM worst JOIN pct USING (package)",
    "combined_validation": f"""{_JOINED}, j AS (SELECT importance_rank_pct * maintenance_rank_pct * replacement_rank_pct AS x, severity AS y FROM worst JOIN pct USING (package) WHERE severity IS NOT NULL),
k AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM j)
SELECT count(*) AS n, round(corr(x, y), 6) AS pearson_r, round(corr(rx, ry), 6) AS spearman_r FROM k""",
    "dimension_correlations": f"{_JOINED} SELECT round(corr(importance_rank_pct, maintenance_rank_pct), 6) AS im, round(corr(importance_rank_pct, replacement_rank_pct), 6) AS ir, round(corr(maintenance_rank_pct, replacement_rank_pct), 6) AS mr FROM worst JOIN pct USING (package)",
    "linear_fit": f"{_M} SELECT round(regr_slope(importance, replacement_metric), 4) AS slope, round(regr_intercept(importance, replacement_metric), 4) AS intercept, regr_count(importance, replacement_metric) AS n FROM metrics",
    "histogram": f"""{_M}, e AS (SELECT min(activity_probability) AS lo, max(activity_probability) AS hi FROM metrics), b AS (SELECT least(79, floor((activity_probability - lo) / ((hi - lo) / 80))) AS bin, count(*) AS n FROM metrics, e GROUP BY 1)
SELECT CAST(i AS INT) AS bin, round(lo + i * ((hi - lo) / 80), 4) AS low, round(lo + (i + 1) * ((hi - lo) / 80), 4) AS high, coalesce(n, 0) AS n FROM range(80) r(i) CROSS JOIN e LEFT JOIN b ON bin = i""",
    "describe": f"{_M}, v AS (SELECT activity_probability AS v FROM metrics) SELECT count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS lo, round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.75), 4) AS q75, round(max(v), 4) AS hi FROM v",
    "minmax_zero": _minmax_sql("0"),
    "minmax_half": _minmax_sql("0.5"),
    "roc_auc": f"{_PRED}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM p), c AS (SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, sum(r) FILTER (label = 1) AS s FROM r) SELECT n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 9) AS auc FROM c",
    "average_precision": f"{_PRED}, g AS (SELECT score, count(*) AS n, count(*) FILTER (label = 1) AS p FROM p GROUP BY 1), w AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER () AS all_p FROM g) SELECT round(sum(p / all_p * cp / cn), 9) AS average_precision FROM w",
    "classification_report": f"""{_PRED}, {_REPORT}
SELECT name, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM f
UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 9), round(sum(hit) / sum(support), 9), round(sum(hit) / sum(support), 9), sum(support) FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), sum(support) FROM f""",
    "label_distribution": f"{_PRED} SELECT label, count(*) AS n FROM p GROUP BY 1",
    "score_lookup": f"{_S} SELECT crate_name, round(geo_rank_score, 6) AS score FROM scored WHERE lower(crate_name) = 'customer#000000007'",
    "score_limit": f"{_S} SELECT crate_name, round(geo_rank_score, 6) AS score FROM scored ORDER BY crate_name LIMIT 25",
    "substitute_score_log": f"{_M} SELECT crate_name, round((ln(1 + replacement_metric) - min(ln(1 + replacement_metric)) OVER ()) / (max(ln(1 + replacement_metric)) OVER () - min(ln(1 + replacement_metric)) OVER ()), 9) AS substitute_score FROM metrics",
    "substitute_score_linear": f"{_M} SELECT crate_name, round((replacement_metric - min(replacement_metric) OVER ()) / (max(replacement_metric) OVER () - min(replacement_metric) OVER ()), 9) AS substitute_score FROM metrics",
    "substitute_score_percentile": f"{_M} SELECT crate_name, round((rank() OVER (ORDER BY replacement_metric) + (count(*) OVER (PARTITION BY replacement_metric) - 1) / 2) / count(*) OVER (), 9) AS substitute_score FROM metrics",
}
