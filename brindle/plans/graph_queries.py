"""Registered queries over the dependency graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranks import average_ranks
from ..functions.stats import correlations
from ..operators import graph
from . import tables as t


def edges(spark, sf):
    return graph.dependency_edges(t.dependencies(spark, sf), t.versions(spark, sf), t.crates(spark, sf))


def weight(spark, sf):
    return graph.weights(t.crates(spark, sf), graph.recent_downloads(t.downloads(spark, sf), t.versions(spark, sf)))


def latest_version(spark, sf):
    return graph.latest_versions(t.versions(spark, sf))


def degree_stats(spark, sf):
    return graph.degrees(t.crates(spark, sf), edges(spark, sf))


def degree_averages(spark, sf):
    return degree_stats(spark, sf).agg(F.avg("in_degree").alias("avg_in"), F.avg("out_degree").alias("avg_out"))


def recent_downloads(spark, sf):
    return graph.recent_downloads(t.downloads(spark, sf), t.versions(spark, sf))


def node_weights(spark, sf):
    return weight(spark, sf).select("id", F.round("w", 6).alias("w"))


def unweighted_nodes(spark, sf):
    return graph.weights(t.crates(spark, sf), None)


def graph_summary(spark, sf):
    e = graph.materialize(edges(spark, sf), "graph")
    nodes = t.crates(spark, sf)
    row = graph.summary(nodes, e, graph.weak_components(nodes, e), graph.strong_components(nodes, e))
    return row.withColumn("avg_degree", F.round("avg_degree", 6))


def wcc_labels(spark, sf):
    return graph.weak_components(t.crates(spark, sf), edges(spark, sf))


def scc_labels(spark, sf):
    return graph.strong_components(t.crates(spark, sf), edges(spark, sf))


def pagerank_20(spark, sf):
    return graph.pagerank(t.crates(spark, sf), graph.materialize(edges(spark, sf), "graph"), tol=None, max_iter=20).select("id", F.round("pagerank", 9).alias("pagerank"))


def pagerank_converged(spark, sf):
    return graph.pagerank(t.crates(spark, sf), graph.materialize(edges(spark, sf), "graph")).select("id", F.round("pagerank", 9).alias("pagerank"))


def cache_coverage(spark, sf):
    return graph.cache_coverage(t.versions(spark, sf).select(F.col("crate_id").alias("id")), t.crates(spark, sf)).withColumn("coverage", F.round("coverage", 6))


def hop_pairs(spark, sf):
    return graph.hops(edges(spark, sf))


def hop_layer_stats(spark, sf):
    e = graph.materialize(edges(spark, sf), "graph")
    return graph.layer_stats(e, weight(spark, sf), 7).withColumns({"sum_weight": F.round("sum_weight", 6), "avg_weight": F.round("avg_weight", 6)})


def _decay(spark, sf):
    return graph.decay_scores(t.crates(spark, sf), graph.materialize(edges(spark, sf), "graph"), weight(spark, sf))


def decay_scores(spark, sf):
    return _decay(spark, sf).select("id", F.round("s_down", 6).alias("s_down"), F.round("s_up", 6).alias("s_up"))


def _importance(method):
    return lambda spark, sf: graph.importance(_decay(spark, sf), method).select("id", F.round("importance", 6).alias("importance"))


def corr_report(spark, sf):
    # sums of floats differ in their last digits by order of summation, which would make or break ties of ranks
    scores = graph.materialize(graph.importance(_decay(spark, sf)).withColumn("importance", F.round("importance", 9)).join(degree_stats(spark, sf), "id"), "scores")
    return correlations(scores, "importance", "in_degree").select("n", F.round("pearson_r", 5).alias("pearson_r"), F.round("spearman_r", 5).alias("spearman_r"))


def name_lookup(spark, sf):
    return graph.find_by_name(t.crates(spark, sf), " customer#000000042 ")


def induced_subgraph(spark, sf):
    e = graph.materialize(edges(spark, sf), "graph")
    top = graph.degrees(t.crates(spark, sf), e).orderBy(F.desc("in_degree"), "id").limit(100)
    return graph.induced(e, top)


def spearman_ranks(spark, sf):
    m = t.metrics(spark, sf)
    ranked = average_ranks(m, ("importance", "rx", False), ("activity_probability", "ry", False))
    return ranked.select("crate_name", F.col("rx").cast("int").alias("rank_x"), F.col("ry").cast("int").alias("rank_y"))


QUERIES = {
    "directed_edges": edges, "latest_version": latest_version, "degree_stats": degree_stats, "degree_averages": degree_averages, "recent_downloads": recent_downloads, "node_weights": node_weights,
    "unweighted_nodes": unweighted_nodes, "graph_summary": graph_summary, "wcc_labels": wcc_labels, "scc_labels": scc_labels, "pagerank_20": pagerank_20, "pagerank_converged": pagerank_converged,
    "cache_coverage": cache_coverage, "hop_pairs": hop_pairs, "hop_layer_stats": hop_layer_stats, "decay_scores": decay_scores,
    **{f"importance_{m}": _importance(m) for m in ("linear", "geo", "harmonic", "max", "min")},
    "corr_report": corr_report, "name_lookup": name_lookup, "induced_subgraph": induced_subgraph, "spearman_ranks": spearman_ranks,
}

_NORM = """norm AS (SELECT id, CASE WHEN max(s_down) OVER () <= min(s_down) OVER () THEN 0 ELSE (s_down - min(s_down) OVER ()) / (max(s_down) OVER () - min(s_down) OVER ()) END AS d,
  CASE WHEN max(s_up) OVER () <= min(s_up) OVER () THEN 0 ELSE (s_up - min(s_up) OVER ()) / (max(s_up) OVER () - min(s_up) OVER ()) END AS u FROM scores)"""
_ALL = f"WITH RECURSIVE {t.EDGES}, {t.DOWNLOADS}, {t.PAIRS}, {t.DECAY}"
_COMBINED = {"linear": "0.8 * d + 0.2 * u", "geo": "sqrt(d * u)", "harmonic": "CASE WHEN d + u > 0 THEN 2 * d * u / (d + u) ELSE 0 END", "max": "greatest(d, u)", "min": "least(d, u)"}
_WEAK = """both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
walk(id, c) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT b, c FROM walk JOIN both_ways ON a = id WHERE c < b),
weak AS (SELECT id, min(c) AS component FROM walk GROUP BY id)"""
_STRONG = """r(a, b) AS (SELECT src, dst FROM edges UNION SELECT a, dst FROM r JOIN edges ON b = src),
strong AS (SELECT c_custkey AS id, least(c_custkey, coalesce((SELECT min(x.b) FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a = c_custkey), c_custkey)) AS component FROM customer)"""
_DEGREES = """degrees AS (SELECT c_custkey AS id, (SELECT count(*) FROM edges WHERE dst = c_custkey) AS in_degree, (SELECT count(*) FROM edges WHERE src = c_custkey) AS out_degree FROM customer)"""

def _rank_sql(rounds: int) -> str:
    return f"""WITH RECURSIVE {t.EDGES}, n AS (SELECT count(*) AS n FROM customer), outs AS (SELECT src, count(*) AS o FROM edges GROUP BY 1),
pr(k, id, x) AS (SELECT 0, c_custkey, 1.0::DOUBLE / n.n FROM customer, n
  UNION ALL SELECT k + 1, c_custkey, 0.85 * (coalesce(got, 0) + loose / n.n) + 0.15 / n.n FROM
    (SELECT DISTINCT k FROM pr WHERE k < {rounds}) CROSS JOIN customer CROSS JOIN n
    LEFT JOIN (SELECT dst, sum(x / o) AS got FROM pr JOIN edges ON pr.id = edges.src JOIN outs ON outs.src = edges.src GROUP BY 1) ON dst = c_custkey
    CROSS JOIN (SELECT coalesce(sum(x), 0) AS loose FROM pr WHERE id NOT IN (SELECT src FROM outs)))
SELECT id, round(x / sum(x) OVER (), 9) AS pagerank FROM pr WHERE k = {rounds}"""


ORACLE = {
    "directed_edges": f"WITH {t.EDGES} SELECT * FROM edges",
    "latest_version": f"WITH {t.EDGES} SELECT o_custkey AS crate_id, o_orderkey AS version_id FROM latest",
    "degree_stats": f"WITH {t.EDGES}, {_DEGREES} SELECT * FROM degrees",
    "degree_averages": f"WITH {t.EDGES}, {_DEGREES} SELECT avg(in_degree) AS avg_in, avg(out_degree) AS avg_out FROM degrees",
    "recent_downloads": f"WITH {t.DOWNLOADS} SELECT * FROM recent",
    "node_weights": f"WITH {t.DOWNLOADS} SELECT id, round(w, 6) AS w FROM weights",
    "unweighted_nodes": "SELECT c_custkey AS id, CAST(1 AS DOUBLE) AS w FROM customer",
    "graph_summary": f"""WITH RECURSIVE {t.EDGES}, {_WEAK}, {_STRONG}, sizes AS (SELECT component, count(*) AS size FROM weak GROUP BY 1)
SELECT (SELECT count(*) FROM customer) AS nodes, (SELECT count(*) FROM edges) AS edges, round((SELECT count(*) FROM edges) / (SELECT count(*) FROM customer), 6) AS avg_degree,
  (SELECT count(*) FROM sizes) AS wcc_count, (SELECT count(DISTINCT component) FROM strong) AS scc_count, component AS biggest_wcc, size AS biggest_wcc_size FROM sizes ORDER BY size DESC, component LIMIT 1""",
    "wcc_labels": f"WITH RECURSIVE {t.EDGES}, {_WEAK} SELECT id, component FROM weak",
    "scc_labels": f"WITH RECURSIVE {t.EDGES}, {_STRONG} SELECT id, component FROM strong",
    "pagerank_20": _rank_sql(20),
    "pagerank_converged": _rank_sql(60),  # steps are under the tolerance long before
    "cache_coverage": """WITH c AS (SELECT count(*) AS total, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS covered FROM customer)
SELECT covered, total, round(covered / total, 6) AS coverage, covered / total >= 0.98 AS valid FROM c""",
    "hop_pairs": f"WITH RECURSIVE {t.EDGES}, {t.PAIRS} SELECT src, dst, dist FROM pairs",
    "hop_layer_stats": f"""WITH RECURSIVE {t.EDGES}, {t.DOWNLOADS}, {t.PAIRS},
near AS (SELECT 'up' AS direction, dist, dst AS id FROM pairs WHERE src = 7 UNION ALL SELECT 'down', dist, src FROM pairs WHERE dst = 7)
SELECT direction, CAST(distance AS INT) AS distance, count(w) AS n, round(coalesce(sum(w), 0), 6) AS sum_weight, round(coalesce(avg(w), 0), 6) AS avg_weight
FROM (VALUES ('up'), ('down')) a(direction) CROSS JOIN range(1, 7) b(distance) LEFT JOIN (SELECT direction AS nd, dist, w FROM near JOIN weights USING (id)) ON nd = direction AND dist = distance GROUP BY 1, 2""",
    "decay_scores": f"{_ALL} SELECT id, round(s_down, 6) AS s_down, round(s_up, 6) AS s_up FROM scores",
    **{f"importance_{m}": f"{_ALL}, {_NORM} SELECT id, round({x}, 6) AS importance FROM norm" for m, x in _COMBINED.items()},
    "corr_report": f"""{_ALL}, {_NORM}, {_DEGREES}, both_ AS (SELECT round(0.8 * d + 0.2 * u, 9) AS x, CAST(in_degree AS DOUBLE) AS y FROM norm JOIN degrees USING (id)),
r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM both_)
SELECT count(*) AS n, round(corr(x, y), 5) AS pearson_r, round(corr(rx, ry), 5) AS spearman_r FROM r""",
    "name_lookup": "SELECT c_custkey AS id, c_name AS name FROM customer WHERE lower(c_name) = 'customer#000000042'",
    "induced_subgraph": f"WITH {t.EDGES}, {_DEGREES}, top AS (SELECT id FROM degrees ORDER BY in_degree DESC, id LIMIT 100) SELECT src, dst FROM edges WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top)",
    "spearman_ranks": f"""WITH {t.METRICS} SELECT crate_name, CAST(floor(rank() OVER (ORDER BY importance) + (count(*) OVER (PARTITION BY importance) - 1) / 2) AS INT) AS rank_x,
  CAST(floor(rank() OVER (ORDER BY activity_probability) + (count(*) OVER (PARTITION BY activity_probability) - 1) / 2) AS INT) AS rank_y FROM metrics""",
}
