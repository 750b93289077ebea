"""Registered queries that write the stand-ins to files of each format and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph, model, timeseries
from ..session import materialize, shared_dir
from ..sources import readers, writers
from . import event_queries, graph_queries, vector_queries
from . import tables as t


def _place(spark, name):
    return f"{shared_dir(spark)}/brindle/{name}-{uuid.uuid4().hex}"


def _csv(spark, df, name):
    where = _place(spark, name)
    df.write.option("header", True).option("escape", '"').csv(where)
    return where


def versions_csv(spark, sf):
    v = t.versions(spark, sf).withColumn("updated_at", F.when(F.col("id") % 7 != 0, F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSS"))).withColumn("created_at", F.lit("2020-01-02 03:04:05+00"))
    back = readers.versions(spark, _csv(spark, v, "versions"))
    return back.select("id", "crate_id", F.unix_seconds("updated_at").alias("updated_at"), F.unix_seconds("created_at").alias("created_at"))


def dependency_files(spark, sf):
    """Edges of the usual kind (0) from the three CSVs."""
    deps = t.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_partkey").alias("crate_id"), F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("kind"))
    versions = t.versions(spark, sf).withColumn("created_at", F.lit(None).cast("string")).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))
    read = readers.dependencies(spark, _csv(spark, deps, "deps")), readers.versions(spark, _csv(spark, versions, "versions")), readers.crates(spark, _csv(spark, t.crates(spark, sf), "crates"))
    return graph.dependency_edges(*read, kind=F.col("kind") == 0)


def download_csv(spark, sf):
    d = t.downloads(spark, sf).select(F.to_date("date").alias("date"), F.col("downloads").cast("bigint").alias("downloads"), "version_id")
    return graph.recent_downloads(readers.version_downloads(spark, _csv(spark, d, "downloads")), t.versions(spark, sf))


def prediction_csv(spark, sf):
    """Numbers only, and one row of a name."""
    m = t.metrics(spark, sf).select("crate_name", F.when(F.col("id") % 5 == 0, F.lit("none")).otherwise(F.col("activity_probability").cast("string")).alias("activity_probability"))
    return readers.predictions(spark, _csv(spark, m.unionByName(m), "predictions"))


def metric_files(spark, sf):
    m = t.metrics(spark, sf)
    paths = [_csv(spark, m.select("crate_name", c), c) for c in ("importance", "replacement_metric", "activity_probability")]
    a, b, c = readers.metric_files(spark, *paths)
    return a.join(b, "crate_name").join(c, "crate_name")


def advisory_lines(spark, sf):
    p = t.read(spark, sf, "part")
    name = F.concat(F.lit(" "), F.upper("p_name"))
    line = F.struct(
        F.when(F.col("p_partkey") % 3 == 0, name).alias("package"), F.when(F.col("p_partkey") % 3 == 1, name).alias("package_name"), F.when(F.col("p_partkey") % 3 == 2, name).alias("crate_name"),
        F.col("p_retailprice").cast("string").alias("cvss_score"), F.lit("HIGH").alias("severity"), F.lit("2025-01-02T03:04:05Z").alias("published"), F.concat(F.lit("G"), "p_partkey").alias("ghsaId"),
    )
    where = _place(spark, "advisories")
    p.select(F.when(F.col("p_partkey") % 50 == 0, F.lit("no json")).otherwise(F.to_json(line)).alias("value")).write.text(where)
    return readers.advisories(spark, where).select("ghsa_id", "package", "cvss", "label", F.unix_seconds("published").alias("published"))


def repository_list(spark, sf):
    """The project list from crates' repositories, written as text and read as a list."""
    c = t.crates(spark, sf).select(F.concat(F.lit("https://github.com/Org"), F.col("id") % 97, F.lit("/Repo.git")).alias("repository"))
    where = _place(spark, "projects")
    readers.project_list(c).coalesce(1).write.text(where)
    return readers.repo_list(spark, where)


def embedding_lines(spark, sf):
    e = t.embeddings(spark, sf)
    where = _place(spark, "embeddings")
    e.select(F.concat(F.lit("v"), "id").alias("package_name"), "embedding").write.json(where)
    back = readers.embeddings(spark, where)
    return back.select("name", F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def embedding_cache(spark, sf):
    e = t.embeddings(spark, sf)
    where = _place(spark, "cache")
    writers.embedding_cache(e.select(F.concat(F.lit("v"), "id").alias("name"), F.col("id").alias("crate_id"), "embedding"), where)
    back = readers.cached_embeddings(spark, where)
    return back.select("name", "crate_id", F.size("embedding").alias("n"))


def function_descriptions(spark, sf):
    """Descriptions joined to names; of names that differ by case alone, the first row stays."""
    c = t.crates(spark, sf)
    rows = c.select(F.col("id").alias("crate_id"), *[F.lit(None).cast("string").alias(x) for x in ("github_owner", "github_repo")], F.concat(F.lit("role "), "id").alias("functional_role"), *[F.lit("x").alias(x) for x in ("capability_set", "api_intent", "architectural_position", "integration_pattern", "key_inputs", "key_outputs", "external_interfaces", "domain_tags")])
    twins = c.select((F.col("id") + 10_000_000).alias("id"), F.upper("name").alias("name"))
    again = rows.withColumn("crate_id", F.col("crate_id") + 10_000_000)
    where = _csv(spark, rows.unionByName(again).orderBy("crate_id").coalesce(1), "functions")
    return readers.functions(spark, where, c.unionByName(twins)).select("crate_id", "name", "functional_role")


def replacement_pairs(spark, sf):
    """Accepted answers, written as pairs and read again without those that name themselves."""
    p = t.read(spark, sf, "part")
    k = F.col("p_partkey")
    said = F.when(k % 5 == 0, "None").when(k % 5 == 1, "").when(k % 5 == 2, F.concat(F.lit(" "), F.upper("p_name"))).when(k % 5 == 3, F.lit("unknown")).otherwise(F.lit("steel widget"))
    names = p.select(F.col("p_name").alias("name")).unionByName(spark.createDataFrame([("Steel Widget",)], "name string"))
    answers = p.select(k.alias("crate_id"), F.col("p_name").alias("name"), F.lit("o").alias("github_owner"), F.lit("r").alias("github_repo"), said.alias("replacement"), F.lit("s").alias("snippet"))
    where = _csv(spark, readers.accepted_replacements(answers, names), "pairs")
    return readers.pairs(spark, where, names).select("crate_id", "name", "replacement")


def month_file_list(spark, sf):
    o = t.read(spark, sf, "orders").select(F.concat(F.lit("gha/"), F.date_format("o_orderdate", "yyyy"), F.lit("/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), F.col("o_orderkey") % 27, F.lit(".json.gz")).alias("source_path"))
    return readers.month_files(o, 1996, 2)


def node_table(spark, sf):
    where = _place(spark, "nodes")
    nodes, e = t.crates(spark, sf), graph.materialize(graph_queries.edges(spark, sf), "graph")
    writers.node_table(nodes, e, graph.weak_components(nodes, e), graph.strong_components(nodes, e), where)
    return spark.read.option("header", True).schema("crate_id bigint, name string, in_degree bigint, out_degree bigint, wcc_label bigint, scc_label bigint").csv(where)


def summary_json(spark, sf):
    where = _place(spark, "summary")
    nodes, e = t.crates(spark, sf), graph.materialize(graph_queries.edges(spark, sf), "graph")
    writers.summary_json(graph.summary(nodes, e, graph.weak_components(nodes, e)), {"alpha_down": 0.7, "combine": "linear", "unweighted": False}, where)
    back = spark.read.schema("nodes bigint, edges bigint, wcc_count bigint, biggest_wcc_size bigint, importance_params struct<alpha_down: double, combine: string, unweighted: boolean>").json(where)
    return back.select("nodes", "edges", "wcc_count", "biggest_wcc_size", "importance_params.*")


def evaluation_text(spark, sf):
    where = _place(spark, "evaluation")
    scores = vector_queries.retrieval_hit_mrr(spark, sf)
    writers.evaluation_text(scores, "made", t.embeddings(spark, sf).count(), where)
    return spark.read.text(where)


def cached_ranks(spark, sf):
    """PageRank from a cache that covers all ids but a few; those get 0."""
    where = _place(spark, "ranks")
    nodes = t.crates(spark, sf)
    nodes.filter("id % 100 <> 0").select("id", F.col("id").cast("double").alias("pagerank")).write.parquet(where)
    return graph.cached_pagerank(nodes, graph_queries.edges(spark, sf), where)


def crate_predictions(spark, sf):
    """Scores of repositories as scores of crates; the last crate of a repository wins."""
    c = t.crates(spark, sf).select(F.concat(F.lit("github:o/r"), F.col("id") % 400).alias("repo_key"), "name", F.col("id").alias("place"))
    scored = spark.range(0, 300).select(F.concat(F.lit("github:o/r"), "id").alias("repo_key"), (F.col("id") / 300).alias("activity_probability"))
    return model.predictions_by_crate(scored, c).select("crate_name", F.round("activity_probability", 9).alias("activity_probability"))


def scan_scores(spark, sf):
    """Sequences scored by a selective scan with given (here seeded) weights; tests hold the forward pass against a plain loop."""
    seq = materialize(timeseries.sequences(event_queries._filled(spark, sf), event_queries.COLUMNS, 6), "sequences")
    return model.forward(seq, model.SelectiveScan.seeded(len(event_queries.COLUMNS)))


QUERIES = {
    "versions_csv": versions_csv, "dependency_files": dependency_files, "download_csv": download_csv, "prediction_csv": prediction_csv, "metric_files": metric_files, "advisory_lines": advisory_lines,
    "repository_list": repository_list, "embedding_lines": embedding_lines, "embedding_cache": embedding_cache, "function_descriptions": function_descriptions, "replacement_pairs": replacement_pairs,
    "month_file_list": month_file_list, "node_table": node_table, "summary_json": summary_json, "evaluation_text": evaluation_text, "cached_ranks": cached_ranks, "crate_predictions": crate_predictions,
    "scan_scores": scan_scores,
}

_HITS = ", ".join(f"'Hit@{k:<3}    : ' || printf('%.4f', avg(CAST(rank <= {k} AS INT))) || '  (' || count(*) FILTER (rank <= {k}) || '/' || count(*) || ')'" for k in (1, 3, 5, 10, 20, 50))
ORACLE = {
    "versions_csv": "SELECT o_orderkey AS id, o_custkey AS crate_id, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS updated_at, CAST(epoch(TIMESTAMP '2020-01-02 03:04:05') AS BIGINT) AS created_at FROM orders",
    "dependency_files": f"WITH {t.EDGES} SELECT * FROM edges",
    "download_csv": f"WITH {t.DOWNLOADS} SELECT crate_id, CAST(downloads AS BIGINT) AS downloads FROM recent",
    "prediction_csv": f"WITH {t.METRICS} SELECT crate_name, activity_probability FROM metrics WHERE id % 5 <> 0",
    "metric_files": f"WITH {t.METRICS} SELECT crate_name, importance, replacement_metric, activity_probability FROM metrics",
    "advisory_lines": "SELECT 'G' || p_partkey AS ghsa_id, lower(p_name) AS package, CAST(p_retailprice AS VARCHAR) AS cvss, 'HIGH' AS label, CAST(epoch(TIMESTAMP '2025-01-02 03:04:05') AS BIGINT) AS published FROM part WHERE p_partkey % 50 <> 0",
    "repository_list": "SELECT DISTINCT 'github:org' || (c_custkey % 97) || '/repo' AS repo_key FROM customer",
    "embedding_lines": "SELECT 'v' || vec_id AS name, CAST(len(embedding) AS INT) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings",
    "embedding_cache": "SELECT 'v' || vec_id AS name, CAST(vec_id AS VARCHAR) AS crate_id, CAST(len(embedding) AS INT) AS n FROM embeddings",
    "function_descriptions": "SELECT c_custkey AS crate_id, c_name AS name, 'role ' || c_custkey AS functional_role FROM customer",
    "replacement_pairs": "SELECT p_partkey AS crate_id, p_name AS name, 'steel widget' AS replacement FROM part WHERE p_partkey % 5 = 4 AND lower(p_name) <> 'steel widget'",
    "month_file_list": "SELECT 'gha/1996/' || strftime(o_orderdate, '%Y-%m-%d') || '-' || (o_orderkey % 27) || '.json.gz' AS source_path, CAST(day(o_orderdate) AS INT) AS day, CAST(o_orderkey % 27 AS INT) AS hour FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) = 2 AND o_orderkey % 27 < 24",
    "node_table": f"WITH RECURSIVE {t.EDGES}, {graph_queries._WEAK}, {graph_queries._STRONG}, {graph_queries._DEGREES} SELECT c_custkey AS crate_id, c_name AS name, in_degree, out_degree, weak.component AS wcc_label, strong.component AS scc_label FROM customer JOIN degrees ON degrees.id = c_custkey JOIN weak ON weak.id = c_custkey JOIN strong ON strong.id = c_custkey",
    "summary_json": f"WITH RECURSIVE {t.EDGES}, {graph_queries._WEAK}, sizes AS (SELECT component, count(*) AS size FROM weak GROUP BY 1) SELECT (SELECT count(*) FROM customer) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM sizes) AS wcc_count, (SELECT max(size) FROM sizes) AS biggest_wcc_size, CAST(0.7 AS DOUBLE) AS alpha_down, 'linear' AS combine, false AS unweighted",
    "evaluation_text": f"{vector_queries._S}, {vector_queries._RANKS} SELECT unnest(['Model       : made', 'Index size  : ' || (SELECT count(*) FROM embeddings), 'Pairs eval  : ' || count(*), {_HITS}, 'MRR         : ' || printf('%.4f', avg(1 / rank))]) AS value FROM ranks",
    "cached_ranks": "SELECT c_custkey AS id, CASE WHEN c_custkey % 100 <> 0 THEN CAST(c_custkey AS DOUBLE) ELSE 0 END AS pagerank FROM customer",
    "crate_predictions": "SELECT arg_max(c_name, c_custkey) AS crate_name, round((c_custkey % 400) / 300, 9) AS activity_probability FROM customer WHERE c_custkey % 400 < 300 GROUP BY c_custkey % 400",
}
