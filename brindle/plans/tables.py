"""How the driver's tables stand for packages, versions, dependencies, downloads, events, embeddings and advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def crates(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def versions(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("crate_id"), F.col("o_orderdate").alias("updated_at"))


def dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").filter(F.col("l_returnflag") == "N").select(F.col("l_orderkey").alias("version_id"), F.col("l_partkey").alias("crate_id"))


def downloads(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(F.col("l_shipdate").alias("date"), F.col("l_quantity").alias("downloads"), F.col("l_orderkey").alias("version_id"))


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """(id, importance, replacement_metric, activity_probability): total, number of orders, balance of each customer with orders."""
    per = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.sum("o_totalprice"), 2).alias("importance"), F.count("*").cast("double").alias("replacement_metric"))
    return per.join(read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("crate_name"), F.col("c_acctbal").alias("activity_probability")), "id")


def advisories(spark: SparkSession, sf: str) -> DataFrame:
    """(package, cvss, label, published, row): line items; a zero discount makes the label count."""
    tax = F.col("l_tax")
    label = F.when(tax < 0.02, "LOW").when(tax < 0.04, "MODERATE").when(tax < 0.06, "HIGH").when(tax < 0.07, "CRITICAL").otherwise("none")
    return read(spark, sf, "lineitem").select(F.col("l_partkey").alias("package"), F.round(F.col("l_discount") * 100, 2).alias("cvss"), label.alias("label"), F.col("l_shipdate").alias("published"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").alias("row"))


#: Event kinds of the events table as repository events (type, action).
KINDS = {"view": ("WatchEvent", "started"), "click": ("PushEvent", ""), "signup": ("IssuesEvent", "opened"), "error": ("IssueCommentEvent", "created"), "purchase": ("PullRequestEvent", "closed")}


def json_events(spark: SparkSession, sf: str) -> DataFrame:
    """Nested event records as JSON text, made from the events table."""
    kind = F.col("event_type")
    name = F.lit("")
    action = F.lit("")
    for k, (n, a) in KINDS.items():
        name, action = F.when(kind == k, n).otherwise(name), F.when(kind == k, a).otherwise(action)
    k = F.get_json_object("props", "$.k")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.struct(
        F.col("event_id").cast("string").alias("id"), name.alias("type"), at.alias("created_at"), F.struct(F.concat(F.lit("U"), k).alias("login"), F.lit("User").alias("type")).alias("actor"),
        F.struct(F.concat(F.lit("Org/Repo"), F.col("user_id")).alias("name")).alias("repo"),
        F.struct(
            action.alias("action"), F.when(kind == "click", F.floor("value").cast("int")).alias("size"), F.when(kind == "click", F.lit(1)).alias("distinct_size"),
            F.when(kind == "signup", F.struct(F.col("event_id").alias("number"), F.lit("").alias("title"), F.lit("body").alias("body"), at.alias("created_at"))).alias("issue"),
            F.when(kind == "purchase", F.struct(F.col("event_id").alias("number"), F.lit("T").alias("title"), F.lit("").alias("body"), F.date_format(F.col("ts") - F.expr("INTERVAL 36 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), at.alias("merged_at"))).alias("pull_request"),
            F.when(k.cast("int") % 2 == 0, F.lit("member")).otherwise(F.lit("none")).alias("author_association"),
        ).alias("payload"),
    )
    return read(spark, sf, "events").select(F.to_json(record).alias("value"))


def flat_events(spark: SparkSession, sf: str) -> DataFrame:
    from .. import schemas
    from ..operators.events import flatten

    nested = json_events(spark, sf).select(F.from_json("value", schemas.EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e")).select("e.*")
    return flatten(nested)


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label"))


#: SQL of the same stand-ins.
EDGES = """latest AS (SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC) AS n FROM orders) WHERE n = 1),
edges AS (SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM lineitem JOIN latest ON l_orderkey = o_orderkey WHERE l_returnflag = 'N' AND o_custkey <> l_partkey
  AND o_custkey IN (SELECT c_custkey FROM customer) AND l_partkey IN (SELECT c_custkey FROM customer))"""
DOWNLOADS = """recent AS (SELECT o_custkey AS crate_id, sum(l_quantity) AS downloads FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= (SELECT max(l_shipdate) - INTERVAL 90 DAY FROM lineitem) GROUP BY 1),
weights AS (SELECT c_custkey AS id, ln(1 + coalesce(downloads, 0)) AS w FROM customer LEFT JOIN recent ON crate_id = c_custkey)"""
PAIRS = """reach(src, dst, d) AS (SELECT src, dst, 1 FROM edges UNION SELECT r.src, e.dst, r.d + 1 FROM reach r JOIN edges e ON r.dst = e.src WHERE r.d < 6),
pairs AS (SELECT src, dst, min(d) AS dist FROM reach WHERE src <> dst GROUP BY 1, 2)"""
DECAY = """scores AS (SELECT c_custkey AS id,
  coalesce((SELECT sum(w * exp(-0.7 * dist)) FROM pairs JOIN weights ON weights.id = src WHERE dst = c_custkey), 0) AS s_down,
  coalesce((SELECT sum(w * exp(-0.7 * dist)) FROM pairs JOIN weights ON weights.id = dst WHERE src = c_custkey), 0) AS s_up FROM customer)"""
METRICS = """metrics AS (SELECT o_custkey AS id, c_name AS crate_name, round(sum(o_totalprice), 2) AS importance, CAST(count(*) AS DOUBLE) AS replacement_metric, any_value(c_acctbal) AS activity_probability
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
ADVISORIES = """advisories AS (SELECT CAST(l_partkey AS VARCHAR) AS package, l_shipdate AS published, (l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS row,
  coalesce(nullif(round(l_discount * 100, 2), 0), CASE WHEN l_tax < 0.02 THEN 2.0 WHEN l_tax < 0.04 THEN 5.5 WHEN l_tax < 0.06 THEN 8.0 WHEN l_tax < 0.07 THEN 9.5 END) AS severity FROM lineitem)"""
BUCKET = "CASE WHEN severity IS NULL THEN 'UNKNOWN' WHEN severity < 4 THEN 'LOW' WHEN severity < 7 THEN 'MEDIUM' WHEN severity < 9 THEN 'HIGH' ELSE 'CRITICAL' END"
RANKED = """ranked AS (SELECT *, rank() OVER (ORDER BY importance) + (count(*) OVER (PARTITION BY importance) - 1) / 2 AS rank_importance,
  rank() OVER (ORDER BY activity_probability DESC) + (count(*) OVER (PARTITION BY activity_probability) - 1) / 2 AS rank_risk,
  rank() OVER (ORDER BY replacement_metric DESC) + (count(*) OVER (PARTITION BY replacement_metric) - 1) / 2 AS rank_irreplaceability FROM metrics),
raw AS (SELECT *, pow(rank_importance * rank_risk * rank_irreplaceability, 1.0 / 3) AS geo_rank_raw, (rank_importance + rank_risk + rank_irreplaceability) / 3 AS avg_rank_raw FROM ranked),
scored AS (SELECT *, (geo_rank_raw - min(geo_rank_raw) OVER ()) / (max(geo_rank_raw) OVER () - min(geo_rank_raw) OVER ()) AS geo_rank_score,
  (avg_rank_raw - min(avg_rank_raw) OVER ()) / (max(avg_rank_raw) OVER () - min(avg_rank_raw) OVER ()) AS avg_rank_score FROM raw)"""
FLAT = """flat AS (SELECT event_id, date_trunc('second', ts) AS happened, 'github:org/repo' || user_id AS repo_key, 'u' || json_extract_string(props, '$.k') AS actor, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  event_type AS kind, CAST(floor(value) AS INT) AS size, date_trunc('week', ts) AS period FROM events)"""
