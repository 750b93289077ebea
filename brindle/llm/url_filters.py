"""URL filters: captures against dated block and allow lists, as of their fetch time. DataFrame functions only.

A list entry says that from ``effective_at`` on, a pattern (a host, which covers its subdomains, or host/path, which
covers longer paths of that very host) is added to or removed from a list. Entries of one list and pattern become
validity intervals [added, next change). A capture has one key for each suffix of its host and for each path prefix as
deep as the lists go, and joins intervals by key where its fetch time lies inside. The most specific active entry
decides; between equally specific ones an allow list wins.

Sizes: both sides are narrow; the join is a plain equi-join, so Catalyst broadcasts lists of small known size and else
shuffles both, where adaptive execution splits a hot host's captures. Only matches are grouped, by capture.

Defined results: null, empty or hostless urls match nothing and are kept; null fetch times match nothing; changes of one
pattern at the same instant count as one, and removal wins; repeated captures give repeated rows; an empty list keeps
everything. Other columns of the captures are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

#: The query's lists: (list, kind, pattern, action, from). Test values, dated within the captures' two years.
LISTS = [
    ("spam", "block", "spam-farm.example.org", "add", "2023-03-01 00:00:00"),
    ("spam", "block", "tionsh.example.net", "add", "2023-06-15 12:00:00"),
    ("spam", "block", "tionsh.example.net", "remove", "2023-09-01 00:00:00"),
    ("spam", "block", "tionsh.example.net", "add", "2024-02-01 00:00:00"),
    ("spam", "block", "therou.example.com", "add", "2023-01-01 00:00:00"),
    ("spam", "block", "ththan.example.net", "add", "2023-05-05 05:00:00"),
    ("spam", "block", "ththan.example.net", "remove", "2024-05-05 05:00:00"),
    ("malware", "block", "thther.example.org/en", "add", "2023-02-10 00:00:00"),
    ("malware", "block", "blog.tionble.example.com/fr", "add", "2023-04-01 00:00:00"),
    ("malware", "block", "blog.tionble.example.com/fr", "remove", "2024-01-01 00:00:00"),
    ("malware", "block", "example.org", "add", "2024-10-01 00:00:00"),
    ("malware", "block", "example.org", "remove", "2024-11-15 00:00:00"),
    ("partners", "allow", "ththth.example.org", "add", "2023-01-01 00:00:00"),
    ("partners", "allow", "m.therou.example.com", "add", "2024-03-01 00:00:00"),
    ("partners", "allow", "tionsh.example.net/de", "add", "2023-07-01 00:00:00"),
    ("partners", "allow", "tionsh.example.net/de", "remove", "2024-08-01 00:00:00"),
]
LIST_SCHEMA = "list string, kind string, pattern string, action string, effective_at string"


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and final dots; empty if there is none."""
    authority = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@|:[0-9]*$", ""), r"\.+$", "")


def path_of(url: Column) -> Column:
    """Path without empty segments, query and fragment, as a/b/c."""
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "^/|/$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, key, depth, valid_from, valid_to) from dated entries; valid_to is null while an entry stands."""
    at = F.to_timestamp("effective_at")
    pattern = F.regexp_replace(F.trim("pattern"), "/+$", "")
    host = F.lower(F.substring_index(pattern, "/", 1))
    key = F.concat(host, F.substr(pattern, F.length(host) + F.lit(1)))
    changes = (
        entries.select("list", "kind", key.alias("key"), at.alias("at"), (F.col("action") == "add").alias("added"))
        .filter(F.col("at").isNotNull() & (F.col("key") != ""))
        .groupBy("list", "kind", "key", "at").agg(F.bool_and("added").alias("added"))
    )
    order = W.partitionBy("list", "kind", "key").orderBy("at")
    spans = changes.withColumn("valid_to", F.lead("at").over(order)).filter("added")
    depth = F.when(F.contains("key", F.lit("/")), 1000 + F.size(F.split("key", "/"))).otherwise(F.size(F.split("key", r"\.")))
    return spans.select("list", "kind", "key", depth.alias("depth"), F.col("at").alias("valid_from"), "valid_to")


def keys_of(host: Column, path: Column, path_depth: int) -> Column:
    """All keys under which a capture may be listed: suffixes of its host, and its host with path prefixes up to ``path_depth``."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if not path_depth:
        return suffixes
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(path_depth))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.concat(suffixes, F.when(path == "", F.array().cast("array<string>")).otherwise(prefixes))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (page_id, url, fetched_at) with n_active, decided_by (list:pattern) and kept."""
    spans = intervals(entries)
    deepest = spans.agg(F.max(F.col("depth") - 1001).alias("d")).first()["d"]  # one number
    captures = captures.select("page_id", "url", "fetched_at")
    keyed = captures.distinct().withColumn("host", host_of("url")).filter((F.col("host") != "") & F.col("fetched_at").isNotNull())
    keyed = keyed.withColumn("key", F.explode(keys_of(F.col("host"), path_of(F.col("url")), max(0, deepest or 0)))).drop("host")
    active = keyed.join(spans, "key").filter((F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
    rank = F.struct("depth", (F.col("kind") == "allow").alias("allow"), F.concat("list", F.lit(":"), "key").alias("name"))
    verdict = active.groupBy("page_id", "url", "fetched_at").agg(F.count("*").alias("n_active"), F.max(rank).alias("top"))
    same = F.expr("c.page_id <=> v.page_id AND c.url = v.url AND c.fetched_at = v.fetched_at")
    return captures.alias("c").join(verdict.alias("v"), same, "left").select(
        "c.page_id", "c.url", "c.fetched_at", F.coalesce("n_active", F.lit(0)).cast("bigint").alias("n_active"),
        F.col("top.name").alias("decided_by"), F.coalesce("top.allow", F.lit(True)).alias("kept"),
    )


def captured(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch times: day page_id mod 730 from 2023-01-01 on stands for them."""
    at = F.timestamp_seconds(F.lit(1_672_531_200) + F.pmod(F.col("page_id"), F.lit(730)) * 86_400)
    return pages.select("page_id", "url", at.alias("fetched_at"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = filter_urls(captured(common.table(spark, sf_dir, "pages", "page_id", "url")), spark.createDataFrame(LISTS, LIST_SCHEMA))
    return result.withColumn("fetched_at", F.unix_seconds("fetched_at"))


ORACLE = f"""
WITH entries(list, kind, key, action, eff) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', '{d}', TIMESTAMP '{e}')" for a, b, c, d, e in LISTS)}),
spans AS (SELECT list, kind, key, action, eff AS valid_from, lead(eff) OVER (PARTITION BY list, kind, key ORDER BY eff) AS valid_to FROM entries),
c AS (SELECT page_id, url, TIMESTAMP '2023-01-01' + INTERVAL 1 DAY * (page_id % 730) AS t,
        regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) AS host, trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS path FROM pages),
m AS (SELECT c.page_id, s.list || ':' || s.key AS name, s.kind = 'allow' AS allow,
        CASE WHEN contains(s.key, '/') THEN 1000 + len(string_split(s.key, '/')) ELSE len(string_split(s.key, '.')) END AS depth
      FROM c JOIN spans s ON s.action = 'add' AND c.t >= s.valid_from AND (s.valid_to IS NULL OR c.t < s.valid_to)
       AND CASE WHEN contains(s.key, '/') THEN starts_with(c.host || '/' || c.path || '/', s.key || '/') ELSE ends_with('.' || c.host, '.' || s.key) END),
v AS (SELECT page_id, count(*) AS n_active, max((depth, allow, name)) AS top FROM m GROUP BY page_id)
SELECT c.page_id, c.url, CAST(epoch(c.t) AS BIGINT) AS fetched_at, coalesce(v.n_active, 0) AS n_active, top[3] AS decided_by, coalesce(top[2], true) AS kept
FROM c LEFT JOIN v USING (page_id)
"""
