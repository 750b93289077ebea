"""Registered queries of text, parsing, set and file operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..sources import readers, writers
from ..session import shared_dir
from . import tables as t

#: Spellings of repositories, for the normalisers.
REPOS = ["https://github.com/Serde-RS/serde", "git@github.com:Tokio-rs/Tokio.git", "git+https://github.com/a/b.git?x=1#f", "github:Own/Re.po", "Owner/Repo", "https://gitlab.com/a/b", "", "http://www.github.com/x/y/tree/main/", "ssh://git@github.com/q/r.git", "nothing"]
#: Severity vectors.
VECTORS = ["CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:L", "AV:L/AC:H/E:P", "CVSS:3.0/S:C/I:L"]
PATTERN = r"(?i)\bthe are\b|\bof the\b"
PATTERNS = "(?i)" + "|".join([r"(?:\bof the\b)", r"(?:\bund die\b)"])


def _values(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")


def repo_normalize(spark, sf):
    return _values(spark, REPOS).select("id", c.normalize_repo(F.col("v")).alias("repo_key"))


def legacy_repo_normalize(spark, sf):
    return _values(spark, REPOS).select("id", c.legacy_repo(F.col("v")).alias("repo_key"))


def cvss_parse(spark, sf):
    return _values(spark, VECTORS).select("id", F.explode(c.cvss_parts(F.col("v"))).alias("part", "value"))


def explode_packages(spark, sf):
    rows = spark.createDataFrame([(1, ["B", "a", "b"]), (2, []), (3, ["Z"])], "id int, names array<string>")
    return rows.select("id", F.explode(F.array_sort(F.array_distinct(F.transform("names", F.lower)))).alias("package"))


def deprecation_filter(spark, sf):
    return t.read(spark, sf, "documents").filter(F.rlike("text", F.lit(c.sql_words(PATTERNS)))).groupBy("lang").agg(F.count("*").alias("n"))


def deprecation_snippet(spark, sf):
    docs = t.read(spark, sf, "documents")
    return docs.select("doc_id", c.snippet(F.col("text"), c.sql_words(r"(?i)\bof the\b"), 1).alias("snippet")).filter("snippet IS NOT NULL").select("doc_id", F.length("snippet").alias("n"), F.md5("snippet").alias("digest"))


#: A sentence for each pattern of deprecation, and some that match none.
SAID = [
    "This is Deprecated.", "It raises DeprecationWarning!", "It is no longer maintained.", "Left unmaintained.", "It has been deprecated.", "It was replaced by x.", "It is superseded with y.", "We moved to z.",
    "We recommend to use w.", "They suggested using v.", "In maintenance mode.", "The repository is archived.", "It lies abandoned.", "There is no active development.", "Please use alternative u.",
    "You may consider switching to t.", "It will not receive updates.", "A deprecat of sorts.", "It is maintained.", "Archives are here.",
]


def deprecation_phrases(spark, sf):
    """The fixed patterns over parts' descriptions: a sentence in ten says one of :data:`SAID`."""
    p = t.read(spark, sf, "part")
    said = F.get(F.array(*[F.lit(s) for s in SAID]), (F.col("p_partkey") % len(SAID)).cast("int"))
    text = F.concat(F.lit("  "), F.repeat(F.concat("p_name", F.lit(". ")), 8), said, F.lit(" "), F.repeat(F.concat("p_brand", F.lit("?\n")), 9))
    return p.select("p_partkey", c.snippet(text).alias("snippet")).filter("snippet IS NOT NULL")


def row_to_text(spark, sf):
    p = t.read(spark, sf, "part")
    fields = {"functional_role": F.col("p_type"), "capability_set": F.col("p_brand"), "api_intent": F.when(F.col("p_size") % 3 == 0, "ERROR").when(F.col("p_size") % 3 == 1, "").otherwise(F.concat(F.lit(" "), F.col("p_size"), F.lit(" ")))}
    return p.select("p_partkey", c.described(F.col("p_name"), fields).alias("text"))


def keyword_listagg(spark, sf):
    p = t.read(spark, sf, "part")
    return p.groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda e: e["p_name"]), ", ").alias("names")).select("p_brand", F.md5("names").alias("digest"))


def json_fallback(spark, sf):
    e = t.read(spark, sf, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.lit("no json")).otherwise(F.col("props"))
    fields = ["k", "functional_role"]
    return e.select("event_id", c.parsed_answer(raw, "k string, functional_role string", fields).alias("p")).select("event_id", "p.*")


def prompt_text(spark, sf):
    p = t.read(spark, sf, "part")
    return p.select("p_partkey", c.prompt(F.col("p_name"), description=F.concat(F.lit(" "), F.col("p_type")), keywords=F.when(F.col("p_size") % 2 == 0, F.repeat("p_brand", 40)), documentation=F.repeat("p_brand", 40), readme=F.repeat("p_brand", 300)).alias("prompt")).select("p_partkey", F.length("prompt").alias("n"), F.md5("prompt").alias("digest"))


def clean_lines(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", F.md5(c.clean_line_ends(F.col("text"))).alias("digest"))


def name_labels(spark, sf):
    return t.read(spark, sf, "part").select("p_partkey", c.shortened(F.col("p_name"), 10).alias("label"))


def set_ops(spark, sf):
    a = t.read(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    b = t.read(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return a.union(b).distinct().select(F.lit("union").alias("op"), "k").union(a.intersect(b).select(F.lit("both"), "k")).union(a.exceptAll(b.distinct()).select(F.lit("only"), "k"))


def resume_anti(spark, sf):
    orders = t.read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    done = orders.filter("o_orderkey % 7 = 0")
    return writers.remaining(orders, done, "o_orderkey")


def manifest_upsert(spark, sf):
    o = t.read(spark, sf, "orders").select(F.col("o_custkey").alias("source_path"), F.col("o_orderkey").alias("updated_at"), F.col("o_orderstatus").alias("status"))
    return writers.upsert(o.filter("updated_at % 2 = 0"), o.filter("updated_at % 2 = 1"))


def incremental_pending(spark, sf):
    files = t.read(spark, sf, "orders").select(F.col("o_orderkey").alias("source_path"), F.col("o_custkey").alias("size"), F.col("o_orderdate").alias("mtime"))
    manifest = files.filter("source_path % 3 <> 0").withColumn("size", F.when(F.col("source_path") % 5 == 0, F.col("size") + 1).otherwise(F.col("size"))).withColumn("status", F.when(F.col("source_path") % 4 == 0, "failed").otherwise("done"))
    return writers.pending(files, manifest).select("source_path")


def missing_columns(spark, sf):
    out = writers.missing_columns(t.read(spark, sf, "region"), ["r_name", "r_comment"])
    return out.select("rows", F.array_join("missing", ",").alias("missing"))


def month_calendar(spark, sf):
    from ..operators.timeseries import calendar

    months = spark.range(1).select(F.explode(calendar("2023-11-01", "2024-03-01")).alias("month"))
    return months.select("month", F.day(F.last_day("month")).alias("days"), (F.day(F.last_day("month")) * 24).alias("files"), F.unix_seconds(c.month_end(F.col("month"))).alias("ends"))


def available_months(spark, sf):
    flat = t.read(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return readers.available_months(flat)


def top_n_sample(spark, sf):
    return t.read(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "p_retailprice")


def parquet_partitions(spark, sf):
    """Flat events written by month and read back by a pruned filter."""
    import uuid

    where = f"{shared_dir(spark)}/brindle/flat-{uuid.uuid4().hex}"
    writers.events(t.flat_events(spark, sf), where)
    return spark.read.parquet(where).filter("year = 2024 AND month = 1").groupBy("event_type").agg(F.count("*").alias("n"))


def csv_round_trip(spark, sf):
    import uuid

    where = f"{shared_dir(spark)}/brindle/csv-{uuid.uuid4().hex}"
    writers.single_csv(t.crates(spark, sf), where, "id")
    return readers.crates(spark, where)


def score_export(spark, sf):
    import uuid

    where = f"{shared_dir(spark)}/brindle/scores-{uuid.uuid4().hex}"
    rows = t.read(spark, sf, "customer").select(F.col("c_name").alias("crate_name"), F.col("c_acctbal").alias("score")).orderBy("crate_name")
    writers.scores(rows, where)
    return readers.scores(spark, where)


QUERIES = {
    "repo_normalize": repo_normalize, "legacy_repo_normalize": legacy_repo_normalize, "cvss_parse": cvss_parse, "explode_packages": explode_packages, "deprecation_filter": deprecation_filter,
    "deprecation_snippet": deprecation_snippet, "deprecation_phrases": deprecation_phrases, "row_to_text": row_to_text, "keyword_listagg": keyword_listagg, "json_fallback": json_fallback, "prompt_text": prompt_text, "clean_lines": clean_lines,
    "name_labels": name_labels, "set_ops": set_ops, "resume_anti": resume_anti, "manifest_upsert": manifest_upsert, "incremental_pending": incremental_pending, "missing_columns": missing_columns,
    "month_calendar": month_calendar, "available_months": available_months, "top_n_sample": top_n_sample, "parquet_partitions": parquet_partitions, "csv_round_trip": csv_round_trip, "score_export": score_export,
}

ORACLE = {
    "repo_normalize": "SELECT * FROM (VALUES (0, 'github:serde-rs/serde'), (1, 'github:tokio-rs/tokio'), (2, 'github:a/b'), (3, 'github:own/re.po'), (4, 'github:owner/repo'), (5, NULL), (6, NULL), (7, 'github:x/y'), (8, 'github:q/r'), (9, NULL)) v(id, repo_key)",
    "legacy_repo_normalize": "SELECT * FROM (VALUES (0, 'github:serde-rs/serde'), (1, NULL), (2, 'github:a/b.git?x=1#f'), (3, NULL), (4, NULL), (5, NULL), (6, NULL), (7, 'github:x/y'), (8, 'github:q/r.git'), (9, NULL)) v(id, repo_key)",
    "cvss_parse": f"""WITH v(id, s) AS (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(VECTORS))}), p AS (SELECT id, unnest(string_split(s, '/')) AS kv FROM v)
SELECT id, split_part(kv, ':', 1) AS part, split_part(kv, ':', 2) AS value FROM p WHERE split_part(kv, ':', 1) IN ('AV', 'AC', 'PR', 'UI', 'S', 'C', 'I', 'A')""",
    "explode_packages": "SELECT * FROM (VALUES (1, 'a'), (1, 'b'), (3, 'z')) v(id, package)",
    "deprecation_filter": r"SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(text, '(?i)\bof the\b|\bund die\b') GROUP BY 1",
    "deprecation_snippet": r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
h AS (SELECT doc_id, p, list_position(list_transform(p, lambda x: regexp_matches(x, '(?i)\bof the\b')), true) AS k FROM s), c AS (SELECT doc_id, regexp_replace(array_to_string(p[greatest(1, k - 1):k + 1], ' '), '^\s+|\s+$', '', 'g') AS snippet FROM h WHERE k > 0)
SELECT doc_id, CAST(length(snippet) AS INT) AS n, md5(snippet) AS digest FROM c""",
    "deprecation_phrases": f"""WITH said(k, s) AS (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(SAID))}), pats(x) AS (VALUES {", ".join("('(?i)" + x + "')" for x in c.DEPRECATION)})
SELECT p_partkey, repeat(p_name || '. ', 5) || s || ' ' || rtrim(repeat(p_brand || '? ', 5)) AS snippet FROM part JOIN said ON k = p_partkey % {len(SAID)} WHERE EXISTS (SELECT 1 FROM pats WHERE regexp_matches(s, x))""",
    "row_to_text": "SELECT p_partkey, 'Crate: ' || p_name || '. Role: ' || p_type || '. Capabilities: ' || p_brand || CASE WHEN p_size % 3 = 2 THEN '. API: ' || p_size ELSE '' END AS text FROM part",
    "keyword_listagg": "SELECT p_brand, md5(string_agg(p_name, ', ' ORDER BY p_partkey)) AS digest FROM part GROUP BY 1",
    "json_fallback": "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'PARSE_ERROR' ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 3 = 1 THEN 'PARSE_ERROR: no json' ELSE '' END AS functional_role FROM events",
    "prompt_text": "WITH p AS (SELECT p_partkey, 'Crate name: ' || p_name || chr(10) || 'Description: ' || p_type || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Keywords: ' || repeat(p_brand, 40) ELSE '' END || chr(10) || 'Documentation URL: ' || substr(repeat(p_brand, 40), 1, 200) || chr(10) || 'README (excerpt): ' || substr(repeat(p_brand, 300), 1, 1200) || chr(10) || chr(10) || 'Return only the JSON object as specified. No extra text.' AS prompt FROM part) SELECT p_partkey, CAST(length(prompt) AS INT) AS n, md5(prompt) AS digest FROM p",
    "clean_lines": r"SELECT doc_id, md5(regexp_replace(text, '(?m)[ \t]+$', '', 'g')) AS digest FROM documents",
    "name_labels": "SELECT p_partkey, CASE WHEN length(p_name) > 10 THEN substr(p_name, 1, 10) || '…' ELSE p_name END AS label FROM part",
    "set_ops": "SELECT 'union' AS op, k FROM (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders) UNION ALL SELECT 'both', k FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'only', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)",
    "resume_anti": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 <> 0",
    "manifest_upsert": "SELECT o_custkey AS source_path, max(o_orderkey) AS updated_at, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1",
    "incremental_pending": "SELECT o_orderkey AS source_path FROM orders WHERE NOT (o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 4 <> 0)",
    "missing_columns": "SELECT count(*) AS rows, 'r_comment' AS missing FROM region",
    "month_calendar": "SELECT CAST(m AS DATE) AS month, CAST(day(last_day(m)) AS INT) AS days, CAST(day(last_day(m)) * 24 AS INT) AS files, CAST(epoch(last_day(m) + INTERVAL 1 DAY) AS BIGINT) - 1 AS ends FROM range(TIMESTAMP '2023-11-01', TIMESTAMP '2024-03-02', INTERVAL 1 MONTH) r(m)",
    "available_months": "WITH b AS (SELECT date_trunc('month', min(o_orderdate)) AS a, date_trunc('month', max(o_orderdate)) AS z FROM orders) SELECT CAST(year(m) AS INT) AS year, CAST(month(m) AS INT) AS month FROM b, range(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 MONTH) r(m)",
    "top_n_sample": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10",
    "parquet_partitions": "SELECT CASE event_type WHEN 'view' THEN 'WatchEvent' WHEN 'click' THEN 'PushEvent' WHEN 'signup' THEN 'IssuesEvent' WHEN 'error' THEN 'IssueCommentEvent' ELSE 'PullRequestEvent' END AS event_type, count(*) AS n FROM events WHERE year(ts) = 2024 AND month(ts) = 1 GROUP BY 1",
    "csv_round_trip": "SELECT c_custkey AS id, c_name AS name FROM customer",
    "score_export": "SELECT c_name AS crate_name, c_acctbal AS score FROM customer ORDER BY c_name LIMIT 9999",
}
