"""Registered queries over events of every kind: all flat columns, and all keys of a month's document."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas
from ..operators import events as ev
from ..session import shared_dir
from ..sources import readers, writers
from . import tables as t

#: Kinds of the made events, by number: type, and action (None: none).
KINDS = [
    ("PushEvent", None), ("IssuesEvent", "opened"), ("IssuesEvent", "closed"), ("IssueCommentEvent", "created"), ("PullRequestEvent", "opened"), ("PullRequestEvent", "closed"),
    ("PullRequestReviewEvent", "submitted"), ("PullRequestReviewCommentEvent", "created"), ("ReleaseEvent", "published"), ("WatchEvent", "started"), ("ForkEvent", None), ("CreateEvent", None),
    ("DeleteEvent", None), ("IssuesEvent", "reopened"),
]


def _pick(n, values):
    return F.get(F.array(*[F.lit(v) for v in values]), n.cast("int"))


def json_events(spark, sf):
    """Nested event records of every kind as JSON text, made from the events table: the kind is event_id modulo 14, variants go by event_id / 14."""
    j, m = F.col("event_id") % 14, F.floor(F.col("event_id") / 14)
    k = F.get_json_object("props", "$.k").cast("int")
    iso = lambda hours: F.date_format(F.col("ts") - F.expr(f"INTERVAL {hours} HOURS"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    at = iso(0)
    odd = m % 2 == 1
    is_pull = j.isin(4, 5) | ((j == 13) & odd)
    is_issue = j.isin(1, 2, 3) | ((j == 13) & ~odd)
    name = F.when((j == 13) & odd, "PullRequestEvent").otherwise(_pick(j, [n for n, _ in KINDS]))
    action = F.when((j == 6) & odd, "created").when((j == 7) & (m % 3 == 0), F.lit(None)).otherwise(_pick(j, [a for _, a in KINDS]))
    issue = F.struct(F.col("event_id").alias("number"), iso(36).alias("created_at"), F.when((j == 2) & (m % 3 != 0), at).alias("closed_at"), F.lit("T").alias("title"), F.when(odd, "body").otherwise("").alias("body"), F.when((j == 3) & ~odd, "x").alias("pull_request"))
    pull = F.struct(F.col("event_id").alias("number"), iso(60).alias("created_at"), F.when(j == 5, at).alias("closed_at"), F.when((j == 5) & (m % 3 != 0), at).alias("merged_at"), F.when((j == 5) & odd, m % 3 != 0).alias("merged"), F.lit("PT").alias("title"), F.lit("").alias("body"))
    payload = F.struct(
        action.alias("action"), F.when(j == 0, m % 5).alias("size"), F.when(j == 0, m % 3).alias("distinct_size"), F.when(j == 0, F.array_repeat(F.lit("c"), (m % 4).cast("int"))).alias("commits"),
        F.when(j.isin(4, 5), F.col("event_id")).alias("number"), F.when(j == 11, _pick(m % 2, ["Branch", "tag"])).when(j == 12, _pick(m % 2, ["branch", "TAG"])).alias("ref_type"),
        _pick(k % 3, ["MEMBER", "none", ""]).alias("author_association"), F.when(is_issue, issue).alias("issue"), F.when(is_pull, pull).alias("pull_request"),
        F.when(j == 6, F.struct(_pick(m % 3, ["approved", "CHANGES_REQUESTED", "commented"]).alias("state"), F.lit("rev").alias("body"))).alias("review"),
        F.when(j == 8, F.struct(F.when(~odd, iso(2)).alias("published_at"), iso(5).alias("created_at"))).alias("release"), F.when(j.isin(3, 7), F.struct(F.lit("hello").alias("body"))).alias("comment"),
    )
    actor = F.struct(F.when(m % 11 != 0, F.concat(F.lit("U"), k)).alias("login"), F.lit("User").alias("type"))
    record = F.struct(F.col("event_id").cast("string").alias("id"), name.alias("type"), at.alias("created_at"), actor.alias("actor"), F.struct(F.concat(F.lit("Org/Repo"), F.col("user_id")).alias("name")).alias("repo"), payload.alias("payload"))
    return t.read(spark, sf, "events").select(F.to_json(record).alias("value"))


def _flat(spark, sf):
    """By the reader of gzipped JSON lines, from files."""
    where = f"{shared_dir(spark)}/brindle/raw-{uuid.uuid4().hex}"
    json_events(spark, sf).write.option("compression", "gzip").text(where)
    return ev.flatten(readers.raw_events(spark, where))


def event_columns(spark, sf):
    flat = _flat(spark, sf)
    return flat.select(*[F.unix_seconds(c).alias(c) if kind == "timestamp" else F.col(c) for c, kind in flat.dtypes])


def event_totals(spark, sf):
    where = f"{shared_dir(spark)}/brindle/raw-{uuid.uuid4().hex}"
    broken = t.read(spark, sf, "region").select(F.lit("{broken").alias("value"))
    json_events(spark, sf).unionByName(broken).write.option("compression", "gzip").text(where)
    raw = readers.raw_events(spark, where)
    return ev.totals(raw, ev.flatten(raw))


def _months(flat):
    return flat.select(F.trunc(F.to_date("created_at"), "month").alias("period")).distinct()


def _readable(documents):
    """Lists and maps as text, for comparison."""
    kinds = dict(documents.dtypes)

    def shown(c):
        if kinds[c].startswith("array"):
            return F.array_join(c, ",")
        if c == "event_type_counts":
            return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
        if c == "event_action_counts":
            return F.array_join(F.array_sort(F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(F.map_entries(e["value"]), lambda x: F.concat(e["key"], F.lit("."), x["key"], F.lit("="), x["value"]))))), ",")
        return F.round(c, 6) if kinds[c] == "double" else F.col(c)

    return documents.select(*[shown(c).alias(c) for c in documents.columns])


def month_documents(spark, sf):
    """All keys for every repository and month, written as documents and read back."""
    where = f"{shared_dir(spark)}/brindle/months-{uuid.uuid4().hex}"
    flat = _flat(spark, sf)
    writers.month_documents(ev.month_documents(flat, _months(flat)), where)
    return _readable(readers.month_documents(spark, where))


def release_bootstrap(spark, sf):
    """A run over the last month alone, started from the releases that earlier partitions have."""
    where = f"{shared_dir(spark)}/brindle/flat-{uuid.uuid4().hex}"
    flat = _flat(spark, sf)
    writers.events(flat, where)
    stored = spark.read.parquet(where)
    last = stored.select((F.col("year") * 12 + F.col("month")).alias("m")).agg(F.max("m")).first()[0]
    month = F.col("year") * 12 + F.col("month")
    late = stored.filter(month == last)
    documents = ev.month_documents(late, _months(late), stored.select("repo_key"), readers.published_releases(spark, where, month < last))
    return documents.select("repo_key", "period", "last_release_at", "release_observed", "days_since_last_release", "releases_published", "total_events")


QUERIES = {"event_columns": event_columns, "event_totals": event_totals, "month_documents": month_documents, "release_bootstrap": release_bootstrap}

_TYPES = ", ".join(f"'{n}'" for n, _ in KINDS)
_ACTIONS = ", ".join("''" if a is None else f"'{a}'" for _, a in KINDS)
_RICH = f"""made AS (SELECT event_id, date_trunc('second', ts) AS happened, 'github:org/repo' || user_id AS repo_key, 'org/repo' || user_id AS repo_name, event_id % 14 AS j, event_id // 14 AS m, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
parts AS (SELECT *, m % 2 = 1 AS odd, j IN (4, 5) OR (j = 13 AND m % 2 = 1) AS is_pull, j IN (1, 2, 3) OR (j = 13 AND m % 2 = 0) AS is_issue FROM made),
flat AS (SELECT CAST(event_id AS VARCHAR) AS event_id, happened AS created_at, repo_key, repo_name, CASE WHEN m % 11 <> 0 THEN 'u' || k ELSE '' END AS actor_login, 'User' AS actor_type,
  CASE WHEN j = 13 AND odd THEN 'PullRequestEvent' ELSE ([{_TYPES}])[j + 1] END AS event_type, CASE WHEN j = 6 AND odd THEN 'created' WHEN j = 7 AND m % 3 = 0 THEN '' ELSE ([{_ACTIONS}])[j + 1] END AS action,
  (['MEMBER', 'NONE', ''])[k % 3 + 1] AS author_association, CAST(CASE WHEN j = 0 THEN coalesce(nullif(m % 5, 0), m % 4) ELSE 0 END AS INT) AS push_size, CAST(CASE WHEN j = 0 THEN m % 3 ELSE 0 END AS INT) AS push_distinct_size,
  CASE WHEN is_issue THEN nullif(event_id, 0) END AS issue_number, j = 3 AND NOT odd AS issue_is_pull_request, CASE WHEN is_issue THEN happened - INTERVAL 36 HOUR END AS issue_created_at,
  CASE WHEN j = 2 AND m % 3 <> 0 THEN happened END AS issue_closed_at, CASE WHEN is_pull THEN nullif(event_id, 0) END AS pull_number, CASE WHEN is_pull THEN happened - INTERVAL 60 HOUR END AS pull_created_at,
  CASE WHEN j = 5 THEN happened END AS pull_closed_at, CASE WHEN j = 5 AND m % 3 <> 0 THEN happened END AS pull_merged_at, j = 5 AND m % 3 <> 0 AS pull_merged,
  CASE WHEN j = 6 THEN (['approved', 'changes_requested', 'commented'])[m % 3 + 1] ELSE '' END AS review_state, CASE WHEN j = 8 THEN CASE WHEN odd THEN happened - INTERVAL 5 HOUR ELSE happened - INTERVAL 2 HOUR END END AS release_published_at,
  CASE WHEN j = 11 THEN (['branch', 'tag'])[m % 2 + 1] WHEN j = 12 THEN (['branch', 'tag'])[m % 2 + 1] ELSE '' END AS ref_type, CASE WHEN is_pull THEN 2 WHEN is_issue THEN 1 ELSE 0 END AS title_chars,
  CASE WHEN is_issue AND odd THEN 4 WHEN j = 6 THEN 3 ELSE 0 END AS body_chars, CASE WHEN j IN (3, 7) THEN 5 ELSE 0 END AS comment_chars FROM parts)"""
_TIMES = ["created_at", "issue_created_at", "issue_closed_at", "pull_created_at", "pull_closed_at", "pull_merged_at", "release_published_at"]
_ISO = "'%Y-%m-%dT%H:%M:%SZ'"


def _n(condition: str) -> str:
    return f"count(*) FILTER ({condition})"


_TALK, _REVIEW, _REMARK = "event_type = 'IssueCommentEvent' AND action IN ('', 'created')", "event_type = 'PullRequestReviewEvent' AND action IN ('', 'created', 'submitted')", "event_type = 'PullRequestReviewCommentEvent' AND action IN ('', 'created')"
_CLOSED = "event_type = 'PullRequestEvent' AND action = 'closed'"
_MEASURES = {
    "push_events": _n("event_type = 'PushEvent'"), "push_commits": "CAST(coalesce(sum(push_size) FILTER (event_type = 'PushEvent'), 0) AS BIGINT)", "push_distinct_commits": "CAST(coalesce(sum(push_distinct_size) FILTER (event_type = 'PushEvent'), 0) AS BIGINT)",
    **{f"issues_{a}": _n(f"event_type = 'IssuesEvent' AND action = '{a}'") for a in ("opened", "closed", "reopened")},
    "issue_comments": _n(_TALK), "issue_comments_created": _n(_TALK), "issue_only_comments": _n(f"{_TALK} AND NOT issue_is_pull_request"), "pr_conversation_comments": _n(f"{_TALK} AND issue_is_pull_request"),
    **{f"{r}_issue_comments": _n(f"{_TALK} AND role = '{r}'") for r in ("maintainer", "external", "unknown_role")},
    "issue_resolution_count": _n("event_type = 'IssuesEvent' AND action = 'closed'"), "issue_resolution_days_mean": "CASE WHEN count(*) FILTER (event_type = 'IssuesEvent' AND action = 'closed') > 0 THEN CAST(1.5 AS DOUBLE) END",
    "prs_opened": _n("event_type = 'PullRequestEvent' AND action = 'opened'"), "prs_closed": _n(_CLOSED), "prs_merged": _n(f"{_CLOSED} AND pull_merged"), "prs_reopened": _n("event_type = 'PullRequestEvent' AND action = 'reopened'"),
    "pr_reviews_submitted": _n(_REVIEW), "pr_reviews_approved": _n(f"{_REVIEW} AND review_state = 'approved'"), "pr_reviews_changes_requested": _n(f"{_REVIEW} AND review_state = 'changes_requested'"),
    "pr_review_comments": _n(_REMARK), "pr_review_comments_created": _n(_REMARK), **{f"{r}_pr_reviews": _n(f"{_REVIEW} AND role = '{r}'") for r in ("maintainer", "external")},
    **{f"{r}_pr_review_comments": _n(f"{_REMARK} AND role = '{r}'") for r in ("maintainer", "external")}, "pr_close_days_mean": f"CASE WHEN {_n(_CLOSED)} > 0 THEN CAST(2.5 AS DOUBLE) END",
    "pr_merge_days_mean": f"CASE WHEN {_n(f'{_CLOSED} AND pull_merged')} > 0 THEN CAST(2.5 AS DOUBLE) END", "releases_published": _n("event_type = 'ReleaseEvent'"),
    "watch_started": _n("event_type = 'WatchEvent'"), "forks": _n("event_type = 'ForkEvent'"),
    **{f"{p}_{v}d": _n(f"event_type = '{v.capitalize()}Event' AND ref_type = '{r}'") for r, p in (("branch", "branches"), ("tag", "tags")) for v in ("create", "delete")},
    "active_days": "count(DISTINCT CAST(created_at AS DATE)) FILTER (actor_login <> '')", "contributor_days": "count(DISTINCT (actor_login, CAST(created_at AS DATE))) FILTER (actor_login <> '')", "active_contributors_count": "count(DISTINCT actor_login) FILTER (actor_login <> '')",
    "code_contributors_count": f"count(DISTINCT actor_login) FILTER (actor_login <> '' AND event_type IN ({', '.join(repr(x) for x in ev.CODE_EVENTS)}))",
    **{f"{r}_contributors_count": f"count(DISTINCT actor_login) FILTER (actor_login <> '' AND role = '{r}')" for r in ("maintainer", "external", "unknown_role")},
    "active_contributors": "coalesce(string_agg(DISTINCT 'github:' || actor_login, ',' ORDER BY 'github:' || actor_login) FILTER (actor_login <> ''), '')",
    **{f"{r}_contributors": f"coalesce(string_agg(DISTINCT 'github:' || actor_login, ',' ORDER BY 'github:' || actor_login) FILTER (actor_login <> '' AND role = '{r}'), '')" for r in ("maintainer", "external")},
    "first_event_at": f"strftime(min(created_at), {_ISO})", "last_event_at": f"strftime(max(created_at), {_ISO})", "total_events": "count(*)", "release_in": "max(release_published_at) FILTER (event_type = 'ReleaseEvent')",
}
_DOCS = f"""{_RICH}, dated AS (SELECT *, CAST(date_trunc('month', created_at) AS DATE) AS period, CASE author_association WHEN 'MEMBER' THEN 'maintainer' WHEN 'NONE' THEN 'external' ELSE 'unknown_role' END AS role FROM flat),
made_months AS (SELECT repo_key, period, {", ".join(f"{x} AS {k}" for k, x in _MEASURES.items())} FROM dated GROUP BY 1, 2),
kinds AS (SELECT repo_key, period, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS event_type_counts FROM (SELECT repo_key, period, event_type, count(*) AS n FROM dated GROUP BY 1, 2, 3) GROUP BY 1, 2),
acts AS (SELECT repo_key, period, string_agg(event_type || '.' || action || '=' || n, ',' ORDER BY event_type || '.' || action || '=' || n) AS event_action_counts FROM (SELECT repo_key, period, event_type, action, count(*) AS n FROM dated WHERE action <> '' GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
every AS (SELECT repo_key, period FROM (SELECT DISTINCT repo_key FROM dated) CROSS JOIN (SELECT DISTINCT period FROM dated)),
carried AS (SELECT e.repo_key, e.period, last_value(release_in IGNORE NULLS) OVER (PARTITION BY e.repo_key ORDER BY e.period) AS release FROM every e LEFT JOIN made_months USING (repo_key, period))"""
_TEXT = ("active_contributors", "maintainer_contributors", "external_contributors", "event_type_counts", "event_action_counts")
_NULLABLE = ("issue_resolution_days_mean", "pr_close_days_mean", "pr_merge_days_mean", "first_event_at", "last_event_at")


def _key(k: str) -> str:
    if k == "last_release_at":
        return f"strftime(release, {_ISO}) AS {k}"
    if k == "release_observed":
        return f"release IS NOT NULL AS {k}"
    if k == "days_since_last_release":
        return f"CAST(greatest(0, date_diff('day', CAST(release AS DATE), last_day(period))) AS INT) AS {k}"
    return k if k in _NULLABLE else f"coalesce({k}, {repr('') if k in _TEXT else 0}) AS {k}"


ORACLE = {
    "event_columns": f"WITH {_RICH} SELECT * REPLACE ({', '.join(f'CAST(epoch({c}) AS BIGINT) AS {c}' for c in _TIMES)}) FROM flat",
    "event_totals": "SELECT count(*) + (SELECT count(*) FROM region) AS scanned, (SELECT count(*) FROM region) AS malformed, count(*) AS matched, CAST(0 AS BIGINT) AS failed FROM events",
    "month_documents": f"WITH {_DOCS} SELECT repo_key, period, {', '.join(_key(k) for k in ev.MONTH_KEYS)} FROM carried LEFT JOIN made_months USING (repo_key, period) LEFT JOIN kinds USING (repo_key, period) LEFT JOIN acts USING (repo_key, period)",
    "release_bootstrap": f"WITH {_DOCS} SELECT repo_key, period, {', '.join(_key(k) for k in ('last_release_at', 'release_observed', 'days_since_last_release', 'releases_published', 'total_events'))} FROM carried LEFT JOIN made_months USING (repo_key, period) WHERE period = (SELECT max(period) FROM every)",
}
