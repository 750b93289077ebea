"""Registered queries over events, monthly series, labels and sequences (weeks stand for months)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas
from ..operators import events as ev
from ..operators.events import flatten as flatten_all
from ..operators import model
from ..operators import timeseries as ts
from ..session import materialize, shared_dir
from ..streaming import events as streaming
from . import tables as t

COLUMNS = ["push_events", "prs_merged", "active_contributors_count"]


def period():
    return F.to_date(F.date_trunc("week", F.col("created_at")))


def event_flatten(spark, sf):
    return t.flat_events(spark, sf).select("event_id", "created_at", "repo_key", "actor_login", "event_type", "action", "author_association", "push_size", "issue_number", "pull_number", "pull_merged", "title_chars", "body_chars").withColumn("created_at", F.unix_seconds("created_at"))


def event_filter_repos(spark, sf):
    repos = spark.range(0, 20).select(F.concat(F.lit("github:org/repo"), F.col("id")).alias("repo_key"))
    nested = t.json_events(spark, sf).select(F.from_json("value", schemas.EVENT, {"columnNameOfCorruptRecord": "_corrupt"}).alias("e")).select("e.*")
    return ev.flatten(nested, repos).groupBy("repo_key").agg(F.count("*").alias("n"))


def _features(spark, sf):
    return ev.period_features(t.flat_events(spark, sf), period())


FEATURES = ["total_events", "push_events", "push_commits", "issues_opened", "issue_comments_created", "maintainer_issue_comments", "prs_closed", "prs_merged", "watch_started", "active_days", "contributor_days", "active_contributors_count", "code_contributors_count", "maintainer_contributors_count"]


def repo_period_features(spark, sf):
    return _features(spark, sf).select("repo_key", "period", *FEATURES, F.round("pr_merge_days_mean", 6).alias("pr_merge_days_mean"))


def active_contributors(spark, sf):
    return _features(spark, sf).select("repo_key", "period", F.array_join("active_contributors", ",").alias("contributors"))


def event_type_map(spark, sf):
    return ev.type_counts(t.flat_events(spark, sf), period()).select("repo_key", "period", F.explode("event_type_counts").alias("event_type", "n"))


def event_action_map(spark, sf):
    return ev.action_counts(t.flat_events(spark, sf), period()).select("repo_key", "period", F.explode("event_action_counts").alias("event_type", "m")).select("repo_key", "period", "event_type", F.explode("m").alias("action", "n"))


def duration_means(spark, sf):
    from ..functions.columns import days_between

    o, l = t.read(spark, sf, "orders"), t.read(spark, sf, "lineitem")  # noqa: E741
    d = days_between(F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp"))
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count(d).alias("n"), F.round(F.avg(d), 6).alias("days_mean"))


def release_carry(spark, sf):
    rows = t.flat_events(spark, sf).withColumn("release", F.when(F.col("event_type") == "PullRequestEvent", F.col("created_at")))
    per = rows.groupBy("repo_key", period().alias("period")).agg(F.max("release").alias("release_in_period"))
    return ev.carry_release(per).select("repo_key", "period", F.unix_seconds("last_release_at").alias("last_release_at"), "release_observed")


def zero_fill(spark, sf):
    f = materialize(_features(spark, sf).select("repo_key", "period", *COLUMNS), "features")
    return ts.zero_fill(f, f, COLUMNS)


def _filled(spark, sf):
    f = materialize(_features(spark, sf).select("repo_key", "period", *COLUMNS), "features")
    return ts.forward_fill(f, f, COLUMNS)


def month_spine_ffill(spark, sf):
    return _filled(spark, sf)


def lag_features(spark, sf):
    return ts.lags(_features(spark, sf).select("repo_key", "period", "push_events"), "push_events", (1, 2, 3))


def rolling_features(spark, sf):
    out = ts.rolling(_features(spark, sf).select("repo_key", "period", "push_events"), "push_events", (3,))
    return out.select("repo_key", "period", *[F.round(f"push_events_rolling_{n}_3", 6).alias(n) for n in ("mean", "std", "max", "min")])


def latest_features(spark, sf):
    return ts.latest_features(_features(spark, sf).select("repo_key", "period", "push_events"), ["push_events"], 4).select("repo_key", "period", "push_events_lag_1", "push_events_lag_2", F.round("push_events_rolling_mean_3", 6).alias("mean_3"))


def sequence_features(spark, sf):
    seq = ts.sequences(_filled(spark, sf), COLUMNS, 6)
    return seq.select("repo_key", F.posexplode("sequence").alias("step", "v")).select("repo_key", "step", *[F.col("v")[i].alias(c) for i, c in enumerate(COLUMNS)])


def _label(spark, sf):
    f = materialize(_features(spark, sf).select("repo_key", "period", *COLUMNS), "features")
    return ts.future_activity(f, ts.last_periods(f, 1), f, (F.col("push_events") > 1) & (F.col("prs_merged") > 1))


def activity_label(spark, sf):
    return _label(spark, sf)


def activity_label_distribution(spark, sf):
    return _label(spark, sf).groupBy("label").agg(F.count("*").alias("n"))


def minmax_scaler(spark, sf):
    f = materialize(_features(spark, sf).select("repo_key", "period", *COLUMNS), "features")
    fitted = ts.scaler(f.filter(F.col("period") < F.lit("2024-01-22").cast("date")), COLUMNS)
    return ts.scaled(f, fitted, COLUMNS).select("repo_key", "period", *[F.round(c, 9).alias(c) for c in COLUMNS])


def hash_split(spark, sf):
    return ts.stratified_split(_label(spark, sf), "repo_key", "label")


def release_days(spark, sf):
    from ..functions.columns import days_since_release, whole_days_since_release

    at = F.col("ts").cast("timestamp")
    month = F.to_date("ts")
    return t.read(spark, sf, "events").select("event_id", days_since_release(month, at).cast("bigint").alias("calendar_days"), whole_days_since_release(month, at).alias("whole_days"))


def model_score(spark, sf):
    """Fitted on the train part alone; every repository is scored, with the part it belongs to."""
    seq = ts.sequences(_filled(spark, sf), COLUMNS, 6).join(_label(spark, sf), "repo_key")
    seq = materialize(ts.stratified_split(seq, "repo_key", "label"), "sequences")
    return model.fit_predict(seq.filter("part = 'train'"), seq, "logistic").select("repo_key", "label", "part", "activity_probability")


def stream_available_now(spark, sf):
    """The same flat events by a stream over written JSON files; run once to the end."""
    where = f"{shared_dir(spark)}/brindle/stream-{uuid.uuid4().hex}"
    t.json_events(spark, sf).write.text(f"{where}/in")
    streaming.extract(spark, f"{where}/in", f"{where}/out", f"{where}/state").awaitTermination()
    return spark.read.schema(schemas.FLAT_EVENT + ", year int, month int").parquet(f"{where}/out").groupBy("year", "month", "event_type").agg(F.count("*").alias("n"))


def _folder(spark, sf):
    """Event records as JSON files of a few thousand lines, to stream from."""
    where = f"{shared_dir(spark)}/brindle/stream-{uuid.uuid4().hex}"
    t.json_events(spark, sf).repartition(4).write.text(f"{where}/in")
    return where


def stream_monthly_counts(spark, sf):
    where = _folder(spark, sf)
    streaming.run_counts(spark, f"{where}/in", f"{where}/out", f"{where}/state").awaitTermination()
    return spark.read.parquet(f"{where}/out")


def stream_last_release(spark, sf):
    """What carries between months, as state; merged pull requests stand for releases."""
    where = _folder(spark, sf)
    releases = flatten_all(streaming.read(spark, f"{where}/in")).filter("event_type = 'PullRequestEvent'").select("repo_key", F.col("created_at").alias("released_at"))
    streaming.run_carry(streaming.last_release(releases), f"{where}/out", f"{where}/state").awaitTermination()
    return spark.read.parquet(f"{where}/out").groupBy("repo_key").agg(F.unix_seconds(F.max("last_release_at")).alias("last_release_at"))


QUERIES = {
    "stream_monthly_counts": stream_monthly_counts, "stream_last_release": stream_last_release,
    "event_flatten": event_flatten, "event_filter_repos": event_filter_repos, "repo_period_features": repo_period_features, "active_contributors": active_contributors, "event_type_map": event_type_map,
    "event_action_map": event_action_map, "duration_means": duration_means, "release_carry": release_carry, "release_days": release_days, "zero_fill": zero_fill, "month_spine_ffill": month_spine_ffill,
    "lag_features": lag_features, "rolling_features": rolling_features, "latest_features": latest_features, "sequence_features": sequence_features, "activity_label": activity_label,
    "activity_label_distribution": activity_label_distribution, "minmax_scaler": minmax_scaler, "hash_split": hash_split, "model_score": model_score, "stream_available_now": stream_available_now,
}

_KIND = "CASE kind WHEN 'view' THEN 'WatchEvent' WHEN 'click' THEN 'PushEvent' WHEN 'signup' THEN 'IssuesEvent' WHEN 'error' THEN 'IssueCommentEvent' WHEN 'purchase' THEN 'PullRequestEvent' END"
_ACTION = "CASE kind WHEN 'view' THEN 'started' WHEN 'signup' THEN 'opened' WHEN 'error' THEN 'created' WHEN 'purchase' THEN 'closed' ELSE '' END"
_F = f"""WITH {t.FLAT}, features AS (SELECT repo_key, CAST(period AS DATE) AS period, count(*) AS total_events, count(*) FILTER (kind = 'click') AS push_events,
  CAST(coalesce(sum(CASE WHEN size = 0 THEN 0 ELSE size END) FILTER (kind = 'click'), 0) AS BIGINT) AS push_commits, count(*) FILTER (kind = 'signup') AS issues_opened,
  count(*) FILTER (kind = 'error') AS issue_comments_created, count(*) FILTER (kind = 'error' AND k % 2 = 0) AS maintainer_issue_comments, count(*) FILTER (kind = 'purchase') AS prs_closed,
  count(*) FILTER (kind = 'purchase') AS prs_merged, count(*) FILTER (kind = 'view') AS watch_started, count(DISTINCT CAST(happened AS DATE)) AS active_days, count(DISTINCT (actor, CAST(happened AS DATE))) AS contributor_days,
  count(DISTINCT actor) AS active_contributors_count, count(DISTINCT actor) FILTER (kind IN ('click', 'purchase')) AS code_contributors_count, count(DISTINCT actor) FILTER (k % 2 = 0) AS maintainer_contributors_count,
  CASE WHEN count(*) FILTER (kind = 'purchase') > 0 THEN 1.5 END AS pr_merge_days_mean FROM flat GROUP BY 1, 2),
weeks AS (SELECT DISTINCT period FROM features)"""
_FILLED = """sparse AS (SELECT * FROM features), grid AS (SELECT repo_key, period FROM (SELECT DISTINCT repo_key FROM sparse) CROSS JOIN weeks),
filled AS (SELECT g.repo_key, g.period, coalesce(last_value(s.push_events IGNORE NULLS) OVER w, 0) AS push_events, coalesce(last_value(s.prs_merged IGNORE NULLS) OVER w, 0) AS prs_merged,
  coalesce(last_value(s.active_contributors_count IGNORE NULLS) OVER w, 0) AS active_contributors_count FROM grid g LEFT JOIN sparse s USING (repo_key, period) WINDOW w AS (PARTITION BY g.repo_key ORDER BY g.period))"""
_LABEL = "labels_ AS (SELECT repo_key, CAST(coalesce(max(CASE WHEN push_events > 1 AND prs_merged > 1 THEN 1 ELSE 0 END) FILTER (period = (SELECT max(period) FROM weeks)), 0) AS INT) AS label FROM features GROUP BY 1)"
_SCALED = ", ".join(f"round(({c} - min_{c}) / CASE WHEN max_{c} = min_{c} THEN 1 ELSE max_{c} - min_{c} END, 9) AS {c}" for c in COLUMNS)

_SPLIT = """h AS (SELECT repo_key, label, CAST('0x' || substr(md5(repo_key || ':42'), 1, 15) AS BIGINT) AS h FROM labels_),
n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS r, round(count(*) OVER (PARTITION BY label) * 0.2) AS t, count(*) OVER (PARTITION BY label) AS n FROM h)"""

ORACLE = {
    "hash_split": f"{_F}, {_LABEL}, {_SPLIT} SELECT repo_key, label, CASE WHEN r <= t THEN 'test' WHEN r <= t + round((n - t) * 0.2) THEN 'validation' ELSE 'train' END AS part FROM n",
    "stream_available_now": f"WITH {t.FLAT} SELECT CAST(year(happened) AS INT) AS year, CAST(month(happened) AS INT) AS month, {_KIND} AS event_type, count(*) AS n FROM flat GROUP BY 1, 2, 3",
    "stream_monthly_counts": f"WITH {t.FLAT} SELECT repo_key, CAST(date_trunc('month', happened) AS DATE) AS month, count(*) AS n FROM flat GROUP BY 1, 2",
    "stream_last_release": f"WITH {t.FLAT} SELECT repo_key, CAST(max(epoch(happened)) FILTER (kind = 'purchase') AS BIGINT) AS last_release_at FROM flat WHERE kind = 'purchase' GROUP BY 1",
    "event_flatten": f"""WITH {t.FLAT} SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(epoch(happened) AS BIGINT) AS created_at, repo_key, actor AS actor_login, {_KIND} AS event_type, {_ACTION} AS action, CASE WHEN k % 2 = 0 THEN 'MEMBER' ELSE 'NONE' END AS author_association,
CASE WHEN kind = 'click' THEN coalesce(nullif(size, 0), 0) ELSE 0 END AS push_size, CASE WHEN kind = 'signup' THEN nullif(event_id, 0) END AS issue_number, CASE WHEN kind = 'purchase' THEN nullif(event_id, 0) END AS pull_number, kind = 'purchase' AS pull_merged,
CAST(kind = 'purchase' AS INT) AS title_chars, CASE WHEN kind = 'signup' THEN 4 ELSE 0 END AS body_chars FROM flat""",
    "event_filter_repos": "SELECT 'github:org/repo' || user_id AS repo_key, count(*) AS n FROM events WHERE user_id < 20 GROUP BY 1",
    "repo_period_features": f"{_F} SELECT * FROM features",
    "active_contributors": f"WITH {t.FLAT} SELECT repo_key, CAST(period AS DATE) AS period, string_agg(DISTINCT 'github:' || actor, ',' ORDER BY 'github:' || actor) AS contributors FROM flat GROUP BY 1, 2",
    "event_type_map": f"WITH {t.FLAT} SELECT repo_key, CAST(period AS DATE) AS period, {_KIND} AS event_type, count(*) AS n FROM flat GROUP BY 1, 2, 3",
    "event_action_map": f"WITH {t.FLAT} SELECT repo_key, CAST(period AS DATE) AS period, {_KIND} AS event_type, {_ACTION} AS action, count(*) AS n FROM flat WHERE kind <> 'click' GROUP BY 1, 2, 3, 4",
    "duration_means": "SELECT o_orderpriority, count(*) FILTER (l_shipdate >= o_orderdate) AS n, round(avg(epoch(l_shipdate - o_orderdate) / 86400) FILTER (l_shipdate >= o_orderdate), 6) AS days_mean FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "release_carry": f"""WITH {t.FLAT}, per AS (SELECT repo_key, CAST(period AS DATE) AS period, max(happened) FILTER (kind = 'purchase') AS r FROM flat GROUP BY 1, 2),
c AS (SELECT repo_key, period, last_value(r IGNORE NULLS) OVER (PARTITION BY repo_key ORDER BY period) AS l FROM per) SELECT repo_key, period, CAST(epoch(l) AS BIGINT) AS last_release_at, l IS NOT NULL AS release_observed FROM c""",
    "release_days": "SELECT event_id, greatest(0, date_diff('day', CAST(ts AS DATE), last_day(ts))) AS calendar_days, CAST(greatest(0, floor((epoch(CAST(last_day(ts) AS TIMESTAMP)) - floor(epoch(ts))) / 86400)) AS BIGINT) AS whole_days FROM events",
    "zero_fill": f"{_F} SELECT repo_key, period, coalesce(push_events, 0) AS push_events, coalesce(prs_merged, 0) AS prs_merged, coalesce(active_contributors_count, 0) AS active_contributors_count FROM (SELECT DISTINCT repo_key FROM features) CROSS JOIN weeks LEFT JOIN features USING (repo_key, period)",
    "month_spine_ffill": f"{_F}, {_FILLED} SELECT * FROM filled",
    "lag_features": f"{_F} SELECT repo_key, period, push_events, lag(push_events, 1) OVER w AS push_events_lag_1, lag(push_events, 2) OVER w AS push_events_lag_2, lag(push_events, 3) OVER w AS push_events_lag_3 FROM features WINDOW w AS (PARTITION BY repo_key ORDER BY period)",
    "rolling_features": f"""{_F} SELECT repo_key, period, CASE WHEN n >= 3 THEN round(mean, 6) END AS mean, CASE WHEN n >= 3 THEN round(std, 6) END AS std, CASE WHEN n >= 3 THEN hi END AS max, CASE WHEN n >= 3 THEN lo END AS min FROM
(SELECT repo_key, period, row_number() OVER (PARTITION BY repo_key ORDER BY period) AS n, avg(push_events) OVER w AS mean, stddev_samp(push_events) OVER w AS std, max(push_events) OVER w AS hi, min(push_events) OVER w AS lo FROM features WINDOW w AS (PARTITION BY repo_key ORDER BY period ROWS 2 PRECEDING))""",
    "latest_features": f"""{_F}, m AS (SELECT repo_key, period, lag(push_events, 1) OVER w AS l1, lag(push_events, 2) OVER w AS l2, avg(push_events) OVER (PARTITION BY repo_key ORDER BY period ROWS 2 PRECEDING) AS mean_3, row_number() OVER (PARTITION BY repo_key ORDER BY period DESC) AS r, count(*) OVER (PARTITION BY repo_key) AS n FROM features WINDOW w AS (PARTITION BY repo_key ORDER BY period))
SELECT repo_key, period, coalesce(l1, 0) AS push_events_lag_1, coalesce(l2, 0) AS push_events_lag_2, round(mean_3, 6) AS mean_3 FROM m WHERE r = 1 AND n >= 4""",
    "sequence_features": f"""{_F}, {_FILLED}, s AS (SELECT *, row_number() OVER (PARTITION BY repo_key ORDER BY period DESC) AS back FROM filled)
SELECT repo_key, CAST(step AS INT) AS step, CAST(coalesce(push_events, 0) AS DOUBLE) AS push_events, CAST(coalesce(prs_merged, 0) AS DOUBLE) AS prs_merged, CAST(coalesce(active_contributors_count, 0) AS DOUBLE) AS active_contributors_count
FROM (SELECT DISTINCT repo_key FROM filled) CROSS JOIN range(6) r(step) LEFT JOIN (SELECT repo_key AS rk, 6 - back AS st, push_events, prs_merged, active_contributors_count FROM s) ON rk = repo_key AND st = step""",
    "activity_label": f"{_F}, {_LABEL} SELECT repo_key, label FROM labels_",
    "activity_label_distribution": f"{_F}, {_LABEL} SELECT label, count(*) AS n FROM labels_ GROUP BY 1",
    "minmax_scaler": f"{_F}, fitted AS (SELECT {', '.join(f'min({c}) AS min_{c}, max({c}) AS max_{c}' for c in COLUMNS)} FROM features WHERE period < DATE '2024-01-22') SELECT repo_key, period, {_SCALED} FROM features, fitted",
}
