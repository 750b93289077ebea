"""Repository events: flattening nested records, monthly features, and what carries between months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import days_between, days_since_release, iso, normalize_repo, present, role

#: Event types that count as work on code.
CODE_EVENTS = ["PushEvent", "PullRequestEvent", "PullRequestReviewEvent", "PullRequestReviewCommentEvent", "CommitCommentEvent", "ReleaseEvent", "CreateEvent", "DeleteEvent"]


def _truthy_number(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def flatten(events: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """The 26 flat columns of nested events (schemas.EVENT); of ``repos`` (repo_key) only, if given.

    Empty strings and zeros count as missing where a fallback follows, as the field rules ask.
    """
    p = F.col("payload")
    issue, pull, review, release, comment = (p[c] for c in ("issue", "pull_request", "review", "release", "comment"))
    ts = lambda c: F.try_to_timestamp(c)
    association = F.coalesce(*[present(s["author_association"]) for s in (p, issue, pull, comment, review)])
    keyed = events.withColumn("repo_key", normalize_repo(F.concat(F.lit("github:"), F.col("repo.name")))).filter(F.col("repo_key").isNotNull())
    if repos is not None:
        keyed = keyed.join(repos.select("repo_key"), "repo_key", "left_semi")
    zero = F.lit(0)
    return keyed.select(
        F.coalesce("id", F.lit("")).alias("event_id"), ts(F.col("created_at")).alias("created_at"), "repo_key", F.lower("repo.name").alias("repo_name"),
        F.coalesce(F.lower("actor.login"), F.lit("")).alias("actor_login"), F.coalesce("actor.type", F.lit("")).alias("actor_type"), F.coalesce("type", F.lit("")).alias("event_type"),
        F.coalesce(p["action"], F.lit("")).alias("action"), F.upper(F.coalesce(association, F.lit(""))).alias("author_association"),
        F.coalesce(_truthy_number(p["size"]), F.size(F.coalesce(p["commits"], F.array().cast("array<string>"))), zero).cast("int").alias("push_size"),
        F.coalesce(p["distinct_size"], zero).cast("int").alias("push_distinct_size"),
        _truthy_number(issue["number"]).alias("issue_number"), present(issue["pull_request"]).isNotNull().alias("issue_is_pull_request"),
        ts(issue["created_at"]).alias("issue_created_at"), ts(issue["closed_at"]).alias("issue_closed_at"),
        F.coalesce(_truthy_number(p["number"]), _truthy_number(pull["number"])).alias("pull_number"),
        ts(pull["created_at"]).alias("pull_created_at"), ts(pull["closed_at"]).alias("pull_closed_at"), ts(pull["merged_at"]).alias("pull_merged_at"),
        F.coalesce(pull["merged"], present(pull["merged_at"]).isNotNull()).alias("pull_merged"), F.coalesce(F.lower(review["state"]), F.lit("")).alias("review_state"),
        ts(F.coalesce(present(release["published_at"]), present(release["created_at"]))).alias("release_published_at"), F.coalesce(F.lower(p["ref_type"]), F.lit("")).alias("ref_type"),
        F.length(F.coalesce(present(pull["title"]), present(issue["title"]), F.lit(""))).alias("title_chars"),
        F.length(F.coalesce(present(pull["body"]), present(issue["body"]), present(review["body"]), F.lit(""))).alias("body_chars"),
        F.length(F.coalesce(comment["body"], F.lit(""))).alias("comment_chars"),
    )


def period_features(flat: DataFrame, period: Column) -> DataFrame:
    """One row of features for each (repo_key, period) of flat events: one grouped aggregation, merged map-side first.

    Counts of people are sizes of the sets of people that the row lists anyway; measures that a caller doesn't select aren't computed.
    """
    e, a, at = F.col("event_type"), F.col("action"), F.col("created_at")
    who = role(F.col("author_association"))
    actor = F.when(F.col("actor_login") != "", F.concat(F.lit("github:"), F.col("actor_login")))
    day = F.to_date(at)
    pr, issue_ = e == "PullRequestEvent", e == "IssuesEvent"
    closed = pr & (a == "closed")
    merged = closed & (F.col("pull_merged") | F.col("pull_merged_at").isNotNull())
    said, submitted = a.isin("", "created"), a.isin("", "created", "submitted")
    talk, review, remark = (e == "IssueCommentEvent") & said, (e == "PullRequestReviewEvent") & submitted, (e == "PullRequestReviewCommentEvent") & said
    resolved = F.when(issue_ & (a == "closed"), days_between(F.col("issue_created_at"), F.coalesce("issue_closed_at", at)))
    close_days = F.when(closed, days_between(F.col("pull_created_at"), F.coalesce("pull_closed_at", at)))
    merge_days = F.when(merged, days_between(F.col("pull_created_at"), F.coalesce("pull_merged_at", "pull_closed_at", at)))
    on_pull = F.col("issue_is_pull_request")
    count, total = F.count_if, lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    release = (e == "ReleaseEvent") & (a == "published")
    some = lambda c: F.size(F.collect_set(c)).cast("bigint")
    measures = {
        "total_events": F.count("*"), "push_events": count(e == "PushEvent"), "push_commits": total(e == "PushEvent", "push_size"), "push_distinct_commits": total(e == "PushEvent", "push_distinct_size"),
        "issues_opened": count(issue_ & (a == "opened")), "issues_closed": count(issue_ & (a == "closed")), "issues_reopened": count(issue_ & (a == "reopened")),
        "issue_resolution_count": F.count(resolved), "issue_resolution_days_mean": F.avg(resolved),
        "issue_comments": count(talk), "issue_comments_created": count(talk), "issue_only_comments": count(talk & ~on_pull), "pr_conversation_comments": count(talk & on_pull),
        **{f"{r}_{'role_' if r == 'unknown' else ''}issue_comments": count(talk & (who == r)) for r in ("maintainer", "external", "unknown")},
        "prs_opened": count(pr & (a == "opened")), "prs_closed": count(closed), "prs_merged": count(merged), "prs_reopened": count(pr & (a == "reopened")),
        "pr_close_count": F.count(close_days), "pr_close_days_mean": F.avg(close_days), "pr_merge_count": F.count(merge_days), "pr_merge_days_mean": F.avg(merge_days),
        "pr_reviews_submitted": count(review), "pr_reviews_approved": count(review & (F.col("review_state") == "approved")), "pr_reviews_changes_requested": count(review & (F.col("review_state") == "changes_requested")),
        "pr_review_comments": count(remark), "pr_review_comments_created": count(remark),
        **{f"{r}_pr_reviews": count(review & (who == r)) for r in ("maintainer", "external")}, **{f"{r}_pr_review_comments": count(remark & (who == r)) for r in ("maintainer", "external")},
        "releases_published": count(release), "release_in_period": F.max(F.when(release, F.coalesce("release_published_at", at))),
        "watch_started": count((e == "WatchEvent") & (a == "started")), "forks": count(e == "ForkEvent"),
        **{f"{what}es_{verb}d" if what == "branch" else f"{what}s_{verb}d": count((e == f"{verb.capitalize()}Event") & (F.col("ref_type") == what)) for what in ("branch", "tag") for verb in ("create", "delete")},
        "active_days": some(F.when(actor.isNotNull(), day)), "contributor_days": some(F.when(actor.isNotNull() & day.isNotNull(), F.concat(actor, day.cast("string")))),
        "active_contributors_count": some(actor), "code_contributors_count": some(F.when(e.isin(CODE_EVENTS), actor)),
        **{f"{r}_{'role_' if r == 'unknown' else ''}contributors_count": some(F.when(who == r, actor)) for r in ("maintainer", "external", "unknown")},
        "active_contributors": F.sort_array(F.collect_set(actor)), **{f"{r}_contributors": F.sort_array(F.collect_set(F.when(who == r, actor))) for r in ("maintainer", "external")},
        "first_event_at": F.min(at), "last_event_at": F.max(at),
    }
    return flat.groupBy("repo_key", period.alias("period")).agg(*[c.alias(n) for n, c in measures.items()])


def type_counts(flat: DataFrame, period: Column) -> DataFrame:
    """(repo_key, period, event_type_counts): a map from type to count, keys ascending."""
    per = flat.groupBy("repo_key", period.alias("period"), "event_type").agg(F.count("*").alias("n"))
    return per.groupBy("repo_key", "period").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n")))).alias("event_type_counts"))


def action_counts(flat: DataFrame, period: Column) -> DataFrame:
    """(repo_key, period, event_action_counts): type to action to count, non-empty actions only, keys ascending."""
    per = flat.filter("action <> ''").groupBy("repo_key", period.alias("period"), "event_type", "action").agg(F.count("*").alias("n"))
    inner = per.groupBy("repo_key", "period", "event_type").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("action", "n")))).alias("m"))
    pairs = F.array_sort(F.collect_list(F.struct("event_type", "m")), lambda x, y: F.when(x["event_type"] < y["event_type"], -1).when(x["event_type"] > y["event_type"], 1).otherwise(0))
    return inner.groupBy("repo_key", "period").agg(F.map_from_entries(pairs).alias("event_action_counts"))


def carry_release(features: DataFrame, release: str = "release_in_period") -> DataFrame:
    """``features`` with last_release_at: the period's own release, else the last earlier one (even if that was newer or the own one is older)."""
    over = W.partitionBy("repo_key").orderBy("period").rowsBetween(W.unboundedPreceding, W.currentRow)
    return features.withColumn("last_release_at", F.last(release, ignorenulls=True).over(over)).withColumn("release_observed", F.col("last_release_at").isNotNull())


def last_releases(flat: DataFrame, before: Column | None = None) -> DataFrame:
    """(repo_key, last_release_at): the newest published release of events ``before`` (a filter that reaches the scan); what a run over later months starts from."""
    published = flat.filter((F.col("event_type") == "ReleaseEvent") & (F.col("action") == "published"))
    rows = published if before is None else published.filter(before)
    return rows.groupBy("repo_key").agg(F.max(F.coalesce("release_published_at", "created_at")).alias("last_release_at")).filter("last_release_at IS NOT NULL")


#: The keys of a month's document, in order.
MONTH_KEYS = [
    "push_events", "push_commits", "push_distinct_commits", "issues_opened", "issues_closed", "issues_reopened", "issue_comments", "issue_comments_created", "issue_only_comments",
    "pr_conversation_comments", "maintainer_issue_comments", "external_issue_comments", "unknown_role_issue_comments", "issue_resolution_count", "issue_resolution_days_mean", "prs_opened",
    "prs_closed", "prs_merged", "prs_reopened", "pr_reviews_submitted", "pr_reviews_approved", "pr_reviews_changes_requested", "pr_review_comments", "pr_review_comments_created",
    "maintainer_pr_reviews", "external_pr_reviews", "maintainer_pr_review_comments", "external_pr_review_comments", "pr_close_days_mean", "pr_merge_days_mean", "releases_published",
    "last_release_at", "release_observed", "days_since_last_release", "watch_started", "forks", "branches_created", "branches_deleted", "tags_created", "tags_deleted", "active_days",
    "contributor_days", "active_contributors_count", "code_contributors_count", "maintainer_contributors_count", "external_contributors_count", "unknown_role_contributors_count",
    "active_contributors", "maintainer_contributors", "external_contributors", "first_event_at", "last_event_at", "total_events", "event_type_counts", "event_action_counts",
]


def month_documents(flat: DataFrame, months: DataFrame, repos: DataFrame | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """(repo_key, period, the 55 :data:`MONTH_KEYS`) for every repo with every month (period: its first day); months without events are zeros.

    ``earlier`` (repo_key, last_release_at) is what :func:`last_releases` found before the first month. Times are ISO text.
    """
    period = F.trunc(F.to_date("created_at"), "month")
    made = period_features(flat, period).join(type_counts(flat, period), ["repo_key", "period"], "left").join(action_counts(flat, period), ["repo_key", "period"], "left")
    every = (repos if repos is not None else flat).select("repo_key").distinct().crossJoin(F.broadcast(months.select("period").distinct()))
    full = every.join(made, ["repo_key", "period"], "left")
    over = W.partitionBy("repo_key").orderBy("period").rowsBetween(W.unboundedPreceding, W.currentRow)
    full = full.withColumn("last_release_at", F.last("release_in_period", ignorenulls=True).over(over))
    if earlier is not None:
        full = full.join(earlier.select("repo_key", F.col("last_release_at").alias("_earlier")), "repo_key", "left").withColumn("last_release_at", F.coalesce("last_release_at", "_earlier"))
    kinds = dict(made.dtypes)

    def value(key: str) -> Column:
        if key == "last_release_at":
            return iso(F.col(key))
        if key == "release_observed":
            return F.col("last_release_at").isNotNull()
        if key == "days_since_last_release":
            return days_since_release(F.col("period"), F.col("last_release_at"))
        if kinds[key] == "timestamp":
            return iso(F.col(key))
        if kinds[key] == "bigint":
            return F.coalesce(key, F.lit(0))
        if kinds[key].startswith(("array", "map")):
            return F.coalesce(key, (F.array() if kinds[key].startswith("array") else F.create_map()).cast(kinds[key]))
        return F.col(key)

    return full.select("repo_key", "period", *[value(k).alias(k) for k in MONTH_KEYS])


def totals(raw: DataFrame, flat: DataFrame, failed: int = 0) -> DataFrame:
    """One row (scanned, malformed, matched, failed) of a parse with a _corrupt column; ``failed`` counts files that couldn't be read."""
    counted = raw.agg(F.count("*").alias("scanned"), F.count_if(F.col("_corrupt").isNotNull()).alias("malformed")).crossJoin(flat.agg(F.count("*").alias("matched")))
    return counted.withColumn("failed", F.lit(failed).cast("bigint"))
