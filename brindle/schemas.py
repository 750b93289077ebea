"""Declared schemas of the inputs; nothing is inferred."""

CRATES = "created_at string, description string, documentation string, homepage string, id bigint, max_features string, max_upload_size string, name string, readme string, repository string, trustpub_only string, updated_at string"
VERSIONS = "bin_names string, categories string, checksum string, crate_id bigint, crate_size bigint, created_at string, description string, documentation string, downloads bigint, edition int, features string, has_lib string, homepage string, id bigint, keywords string, license string, links string, num string, num_no_build string, published_by bigint, repository string, rust_version string, updated_at string, yanked string"
DEPENDENCIES = "crate_id bigint, default_features string, explicit_name string, features string, id bigint, kind int, optional string, req string, target string, version_id bigint"
VERSION_DOWNLOADS = "date date, downloads bigint, version_id bigint"
KEYWORDS = "crates_cnt bigint, created_at string, id bigint, keyword string"
CRATE_KEYWORDS = "crate_id bigint, keyword_id bigint"
FUNCTIONS = "crate_id bigint, github_owner string, github_repo string, functional_role string, capability_set string, api_intent string, architectural_position string, integration_pattern string, key_inputs string, key_outputs string, external_interfaces string, domain_tags string"
PAIRS = "crate_id bigint, name string, github_owner string, github_repo string, replacement string, snippet string"
SCORES = "crate_name string, score double"
ADVISORY = "package string, package_name string, crate_name string, ghsaId string, severity string, publishedAt string, published_at string, published string, cvss_score string, cvss_vector string"
EMBEDDING = "package_name string, embedding array<double>"

_ISSUE = "struct<number: bigint, created_at: string, closed_at: string, title: string, body: string, pull_request: string, author_association: string>"
_PULL = "struct<number: bigint, created_at: string, closed_at: string, merged_at: string, merged: boolean, title: string, body: string, author_association: string>"
EVENT = (
    "id string, type string, created_at string, actor struct<login: string, type: string>, repo struct<name: string>, "
    f"payload struct<action: string, size: int, distinct_size: int, commits: array<string>, number: bigint, ref_type: string, author_association: string, issue: {_ISSUE}, pull_request: {_PULL}, "
    "review: struct<state: string, body: string, author_association: string>, release: struct<published_at: string, created_at: string>, comment: struct<body: string, author_association: string>>, _corrupt string"
)

FLAT_EVENT = (
    "event_id string, created_at timestamp, repo_key string, repo_name string, actor_login string, actor_type string, event_type string, action string, author_association string, "
    "push_size int, push_distinct_size int, issue_number bigint, issue_is_pull_request boolean, issue_created_at timestamp, issue_closed_at timestamp, pull_number bigint, "
    "pull_created_at timestamp, pull_closed_at timestamp, pull_merged_at timestamp, pull_merged boolean, review_state string, release_published_at timestamp, ref_type string, "
    "title_chars int, body_chars int, comment_chars int"
)

MONTH_FEATURES = (
    "push_events bigint, issues_opened bigint, issues_closed bigint, prs_opened bigint, prs_closed bigint, prs_merged bigint, issue_comments bigint, pr_review_comments bigint, "
    "releases_published bigint, last_release_at string, watch_started bigint, active_contributors array<string>"
)

MONTH_DOCUMENT = (
    "push_events bigint, push_commits bigint, push_distinct_commits bigint, issues_opened bigint, issues_closed bigint, issues_reopened bigint, issue_comments bigint, issue_comments_created bigint, "
    "issue_only_comments bigint, pr_conversation_comments bigint, maintainer_issue_comments bigint, external_issue_comments bigint, unknown_role_issue_comments bigint, issue_resolution_count bigint, "
    "issue_resolution_days_mean double, prs_opened bigint, prs_closed bigint, prs_merged bigint, prs_reopened bigint, pr_reviews_submitted bigint, pr_reviews_approved bigint, "
    "pr_reviews_changes_requested bigint, pr_review_comments bigint, pr_review_comments_created bigint, maintainer_pr_reviews bigint, external_pr_reviews bigint, maintainer_pr_review_comments bigint, "
    "external_pr_review_comments bigint, pr_close_days_mean double, pr_merge_days_mean double, releases_published bigint, last_release_at string, release_observed boolean, days_since_last_release int, "
    "watch_started bigint, forks bigint, branches_created bigint, branches_deleted bigint, tags_created bigint, tags_deleted bigint, active_days bigint, contributor_days bigint, "
    "active_contributors_count bigint, code_contributors_count bigint, maintainer_contributors_count bigint, external_contributors_count bigint, unknown_role_contributors_count bigint, "
    "active_contributors array<string>, maintainer_contributors array<string>, external_contributors array<string>, first_event_at string, last_event_at string, total_events bigint, "
    "event_type_counts map<string, bigint>, event_action_counts map<string, map<string, bigint>>"
)
