"""Readers and writers on small files."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators.events import flatten, totals
from brindle.sources import readers, writers


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_csv_with_line_ends_in_quotes(spark, tmp_path):
    where = put(tmp_path / "crates.csv", 'id,name,readme,repository\n1,a,"two\nlines, ""quoted""",https://GitHub.com/x/y\n2,null,,\n')
    assert [tuple(r) for r in readers.crates(spark, where).orderBy("id").collect()] == [(1, "a"), (2, "null")]
    assert [r["name"] for r in readers.crates_with_repository(spark, where).collect()] == ["a"]
    with pytest.raises(ValueError):
        readers.versions(spark, where)


def test_version_dates_with_and_without_fractions(spark, tmp_path):
    where = put(tmp_path / "v.csv", "id,crate_id,updated_at,created_at\n1,1,2024-01-02 03:04:05.678+00,x\n2,1,2024-01-02 03:04:05+00,\n3,1,bad,\n")
    assert [r["updated_at"] is None for r in readers.versions(spark, where).orderBy("id").collect()] == [False, False, True]


def test_advisory_lines(spark, tmp_path):
    lines = ['{"package": "", "crate_name": " Ab ", "severity": "HIGH", "published": "2025-01-01T00:00:00Z", "cvss_score": 0.0}', "", "not json", '{"package_name": "c", "publishedAt": "never"}']
    rows = {r["package"]: r for r in readers.advisories(spark, put(tmp_path / "a.jsonl", "\n".join(lines))).collect()}
    assert set(rows) == {"ab", "c"} and rows["ab"]["published"] is not None and rows["c"]["published"] is None


def test_month_maps(spark, tmp_path):
    for m in ("2023_11", "2023_12"):
        put(tmp_path / f"m/delta_{m}.json", json.dumps({"_meta": {"month": m}, "github:Own/Repo": {"push_events": 3, "active_contributors": ["a"]}}))
    rows = readers.monthly(spark, str(tmp_path / "m"), last=1).collect()
    assert [(r["repo_key"], r["period"], r["push_events"], r["prs_opened"]) for r in rows] == [("github:own/repo", "2023_12", 3, None)]


def test_repo_lists(spark, tmp_path):
    array = put(tmp_path / "a.json", '["github:A/b", "https://github.com/a/B"]')
    inner = put(tmp_path / "b.json", '{"repositories": ["x/y"]}')
    keyed = put(tmp_path / "c.json", '{"github:k/l": 1}')
    table = put(tmp_path / "d.csv", "name,repository,url\nn,,https://github.com/u/v\n")
    text = put(tmp_path / "e.txt", "o/p\n\n")
    got = [[r["repo_key"] for r in readers.repo_list(spark, p).collect()] for p in (array, inner, keyed, table, text)]
    assert got == [["github:a/b"], ["github:x/y"], ["github:k/l"], ["github:u/v"], ["github:o/p"]]
    with pytest.raises(ValueError):
        readers.repo_list(spark, put(tmp_path / "f.txt", "nothing\n"))


def test_raw_events_and_truthiness(spark, tmp_path):
    event = {"id": "1", "type": "PullRequestEvent", "created_at": "2024-01-02T00:00:00Z", "actor": {"login": "Me"}, "repo": {"name": "A/b"}, "payload": {"action": "closed", "number": 0, "pull_request": {"number": 7, "title": "", "merged_at": "2024-01-01T00:00:00Z", "author_association": ""}, "issue": {"title": "T", "author_association": "owner"}}}
    where = tmp_path / "2024-01-02-0.json.gz"
    where.write_bytes(gzip.compress(("\n".join([json.dumps(event), "", "broken", json.dumps({"id": "2", "repo": {"name": ""}})])).encode()))
    raw = readers.raw_events(spark, str(where))
    flat = flatten(raw)
    r = flat.first()
    assert (r["repo_key"], r["actor_login"], r["pull_number"], r["pull_merged"], r["title_chars"], r["author_association"]) == ("github:a/b", "me", 7, True, 1, "OWNER")
    assert tuple(totals(raw, flat, failed=2).first()) == (3, 1, 1, 2)
    assert flatten(raw, spark.createDataFrame([("github:c/d",)], "repo_key string")).count() == 0


def test_embeddings_last_wins_and_array_file(spark, tmp_path):
    lines = ['{"package_name": "a", "embedding": [1.0]}', '{"package_name": "a", "embedding": [2.0]}']
    assert [tuple(r) for r in readers.embeddings(spark, put(tmp_path / "e.jsonl", "\n".join(lines))).collect()] == [("a", [2.0])]
    np.savez_compressed(tmp_path / "e.npz", names=np.array(["a", "b"]), crate_ids=np.array(["1", "2"]), embeddings=np.eye(2, dtype=np.float32))
    assert [tuple(r) for r in readers.npz_embeddings(spark, str(tmp_path / "e.npz")).collect()] == [("a", "1", [1.0, 0.0]), ("b", "2", [0.0, 1.0])]


def test_pairs_drop_self_and_unknown(spark, tmp_path):
    where = put(tmp_path / "p.csv", "crate_id,name,github_owner,github_repo,replacement,snippet\n1,a,,,B,\n2,b,,,B,\n3,a,,,zz,\n4,a,,,,\n")
    known = spark.createDataFrame([("A",), ("b",)], "name string")
    assert [r["crate_id"] for r in readers.pairs(spark, where, known).collect()] == [1]


def test_keywords_keep_file_order(spark, tmp_path):
    k = put(tmp_path / "k.csv", "id,keyword\n1,z\n2,a\n")
    l = put(tmp_path / "l.csv", "crate_id,keyword_id\n5,1\n5,2\n")  # noqa: E741
    assert [tuple(r) for r in readers.keyword_lists(spark, k, l).collect()] == [(5, "z, a")]


def test_manifest(spark):
    old = spark.createDataFrame([("a", 1, 1, "done", 1), ("b", 1, 1, "failed", 1)], "source_path string, size long, mtime long, status string, updated_at long")
    new = spark.createDataFrame([("b", 1, 1, "done", 2)], old.schema)
    now = writers.upsert(old, new)
    files = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 1, 1)], "source_path string, size long, mtime long")
    assert sorted(r["source_path"] for r in writers.pending(files, now).collect()) == ["b", "c"]


def test_score_resource(spark, tmp_path):
    df = spark.createDataFrame([("a", "1.5"), ("", "2"), ("c", "x"), ("d", "4")], "crate_name string, score string")
    writers.scores(df, f"{tmp_path}/s", 2)
    assert readers.scores(spark, f"{tmp_path}/s").filter(F.col("crate_name") == "a").first()["score"] == 1.5
