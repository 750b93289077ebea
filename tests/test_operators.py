"""Golden cases by hand, invariants and edge cases of the operators."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import ranks, stats
from brindle.functions.columns import normalize_repo, parsed_answer, severity, sql_words
from brindle.operators import graph, model, ranking, timeseries, vectors
from brindle.plans import stages, text_queries
from brindle.plans.runner import Pipeline, Stage


def ints(df):
    return sorted(tuple(r) for r in df.collect())


def test_average_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 3.0, None, 2.0])], "id int, v double")
    up = {r["id"]: r["r"] for r in ranks.average_rank(df, "v", "r").collect()}
    assert up == {0: 3.5, 1: 1.0, 2: 3.5, 3: None, 4: 2.0}
    down = {r["id"]: r["r"] for r in ranks.average_rank(df, "v", "r", descending=True, percent=True).collect()}
    assert down == {0: 1.5 / 4, 1: 1.0, 2: 1.5 / 4, 3: None, 4: 0.75}


def test_ranks_sum(spark):
    df = spark.range(1, 2001).select((F.col("id") * 7919 % 313).cast("double").alias("v"))
    assert ranks.average_rank(df, "v", "r").agg(F.sum("r")).first()[0] == 2000 * 2001 / 2


def test_minmax_constant(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    for c in (0.0, 0.5, None):
        assert {r["s"] for r in ranks.minmax(df, "v", "s", c).collect()} == {c}


def test_latest_version_null_date_wins_and_ties_by_id(spark):
    v = spark.createDataFrame([(1, 1, "2024-01-01"), (2, 1, None), (3, 2, "2024-01-01"), (4, 2, "2024-01-01")], "id long, crate_id long, updated_at string").withColumn("updated_at", F.to_timestamp("updated_at"))
    assert ints(graph.latest_versions(v)) == [(1, 2), (2, 4)]
    assert ints(graph.latest_versions(v, nulls="last")) == [(1, 1), (2, 4)]


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.range(0, 7)
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (4, 5)], "src long, dst long")
    return nodes, edges


def test_components(small):
    nodes, edges = small
    assert ints(graph.weak_components(nodes, edges)) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 4), (6, 6)]
    assert ints(graph.strong_components(nodes, edges)) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 5), (6, 6)]


def test_hops_leave_out_the_source_itself(small):
    _, edges = small
    assert (0, 0, 3) not in ints(graph.hops(edges)) and (0, 3, 3) in ints(graph.hops(edges)) and (2, 1, 2) in ints(graph.hops(edges))


def test_pagerank_sums_to_one_with_dangling_nodes(small):
    nodes, edges = small
    rows = {r["id"]: r["pagerank"] for r in graph.pagerank(nodes, edges).collect()}
    assert math.isclose(sum(rows.values()), 1.0) and rows[3] > rows[6] and math.isclose(rows[4], rows[6])


def test_download_window_keeps_both_ends(spark):
    d = spark.createDataFrame([("2024-04-01", 1, 1), ("2024-01-02", 10, 1), ("2024-01-01", 100, 1)], "date string, downloads long, version_id long").withColumn("date", F.to_date("date"))
    v = spark.createDataFrame([(1, 9)], "id long, crate_id long")
    assert ints(graph.recent_downloads(d, v)) == [(9, 11)]


def test_name_lookup_errors(spark):
    n = spark.createDataFrame([(1, "Ab"), (2, "aB"), (3, "c")], "id long, name string")
    assert graph.find_by_name(n, " Ab ").first()["id"] == 1 and graph.find_by_name(n, "C").first()["id"] == 3
    for bad in ("", "ab", "x"):
        with pytest.raises(ValueError):
            graph.find_by_name(n, bad)


def test_severity_falls_back_to_label(spark):
    rows = [("0.0", "high"), (None, "LOW"), ("x", "critical"), ("7.5", "LOW"), ("0", "odd")]
    df = spark.createDataFrame(rows, "c string, l string").select(severity(F.col("c"), F.col("l")).alias("s"))
    assert [r["s"] for r in df.collect()] == [8.0, 2.0, 9.5, 7.5, None]


def test_repo_spellings(spark):
    df = spark.createDataFrame([("https://github.com/A/B.git",), ("nothing",), (None,)], "v string").select(normalize_repo(F.col("v")).alias("k"))
    assert [r["k"] for r in df.collect()] == ["github:a/b", None, None]


def test_repo_inside_other_text(spark):
    said = ['"https://github.com/A/B"', r"github.com\A\B", "see git+https://www.github.com/A/B.git#readme for more", "github:A/B?x", "'A/B/'", "github.com/A", "git@github.com:A/B.git", " "]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(said)], "k int, v string").select("k", normalize_repo(F.col("v")).alias("r"))
    got = [r["r"] for r in df.orderBy("k").collect()]
    assert got == ["github:a/b", "github:github.com/a", "github:a/b", "github:a/b", "github:a/b", "github:github.com/a", "github:a/b", None]


def test_parsed_answer_without_json(spark):
    df = spark.createDataFrame([('```json\n{"a": "x"}\n```',), ("no",)], "v string").select(parsed_answer(F.col("v"), "a string, b string", ["a", "b"]).alias("p"))
    assert [tuple(r["p"]) for r in df.collect()] == [("x", ""), ("PARSE_ERROR", "PARSE_ERROR")]


def test_p_values():
    assert stats.p_value(0.5, 2) is None and stats.p_value(1.0, 9) == 0.0
    assert math.isclose(stats.p_value(0.5, 20), 0.02477, rel_tol=1e-3)
    assert math.isclose(stats.p_value(0.1, 100), 0.3222, rel_tol=1e-3)


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.5, 1), (0.1, 0)], "s double, l int")
    assert stats.roc_auc(df, "s", "l").first()["auc"] == 0.875
    assert stats.roc_auc(df.filter("l = 1"), "s", "l").first()["auc"] == 0.0


def test_rolling_waits_for_a_full_window(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(4)], "repo_key string, period int, x int")
    got = [r["x_rolling_mean_3"] for r in timeseries.rolling(df, "x", (3,)).orderBy("period").collect()]
    assert got == [None, None, 1.0, 2.0]


def test_forward_fill_and_padding(spark):
    f = spark.createDataFrame([("a", 2, 5), ("b", 1, 7)], "repo_key string, period int, x int")
    p = spark.createDataFrame([(1,), (2,), (3,)], "period int")
    filled = timeseries.forward_fill(f, p, ["x"])
    assert ints(filled) == [("a", 1, 0), ("a", 2, 5), ("a", 3, 5), ("b", 1, 7), ("b", 2, 7), ("b", 3, 7)]
    seq = {r["repo_key"]: r["sequence"] for r in timeseries.sequences(filled, ["x"], 4).collect()}
    assert seq["a"] == [[0.0], [0.0], [5.0], [5.0]]


def test_lone_and_zero_vectors(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    assert vectors.replacement_metric(one).collect() == [] or vectors.replacement_metric(one).first()["replacement_metric"] is None
    two = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.1])], "id long, embedding array<double>")
    assert ints(vectors.substitutes(two)) == [(1, 0), (2, 1), (3, 1)]


def test_missing_metric_column(spark):
    a = spark.createDataFrame([("x", 1.0)], "crate_name string, importance double")
    with pytest.raises(ValueError):
        ranking.merge_metrics(a, a, a)


def test_runner_checks_inputs(spark, tmp_path):
    p = Pipeline([Stage("double", ["n"], lambda s, t: t["n"].select((F.col("id") * 2).alias("id")))], {"n": spark.range(3)})
    assert [r["id"] for r in p.execute(spark, str(tmp_path))["double"].orderBy("id").collect()] == [0, 2, 4]
    with pytest.raises(ValueError):
        Pipeline([Stage("x", ["gone"], lambda s, t: None)]).plan()


def test_five_stages(spark, tmp_path):
    names = [f"c{k}" for k in range(12)]
    tables = {
        "crates": spark.createDataFrame(list(enumerate(names)), "id long, name string"),
        "versions": spark.createDataFrame([(k, k, "2024-01-01") for k in range(12)], "id long, crate_id long, updated_at string").withColumn("updated_at", F.to_timestamp("updated_at")),
        "dependencies": spark.createDataFrame([(k, k // 2, k % 3 // 2) for k in range(1, 12)], "version_id long, crate_id long, kind int"),
        "downloads": spark.createDataFrame([("2024-01-01", 10 * k, k) for k in range(12)], "date string, downloads long, version_id long").withColumn("date", F.to_date("date")),
        "months": spark.createDataFrame([(f"github:o/{n}", f"{2022 + m // 12}-{m % 12 + 1:02d}", m * (k % 2), 1, 1) if k % 2 or m < 12 else (f"github:o/{n}", f"{2022 + m // 12}-{m % 12 + 1:02d}", 0, 0, 0) for k, n in enumerate(names) for m in range(24)], "repo_key string, period string, push_events long, prs_merged long, active_contributors_count long"),
        "repositories": spark.createDataFrame([(f"github:o/{n}", n, k) for k, n in enumerate(names)], "repo_key string, name string, place int"),
        "embeddings": spark.createDataFrame([(k, n, [1.0, k / 10, float(k % 3)]) for k, n in enumerate(names)], "id long, name string, embedding array<double>"),
        "advisories": spark.createDataFrame([(n.upper(), str(k % 9 + 1), None, None, f"g{k}") for k, n in enumerate(names)], "package string, cvss string, label string, published timestamp, ghsa_id string"),
    }
    run = stages.pipeline(tables)
    assert run.execute(spark, str(tmp_path), dry_run=True).keys() == tables.keys() and run.plan(["criticality"]) == ["criticality"]
    done = run.execute(spark, str(tmp_path))
    assert done["combine"].count() == 12 and done["validate"].first()["n"] == 12
    with pytest.raises(ValueError):
        stages.pipeline(tables | {"months": tables["months"].filter("period < '2023-06'")}).execute(spark, str(tmp_path / "b"), ["maintenance"])
    with pytest.raises(ValueError):
        stages.pipeline(tables | {"embeddings": tables["embeddings"].limit(0)}).execute(spark, str(tmp_path / "c"), ["replaceability"])


def test_pagerank_returns_the_first_iterate_under_the_tolerance(spark):
    nodes, edges = spark.range(0, 4), spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 0)], "src long, dst long")
    x, rounds = [0.25] * 4, 0
    while True:
        rounds += 1
        y = [0.85 * v + 0.0375 for v in (x[2] + x[3], x[0], x[1], 0.0)]
        x, step = y, sum(abs(a - b) for a, b in zip(x, y, strict=True))
        if step < 0.05:
            break
    got = {r["id"]: r["pagerank"] for r in graph.pagerank(nodes, edges, tol=0.05).collect()}
    assert all(math.isclose(got[k], v / sum(x), rel_tol=1e-12) for k, v in enumerate(x)) and rounds < 20


def test_pagerank_cache_is_used_only_if_it_covers_the_ids(spark, tmp_path):
    nodes, edges = spark.range(0, 4), spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    where = f"{tmp_path}/ranks"
    spark.createDataFrame([(0, 1.0)], "id long, pagerank double").write.parquet(where)
    made = graph.cached_pagerank(nodes, edges, where).collect()
    assert len(made) == 4 and math.isclose(sum(r["pagerank"] for r in made), 1.0)
    spark.createDataFrame([(k, 9.0) for k in range(4)], "id long, pagerank double").write.mode("overwrite").parquet(where)
    assert {r["pagerank"] for r in graph.cached_pagerank(nodes, edges, where).collect()} == {9.0}
    assert {r["pagerank"] for r in graph.cached_pagerank(nodes, edges, where, force=True).collect()} != {9.0}


def test_split_is_stratified(spark):
    df = spark.range(0, 300).select(F.col("id").cast("string").alias("repo_key"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    got = {(r["label"], r["part"]): r["count"] for r in timeseries.stratified_split(df, "repo_key", "label").groupBy("label", "part").count().collect()}
    assert got == {(0, "test"): 40, (0, "validation"): 32, (0, "train"): 128, (1, "test"): 20, (1, "validation"): 16, (1, "train"): 64}


def test_best_places_on_ties():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sims = rng.integers(0, 4, (7, 30)).astype(float)
        assert (vectors.best_of(sims, 5) == np.argsort(-sims, axis=1, kind="stable")[:, :5]).all()


def test_selective_scan_against_a_plain_loop():
    net = model.SelectiveScan.seeded(3, width=4, layers=1, states=2, seed=5)
    x = np.random.default_rng(6).normal(size=(1, 5, 3))
    w = net.w
    dense = lambda v, n: [sum(a * b for a, b in zip(v, row, strict=True)) + bias for row, bias in zip(w[f"{n}.weight"], w[f"{n}.bias"], strict=True)]
    sig = lambda v: 1 / (1 + math.exp(-v))
    h = [dense(v, "input_proj") for v in x[0]]
    two = [dense(v, "layers.0.in_proj") for v in h]
    path, gate = [v[:4] for v in two], [v[4:] for v in two]
    conv = []
    for t in range(5):
        row = [w["layers.0.conv1d.bias"][d] + sum(w["layers.0.conv1d.weight"][d, 0, k] * path[t + k - 1][d] for k in range(3) if 0 <= t + k - 1 < 5) for d in range(4)]
        conv.append([v * sig(v) for v in row])
    state, outs = np.zeros((4, 2)), []
    for t in range(5):
        step = [math.log1p(math.exp(v)) for v in dense(conv[t], "layers.0.dt_proj")]
        b, c = dense(conv[t], "layers.0.B_proj"), dense(conv[t], "layers.0.C_proj")
        for d in range(4):
            for s in range(2):
                state[d, s] = state[d, s] * math.exp(-step[d] * math.exp(w["layers.0.A"][d, s])) + step[d] * b[s] * conv[t][d]
        y = [(sum(state[d, s] * c[s] for s in range(2)) + w["layers.0.D"][d] * conv[t][d]) * gate[t][d] * sig(gate[t][d]) for d in range(4)]
        z = [a + r for a, r in zip(dense(y, "layers.0.out_proj"), h[t], strict=True)]
        mean = sum(z) / 4
        outs.append([(v - mean) / math.sqrt(sum((u - mean) ** 2 for u in z) / 4 + 1e-5) for v in z])
    pooled = [sum(o[d] for o in outs) / 5 for d in range(4)]
    assert math.isclose(net(x)[0], sig(dense([max(0.0, v) for v in dense(pooled, "fc1")], "fc2")[0]), rel_tol=1e-9)


def test_snippets_of_documents_in_any_language(spark, tmp_path):
    rows = [(1, "Out of the box.", "en"), (2, "Au nom of the loi.", "fr"), (3, "End OF THE line", None), (4, "nothing", "en"), (5, None, "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["doc_id"] for r in text_queries.deprecation_snippet(spark, str(tmp_path)).collect()) == [1, 2, 3]


def test_word_ends_beside_other_letters_as_in_sql(spark, tmp_path):
    texts = ["haus und dieöte", "für und dießen", "öund die", "und dies", "xund die", "Und Die", "_of the", "a of the9", "éof theé", "OF THE", "of thé", "", None]
    rows = [(i, s, f"l{i}") for i, s in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("deprecation_filter", "deprecation_snippet"):
        got = sorted(map(tuple, text_queries.QUERIES[name](spark, str(tmp_path)).collect()))
        assert got == sorted(duck.sql(text_queries.ORACLE[name]).fetchall())
        assert len(got) == {"deprecation_filter": 6, "deprecation_snippet": 2}[name]
    assert sql_words(r"\bof the\b|x\b") == r"(?<!\w)of the(?!\w)|x(?:(?=\w)(?<!\w)|(?!\w)(?<=\w))"
