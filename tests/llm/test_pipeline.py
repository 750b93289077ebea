"""The pipeline's stages: what goes, what stays, and whole results."""

import corpus_pipeline
from brindle.llm import common, decontaminate, jaccard

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_strings", "benchmark_leaks", "best_fit_packing"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, columns = docs, docs.columns
        docs = common.materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "near_duplicates":
            found = jaccard.jaccard_components(before, 5, 80)
            assert sizes[-1] == found.select("component_id").distinct().count()
        if name == "benchmark_leaks":
            assert decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    assert sorted(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()))


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, no_docs.select(plain.columns), SF).count() == 0
        assert stage(spark, plain, SF).columns == plain.columns and stage(spark, plain, SF).count() > 0


def test_near_duplicates_go_by_row(spark):
    copy, own, other = (" ".join(f"{c}{k}" for k in range(40)) for c in "abc")
    rows = [(1, copy), (5, copy + " end"), (5, own), (None, other), (None, other)]
    for more in ([], [(7, "one two"), (7, "one two")]):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string")
        kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
        assert sorted(map(tuple, kept), key=str) == sorted([(1, copy), (5, own), (None, other), (None, other), *more[:1]], key=str)
