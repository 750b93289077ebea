"""The corpus pipeline: language, near duplicates, repeated strings, benchmark leaks, packing.

Each stage is a function of (spark, docs, sf_dir) over all rows that the stage before it has kept; all but the last
return the columns of ``documents``. Rows with null doc_id pass every filter but packing takes them as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import common, decontaminate, jaccard, language, packing, suffix_dedup

#: Least score of a language that is believed; words and percent of near duplicates.
MIN_SCORE, SHINGLE_WORDS, SIMILAR_PERCENT = 0.2, 5, 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts of no believable language; fills missing languages with the prediction."""
    model = language.fit(docs.select("doc_id", "text", "lang").filter(~language.held_out()))
    return language.kept(docs, model, MIN_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each component of near duplicates, and one of rows with equal doc_id and text; documents without words stay."""
    found = jaccard.row_components(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    gone = found.filter(F.col("component_id") != F.col("doc_id")).select("doc_id", F.col("tag").alias("_tag")).distinct()
    kept = docs.withColumn("_tag", F.xxhash64("text")).join(gone, ["doc_id", "_tag"], "left_anti").select(docs.columns)
    again = docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").limit(1).count()
    return kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(kept.filter("doc_id IS NULL")) if again else kept


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings that an earlier document has; documents of which nothing but white space is left go."""
    cut = suffix_dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    return cut.filter(F.col("text").isNull() | F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    leaks = decontaminate.contaminated(docs, common.table(spark, sf_dir, "benchmark", "item_id", "text"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents into token sequences."""
    return packing.best_fit(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("benchmark_leaks", benchmark_leaks),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and the one before it is deleted then."""
    docs = common.table(spark, sf_dir, "documents")
    tables = common.Tables()
    for name, function in STAGES[:-1]:
        docs = tables.only(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
