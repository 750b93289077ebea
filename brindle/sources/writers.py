"""Writers, and the manifest of processed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import degrees


def single_csv(df: DataFrame, path: str, *order: str | Column) -> None:
    """A small result as one CSV with header, sorted (pass ``F.desc(column)`` for the usual descending order)."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def events(flat: DataFrame, path: str, mode: str = "append") -> None:
    """Flat events as zstd Parquet by year and month; months without rows get no file."""
    dated = flat.withColumns({"year": F.year("created_at"), "month": F.month("created_at")})
    dated.repartition("year", "month", F.pmod(F.xxhash64("repo_key"), F.lit(16))).write.mode(mode).option("compression", "zstd").partitionBy("year", "month").parquet(path)


def documents(df: DataFrame, key: str, path: str) -> None:
    """Rows as JSON lines with their key, for readers that want documents."""
    df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("document")).write.mode("overwrite").json(path)


#: Columns that a score is taken from, in order.
SCORE_COLUMNS = ["score", "importance_with_download_portion"]


def scores(df: DataFrame, path: str, most: int = 10_000, column: str | None = None) -> None:
    """The first ``most`` - 1 rows, in the table's order, with a name and a number as gzipped CSV; the score is the first of :data:`SCORE_COLUMNS` that is there."""
    column = column or next((c for c in SCORE_COLUMNS if c in df.columns), None)
    if column is None:
        raise ValueError(f"none of the columns {SCORE_COLUMNS}")
    value = F.col(column).try_cast("double") if dict(df.dtypes)[column] == "string" else F.col(column).cast("double")
    good = df.select("crate_name", value.alias("score")).filter("crate_name <> '' AND score IS NOT NULL").withColumn("_place", F.monotonically_increasing_id())
    good.orderBy("_place").limit(most - 1).drop("_place").coalesce(1).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def node_table(nodes: DataFrame, edges: DataFrame, weak: DataFrame, strong: DataFrame, path: str) -> None:
    """(crate_id, name, in_degree, out_degree, wcc_label, scc_label) of every node (id, name) as CSV with header."""
    made = nodes.select("id", "name").join(degrees(nodes, edges), "id")
    made = made.join(weak.select("id", F.col("component").alias("wcc_label")), "id").join(strong.select("id", F.col("component").alias("scc_label")), "id")
    made.select(F.col("id").alias("crate_id"), "name", "in_degree", "out_degree", "wcc_label", "scc_label").write.mode("overwrite").option("header", True).csv(path)


def summary_json(summary: DataFrame, parameters: dict[str, object], path: str) -> None:
    """A one-row summary with the parameters that it was made with, as one JSON document."""
    said = F.struct(*[F.lit(v).alias(k) for k, v in parameters.items()]).alias("importance_params")
    summary.select("*", said).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def evaluation_text(scores: DataFrame, model: str, index_size: int, path: str) -> None:
    """The lines of a retrieval evaluation: model, sizes, hits at each k with their counts, and the mean reciprocal rank."""
    hits = [c for c in scores.columns if c.startswith("hit_")]
    lines = [F.lit(f"Model       : {model}"), F.lit(f"Index size  : {index_size}"), F.concat(F.lit("Pairs eval  : "), F.col("n"))]
    for c in hits:
        lines.append(F.concat(F.lit(f"Hit@{c[4:]:<3}    : "), F.format_number(F.col(c), 4), F.lit("  ("), F.round(F.col(c) * F.col("n")).cast("bigint"), F.lit("/"), F.col("n"), F.lit(")")))
    lines.append(F.concat(F.lit("MRR         : "), F.format_number("mrr", 4)))
    scores.select(F.concat_ws("\n", *lines).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def embedding_cache(vectors: DataFrame, path: str) -> None:
    """(name, crate_id, embedding) as Parquet, the cache that :func:`readers.cached_embeddings` reads."""
    vectors.select("name", F.col("crate_id").cast("string").alias("crate_id"), F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").option("compression", "zstd").parquet(path)


def month_documents(documents: DataFrame, path: str) -> None:
    """Month documents as JSON lines of (repo_key, document), a folder for each period, absent values kept as null."""
    body = F.to_json(F.struct(*[c for c in documents.columns if c not in ("repo_key", "period")]), {"ignoreNullFields": "false"})
    documents.select(F.date_format("period", "yyyy_MM").alias("month"), "repo_key", body.alias("document")).write.mode("overwrite").partitionBy("month").json(path)


def tables(frames: dict[str, DataFrame], database: str) -> None:
    """Save frames as tables of a database, to be inspected by SQL."""
    for name, df in frames.items():
        df.write.mode("overwrite").saveAsTable(f"{database}.{name}")


def upsert(manifest: DataFrame | None, done: DataFrame) -> DataFrame:
    """The manifest with new rows in place of older ones of the same source_path (by updated_at)."""
    rows = done if manifest is None else manifest.unionByName(done)
    newest = F.max_by(F.struct(*[c for c in rows.columns if c != "source_path"]), "updated_at").alias("r")
    return rows.groupBy("source_path").agg(newest).select("source_path", "r.*")


def pending(files: DataFrame, manifest: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """Files (source_path, size, mtime) that the manifest doesn't have as done with the same size and time.

    With ``written`` (output_path), a done file whose manifest row names an output counts only if that is there.
    """
    done = manifest.filter("status = 'done'")
    if written is not None:
        gone = done.filter("output_path IS NOT NULL").join(written.select("output_path").distinct(), "output_path", "left_anti").select("source_path")
        done = done.join(gone, "source_path", "left_anti")
    return files.join(done, ["source_path", "size", "mtime"], "left_anti")


def remaining(records: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Records whose keys are not among those done, for resumed runs that append."""
    return records.join(done.select(*keys), list(keys), "left_anti")


def missing_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """One row (rows, missing): a validation of a table against the wanted columns."""
    absent = [c for c in wanted if c not in df.columns]
    return df.agg(F.count("*").alias("rows")).withColumn("missing", F.array(*[F.lit(c) for c in absent]).cast("array<string>"))
