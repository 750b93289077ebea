"""Readers of all inputs; schemas are declared, bad rows are tolerated where the format says so."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import normalize_repo, present
from ..operators.events import last_releases


def csv(spark: SparkSession, path: str, schema: str, *columns: str) -> DataFrame:
    """A CSV with header, quoted line ends and doubled quotes; ``columns`` by name, all required."""
    declared = spark.createDataFrame([], schema).schema
    head = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    if missing := [c for c in columns if c not in head]:
        raise ValueError(f"{path}: missing columns {missing}")
    known = {f.name: f.dataType.simpleString() for f in declared}
    full = ", ".join(f"`{c}` {known.get(c, 'string')}" for c in head)
    df = spark.read.schema(full).option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).option("nullValue", "").csv(path)
    return df.select(*columns) if columns else df


def crates(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, schemas.CRATES, "id", "name")


def crates_with_repository(spark: SparkSession, path: str) -> DataFrame:
    df = csv(spark, path, schemas.CRATES, "id", "name", "repository")
    return df.filter(F.contains(F.lower(F.coalesce("repository", F.lit(""))), F.lit("github.com")))


def versions(spark: SparkSession, path: str) -> DataFrame:
    df = csv(spark, path, schemas.VERSIONS, "id", "crate_id", "updated_at", "created_at")
    return df.withColumns({c: F.try_to_timestamp(c) for c in ("updated_at", "created_at")})


def dependencies(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, schemas.DEPENDENCIES, "version_id", "crate_id", "kind")


def version_downloads(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, schemas.VERSION_DOWNLOADS, "date", "downloads", "version_id")


def daily_downloads(spark: SparkSession, folder: str) -> DataFrame:
    """Files named by day, each without a date column, united with the day as date."""
    df = spark.read.schema("version_id bigint, downloads bigint").option("header", True).csv(f"{folder}/*.csv")
    return df.select(F.to_date(F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})\.csv", 1)).alias("date"), "downloads", "version_id")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(crate_name, activity_probability) with numbers only, the first row of a name."""
    df = csv(spark, path, "crate_name string, activity_probability string", "crate_name", "activity_probability").withColumn("_row", F.monotonically_increasing_id())
    good = df.withColumn("activity_probability", F.col("activity_probability").try_cast("double")).dropna()
    return good.groupBy("crate_name").agg(F.min_by("activity_probability", "_row").alias("activity_probability"))


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """(package, cvss, label, published, ghsa_id) from JSON lines; blank or broken lines are skipped, key aliases are tried in turn."""
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", schemas.ADVISORY).alias("j")).filter("j IS NOT NULL")
    package = F.coalesce(*[present(F.col(f"j.{c}")) for c in ("package", "package_name", "crate_name")])
    published = F.coalesce(*[present(F.col(f"j.{c}")) for c in ("publishedAt", "published_at", "published")])
    return rows.filter(package.isNotNull()).select(F.lower(F.trim(package)).alias("package"), F.col("j.cvss_score").alias("cvss"), F.col("j.severity").alias("label"), F.try_to_timestamp(published).alias("published"), F.col("j.ghsaId").alias("ghsa_id"))


def monthly(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """(repo_key, period, features...) from month files that map ``github:`` keys to features; other keys go; keys in lower case."""
    text = spark.read.option("wholetext", True).text(path).withColumn("period", F.regexp_extract(F.input_file_name(), r"delta_(\d{4}_\d{2})", 1))
    each = text.select("period", F.explode(F.from_json("value", _month_type())).alias("repo_key", "f")).filter(F.col("repo_key").startswith("github:"))
    df = each.select(F.lower("repo_key").alias("repo_key"), "period", "f.*")
    if last is None:
        return df
    recent = df.select("period").distinct().orderBy(F.desc("period")).limit(last)
    return df.join(F.broadcast(recent), "period", "left_semi")


def _month_type() -> str:
    fields = ", ".join(f.strip().replace(" ", ": ", 1) for f in schemas.MONTH_FEATURES.split(", "))
    return f"map<string, struct<{fields}>>"


def raw_events(spark: SparkSession, path: str) -> DataFrame:
    """Nested events from (gzipped) JSON lines; blank lines go, broken ones keep their text in _corrupt."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    made = rows.select(F.from_json("value", schemas.EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    return made.select("e.*")


def month_glob(root: str, year: int, month: int) -> str:
    """Path pattern of a month's hourly event files."""
    return f"{root}/{year:04d}/{year:04d}-{month:02d}-*.json.gz"


def available_months(flat: DataFrame) -> DataFrame:
    """(year, month) from the first to the last month of a partitioned table, gaps filled."""
    ends = flat.select(F.make_date("year", "month", F.lit(1)).alias("m")).agg(F.min("m").alias("a"), F.max("m").alias("b"))
    return ends.filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("m")).select(F.year("m").alias("year"), F.month("m").alias("month"))


#: Columns of a repository list that may hold a repository, in order.
REPO_COLUMNS = ["repo_key", "repository", "repo", "url", "github_url", "full_name"]


def repo_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (repo_key) from a JSON array, an object with repositories or with keys, a CSV, or text lines; an empty list is an error."""
    if path.endswith(".json"):
        text = spark.read.option("wholetext", True).text(path)
        listed = F.from_json(F.coalesce(F.get_json_object("value", "$.repositories"), "value"), "array<string>")
        names = F.coalesce(listed, F.json_object_keys("value"))
        values = text.select(F.explode(names).alias("v"))
    elif path.endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
        found = [c for c in REPO_COLUMNS if c in df.columns]
        if not found:
            raise ValueError(f"{path}: none of the columns {REPO_COLUMNS}")
        values = df.select(F.coalesce(*[normalize_repo(F.col(c)) for c in found]).alias("v"))
    else:
        values = spark.read.text(path).select(F.col("value").alias("v"))
    keys = values.select(normalize_repo(F.col("v")).alias("repo_key")).filter("repo_key IS NOT NULL").distinct()
    if not keys.limit(1).count():
        raise ValueError(f"{path}: no repositories")
    return keys


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(name, embedding) from JSON lines; the last of equal names wins."""
    df = spark.read.schema(schemas.EMBEDDING).json(path).filter("package_name IS NOT NULL").withColumn("_row", F.monotonically_increasing_id())
    return df.groupBy(F.col("package_name").alias("name")).agg(F.max_by("embedding", "_row").alias("embedding"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, replacement string").option("multiLine", True).json(path)


def pairs(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Deprecated pairs whose names differ and are both in ``known`` (name), without regard to case."""
    df = csv(spark, path, schemas.PAIRS).withColumns({c: F.trim(c) for c in ("name", "replacement")})
    names = known.select(F.lower("name").alias("_k")).distinct()
    good = df.filter((F.col("name") != "") & (F.col("replacement") != "") & (F.lower("name") != F.lower("replacement")))
    return good.join(names, F.lower("name") == F.col("_k"), "left_semi").join(names, F.lower("replacement") == F.col("_k"), "left_semi")


def keyword_lists(spark: SparkSession, keywords: str, links: str) -> DataFrame:
    """(crate_id, keywords) joined by a comma in order of the link file."""
    words = csv(spark, keywords, schemas.KEYWORDS, "id", "keyword").withColumnRenamed("id", "keyword_id")
    linked = csv(spark, links, schemas.CRATE_KEYWORDS, "crate_id", "keyword_id").withColumn("_row", F.monotonically_increasing_id()).join(words, "keyword_id")
    return linked.groupBy("crate_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_row", "keyword"))), lambda e: e["keyword"]), ", ").alias("keywords"))


def scores(spark: SparkSession, path: str) -> DataFrame:
    """(crate_name, score) of a (gzipped) score resource."""
    return csv(spark, path, schemas.SCORES, "crate_name", "score")


def metric_files(spark: SparkSession, importance: str, replacement: str, activity: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three metric CSVs with their required columns, numbers as doubles."""
    wanted = {"importance": importance, "replacement_metric": replacement, "activity_probability": activity}
    return tuple(csv(spark, path, f"crate_name string, {c} string", "crate_name", c).withColumn(c, F.col(c).try_cast("double")) for c, path in wanted.items())


def functions(spark: SparkSession, path: str, crates: DataFrame) -> DataFrame:
    """Functional descriptions with the name of their crate (id, name); the first row of a name, without regard to case, stays."""
    rows = csv(spark, path, schemas.FUNCTIONS).withColumn("_row", F.monotonically_increasing_id())
    named = rows.join(crates.select(F.col("id").alias("crate_id"), F.trim("name").alias("name")), "crate_id").filter("name <> ''")
    fields = [f.split()[0] for f in schemas.FUNCTIONS.split(", ")]
    first = named.groupBy(F.lower("name").alias("_k")).agg(F.min_by(F.struct("name", *fields), "_row").alias("r"))
    return first.select("r.*")


def accepted_replacements(answers: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``answers`` (..., replacement) whose trimmed replacement is neither empty nor "none" and is a name of ``known`` (name), without regard to case."""
    said = F.trim("replacement")
    good = answers.withColumn("replacement", said).filter(~F.lower("replacement").isin("none", ""))
    return good.join(known.select(F.lower("name").alias("_k")).distinct(), F.lower("replacement") == F.col("_k"), "left_semi")


def published_releases(spark: SparkSession, path: str, before: Column) -> DataFrame:
    """(repo_key, last_release_at) from flat events by month, of partitions ``before`` (a filter on year and month, which prunes folders; the event filter reaches the scan)."""
    return last_releases(spark.read.parquet(path), before)


def month_documents(spark: SparkSession, path: str) -> DataFrame:
    """(repo_key, period, the month's keys) from the JSON lines of :func:`writers.month_documents`."""
    rows = spark.read.schema("repo_key string, document string, month string").json(path)
    made = rows.select("repo_key", F.to_date("month", "yyyy_MM").alias("period"), F.from_json("document", schemas.MONTH_DOCUMENT).alias("d"))
    return made.select("repo_key", "period", "d.*")


def cached_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(name, crate_id, embedding) of :func:`writers.embedding_cache`."""
    return spark.read.schema("name string, crate_id string, embedding array<float>").parquet(path)


#: A file of an hour of events, and a month.
HOUR_FILE = r"(\d{4})-(\d{2})-(\d{2})-(\d{1,2})\.json\.gz$"


def month_files(files: DataFrame, year: int, month: int) -> DataFrame:
    """``files`` (source_path) that are hourly event files of a month, with their day and hour, in order."""
    part = lambda k: F.regexp_extract("source_path", HOUR_FILE, k).try_cast("int")
    dated = files.withColumns({"_y": part(1), "_m": part(2), "day": part(3), "hour": part(4)})
    valid = (F.col("_y") == year) & (F.col("_m") == month) & F.col("day").between(1, 31) & F.col("hour").between(0, 23)
    return dated.filter(valid).drop("_y", "_m").orderBy("day", "hour")


def sample(df: DataFrame, n: int = 10) -> DataFrame:
    """The first n rows, as a fixture."""
    return df.limit(n)


def project_list(crates: DataFrame) -> DataFrame:
    """Distinct repositories (repo_key) of crates (repository), sorted without regard to case: the list that events are collected for."""
    keys = crates.select(normalize_repo(F.col("repository")).alias("repo_key")).filter("repo_key IS NOT NULL").distinct()
    return keys.orderBy(F.lower("repo_key"))


def npz_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(name, crate_id, embedding) from a compressed array file with names, crate_ids and embeddings; read once, then keep Parquet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                    vectors, names, ids = z["embeddings"].astype(np.float32), z["names"].astype(str), z["crate_ids"].astype(str)
                    for a in range(0, len(names), 1000):
                        part = vectors[a : a + 1000]
                        ends = pa.array(np.arange(0, part.size + 1, max(part.shape[1], 1), dtype=np.int32)[: len(part) + 1])
                        yield pa.RecordBatch.from_arrays([pa.array(names[a : a + 1000].tolist()), pa.array(ids[a : a + 1000].tolist()), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))], ["name", "crate_id", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "name string, crate_id string, embedding array<float>")
