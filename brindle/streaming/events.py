"""The event extraction and the monthly counts as structured streams over arriving files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas
from ..operators.events import flatten


def read(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Nested events of new JSON files, at most ``files`` a batch."""
    text = spark.readStream.option("maxFilesPerTrigger", files).text(folder)
    return text.filter(F.trim("value") != "").select(F.from_json("value", schemas.EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e")).select("e.*")


def extract(spark: SparkSession, folder: str, out: str, checkpoint: str, repos: DataFrame | None = None) -> StreamingQuery:
    """Flatten what has arrived into Parquet by month, once, and stop; a later call goes on where this one ended."""
    flat = flatten(read(spark, folder), repos).withColumns({"year": F.year("created_at"), "month": F.month("created_at")})
    return flat.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("year", "month").trigger(availableNow=True).start()


def monthly_counts(events: DataFrame) -> DataFrame:
    """(repo_key, month, n) of a stream of flat events. Months differ in length, so they are keys, not windows; the state is a number a repo and month."""
    return events.groupBy("repo_key", F.to_date(F.date_trunc("month", "created_at")).alias("month")).agg(F.count("*").alias("n"))


def run_counts(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Count what has arrived, once, and stop; ``out`` is the whole table after each batch, and a later call goes on from the state."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    counted = monthly_counts(flatten(read(spark, folder)))
    return counted.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_release(releases: DataFrame) -> DataFrame:
    """(repo_key, last_release_at) after each batch that has releases (repo_key, released_at) of a repo: the newest one seen so far, carried as state."""

    def carry(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = pd.Timestamp(state.get[0], unit="us", tz="UTC") if state.exists else None
        for frame in frames:
            top = frame["released_at"].max()
            if not pd.isna(top):
                top = pd.Timestamp(top).tz_localize("UTC") if pd.Timestamp(top).tzinfo is None else pd.Timestamp(top).tz_convert("UTC")
                newest = top if newest is None else max(newest, top)
        if newest is not None:
            state.update((newest.value // 1000,))
            yield pd.DataFrame({"repo_key": [key[0]], "micros": [newest.value // 1000]})

    grouped = releases.filter("released_at IS NOT NULL").groupBy("repo_key")
    made = grouped.applyInPandasWithState(carry, "repo_key string, micros bigint", "micros bigint", "update", GroupStateTimeout.NoTimeout)
    return made.select("repo_key", F.timestamp_micros("micros").alias("last_release_at"))


def run_carry(carried: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's rows of :func:`last_release` to ``out``, once, and stop."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is run again replaces itself

    return carried.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
