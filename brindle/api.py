"""Read-only lookups of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Scores:
    """Scores (crate_name, score) in the order of their table; ``cached`` keeps them in executors until :meth:`close`."""

    def __init__(self, scores: DataFrame, cached: bool = False):
        self.df = scores.select("crate_name", "score")
        self.cached = cached
        if cached:
            self.df = self.df.cache()

    def all(self, limit: int | None = None) -> DataFrame:
        """All scores, or the first ``limit`` of the table; a negative limit is a ValueError."""
        if limit is not None and limit < 0:
            raise ValueError("limit is negative")
        if limit is None:
            return self.df
        return self.df.withColumn("_place", F.monotonically_increasing_id()).orderBy("_place").limit(limit).drop("_place")

    def lookup(self, name: str) -> DataFrame:
        """The score of a name, without regard to case, the first of several; an empty name is a ValueError, an unknown one gives no rows."""
        name = (name or "").strip()
        if not name:
            raise ValueError("a name is needed")
        found = self.df.withColumn("_place", F.monotonically_increasing_id()).filter(F.lower("crate_name") == name.lower())
        return found.orderBy("_place").limit(1).drop("_place")

    def csv(self, limit: int | None = None) -> str:
        """The scores as CSV text with a header, for callers that want the resource itself (a bounded export: see ``writers.scores``)."""
        rows = self.all(limit).select("crate_name", F.col("score").cast("string").alias("score")).toArrow().to_pylist()
        quoted = ['"' + r["crate_name"].replace('"', '""') + '"' if any(c in r["crate_name"] for c in ',"\n\r') else r["crate_name"] for r in rows]
        return "crate_name,score\n" + "".join(f"{n},{r['score']}\n" for n, r in zip(quoted, rows, strict=True))

    def close(self) -> None:
        if self.cached:
            self.df.unpersist()
