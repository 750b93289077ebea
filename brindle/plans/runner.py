"""A small stage runner: named steps from tables to a table, each written before the next one reads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Stage:
    """A step: the tables it needs, and a function of (spark, tables) to its result."""

    name: str
    needs: list[str]
    run: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    check: Callable[[dict[str, DataFrame]], None] | None = None


@dataclass
class Pipeline:
    """Stages in order; a table that a stage needs comes from a stage before it or from the inputs."""

    stages: list[Stage]
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def plan(self, only: list[str] | None = None) -> list[str]:
        """Names of the stages to run; a missing table is a ValueError."""
        chosen = [s for s in self.stages if only is None or s.name in only]
        known = set(self.tables)
        for s in chosen:
            if missing := [t for t in s.needs if t not in known]:
                raise ValueError(f"{s.name}: missing tables {missing}")
            known.add(s.name)
        return [s.name for s in chosen]

    def execute(self, spark: SparkSession, out: str, only: list[str] | None = None, dry_run: bool = False) -> dict[str, DataFrame]:
        """Run the stages; results are Parquet under ``out`` and tables by the stage's name. Inputs are checked just before their stage; a dry run only plans."""
        names = self.plan(only)
        for s in self.stages if not dry_run else []:
            if s.name in names:
                for needed in s.needs:
                    if not self.tables[needed].limit(1).count():
                        raise ValueError(f"{s.name}: table {needed!r} is empty")
                if s.check:
                    s.check(self.tables)
                s.run(spark, self.tables).write.mode("overwrite").parquet(f"{out}/{s.name}")
                self.tables[s.name] = spark.read.parquet(f"{out}/{s.name}")
        return self.tables
