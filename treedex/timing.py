"""Logging with times: a context that logs an operation's beginning, its end with the time taken, and its failure; and the numbers of its stages."""

from __future__ import annotations

import logging
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from treedex.plans.lineage import cut


class Timed:
    """with Timed("name", files=3): ... logs to `logger` at `level`; seconds are in .seconds afterwards. Errors are logged and go on."""

    def __init__(self, operation: str, logger: logging.Logger | None = None, level: int = logging.INFO, **details):
        self.operation, self.log, self.level, self.seconds = operation, logger or logging.getLogger("treedex"), level, 0.0
        self.details = "".join(f", {k}={v}" for k, v in details.items())

    def __enter__(self) -> Timed:
        self.began = time.monotonic()
        self.log.debug("begin %s%s", self.operation, self.details)
        return self

    def __exit__(self, kind, error, trace) -> bool:
        self.seconds = time.monotonic() - self.began
        if kind is None:
            self.log.log(self.level, "%s took %.2f ms%s", self.operation, 1000 * self.seconds, self.details)
        else:
            self.log.error("%s failed after %.2f ms%s: %s", self.operation, 1000 * self.seconds, self.details, error)
        return False


class Counts:
    """Numbers of stages (files read, unreadable, hits), taken by Spark while a stage's rows are written: no job of their own.

    Tasks count only when they succeed. A part that ran again for a lost executor before a shuffle has no bearing here: the numbers are of the stage's last step.
    """

    def __init__(self):
        self.stages: dict[str, dict[str, int]] = {}

    def cut(self, stage: str, df: DataFrame, **numbers: Column) -> DataFrame:
        """df as lineage.cut() keeps it, its number of `rows` taken, and aggregates by name; null (of no row) is 0. A stage that runs again counts anew."""
        if "rows" in numbers:
            raise ValueError("rows are counted anyway")
        seen = Observation()
        kept = cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in numbers.items())))
        self.stages[stage] = {k: v or 0 for k, v in seen.get.items()}
        return kept

    def rows(self, spark: SparkSession) -> DataFrame:
        """stage, number, n."""
        return spark.createDataFrame([(s, k, n) for s, taken in self.stages.items() for k, n in taken.items()], "stage string, number string, n bigint")

    def log(self, logger: logging.Logger | None = None, level: int = logging.INFO) -> None:
        for stage, taken in self.stages.items():
            (logger or logging.getLogger("treedex")).log(level, "%s: %s", stage, ", ".join(f"{k}={n}" for k, n in taken.items()))
