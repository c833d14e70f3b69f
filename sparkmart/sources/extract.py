"""Extraction of a source table in parts of equal depth, which goes on where it stopped.

The bounds of the parts are quantiles of the key, so a skewed key gives parts of like size where equal ranges would
be empty or hot. A key's rows stay together, so a single key that holds more rows than a part is a part of its own.
Parts are read in waves, each one Spark job that writes a folder of its own; a folder with Spark's success mark is
finished and is not read again when an extraction is repeated after a failure. Nothing counts as extracted
before its last wave is.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmart.files import Files

# The mark that Spark leaves in a folder when all of a job's tasks are committed.
_DONE = "_SUCCESS"


def equi_depth_bounds(keys: DataFrame, column: str, parts: int, accuracy: int = 100_000) -> list:
    """At most ``parts - 1`` rising bounds that cut the keys into parts of about the same number of rows.

    Takes all keys or an even sample of them. The quantiles are merged from small sketches of the tasks; a part is off by
    ``1 / accuracy`` of the rows at most. Null keys have no place and belong to the first part.
    """
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = keys.agg(F.percentile_approx(F.col(f"`{column}`"), shares, accuracy)).first()[0] or []
    # A bound at the smallest key would leave the first part empty but for null keys.
    least = keys.agg(F.min(F.col(f"`{column}`"))).first()[0]
    return [b for b in sorted(set(found)) if b > least]


def literal(value) -> str:
    """A bound in SQL that Spark and databases read alike."""
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value.isoformat(' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal)):
        raise ValueError(f"no ranges over keys like {value!r}")
    return str(value)


def range_conditions(quoted: str, bounds: Sequence) -> list[str]:
    """One condition per part; together they cover every row once, rows without a key in the first."""
    if not bounds:
        return ["1 = 1"]
    texts = [literal(b) for b in bounds]
    first = f"{quoted} IS NULL OR {quoted} < {texts[0]}"
    between = [f"{quoted} >= {low} AND {quoted} < {high}" for low, high in zip(texts, texts[1:])]
    return [first, *between, f"{quoted} >= {texts[-1]}"]


def frame_part(frame: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """The rows of some parts; the conditions reach the scan as filters."""
    return frame.where(" OR ".join(f"({c})" for c in conditions))


class Extraction:
    """A restartable copy of a table under ``path``.

    ``read_parts`` gives the rows of some conditions, such as ``JdbcSource.read_conditions`` of a table, which
    reads each over a connection of its own, or ``frame_part`` of a frame. The conditions are kept with
    the copy, so a repeated extraction cuts the table as the first one did, whatever its keys are by then. A wave
    is ``wave`` parts: what a failure costs, and what Spark has to run at a time.
    """

    def __init__(self, spark: SparkSession, path: str, read_parts, conditions, wave: int = 64):
        self.spark, self.path, self.wave = spark, path.rstrip("/"), wave
        self._read, self._conditions = read_parts, conditions
        self._files = Files(spark, self.path)

    def _finished(self, folder: str) -> bool:
        return _DONE in self._files.names(f"{self.path}/{folder}")

    def plan(self) -> list[str]:
        """The conditions, made once and kept."""
        folder = f"{self.path}/_plan"
        if not self._finished("_plan"):
            made = self._conditions() if callable(self._conditions) else list(self._conditions)
            frame = self.spark.createDataFrame(list(enumerate(made)), "part int, condition string")
            frame.coalesce(1).write.mode("overwrite").parquet(folder)
        return [r["condition"] for r in self.spark.read.parquet(folder).orderBy("part").collect()]

    def waves(self) -> list[tuple[str, list[str]]]:
        """The folder and the conditions of every wave that is not finished yet."""
        plan = self.plan()
        all_waves = [(f"wave={n}", plan[k : k + self.wave]) for n, k in enumerate(range(0, len(plan), self.wave))]
        return [(folder, conditions) for folder, conditions in all_waves if not self._finished(folder)]

    def run(self) -> DataFrame:
        """Read what is missing and return the whole copy."""
        for folder, conditions in self.waves():
            # What an interrupted job left behind is replaced.
            self._read(conditions).write.mode("overwrite").parquet(f"{self.path}/{folder}")
        return self.read()

    def read(self) -> DataFrame:
        if self.waves():
            raise ValueError(f"the extraction to {self.path} is not finished")
        return self.spark.read.option("basePath", self.path).parquet(f"{self.path}/wave=*").drop("wave")
