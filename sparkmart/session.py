"""Spark session helpers: adaptive settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Run-time SQL settings the plans rely on. AQE sizes the shuffles, splits skewed join partitions and
# turns a join into a broadcast only after it has measured the side. Forcing the skew split matters for
# chains of joins on one key, where Spark would otherwise keep a hot partition to save a shuffle.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


# Shuffle partitions are planned for this much input each.
_PER_PARTITION = 256 << 20

# Size-dependent settings as they were before the first change, by session and name.
_BEFORE: dict[tuple[str, str], str | None] = {}


def size_conf(input_bytes: int) -> dict[str, str]:
    """Settings that depend on the size of the input.

    AQE merges shuffle partitions that turn out small but cannot add any, so it has to start with enough
    of them. Large inputs are also read and written in larger pieces.
    """
    partitions = -(-input_bytes // _PER_PARTITION)
    conf = {}
    if partitions > 200:
        conf["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(partitions)
    if input_bytes >= 1 << 40:
        conf["spark.sql.files.maxPartitionBytes"] = str(512 << 20)
        conf["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = str(256 << 20)
    return conf


_SIZED = tuple(size_conf(1 << 60))


def tune(spark: SparkSession, input_bytes: int = 0) -> SparkSession:
    """Set the adaptive options, and those for an input of this size, on a running session.

    Size-dependent settings that an input of this size does not need go back to what they were at first.
    """
    session = str(spark._jsparkSession.sessionUUID())
    sized = size_conf(input_bytes)
    for key in _SIZED:
        before = _BEFORE.setdefault((session, key), spark.conf.get(key, None))
        if key in sized:
            spark.conf.set(key, sized[key])
        elif spark.conf.get(key, None) != before:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    for key, value in ADAPTIVE_CONF.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def tuned(spark: SparkSession, input_bytes: int):
    """``tune`` for what runs inside; the size-dependent settings then are as before."""
    before = {key: spark.conf.get(key, None) for key in _SIZED}
    try:
        yield tune(spark, input_bytes)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def local_session(cpus: int = 8, app: str = "sparkmart", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return tune(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Without that setting a temporary folder is used, but only on a local master: on a cluster a
    machine-local folder would lose data with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkmart-"))
    return spark.sparkContext.getCheckpointDir()


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/sparkmart/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all intermediate data of this application. Frames that were built on it can no longer be read."""
    from sparkmart.files import Files

    root = _scratch_root(spark)
    Files(spark, root).remove(root)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, where it is not installed there."""
    root = Path(__file__).parent
    target = os.path.join(tempfile.mkdtemp(prefix="sparkmart-ship-"), "sparkmart.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)


def local_frame(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType) -> DataFrame:
    """A few rows of metadata as a local relation, whose exact size the planner knows."""
    columns = list(zip(*rows)) or [()] * len(schema)
    arrays = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema.names), schema)


def settle(df: DataFrame, name: str, under: str | None = None) -> DataFrame:
    """Write a result that several later steps read to the shared folder, and read it back.

    The steps then neither recompute it nor lose it with an executor, and the planner knows its size.
    ``under`` names a folder the caller removes afterwards.
    """
    path = f"{under}/{name}-{uuid.uuid4().hex[:12]}" if under else scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
