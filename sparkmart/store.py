"""Versioned parquet tables.

A table is a folder of parquet data plus one small JSON file per version that names the folders the
version consists of. Writers add a new data folder and then a version file, so readers see a version
whole or not at all, and a lost executor or a failed job leaves the current version untouched.

Rows are laid out by a hash bucket of the mart's key. A change batch rewrites only the buckets it
touches; the version file points at the old folders of the others. Column renames and drops only edit
the version file.
"""

from __future__ import annotations

import json
import logging
import time
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmart.errors import NotFound, SpecError
from sparkmart.files import Files
from sparkmart.session import local_frame

log = logging.getLogger(__name__)

BUCKET = "_bucket"

_COLUMN_LIST = T.StructType().add("mart", T.StringType()).add("column", T.StringType()).add("ordinal", T.IntegerType())


@dataclass(frozen=True)
class Version:
    """What one version of a table consists of."""

    number: int
    schema: str  # Spark schema of the stored columns, as JSON
    columns: tuple[tuple[str, str], ...]  # (name, stored name) in order
    bucket_by: tuple[str, ...] = ()
    buckets: int = 1
    folders: dict[str, list[str]] = field(default_factory=dict)  # bucket → its folders under data/
    batches: dict[str, int] = field(default_factory=dict)  # stream → last batch applied
    created: float = 0.0

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.columns]

    def crowded(self, folders: int) -> set[int]:
        """Buckets that consist of at least so many folders."""
        return {int(b) for b, fs in self.folders.items() if len(fs) >= folders}

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def from_json(text: str) -> Version:
        raw = json.loads(text)
        raw["columns"] = tuple(tuple(c) for c in raw["columns"])
        raw["bucket_by"] = tuple(raw["bucket_by"])
        return Version(**raw)


def suggest_buckets(total_bytes: int, per_bucket: int = 4 << 30) -> int:
    """Bucket count for a mart of this size: a few gigabytes to rewrite per touched bucket."""
    return max(1, -(-total_bytes // per_bucket))


def bucket_of(df: DataFrame, by: tuple[str, ...], buckets: int) -> Column:
    """The bucket of a new row: by its layout key, or by its content where it has no full key."""
    if buckets == 1:
        return F.lit(0)
    plain = [
        f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType)) and f.name != BUCKET
    ]
    spread = F.pmod(F.xxhash64(*plain), F.lit(buckets)).cast("int")
    if not by:
        return spread
    keyed = F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")
    return F.when(reduce(Column.__and__, [F.col(f"`{c}`").isNotNull() for c in by]), keyed).otherwise(spread)


class TableStore:
    """Named versioned tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._files = Files(spark, self.root)

    # -- versions -------------------------------------------------------------------------------

    def _folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _numbers(self, name: str) -> list[int]:
        files = self._files.names(f"{self._folder(name)}/versions")
        return sorted(int(f[:-5]) for f in files if f.endswith(".json") and not f.startswith("."))

    def exists(self, name: str) -> bool:
        return bool(self._numbers(name))

    def version(self, name: str, number: int | None = None) -> Version:
        """The current version, or an older one by number."""
        numbers = self._numbers(name)
        if not numbers:
            raise NotFound(f"no table {name}")
        chosen = numbers[-1] if number is None else number
        if chosen not in numbers:
            raise NotFound(f"table {name} has no version {number}")
        return Version.from_json(self._files.read(f"{self._folder(name)}/versions/{chosen:010d}.json"))

    def _commit(self, name: str, version: Version) -> Version:
        version = replace(version, created=time.time())
        path = f"{self._folder(name)}/versions/{version.number:010d}.json"
        if not self._files.write_new(path, version.to_json()):
            raise RuntimeError(f"another writer published version {version.number} of {name}")
        return version

    # -- reading --------------------------------------------------------------------------------

    def read(self, name: str, number: int | None = None) -> DataFrame:
        return self.read_version(name, self.version(name, number)).drop(BUCKET)

    def read_version(self, name: str, version: Version, only: set[int] | None = None) -> DataFrame:
        """The rows of a version with their bucket, optionally of some buckets only."""
        folders = [f for b, fs in version.folders.items() if only is None or int(b) in only for f in fs]
        stored = T.StructType.fromJson(json.loads(version.schema))
        stored = stored.add(BUCKET, T.IntegerType()).add("part", T.LongType())
        if folders:
            data = f"{self._folder(name)}/data"
            reader = self.spark.read.schema(stored).option("basePath", data)
            df = reader.parquet(*[f"{data}/{f}" for f in folders])
        else:
            df = local_frame(self.spark, [], stored)
        return df.select(*(F.col(f"`{s}`").alias(n) for n, s in version.columns), BUCKET)

    def columns(self, name: str) -> DataFrame:
        """The table's columns in order as ``(mart, column, ordinal)``."""
        rows = [(name, c, i) for i, c in enumerate(self.version(name).names, 1)]
        return local_frame(self.spark, rows, _COLUMN_LIST)

    # -- writing --------------------------------------------------------------------------------

    def _write(self, name: str, df: DataFrame, columns, buckets: int) -> dict[str, list[str]]:
        """Write rows with their bucket column as a data folder; returns the folder of every bucket."""
        # A part number belongs to one attempt, so a retry never meets leftovers of a failed one.
        folder = f"part={time.time_ns()}"
        path = f"{self._folder(name)}/data/{folder}"
        stored = df.select(*(F.col(f"`{n}`").alias(s) for n, s in columns), BUCKET)
        if buckets == 1:
            stored.drop(BUCKET).write.parquet(f"{path}/{BUCKET}=0")
            return {"0": [f"{folder}/{BUCKET}=0"]}
        # Rebalancing gathers a bucket's rows into few files, and AQE splits a large bucket again.
        stored.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(path)
        prefix = f"{BUCKET}="
        return {f[len(prefix) :]: [f"{folder}/{f}"] for f in self._files.names(path) if f.startswith(prefix)}

    def create(self, name: str, schema: T.StructType) -> Version:
        """Make an empty table unless it exists; needs no Spark job."""
        if self.exists(name):
            return self.version(name)
        return self._commit(name, Version(1, schema.json(), tuple((n, n) for n in schema.names)))

    def is_empty(self, name: str) -> bool:
        """Whether the current version has no data folder at all."""
        return not self.version(name).folders

    def publish(
        self,
        name: str,
        df: DataFrame,
        bucket_by: tuple[str, ...] | list[str] = (),
        buckets: int = 1,
        if_exists: str = "overwrite",
    ) -> Version:
        """Write the rows as a new version: ``overwrite``, ``keep`` or ``error`` when the table exists."""
        numbers = self._numbers(name)
        if numbers and if_exists == "keep":
            log.warning("table %s exists and is kept", name)
            return self.version(name)
        if numbers and if_exists == "error":
            raise SpecError(f"table {name} exists")
        by = tuple(bucket_by)
        columns = tuple((c, c) for c in df.columns)
        number = (numbers[-1] if numbers else 0) + 1
        folders = self._write(name, df.withColumn(BUCKET, bucket_of(df, by, buckets)), columns, buckets)
        return self._commit(name, Version(number, df.schema.json(), columns, by, buckets, folders))

    def publish_buckets(
        self, name: str, base: Version, df: DataFrame, touched: set[int], batch: tuple[str, int] | None = None
    ) -> Version:
        """Publish a version with the touched buckets of ``base`` replaced by ``df``.

        ``df`` holds all rows of the touched buckets with their bucket column. Its rows of other buckets
        are new ones and are added to those. Buckets without rows in ``df`` and not touched are kept.
        """
        written = self._write(name, df, base.columns, base.buckets)
        kept = {b: fs for b, fs in base.folders.items() if int(b) not in touched}
        folders = {b: kept.get(b, []) + written.get(b, []) for b in {**kept, **written}}
        batches = {**base.batches, **(dict([batch]) if batch else {})}
        return self._commit(name, replace(base, number=base.number + 1, folders=folders, batches=batches))

    def mark_batch(self, name: str, base: Version, batch: tuple[str, int]) -> Version:
        """Record a batch that changed nothing."""
        batches = {**base.batches, **dict([batch])}
        return self._commit(name, replace(base, number=base.number + 1, batches=batches))

    def append(self, name: str, df: DataFrame, batch: tuple[str, int] | None = None) -> Version:
        """Publish a version with more rows; columns the new rows lack are NULL. Reads no old data."""
        base = self.create(name, df.schema)
        fields = {f.name: f.dataType for f in T.StructType.fromJson(json.loads(base.schema)).fields}
        extra = set(df.columns) - set(base.names)
        if extra:
            raise SpecError(f"table {name} has no column {', '.join(sorted(extra))}")
        rows = df.select(
            *(
                (F.col(f"`{n}`") if n in df.columns else F.lit(None)).cast(fields[s]).alias(n)
                for n, s in base.columns
            )
        )
        rows = rows.withColumn(BUCKET, bucket_of(rows, base.bucket_by, base.buckets))
        return self.publish_buckets(name, base, rows, set(), batch)

    def append_small(self, name: str, df: DataFrame) -> Version:
        """Append to a metadata table, gathering its rows now and then."""
        self.append(name, df)
        return self.compact(name, 64)

    def compact(self, name: str, folders: int = 2) -> Version:
        """Rewrite the buckets that consist of at least so many folders."""
        base = self.version(name)
        many = base.crowded(folders)
        if not many:
            return base
        return self.publish_buckets(name, base, self.read_version(name, base, many), many)

    def alter(self, name: str, renames: dict[str, str] | None = None, drops: list[str] | tuple = ()) -> Version:
        """Rename and drop columns in one new version, without touching data.

        Renaming a missing column is an error; dropping one is not. Without its layout column a table keeps
        working, but a change no longer tells which buckets it can be in.
        """
        base = self.version(name)
        columns, by = list(base.columns), list(base.bucket_by)
        for old, new in (renames or {}).items():
            if old not in [n for n, _ in columns]:
                raise NotFound(f"table {name} has no column {old}")
            if new in [n for n, _ in columns]:
                raise SpecError(f"table {name} already has a column {new}")
            columns = [(new if n == old else n, s) for n, s in columns]
            by = [new if b == old else b for b in by]
        gone = [d for d in drops if d in [n for n, _ in columns]]
        if set(gone) & set(by):
            by = []  # rows keep their buckets; new ones spread by content
        columns = [(n, s) for n, s in columns if n not in gone]
        return self._commit(name, replace(base, number=base.number + 1, columns=tuple(columns), bucket_by=tuple(by)))

    def prune(self, name: str, keep: int = 2) -> None:
        """Delete all but the newest versions and the data only they use."""
        numbers = self._numbers(name)
        old, kept = numbers[:-keep], numbers[-keep:]
        used = {f.split("/")[0] for n in kept for fs in self.version(name, n).folders.values() for f in fs}
        gone = {f.split("/")[0] for n in old for fs in self.version(name, n).folders.values() for f in fs} - used
        for n in old:
            self._files.remove(f"{self._folder(name)}/versions/{n:010d}.json")
        for folder in gone:
            self._files.remove(f"{self._folder(name)}/data/{folder}")
