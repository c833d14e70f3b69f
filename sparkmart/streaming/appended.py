"""Marts kept current by appending: merge on read.

A batch of changes is folded to one positioned row per key and appended to a folder of its own; nothing that is there is
read or rewritten. The mart is the base with the newest value of every column over all appended rows. A replayed batch
writes its folder again, and folders may be folded together at any time: folding the same rows twice changes nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmart.files import Files
from sparkmart.operators.changes import bad_value_events, conflict_columns, keyless_events, partial_rows
from sparkmart.operators.positions import newest, positioned, with_flags
from sparkmart.operators.upsert import by_conflict_set, merge
from sparkmart.plans.mart import mart_frame
from sparkmart.plans.spec import MartSpec, TableKey
from sparkmart.session import settle, shared_folder, tuned
from sparkmart.sources.catalog import SourceCatalog
from sparkmart.sources.change_log import bad_in, events_in, in_batch, parse


class ChangeFolder:
    """Positioned rows of one key set, a folder per batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._files = Files(spark, path)

    def _folders(self) -> list[str]:
        return sorted(n for n in self._files.names(self.path) if re.match("(batch|folded)=", n))

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Write a batch's rows; a replay replaces them."""
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self) -> DataFrame | None:
        """All rows. Columns that came later are NULL in earlier batches."""
        folders = [f"{self.path}/{n}" for n in self._folders()]
        return self.spark.read.option("mergeSchema", "true").parquet(*folders) if folders else None

    def compact(self, keys: Sequence[str], folders: int = 2, fold: Callable = newest) -> None:
        """Fold everything into one folder if there are at least so many.

        The folders it replaces go afterwards; a reader that sees both finds the same newest values. One that has planned to
        read a folder which then goes fails, and has to read again.
        """
        old = self._folders()
        if len(old) < folders:
            return
        fold(self.read(), keys).write.parquet(f"{self.path}/folded={uuid.uuid4().hex}")
        for name in old:
            self._files.remove(f"{self.path}/{name}")


def table_folder(key: TableKey) -> str:
    """A folder name that tells tables apart, whatever their names hold."""
    return ".".join(re.sub(r"[^A-Za-z0-9_]", lambda m: f"%{ord(m[0]):x}", part) for part in (key.source, key.schema, key.table))


class AppendedMart:
    """One mart: a base that is written once, and folders of changes by source table.

    The instance is the function of ``foreachBatch``. What a batch costs follows the batch, not the mart; reading
    folds the changes and joins them to the base once per source table with changes. ``compact`` bounds the folders, and
    the rows by one per changed key. Tables without update key cannot be applied; their events, those without a key column
    or with a value the mart cannot hold, and unreadable records are kept in the folder ``bad``.

    Source tables are applied in the order of their conflict sets, the largest first, as the other applier does within a
    batch, so the mart does not depend on where batches end.
    """

    def __init__(self, spark: SparkSession, root: str, spec: MartSpec, profile: str = "full", ts_unit: str = "us"):
        self.spark, self.root, self.spec, self.name = spark, root.rstrip("/"), spec, spec.name
        self.profile, self.ts_unit = profile, ts_unit

    def build(self, catalog: SourceCatalog, input_bytes: int = 0) -> None:
        """Write the base; it must not exist."""
        with tuned(self.spark, input_bytes):
            mart_frame(self.spec, catalog).write.parquet(f"{self.root}/base")

    def base(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/base")

    def _tables(self) -> list[TableKey]:
        return by_conflict_set(self.spec, [t.key for t in self.spec.tables if t.conflict_columns()])

    def changes(self, key: TableKey) -> ChangeFolder:
        return ChangeFolder(self.spark, f"{self.root}/changes/{table_folder(key)}")

    def __call__(self, raw: DataFrame, batch_id: int) -> None:
        parsed = in_batch(parse(raw), batch_id).persist()
        try:
            events, schema = events_in(parsed), self.base().schema
            present = {TableKey(*r) for r in events.select("db", "schema", "table").distinct().toLocalIterator()}
            for key in self._tables():
                if key in present:
                    keys = conflict_columns(self.spec.table(key))
                    rows = partial_rows(events, self.spec, key, schema, self.profile, self.ts_unit, on_bad_value="skip")
                    self.changes(key).append(newest(positioned(rows, keys), keys), batch_id)
            self._bad(parsed, events, schema, present).write.mode("overwrite").parquet(f"{self.root}/bad/batch={batch_id}")
        finally:
            parsed.unpersist()

    def _bad(self, parsed: DataFrame, events: DataFrame, schema: T.StructType, present: set[TableKey]) -> DataFrame:
        found = bad_in(parsed)
        for table in self.spec.tables:
            if table.key not in present:
                continue
            wrong = bad_value_events(events, self.spec, table.key, schema, self.profile, self.ts_unit)
            problem = F.concat(F.lit(f"{table.key}: bad value for "), "bad_columns")
            found = found.union(wrong.select(F.to_json("after"), problem))
            lacking = "key column missing" if table.conflict_columns() else "no update key"
            keyless = keyless_events(events, self.spec, table.key)
            found = found.union(keyless.select(F.to_json("after"), F.lit(f"{table.key}: {lacking}")))
        return found

    def bad_records(self) -> DataFrame:
        """``value``, ``reason`` and ``batch`` of what could not be applied."""
        return self.spark.read.schema("value string, reason string, batch long").parquet(f"{self.root}/bad")

    def read(self) -> DataFrame:
        """The mart as it is now."""
        mart, joined = self.base(), 0
        for key in self._tables():
            rows, keys = self.changes(key).read(), conflict_columns(self.spec.table(key))
            if rows is None:
                continue
            if joined > 1:
                # Every merge reads the mart twice; cut the plan before that multiplies.
                mart = settle(mart, "mart")
            mart = merge(mart, settle(with_flags(newest(rows, keys), keys), "changes"), keys)
            joined += 1
        return mart

    def compact(self, folders: int = 16) -> None:
        """Fold the changes of tables with so many folders; not while a result of ``read`` is still being computed."""
        for key in self._tables():
            self.changes(key).compact(conflict_columns(self.spec.table(key)), folders)


def appended_mart(spark: SparkSession, name: str, spec: MartSpec, **options) -> AppendedMart:
    """An appended mart in the shared working folder."""
    return AppendedMart(spark, f"{shared_folder(spark)}/appended/{name}-{uuid.uuid4().hex[:12]}", spec, **options)
