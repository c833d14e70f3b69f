"""Keep marts current from a change stream, one micro-batch at a time."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmart.functions.types import row_type
from sparkmart.operators import drift
from sparkmart.operators.changes import AT, bad_value_events, conflict_columns, fold, keyless_events, partial_rows
from sparkmart.operators.evolve import Evolution
from sparkmart.operators.positions import highest, marks, newest, not_late, positioned, with_flags
from sparkmart.operators.registry import Registry, extra_targets, spec_columns
from sparkmart.operators.routing import TABLE, data_events, observed_columns
from sparkmart.operators.upsert import append_rows, by_conflict_set, merge
from sparkmart.plans.mart import UPDATED_AT
from sparkmart.plans.spec import MartSpec, TableKey
from sparkmart.files import Files
from sparkmart.session import local_frame, scratch_path, settle
from sparkmart.sources.change_log import bad_in, events_in, in_batch, parse
from sparkmart.store import BUCKET, TableStore, Version, bucket_of
from sparkmart.streaming.appended import ChangeFolder, table_folder

log = logging.getLogger(__name__)

BAD_RECORDS, OBSERVED = "bad_records", "observed_columns"

# Checks combined into one plan.
MAX_UNION = 64

# Additions to a bucket before it is rewritten as one folder.
MAX_FOLDERS = 16

_TEXT = T.StringType()
_TABLES = row_type(db=_TEXT, schema=_TEXT, table=_TEXT)
_COLUMNS = row_type(db=_TEXT, schema=_TEXT, table=_TEXT, column=_TEXT)
_SOURCE = row_type(db=_TEXT, schema=_TEXT, table=_TEXT, column=_TEXT, type=_TEXT)
_MARTS = row_type(view_id=T.LongType(), column=_TEXT)


def touched_buckets(store: TableStore, name: str, base: Version, changes: DataFrame, keys: list[str]) -> set[int]:
    """The buckets that hold rows the changes match.

    Only key columns are read, and only of the buckets the change keys can be in when the layout key is
    part of the conflict key. The result has at most one entry per bucket.
    """
    if base.buckets == 1:
        return {0}
    mart = store.read_version(name, base)
    wanted = changes.select(*(F.col(f"`{k}`").cast(mart.schema[k].dataType).alias(k) for k in keys))
    if base.bucket_by and set(base.bucket_by) <= set(keys):
        hashed = wanted.select(bucket_of(wanted, base.bucket_by, base.buckets).alias(BUCKET)).distinct()
        mart = store.read_version(name, base, {r[0] for r in hashed.toLocalIterator()})
    hit = mart.select(BUCKET, *keys).join(wanted, keys, "left_semi").select(BUCKET).distinct()
    return {r[0] for r in hit.toLocalIterator()}


def timely(rows: DataFrame, keys: list[str], seen: ChangeFolder, batch_id: int, scratch: str | None = None) -> DataFrame:
    """Partial rows folded to changes, without writes that come before those of earlier batches.

    The positions are kept before the changes are applied: a batch that fails in between is replayed, and its own positions
    stop none of its writes.
    """
    found = settle(newest(positioned(rows, keys), keys), "positions", scratch)
    earlier = seen.read()
    seen.append(marks(found, keys), batch_id)
    return with_flags(found if earlier is None else not_late(found, earlier, keys), keys)


def upsert_table(
    store: TableStore,
    spec: MartSpec,
    events: DataFrame,
    key: TableKey,
    batch: tuple[str, int] | None = None,
    profile: str = "full",
    ts_unit: str = "us",
    scratch: str | None = None,
    seen: ChangeFolder | None = None,
) -> Version:
    """Apply the events of one source table to a stored mart and publish the result.

    ``seen`` keeps the position of the last write per key and column, so that a late record does not undo a newer one of an
    earlier batch. Events with a value the mart cannot hold are left out. Buckets with matching rows are rewritten; new
    rows are added next to the data that is there. Buckets that additions have split into many folders are
    rewritten along the way.
    """
    name, base = spec.name, store.version(spec.name)
    schema = store.read_version(name, base).drop(BUCKET).schema
    keys = conflict_columns(spec.table(key))
    rows = partial_rows(events, spec, key, schema, profile, ts_unit, on_bad_value="skip")
    kept = seen is not None and batch is not None and AT in rows.columns
    changes = settle(timely(rows, keys, seen, batch[1], scratch) if kept else fold(rows, keys), "changes", scratch)
    if kept:
        seen.compact(keys, MAX_FOLDERS, highest)  # only now that the changes no longer read the folders it replaces
    touched = touched_buckets(store, name, base, changes, keys) | base.crowded(MAX_FOLDERS)
    merged = merge(store.read_version(name, base, touched), changes, keys)
    placed = F.coalesce(F.col(BUCKET), bucket_of(merged, base.bucket_by, base.buckets))
    return store.publish_buckets(name, base, merged.withColumn(BUCKET, placed), touched, batch)


def by_table(events: DataFrame, scratch: str) -> DataFrame:
    """The events written once, in a folder per source table: a mart then reads those of its tables only.

    Rebalancing keeps small tables in one file and cuts large ones into several.
    """
    path = f"{scratch}/events"
    events.hint("rebalance", *TABLE).write.partitionBy(*TABLE).parquet(path)
    return events.sparkSession.read.schema(events.schema).parquet(path)


class ChangeApplier:
    """Applies micro-batches of raw change records to all registered marts.

    Every (mart, source table) of a batch is one published version tagged with the batch id, so replaying
    a batch after a failure repeats nothing. The registry is read per batch, a new mart joins by itself, and only the
    specs that use a table of the batch leave it: a batch costs what its marts cost, however many others there are.

    The events of a batch are written once, in a folder per table, so a mart reads those of its tables only.
    ``keep_versions`` mart versions are kept, older ones are deleted after each batch; ``None`` keeps all.
    ``source_columns`` gives the current source columns of the touched tables for the drift check;
    ``"observed"`` takes all columns seen in events so far, which show what a mart lacks but never that a column
    is gone or renamed; ``None`` switches the check off. ``renames`` switches the rename heuristic.

    Events of a table without update key cannot be applied to a mart that is not versioned; like unreadable records
    they are kept in the table of bad records.
    """

    def __init__(
        self,
        store: TableStore,
        registry: Registry,
        evolution: Evolution | None = None,
        source_columns: Callable[[set[TableKey]], DataFrame] | str | None = None,
        auto_suggest: bool = False,
        name: str = "cdc",
        profile: str = "full",
        ts_unit: str = "us",
        parallel: int = 4,
        keep_versions: int | None = 100,
        renames: bool = True,
    ):
        self.store, self.registry, self.evolution = store, registry, evolution
        self.source_columns, self.auto_suggest = source_columns, auto_suggest
        self.name, self.profile, self.ts_unit, self.parallel = name, profile, ts_unit, parallel
        self.keep_versions, self.renames = keep_versions, renames
        self._checked: dict[frozenset[TableKey], list] = {}  # touched tables → what they were checked with

    # -- one batch ------------------------------------------------------------------------------

    def __call__(self, raw: DataFrame, batch_id: int) -> None:
        # Both uses of the parsed records come first; a lost cache block is parsed again from the source.
        parsed = in_batch(parse(raw), batch_id).persist()
        scratch = scratch_path(self.store.spark, f"batch-{batch_id}")
        try:
            events = by_table(data_events(events_in(parsed)), scratch)
            present = {
                TableKey(*r) for r in events.select("db", "schema", "table").distinct().toLocalIterator()
            }
            tables = local_frame(self.store.spark, [(k.source, k.schema, k.table) for k in present], _TABLES)
            specs = self.registry.specs(tables)
            work = {i: [t.key for t in s.tables if t.key in present] for i, s in specs.items()}
            work = {i: keys for i, keys in work.items() if keys}
            self._keep_bad(parsed, events, [(specs[i], k) for i, keys in work.items() for k in keys], batch_id)
            self._check_drift(events, present, specs, batch_id, scratch)
            gated = self._gated()
            # Specs that share a mart follow each other; different marts run side by side.
            marts: dict[str, list[tuple[int, MartSpec, list[TableKey]]]] = {}
            for i, keys in work.items():
                open_keys = [k for k in keys if (i, k) not in gated]
                marts.setdefault(specs[i].name, []).append((i, specs[i], open_keys))
            with ThreadPoolExecutor(max(1, self.parallel)) as pool:
                jobs = [pool.submit(self._apply_all, m, events, batch_id, scratch) for m in marts.values()]
                for job in jobs:
                    job.result()  # a failed mart fails the batch, which is then replayed
        finally:
            parsed.unpersist()
            Files(self.store.spark, scratch).remove(scratch)

    def _keep_bad(
        self, parsed: DataFrame, events: DataFrame, work: list[tuple[MartSpec, TableKey]], batch_id: int
    ) -> None:
        """Keep records that could not be used: those that are no envelope, and per mart the unusable events."""
        found = [bad_in(parsed)]
        for spec, key in work:
            if not self.store.exists(spec.name):
                continue
            schema = self.store.read(spec.name).schema
            wrong = bad_value_events(events, spec, key, schema, self.profile, self.ts_unit)
            problem = F.concat(F.lit(f"mart {spec.name}, {key}: bad value for "), "bad_columns")
            found.append(wrong.select(F.to_json("after").alias("value"), problem.alias("reason")))
            if not self._versioned(spec):
                keyless = keyless_events(events, spec, key)
                lacking = "key column missing" if spec.table(key).conflict_columns() else "no update key"
                problem = F.lit(f"mart {spec.name}, {key}: {lacking}")
                found.append(keyless.select(F.to_json("after").alias("value"), problem.alias("reason")))
        # Many marts are handled in several plans of limited size, each tagged on its own.
        for n in range(0, len(found), MAX_UNION):
            tag = f"{self.name}:{n}"
            if self._done(BAD_RECORDS, tag, batch_id):
                continue
            bad = reduce(DataFrame.union, found[n : n + MAX_UNION])
            bad = bad.withColumn("batch_id", F.lit(batch_id).cast("bigint")).persist()
            try:
                if not bad.isEmpty():
                    self.store.append(BAD_RECORDS, bad, (tag, batch_id))
            finally:
                bad.unpersist()
        if self.store.exists(BAD_RECORDS):
            self.store.compact(BAD_RECORDS, 64)

    def _check_drift(
        self, events: DataFrame, present: set[TableKey], specs: dict[int, MartSpec], batch_id: int, scratch: str
    ) -> None:
        """Compare the touched tables of all marts, unless nothing changed since the last comparison."""
        present = present & {t.key for s in specs.values() for t in s.tables}
        built = {i: self.store.version(s.name).names for i, s in specs.items() if self.store.exists(s.name)}
        if self.evolution is None or self.source_columns is None or not present or not built:
            return
        observed = self.source_columns == "observed"
        if observed:
            found = self._observed(events, batch_id)
        else:
            found = settle(self.source_columns(present).select(*_SOURCE.names).distinct(), "source", scratch)
        # Whether anything changed is told by a sum over the columns, which stay where they are.
        mark = found.agg(F.count("*"), F.sum(F.xxhash64(*found.columns).cast("decimal(38,0)"))).first()
        state = [tuple(mark), specs, built, self.evolution.state()]
        if state == self._checked.get(frozenset(present)):
            return
        spark = self.store.spark
        touched = local_frame(spark, [(k.source, k.schema, k.table) for k in present], _TABLES)
        registry = self.registry.frame().where(F.col("id").isin(list(built)))
        spec = spec_columns(registry)
        spec = spec.join(touched, _TABLES.names, "left_semi")
        mart = local_frame(spark, [(i, c) for i, names in built.items() for c in names], _MARTS)
        # Columns of the mart's other tables belong to the spec as well.
        extra = extra_targets(registry).union(spec_columns(registry).select("view_id", "target"))
        if observed:
            report = drift.observed_report(found, spec, mart, extra, scratch)
        else:
            report = drift.drift_report(found, spec, mart, extra, renames=self.renames, scratch=scratch)
        report = settle(report, "drift", scratch)
        self.evolution.record(report)
        if self.auto_suggest and not observed:
            self.evolution.suggest(report)
        self._checked[frozenset(present)] = [*state[:-1], self.evolution.state()]

    def _observed(self, events: DataFrame, batch_id: int) -> DataFrame:
        """The columns seen in any event so far; a batch adds those it is the first to show."""
        tag = (f"{self.name}:observed", batch_id)
        if not self._done(OBSERVED, *tag):
            seen = observed_columns(data_events(events))
            if self.store.exists(OBSERVED):
                seen = seen.join(self.store.read(OBSERVED), _COLUMNS.names, "left_anti")
            seen = seen.select(*_COLUMNS.names).persist()
            try:
                if not seen.isEmpty():
                    self.store.append(OBSERVED, seen, tag)
            finally:
                seen.unpersist()
        return self.store.read(OBSERVED) if self.store.exists(OBSERVED) else local_frame(self.store.spark, [], _COLUMNS)

    def _gated(self) -> set[tuple[int, TableKey]]:
        """Marts and tables with a pending rename suggestion."""
        if self.evolution is None or self.store.is_empty(self.evolution.SUGGESTIONS):
            return set()
        pending = self.evolution.suggestions().select("view_id", "db", "schema", "table").distinct()
        return {(r[0], TableKey(*r[1:])) for r in pending.toLocalIterator()}

    def _done(self, table: str, tag: str, batch_id: int) -> bool:
        return self.store.exists(table) and self.store.version(table).batches.get(tag, -1) >= batch_id

    def _versioned(self, spec: MartSpec) -> bool:
        return self.store.exists(spec.name) and UPDATED_AT in self.store.version(spec.name).names

    def _seen(self, view_id: int, spec: MartSpec, key: TableKey) -> ChangeFolder:
        """The positions written so far by this applier to a mart from a table."""
        path = f"{self.store.root}/{spec.name}/positions/{self.name}/{view_id}/{table_folder(key)}"
        return ChangeFolder(self.store.spark, path)

    def _apply_all(self, work: list[tuple[int, MartSpec, list[TableKey]]], *batch) -> None:
        for view_id, spec, keys in work:
            self._apply(view_id, spec, keys, *batch)

    def _apply(
        self, view_id: int, spec: MartSpec, keys: list[TableKey], events: DataFrame, batch_id: int, scratch: str
    ) -> None:
        if not self.store.exists(spec.name):
            log.warning("mart %s is not built yet; its changes are skipped", spec.name)
            return
        versioned = self._versioned(spec)
        for key in by_conflict_set(spec, keys):
            tag = f"{self.name}:{view_id}:{key}"
            if self._done(spec.name, tag, batch_id):
                continue
            batch = (tag, batch_id)
            if not versioned and not spec.table(key).conflict_columns():
                continue  # its events are among the bad records
            if versioned:
                mart = self.store.read(spec.name)
                rows = partial_rows(events, spec, key, mart.schema, self.profile, self.ts_unit, False, "skip")
                self.store.append(spec.name, append_rows(mart, rows), batch)
                self.store.compact(spec.name, MAX_FOLDERS)
            else:
                upsert_table(self.store, spec, events, key, batch, self.profile, self.ts_unit, scratch, self._seen(view_id, spec, key))
        if self.keep_versions:
            self.store.prune(spec.name, self.keep_versions)


def start_cdc(
    stream: DataFrame,
    applier: ChangeApplier,
    checkpoint: str,
    available_now: bool = False,
    interval: str = "1 second",
):
    """Run the applier over a stream of raw records. The checkpoint keeps the position."""
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return (
        stream.writeStream.foreachBatch(applier)
        .option("checkpointLocation", checkpoint)
        .queryName(applier.name)
        .trigger(**trigger)
        .start()
    )


def apply_stream(spark: SparkSession, stream: DataFrame, applier: ChangeApplier, checkpoint: str) -> None:
    """Drain what the stream holds now and return."""
    query = start_cdc(stream, applier, checkpoint, available_now=True)
    query.awaitTermination()
