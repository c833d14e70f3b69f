"""Build marts into a table store."""

from __future__ import annotations

from collections.abc import Iterable

from sparkmart.operators.registry import Registry
from sparkmart.operators.runlog import COMPLETED, FAILED, RunLog
from sparkmart.plans.join_graph import plan_joins
from sparkmart.plans.mart import mart_frame, order_key, stamp
from sparkmart.plans.spec import MartSpec, TableKey
from sparkmart.session import tuned
from sparkmart.sources.catalog import SourceCatalog
from sparkmart.store import TableStore, Version, suggest_buckets


def layout_columns(spec: MartSpec) -> tuple[str, ...]:
    """Columns to lay a mart out by: a table's conflict columns that no event can overwrite.

    A row then never changes its bucket, so the keys of a change name the only buckets it can touch.
    """
    overwritten = {
        n for t in spec.tables for n in t.written_columns() if n not in t.conflict_columns()
    }
    choices = [t.conflict_columns() for t in spec.tables]
    return next((c for c in choices if c and not set(c) & overwritten), ())


def source_sizes(catalog: SourceCatalog, tables: Iterable[TableKey]) -> list[int]:
    """The planner's sizes of source tables, without those it does not know."""
    sizes = [catalog.size(t) for t in tables]
    return [s for s in sizes if s is not None]


def build_mart(
    store: TableStore,
    spec: MartSpec,
    catalog: SourceCatalog,
    if_exists: str = "overwrite",
    buckets: int | None = None,
    versioned: bool = False,
    **options,
) -> Version:
    """Build a mart and publish it. A versioned mart keeps every version of a row with a time stamp.

    Shuffles are sized for the source tables. Without a bucket count, the largest of them decides.
    """
    tables = plan_joins(spec, composite=options.get("composite", False)).tables
    catalog = catalog.opened(tables)
    sizes = source_sizes(catalog, tables)
    buckets = suggest_buckets(max(sizes, default=0)) if buckets is None else buckets
    with tuned(store.spark, sum(sizes)):
        df = mart_frame(spec, catalog, **options)
        if versioned:
            return store.publish(spec.name, stamp(df), (order_key(spec),), buckets, if_exists)
        return store.publish(spec.name, df, layout_columns(spec), buckets, if_exists)


def run_build(
    store: TableStore, registry: Registry, runs: RunLog, view_id: int, catalog: SourceCatalog, **options
) -> str:
    """Build a registered mart as a logged run and return the run's id.

    The run is logged as completed only after the mart is published, and as failed with the error's text.
    """
    task = runs.create()
    try:
        build_mart(store, registry.get(view_id), catalog, **options)
    except Exception as e:
        runs.change(task, FAILED, str(e))
        raise
    runs.change(task, COMPLETED, "mart is published")
    return task
