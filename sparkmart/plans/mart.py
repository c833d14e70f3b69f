"""Compile a mart spec into one DataFrame plan."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmart.errors import SpecError
from sparkmart.functions.transform import staged_columns
from sparkmart.plans.join_graph import Pairs, hang_from, plan_joins
from sparkmart.plans.spec import Endpoint, MartSpec, TableKey
from sparkmart.sources.catalog import SourceCatalog

UPDATED_AT, VERSION_SEQ = "updated_at", "_seq"


def _key_name(slot: int, column: str) -> str:
    return f"k{slot}_{column}"


def mart_frame(
    spec: MartSpec,
    catalog: SourceCatalog,
    profile: str = "full",
    on_bad_cast: str = "fail",
    check_nulls: bool = True,
    strict: bool = False,
    composite: bool = False,
) -> DataFrame:
    """The wide table a spec describes, as a lazy plan.

    Each table is projected once to its mart columns plus the source columns its join rules name, so a
    rule works on source names whatever the aliases are. Tables outside the join tree are not scanned.
    A NULL in a column that the spec does not call nullable fails the load, unless ``check_nulls`` is off.
    """
    plan = plan_joins(spec, strict=strict, composite=composite)
    slots = {t.key: i for i, t in enumerate(spec.tables) if t.key in plan.tables}
    catalog = catalog.opened(slots)
    ends = {e for s in plan.steps for pair in s.pairs for e in pair}

    layout: list[tuple[str, str]] = []  # (internal name, mart name) in mart order
    frames: dict[TableKey, DataFrame] = {}
    for table in spec.tables:
        if table.key not in slots:
            continue
        slot = slots[table.key]
        df = catalog.table(table.key)
        columns = staged_columns(df, table, profile, on_bad_cast, check_nulls)
        keys = sorted({e.column for e in ends if e.table == table.key})
        frames[table.key] = df.select(
            *(c.alias(f"t{slot}_{n}") for n, c in columns.items()),
            *(F.col(f"`{k}`").alias(_key_name(slot, k)) for k in keys),
        )
        layout += [(f"t{slot}_{n}", n) for n in columns]

    repeated = [n for n, times in Counter(n for _, n in layout).items() if times > 1]
    if repeated:
        raise SpecError(f"mart {spec.name} has columns of equal name: {', '.join(repeated)}")

    def key(e: Endpoint) -> Column:
        return F.col(f"`{_key_name(slots[e.table], e.column)}`")

    def attach(left: DataFrame, right: DataFrame, pairs: Pairs) -> DataFrame:
        return left.join(right, reduce(Column.__and__, [key(a) == key(b) for a, b in pairs]), "inner")

    # Hung up at the largest table, the others are joined among themselves first: the largest one is then
    # shuffled for its own joins only, not again for joins between smaller tables.
    sizes = {t: catalog.size(t) or 0 for t in slots} if plan.steps else {plan.root: 0}
    below = hang_from(plan, max(sizes, key=lambda t: (sizes[t], t == plan.root)))

    def subtree(table: TableKey) -> DataFrame:
        return reduce(lambda df, link: attach(df, subtree(link[0]), link[1]), below[table], frames[table])

    if below is None:
        joined = reduce(lambda df, step: attach(df, frames[step.table], step.pairs), plan.steps, frames[plan.root])
    else:
        joined = subtree(next(iter(below)))
    return joined.select(*(F.col(f"`{inner}`").alias(name) for inner, name in layout))


def mart_columns(spec: MartSpec) -> list[str]:
    """Names of the mart's columns in order."""
    kept = plan_joins(spec, composite=True).tables
    return [c.target for t in spec.tables if t.key in kept for c in t.mart_columns()]


def order_key(spec: MartSpec) -> str:
    """The key of a versioned mart: the first column of the first table."""
    return spec.tables[0].mart_columns()[0].target


def stamp(df: DataFrame, at: Column | None = None, seq: Column | None = None) -> DataFrame:
    """Add the stamps of a versioned mart: the time of the version and its order within that time."""
    return df.withColumns(
        {
            UPDATED_AT: F.current_timestamp() if at is None else at,
            VERSION_SEQ: F.lit(0).cast("bigint") if seq is None else seq,
        }
    )


def current_view(versions: DataFrame, keys: list[str], order: tuple[str, ...] = (UPDATED_AT, VERSION_SEQ)) -> DataFrame:
    """The newest version of every key.

    An aggregate rather than a window: the older versions of a hot key are dropped on the map side
    instead of meeting in one task.
    """
    rest = [c for c in versions.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    picked = versions.groupBy(*keys).agg(newest)
    fields = {c: F.col(c) if c in keys else F.col(f"_row.{c}") for c in versions.columns}
    return picked.select(*(c.alias(n) for n, c in fields.items()))
