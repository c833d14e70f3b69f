"""Presence-aware upsert of folded changes into a mart."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmart.errors import SpecError
from sparkmart.operators.changes import (
    SEQ,
    any_null,
    conflict_columns,
    fold,
    has,
    partial_rows,
    value_columns,
)
from sparkmart.plans.mart import stamp
from sparkmart.plans.spec import MartSpec, TableKey
from sparkmart.session import settle

_NEW = "_new_"


def _check(mart: DataFrame, rows: DataFrame) -> None:
    missing = [c for c in value_columns(rows) if c not in mart.columns]
    if missing:
        raise SpecError(f"the mart has no column {', '.join(missing)}")


def widen(mart: DataFrame, rows: DataFrame) -> DataFrame:
    """Change rows widened to the mart's columns; what was not written is NULL."""
    written = set(value_columns(rows))
    return rows.select(
        *(
            (F.col(f"`{f.name}`") if f.name in written else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in mart.schema.fields
        )
    )


def overlay(mart: DataFrame, folded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The mart with the present columns of matching changes written over **all** matching rows.

    A left join that keeps the mart's rows and width: Spark broadcasts the changes when they measure
    small; otherwise AQE splits the mart side of a hot key, and of the NULL keys, which match nothing.
    """
    others = [c for c in value_columns(folded) if c not in keys]
    changes = folded.select(
        *(F.col(f"`{k}`").cast(mart.schema[k].dataType).alias(f"{_NEW}{k}") for k in keys),
        *(F.col(f"`{c}`").cast(mart.schema[c].dataType).alias(f"{_NEW}{c}") for c in others),
        *(F.col(f"`{has(c)}`") for c in others),
    )
    condition = [F.col(f"`{k}`") == F.col(f"`{_NEW}{k}`") for k in keys]
    joined = mart.join(changes, condition, "left")

    def merged(name: str) -> Column:
        kept = F.col(f"`{name}`")
        if name not in others:
            return kept
        return F.when(F.col(f"`{has(name)}`"), F.col(f"`{_NEW}{name}`")).otherwise(kept).alias(name)

    return joined.select(*(merged(c) for c in mart.columns))


def unmatched(mart: DataFrame, folded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Folded changes whose key is nowhere in the mart.

    Only the mart's key columns are read, and they are cut to the keys of the changes first, so a key
    with many mart rows collapses before it is compared.
    """
    wanted = folded.select(*(F.col(f"`{k}`").cast(mart.schema[k].dataType).alias(k) for k in keys))
    present = mart.select(*keys).join(wanted, list(keys), "left_semi").distinct()
    return folded.join(present, list(keys), "left_anti")


def merge(mart: DataFrame, folded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Apply folded changes: matching rows are updated, the other changes become rows of their own.

    A change with a NULL key column matches nothing, so it is always a new row. A change that carries only
    key columns leaves an existing row as it is. The changes are read three times: settle them first.
    """
    keys = list(keys)
    _check(mart, folded)
    keyed, keyless = folded.where(~any_null(keys)), folded.where(any_null(keys))
    return (
        overlay(mart, keyed, keys)
        .unionByName(widen(mart, unmatched(mart, keyed, keys)))
        .unionByName(widen(mart, keyless))
    )


def upsert(mart: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fold partial rows and apply them to a mart."""
    return merge(mart, settle(fold(rows, list(keys)), "changes"), keys)


def merge_into(target: str, folded: DataFrame, keys: Sequence[str]) -> None:
    """The same merge as one MERGE statement, for a catalog table whose format supports it."""
    table = folded.sparkSession.table(target)
    _check(table, folded)
    others = [c for c in value_columns(folded) if c not in keys]
    new = folded.alias("new")
    condition = [F.col(f"{target}.{k}") == F.col(f"new.{k}") for k in keys]
    updates = {c: F.when(F.col(f"new.{has(c)}"), F.col(f"new.{c}")).otherwise(F.col(f"{target}.{c}")) for c in others}
    inserts = {c: F.col(f"new.{c}") for c in [*keys, *others]}
    writer = new.mergeInto(target, reduce(Column.__and__, condition))
    if updates:
        writer = writer.whenMatched().update(updates)
    writer.whenNotMatched().insert(inserts).merge()


def by_conflict_set(spec: MartSpec, tables: Sequence[TableKey]) -> list[TableKey]:
    """The order in which the tables of one batch are applied: largest conflict set first.

    Tables with the same conflict set commute. Where one set contains the other, the rows of the larger
    one have to exist before the smaller one updates them.
    """
    return sorted(tables, key=lambda k: (-len(spec.table(k).conflict_columns()), str(k)))


def apply_events(
    mart: DataFrame,
    events: DataFrame,
    spec: MartSpec,
    tables: Sequence[TableKey] | None = None,
    profile: str = "full",
    ts_unit: str = "us",
) -> DataFrame:
    """Apply the decoded events of all (or the given) tables of a mart."""
    wanted = list(tables) if tables is not None else [t.key for t in spec.tables if t.conflict_columns()]
    for i, key in enumerate(by_conflict_set(spec, wanted)):
        if i > 1:
            # Every upsert reads the mart twice; cut the plan before that multiplies.
            mart = settle(mart, "mart")
        rows = partial_rows(events, spec, key, mart.schema, profile, ts_unit)
        mart = upsert(mart, rows, conflict_columns(spec.table(key)))
    return mart


def append_rows(mart: DataFrame, rows: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """Change rows as appended by a versioned mart: whole rows with a version stamp and their order.

    Columns an event did not carry are NULL in its version.
    """
    wide = stamp(rows, updated_at, F.col(SEQ))
    fields = [f for f in mart.schema.fields if f.name in wide.columns]
    return wide.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields))

