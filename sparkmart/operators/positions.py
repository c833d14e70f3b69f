"""Partial rows that remember which event wrote each column, so that they can be folded in any order.

A positioned row has the key columns, ``seq``, every other column and ``_at_<column>``, the position of the event that wrote it, NULL
where none did. The newest value of a column is the one with the greatest position, whichever batch brought it: folding
is associative, commutative and idempotent, and neither batch borders nor replays change its result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmart.operators.changes import AT, SEQ, any_null, has, value_columns

_AT, _ALONE = "_at_", "_alone"


def at_of(name: str) -> str:
    return f"{_AT}{name}"


def written_columns(rows: DataFrame) -> list[str]:
    """The columns, keys aside, that positioned rows can write."""
    return [c[len(_AT) :] for c in rows.columns if c.startswith(_AT)]


def positioned(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial rows with the position of every write. A row with a NULL key column stays on its own."""
    order = F.col(AT if AT in rows.columns else SEQ)
    others = [c for c in value_columns(rows) if c not in keys]
    return rows.select(
        *keys,
        F.when(any_null(list(keys)), order).alias(_ALONE),
        SEQ,
        *others,
        *(F.when(F.col(has(c)), order).alias(at_of(c)) for c in others),
    )


def newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One positioned row per key with every column's newest value. Aggregates combine on the map side."""
    aggregates = [F.max(SEQ).alias(SEQ)]
    for c in written_columns(rows):
        aggregates += [F.max_by(c, at_of(c)).alias(c), F.max(at_of(c)).alias(at_of(c))]
    return rows.groupBy(*keys, _ALONE).agg(*aggregates)


def with_flags(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Folded positioned rows in the form that ``merge`` takes: a flag per column instead of a position."""
    others = written_columns(rows)
    return rows.select(SEQ, *keys, *others, *(F.col(at_of(c)).isNotNull().alias(has(c)) for c in others))


def marks(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The positions alone, of rows with a full key: one that lacks a key column is never met again."""
    return rows.where(~any_null(list(keys))).select(*keys, *map(at_of, written_columns(rows)))


def highest(seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Marks folded to one row per key."""
    positions = [c for c in seen.columns if c not in keys]
    return seen.groupBy(*keys).agg(*(F.max(c).alias(c) for c in positions)) if positions else seen.distinct()


def not_late(rows: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Folded positioned rows without the writes that come before what was already written.

    ``seen`` holds marks, several per key perhaps; only those of the rows' keys are shuffled on. A write at just the same
    position is the same event, replayed.
    """
    columns = [c for c in written_columns(rows) if at_of(c) in seen.columns]
    wanted = seen.select(*keys, *map(at_of, columns)).join(rows.select(*keys), list(keys), "left_semi")
    high = highest(wanted, keys).select(*(F.col(c).alias(f"_seen{c}") for c in (*keys, *map(at_of, columns))))
    met = [F.col(k) == F.col(f"_seen{k}") for k in keys]

    def kept(position: str) -> Column:
        before = F.col(f"_seen{position}")
        return F.when(before.isNull() | (F.col(position) >= before), F.col(position)).alias(position)

    changed = {at_of(c): kept(at_of(c)) for c in columns}
    return rows.join(high, met, "left").select(*(changed.get(c, F.col(c)) for c in rows.columns))
