"""Change events as partial rows of a mart, and their folding to one row per key.

A partial row has ``seq``, the position ``at`` if its event has one, every mart column the table can write, and a flag ``_has_<column>`` telling
whether the event wrote it: a present NULL is a value, an absent column is not.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmart.errors import SpecError
from sparkmart.functions.convert import decode_change, to_mart_type
from sparkmart.functions.transform import json_text, map_value
from sparkmart.functions.types import mart_type, type_name
from sparkmart.operators.routing import data_events
from sparkmart.plans.spec import ColumnSpec, MartSpec, TableKey, TableSpec

SEQ, AT = "seq", "at"
_HAS = "_has_"

# Fixed value: the text a NULL has when it is looked up in a value map.
NULL_TEXT = "<nil>"

_NUMERIC = ("smallint", "integer", "bigint", "real", "double precision", "numeric", "money")


def has(name: str) -> str:
    return f"{_HAS}{name}"


def conflict_columns(table: TableSpec) -> list[str]:
    """The columns an upsert of this table matches on."""
    keys = list(table.conflict_columns())
    if not keys:
        raise SpecError(f"table {table.key} has no update key, so its changes cannot be matched")
    return keys


def _typed_like(col: ColumnSpec, schema: T.StructType | None) -> ColumnSpec:
    """Fill in missing type facts from the mart's own column."""
    if col.has_type or schema is None or col.target not in schema.names:
        return col
    return replace(col, type=type_name(schema[col.target].dataType))


def _lookup_text(c: Column, col: ColumnSpec) -> Column:
    """The text a value has in a value map: NULL has its own, integral numbers have no fraction."""
    text = F.coalesce(c, F.lit(NULL_TEXT))
    if col.has_type and mart_type(col).name in _NUMERIC:
        return F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1")
    return text


@dataclass(frozen=True)
class _Write:
    """What one event writes to one mart column."""

    value: Column
    present: Column
    bad: Column  # the event has a value that cannot be read as the column's type

    def over(self, earlier: _Write | None) -> _Write:
        """This write on top of an earlier one of the same event."""
        if earlier is None:
            return self
        value = F.when(self.present, self.value).otherwise(earlier.value)
        return _Write(value, earlier.present | self.present, earlier.bad | self.bad)


def _writes(
    table: TableSpec, schema: T.StructType | None, profile: str, ts_unit: str, on_bad_cast: str
) -> dict[str, _Write]:
    """Mart column → what an event writes to it."""
    out: dict[str, _Write] = {}

    def write(name: str, value: Column, present: Column, text: Column) -> None:
        bad = present & text.isNotNull() & value.isNull()
        out[name] = _Write(value, present, bad).over(out.get(name))

    for raw in table.live_columns():
        col = _typed_like(raw, schema)
        payload = F.try_element_at("after", F.lit(col.name))
        present = F.map_contains_key("after", F.lit(col.name))
        value = decode_change(payload, col, profile, ts_unit, on_bad_cast)
        write(col.target, value, present, payload)
        if col.is_update_key and col.view_key and col.view_key != col.target:
            write(col.view_key, value, present, payload)
        mapped = col.value_map()
        if mapped:
            label = map_value(_lookup_text(payload, col), mapped[1])
            write(mapped[0], label, present & label.isNotNull(), label)
        for f in col.json_fields():
            fields = json_text(payload)
            text = F.try_element_at(fields, F.lit(f.key))
            found = F.coalesce(F.map_contains_key(fields, F.lit(f.key)), F.lit(False))
            typed = ColumnSpec(f.output, type=f.type or "text")
            write(f.output, to_mart_type(text, typed, profile, on_bad_cast), present & found, text)
    return out


def events_of(events: DataFrame, key: TableKey) -> DataFrame:
    """Data-changing events of one source table."""
    mine = (F.col("db") == key.source) & (F.col("schema") == key.schema) & (F.col("table") == key.table)
    return data_events(events).where(mine)


def partial_rows(
    events: DataFrame,
    spec: MartSpec,
    key: TableKey,
    mart_schema: T.StructType | None = None,
    profile: str = "full",
    ts_unit: str = "us",
    need_keys: bool = True,
    on_bad_value: str = "fail",
) -> DataFrame:
    """Typed partial rows of a mart from the decoded events of one of its tables.

    Events that write none of the mart's columns are skipped. So are events that lack a key column, unless
    the rows are only appended (``need_keys=False``); ``keyless_events`` returns those. A value that cannot
    be read as its column's type fails the job (a temporal text becomes NULL); with ``on_bad_value="skip"``
    its event is left out instead, and ``bad_value_events`` returns it.
    """
    table = spec.table(key)
    skip = on_bad_value == "skip"
    writes = _writes(table, mart_schema, profile, ts_unit, "null" if skip else "fail")
    rows = events_of(events, key).select(
        *(c for c in (SEQ, AT) if c in events.columns),
        *(w.value.alias(n) for n, w in writes.items()),
        *(w.present.alias(has(n)) for n, w in writes.items()),
        *((reduce(Column.__or__, [w.bad for w in writes.values()]).alias("_bad"),) if skip else ()),
    )
    if skip:
        rows = rows.where(~F.col("_bad")).drop("_bad")
    keys = table.conflict_columns()
    if keys and need_keys:
        return rows.where(reduce(Column.__and__, [F.col(has(k)) for k in keys]))
    return rows.where(reduce(Column.__or__, [F.col(has(n)) for n in writes]))


def bad_value_events(
    events: DataFrame,
    spec: MartSpec,
    key: TableKey,
    mart_schema: T.StructType | None = None,
    profile: str = "full",
    ts_unit: str = "us",
) -> DataFrame:
    """Data-changing events with a value their mart column cannot hold, with those columns' names."""
    writes = _writes(spec.table(key), mart_schema, profile, ts_unit, "null")
    names = F.concat_ws(", ", *[F.when(w.bad, F.lit(n)) for n, w in writes.items()])
    return events_of(events, key).withColumn("bad_columns", names).where(F.col("bad_columns") != "")


def keyless_events(events: DataFrame, spec: MartSpec, key: TableKey) -> DataFrame:
    """Data-changing events that have mart columns but not every key column of their table.

    Of a table without update key that is all of its events.
    """
    table = spec.table(key)

    def present(col: ColumnSpec) -> Column:
        return F.map_contains_key("after", F.lit(col.name))

    keyed = [present(c) for c in table.live_columns() if c.is_update_key]
    any_data = reduce(Column.__or__, [present(c) for c in table.live_columns()], F.lit(False))
    all_keys = reduce(Column.__and__, keyed) if keyed else F.lit(False)
    return events_of(events, key).where(any_data & ~all_keys)


def value_columns(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in (SEQ, AT) and not c.startswith(_HAS)]


def any_null(keys: list[str]) -> Column:
    return reduce(Column.__or__, [F.col(f"`{k}`").isNull() for k in keys])


def fold(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the last present value of every column.

    Equals applying the events one at a time in the order of their positions, or of ``seq`` where events have
    none, which then must not repeat. The aggregates combine on the map side, so a hot key reaches the
    shuffle as one row per task. A row with a NULL key column equals no other row and stays on its own.
    """
    order = F.col(AT if AT in rows.columns else SEQ)
    others = [c for c in value_columns(rows) if c not in keys]
    aggregates = [F.max(SEQ).alias(SEQ)]
    for c in others:
        # max_by keeps a NULL value and skips rows whose ordering is NULL.
        aggregates.append(F.max_by(c, F.when(F.col(has(c)), order)).alias(c))
        aggregates.append(F.max(has(c)).alias(has(c)))
    alone = F.when(any_null(keys), order).alias("_alone")
    return rows.groupBy(*keys, alone).agg(*aggregates).drop("_alone")
