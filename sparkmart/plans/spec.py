"""Mart specs: the nested selection tree, transforms and join rules, read from and written to JSON.

A spec is small driver-side metadata; everything here is pure Python on frozen dataclasses.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace

from sparkmart.errors import SpecError

JSON_TRANSFORM = "JSON"
VALUE_TRANSFORM = "FieldTransform"


def _drop_empty(pairs: dict) -> dict:
    return {k: v for k, v in pairs.items() if v not in (None, "", False, (), [], {})}


@dataclass(frozen=True)
class JsonField:
    """One flattened JSON field: payload key, mart column and its type."""

    key: str
    output: str
    type: str = ""


@dataclass(frozen=True)
class Transform:
    """A column transform: a value map or a JSON flatten."""

    type: str
    values: Mapping[str, str] = field(default_factory=dict)
    output: str = ""
    fields: tuple[JsonField, ...] = ()
    # Carried through a round trip, without behaviour.
    mode: str = ""
    output_column: str = ""
    type_map: str = ""
    type_field: str = ""

    @staticmethod
    def from_dict(raw: Mapping) -> Transform:
        mapping = raw.get("mapping") or {}
        fields = tuple(
            JsonField(key, output, entry.get("type_field", ""))
            for entry in mapping.get("mapping_json") or ()
            for key, output in (entry.get("mapping") or {}).items()
        )
        return Transform(
            type=raw.get("type", ""),
            values=dict(mapping.get("mapping") or {}),
            output=mapping.get("alias_new_column_transform", ""),
            fields=fields,
            mode=raw.get("mode", ""),
            output_column=raw.get("output_column", ""),
            type_map=mapping.get("type_map", ""),
            type_field=mapping.get("type_field", ""),
        )

    def to_dict(self) -> dict:
        mapping = _drop_empty(
            {
                "type_map": self.type_map,
                "mapping": dict(self.values),
                "alias_new_column_transform": self.output,
                "type_field": self.type_field,
                "mapping_json": [
                    _drop_empty({"mapping": {f.key: f.output}, "type_field": f.type}) for f in self.fields
                ],
            }
        )
        return {
            "type": self.type,
            "mode": self.mode,
            "output_column": self.output_column,
            "mapping": mapping,
        }


# JSON keys of a column that map one to one onto ColumnSpec fields.
_COLUMN_KEYS = (
    "name",
    "alias",
    "is_update_key",
    "type",
    "data_type",
    "udt_schema",
    "udt_name",
    "char_max_len",
    "num_precision",
    "num_scale",
    "is_deleted",
    "is_nullable",
    "is_primary_key",
    "view_key",
    "is_fk",
    "default",
    "is_unq",
)


@dataclass(frozen=True)
class ColumnSpec:
    """A selected column with its catalog facts, alias, key roles and transform."""

    name: str
    alias: str = ""
    is_update_key: bool = False
    type: str = ""
    data_type: str = ""
    udt_schema: str = ""
    udt_name: str = ""
    char_max_len: int | None = None
    num_precision: int | None = None
    num_scale: int | None = None
    is_deleted: bool = False
    is_nullable: bool = False
    is_primary_key: bool = False
    view_key: str = ""
    is_fk: bool = False
    default: str = ""
    is_unq: bool = False
    transform: Transform | None = None
    reference: Mapping | None = None

    @staticmethod
    def from_dict(raw: Mapping) -> ColumnSpec:
        known = {k: raw[k] for k in _COLUMN_KEYS if raw.get(k) is not None}
        transform = Transform.from_dict(raw["transform"]) if raw.get("transform") else None
        return ColumnSpec(**{"name": "", **known}, transform=transform, reference=raw.get("reference"))

    def to_dict(self) -> dict:
        out = _drop_empty({k: getattr(self, k) for k in _COLUMN_KEYS})
        if self.transform:
            out["transform"] = self.transform.to_dict()
        if self.reference:
            out["reference"] = dict(self.reference)
        return out

    @property
    def target(self) -> str:
        """The name the column has in the mart."""
        return self.alias or self.name

    @property
    def has_type(self) -> bool:
        return bool(self.type or self.data_type or self.udt_name)

    def value_map(self) -> tuple[str, Mapping[str, str]] | None:
        """Output name and mapping of a value-map transform."""
        if self.transform and self.transform.type == VALUE_TRANSFORM:
            return self.transform.output or f"{self.name}_transformed", self.transform.values
        return None

    def json_fields(self) -> tuple[JsonField, ...]:
        if self.transform and self.transform.type == JSON_TRANSFORM:
            return self.transform.fields
        return ()

    def derived(self) -> tuple[ColumnSpec, ...]:
        """The extra mart columns the transform adds; they are always nullable."""
        extra = tuple(ColumnSpec(f.output, type=f.type or "text", is_nullable=True) for f in self.json_fields())
        mapped = self.value_map()
        if mapped:
            extra += (ColumnSpec(mapped[0], type="text", is_nullable=True),)
        return extra


@dataclass(frozen=True, order=True)
class TableKey:
    """Identity of a source table."""

    source: str
    schema: str
    table: str

    def __str__(self) -> str:
        return f"{self.source}.{self.schema}.{self.table}"


@dataclass(frozen=True)
class TableSpec:
    """One selected table."""

    key: TableKey
    columns: tuple[ColumnSpec, ...]

    def mart_columns(self) -> tuple[ColumnSpec, ...]:
        """Columns this table contributes: selected ones first, then the transform outputs."""
        clean, _ = collapse_duplicates(self.columns + tuple(d for c in self.columns for d in c.derived()))
        return clean

    def live_columns(self) -> tuple[ColumnSpec, ...]:
        """The selected columns without deleted ones, which are never read."""
        return tuple(c for c in self.columns if not c.is_deleted)

    def conflict_columns(self) -> tuple[str, ...]:
        """Mart columns that identify the rows an event of this table belongs to."""
        names: dict[str, None] = {}
        for c in self.live_columns():
            if c.is_update_key:
                names[c.target] = None
                if c.view_key:
                    names[c.view_key] = None
        return tuple(names)

    def written_columns(self) -> tuple[str, ...]:
        """Every mart column an event of this table can write."""
        live = TableSpec(self.key, self.live_columns())
        names = {c.target: None for c in live.mart_columns()}
        names.update({n: None for n in live.conflict_columns()})
        return tuple(names)


@dataclass(frozen=True)
class Endpoint:
    """One side of a join rule, named by the source column."""

    table: TableKey
    column: str


@dataclass(frozen=True)
class JoinRule:
    """An inner equi-join between two endpoints."""

    left: Endpoint
    right: Endpoint


@dataclass(frozen=True)
class MartSpec:
    """A mart: its name, the selected tables in order and the join rules."""

    name: str
    tables: tuple[TableSpec, ...]
    joins: tuple[JoinRule, ...] = ()

    @staticmethod
    def from_json(text: str | Mapping) -> MartSpec:
        raw = json.loads(text) if isinstance(text, str) else text
        tables = tuple(
            TableSpec(
                TableKey(source["name"], schema["name"], table["name"]),
                tuple(ColumnSpec.from_dict(c) for c in table.get("columns") or ()),
            )
            for source in raw.get("sources") or ()
            for schema in source.get("schemas") or ()
            for table in schema.get("tables") or ()
        )
        rules = [_read_rule(j["inner"], tables) for j in raw.get("joins") or () if j and j.get("inner")]
        return MartSpec((raw.get("view_name") or "").lower(), tables, tuple(rules))

    def to_dict(self) -> dict:
        sources: dict[str, dict[str, list]] = {}
        for t in self.tables:
            entry = {"name": t.key.table, "columns": [c.to_dict() for c in t.columns]}
            sources.setdefault(t.key.source, {}).setdefault(t.key.schema, []).append(entry)

        def end(e: Endpoint) -> dict:
            return {"source": e.table.source, "schema": e.table.schema, "table": e.table.table, "column": e.column}

        return {
            "view_name": self.name,
            "sources": [
                {"name": s, "schemas": [{"name": n, "tables": t} for n, t in schemas.items()]}
                for s, schemas in sources.items()
            ],
            "joins": [{"inner": {"left": end(r.left), "right": end(r.right)}} for r in self.joins],
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False)

    def table(self, key: TableKey) -> TableSpec:
        for t in self.tables:
            if t.key == key:
                return t
        raise SpecError(f"table {key} is not part of mart {self.name}")

    def with_tables(self, tables: Iterable[TableSpec]) -> MartSpec:
        return replace(self, tables=tuple(tables))


def _read_rule(raw: Mapping, tables: tuple[TableSpec, ...]) -> JoinRule:
    """Read a rule in the two-endpoint form or in the older main-table form."""
    if "left" in raw:
        return JoinRule(
            *(
                Endpoint(TableKey(raw[s]["source"], raw[s]["schema"], raw[s]["table"]), raw[s]["column"])
                for s in ("left", "right")
            )
        )
    if not tables:
        raise SpecError("a join rule needs tables")
    main = raw.get("main_table")
    found = [t.key for t in tables if t.key.table == main] if main else [tables[0].key]
    if not found:
        raise SpecError(f"main table {main} is not part of the mart")
    right = TableKey(raw["source"], raw["schema"], raw["table"])
    return JoinRule(Endpoint(found[0], raw["column_first"]), Endpoint(right, raw["column_second"]))


def collapse_duplicates(columns: Iterable[ColumnSpec]) -> tuple[tuple[ColumnSpec, ...], tuple[str, ...]]:
    """Keep the first column of every mart name; also return the names seen again."""
    first: dict[str, ColumnSpec] = {}
    again: list[str] = []
    for c in columns:
        if c.target in first:
            again.append(c.target)
        else:
            first[c.target] = c
    return tuple(first.values()), tuple(again)


def reject_duplicates(table: TableSpec) -> None:
    """A scan may not select two columns under one name."""
    _, again = collapse_duplicates(table.columns)
    if again:
        raise SpecError(f"columns with equal names in {table.key}: {', '.join(again)}")


def _same(a: str, b: str) -> bool:
    return a.lower() == b.lower()


def rename_column(spec: MartSpec, key: TableKey, old: str, new: str) -> MartSpec:
    """Point a spec column at its new source name; names compare without case."""

    def matches(k: TableKey) -> bool:
        return _same(k.source, key.source) and _same(k.schema, key.schema) and _same(k.table, key.table)

    if not any(matches(t.key) for t in spec.tables):
        raise SpecError(f"table {key} not found in mart {spec.name}")
    done = False

    def renamed(columns: tuple[ColumnSpec, ...]) -> Iterator[ColumnSpec]:
        nonlocal done
        for c in columns:
            hit = not done and _same(c.name, old)
            done = done or hit
            yield replace(c, name=new) if hit else c

    tables = [replace(t, columns=tuple(renamed(t.columns))) if matches(t.key) else t for t in spec.tables]
    if not done:
        raise SpecError(f"column {old} not found in mart {spec.name}")
    return spec.with_tables(tables)


def remove_columns(spec: MartSpec, key: TableKey, names: Iterable[str]) -> tuple[MartSpec, bool]:
    """Drop columns of exactly this table; also tell whether anything changed."""
    gone = {n.lower() for n in names}
    tables = [
        replace(t, columns=tuple(c for c in t.columns if c.name.lower() not in gone)) if t.key == key else t
        for t in spec.tables
    ]
    changed = spec.with_tables(tables)
    return changed, changed != spec


def unique_names(names: Iterable[str]) -> list[str]:
    """Names without case-insensitive repeats, first spelling kept."""
    seen: dict[str, str] = {}
    for n in names:
        seen.setdefault(n.lower(), n)
    return list(seen.values())
