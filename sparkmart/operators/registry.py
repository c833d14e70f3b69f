"""The mart registry: one JSON spec per row ``(id, schema_view)``, and what can be asked of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmart.errors import NotFound
from sparkmart.functions.types import row_type
from sparkmart.plans.spec import MartSpec
from sparkmart.session import local_frame
from sparkmart.sources.change_log import topic_name
from sparkmart.store import TableStore


_TEXT, _FLAG, _LONG = T.StringType(), T.BooleanType(), T.LongType()
_TEXT_MAP = T.MapType(_TEXT, _TEXT)

_MAPPING = row_type(
    mapping=_TEXT_MAP,
    alias_new_column_transform=_TEXT,
    mapping_json=T.ArrayType(row_type(mapping=_TEXT_MAP, type_field=_TEXT)),
)
_COLUMN = row_type(
    name=_TEXT,
    alias=_TEXT,
    type=_TEXT,
    data_type=_TEXT,
    udt_name=_TEXT,
    char_max_len=_LONG,
    num_precision=_LONG,
    num_scale=_LONG,
    is_update_key=_FLAG,
    view_key=_TEXT,
    transform=row_type(type=_TEXT, mapping=_MAPPING),
)
_TABLE = row_type(name=_TEXT, columns=T.ArrayType(_COLUMN))
_SCHEMA = row_type(name=_TEXT, tables=T.ArrayType(_TABLE))
_SOURCE = row_type(name=_TEXT, schemas=T.ArrayType(_SCHEMA))
VIEW = row_type(view_name=_TEXT, sources=T.ArrayType(_SOURCE))

REGISTRY = row_type(id=_LONG, schema_view=_TEXT)
_LOG = row_type(id=_LONG, schema_view=_TEXT, version=_LONG)


def parsed(registry: DataFrame) -> DataFrame:
    """``(id, v)`` with the spec as a struct."""
    return registry.select("id", F.from_json("schema_view", VIEW).alias("v"))


def _tables(registry: DataFrame) -> DataFrame:
    """``(view_id, view, db, schema, table, columns)``, one row per selected table."""
    return (
        parsed(registry)
        .select("id", "v.view_name", F.explode("v.sources").alias("s"))
        .select("id", "view_name", F.col("s.name").alias("db"), F.explode("s.schemas").alias("c"))
        .select("id", "view_name", "db", F.col("c.name").alias("schema"), F.explode("c.tables").alias("t"))
        .select(
            F.col("id").alias("view_id"),
            F.lower("view_name").alias("view"),
            "db",
            "schema",
            F.col("t.name").alias("table"),
            F.col("t.columns").alias("columns"),
        )
    )


def routes(registry: DataFrame) -> DataFrame:
    """``(view_id, view, db, schema, table)``: which mart uses which table."""
    return _tables(registry).drop("columns")


def topics(registry: DataFrame) -> DataFrame:
    """The distinct change topics of all registered tables."""
    tables = routes(registry).select("db", "schema", "table").distinct()
    return tables.select(topic_name(F.col("db"), F.col("schema"), F.col("table")).alias("topic"))


def summary(registry: DataFrame) -> DataFrame:
    """``(id, name, source_count, table_count)`` of every mart, the newest first."""
    per_source = F.transform(
        "v.sources",
        lambda s: F.aggregate(s["schemas"], F.lit(0), lambda n, c: n + F.coalesce(F.array_size(c["tables"]), F.lit(0))),
    )
    return parsed(registry).select(
        "id",
        F.lower("v.view_name").alias("name"),
        F.coalesce(F.array_size("v.sources"), F.lit(0)).alias("source_count"),
        F.coalesce(F.aggregate(per_source, F.lit(0), lambda n, k: n + F.coalesce(k, F.lit(0))), F.lit(0)).alias(
            "table_count"
        ),
    ).orderBy(F.desc("id"))


def views_using(registry: DataFrame, db: str, schema: str, table: str) -> DataFrame:
    """``(id, name)`` of the marts that select a table."""

    def named(item, name: str):
        return item["name"] == F.lit(name)

    uses = F.exists(
        "v.sources",
        lambda s: named(s, db)
        & F.exists(
            s["schemas"], lambda c: named(c, schema) & F.exists(c["tables"], lambda t: named(t, table))
        ),
    )
    return parsed(registry).where(uses).select("id", F.lower("v.view_name").alias("name"))


def spec_columns(registry: DataFrame) -> DataFrame:
    """One row per selected column: ``(view_id, db, schema, table, column, target, type facts…)``."""
    return (
        _tables(registry)
        .select("view_id", "db", "schema", "table", F.explode("columns").alias("c"))
        .select(
            "view_id",
            "db",
            "schema",
            "table",
            F.lower("c.name").alias("column"),
            F.lower(F.coalesce(F.nullif("c.alias", F.lit("")), "c.name")).alias("target"),
            F.nullif(F.lower(F.trim(F.coalesce("c.udt_name", "c.data_type", "c.type"))), F.lit("")).alias("type"),
        )
    )


def extra_targets(registry: DataFrame) -> DataFrame:
    """Mart columns a spec creates beyond the selected ones: ``(view_id, target)``.

    Transform outputs, view keys and the stamps of a versioned mart.
    """
    columns = _tables(registry).select("view_id", F.explode("columns").alias("c"))
    mapping = F.col("c.transform.mapping")
    kind = F.col("c.transform.type")
    flattened = F.when(
        kind == "JSON", F.flatten(F.transform(mapping["mapping_json"], lambda m: F.map_values(m["mapping"])))
    )
    mapped = F.when(
        kind == "FieldTransform",
        F.array(
            F.coalesce(
                F.nullif(mapping["alias_new_column_transform"], F.lit("")), F.concat("c.name", F.lit("_transformed"))
            )
        ),
    )
    view_key = F.array(F.col("c.view_key"))
    stamps = F.array(F.lit("updated_at"), F.lit("_seq"))
    none = F.array().cast("array<string>")
    names = F.concat(*[F.coalesce(a, none) for a in (flattened, mapped, view_key, stamps)])
    return (
        columns.select("view_id", F.explode(names).alias("target"))
        .where(F.coalesce(F.col("target"), F.lit("")) != "")
        .select("view_id", F.lower("target").alias("target"))
        .distinct()
    )


def newest(log: DataFrame) -> DataFrame:
    """``(id, schema_view)``: every spec as its newest version has it. The aggregate combines on the map side."""
    return log.groupBy("id").agg(F.max_by("schema_view", "version").alias("schema_view"))


def using(registry: DataFrame, tables: DataFrame) -> DataFrame:
    """The specs that select any of the tables ``(db, schema, table)``."""
    hit = routes(registry).join(tables, ["db", "schema", "table"], "left_semi").select(F.col("view_id").alias("id")).distinct()
    return registry.join(hit, "id", "left_semi")


class Registry:
    """The registry kept in a table store, as a log: a changed spec is one more row, and the newest row counts."""

    TABLE = "mart_registry"

    def __init__(self, store: TableStore):
        self.store = store
        store.create(self.TABLE, _LOG)

    def frame(self) -> DataFrame:
        return newest(self.store.read(self.TABLE))

    def _append(self, view_id: int, spec: MartSpec) -> None:
        version = self.store.version(self.TABLE).number + 1
        self.store.append_small(self.TABLE, local_frame(self.store.spark, [(view_id, spec.to_json(), version)], _LOG))

    def add(self, spec: MartSpec) -> int:
        """Store a spec and return its id."""
        last = self.store.read(self.TABLE).agg(F.max("id")).first()[0]
        self._append((last or 0) + 1, spec)
        return (last or 0) + 1

    def get(self, view_id: int) -> MartSpec:
        row = newest(self.store.read(self.TABLE).where(F.col("id") == view_id)).first()
        if row is None:
            raise NotFound(f"no mart with id {view_id}")
        return MartSpec.from_json(row["schema_view"])

    def update(self, view_id: int, spec: MartSpec) -> None:
        """Replace a spec; no other spec is read or written."""
        self.get(view_id)
        self._append(view_id, spec)

    def specs(self, tables: DataFrame | None = None) -> dict[int, MartSpec]:
        """Specs by id, for building plans: all of them, or those that select any of the tables ``(db, schema, table)``."""
        rows = self.frame() if tables is None else using(self.frame(), tables)
        return {r["id"]: MartSpec.from_json(r["schema_view"]) for r in rows.toLocalIterator()}
