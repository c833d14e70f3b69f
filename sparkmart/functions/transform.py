"""The two column transforms — value map and JSON flatten — and the staging projection built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmart.errors import SpecError
from sparkmart.functions.convert import to_mart_type
from sparkmart.functions.types import mart_type, spark_type
from sparkmart.plans.spec import ColumnSpec, JsonField, TableSpec, reject_duplicates

_TEXT_MAP = T.MapType(T.StringType(), T.StringType())


def map_value(c: Column, mapping) -> Column:
    """Look a value up by its text; a value without an entry gives NULL."""
    if not mapping:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c.cast("string"))


def json_text(c: Column) -> Column:
    """A JSON object's top-level fields as a text map; text that is no object gives NULL."""
    return F.from_json(c, _TEXT_MAP)


def json_field(c: Column, key: str) -> Column:
    """A top-level field as text (objects and arrays as JSON text), NULL when missing."""
    return F.try_element_at(json_text(c), F.lit(key))


def json_field_compact(c: Column, key: str) -> Column:
    """A top-level string field; a missing or non-string one gives the empty string."""
    typed = F.from_json(c, T.MapType(T.StringType(), T.VariantType()))
    value = F.try_element_at(typed, F.lit(key))
    is_text = F.schema_of_variant(value) == "STRING"
    return F.when(is_text, F.try_variant_get(value, "$", "string")).otherwise(F.lit(""))


def _flatten(c: Column, f: JsonField, profile: str, on_bad_cast: str) -> Column:
    if profile == "compact":
        return json_field_compact(c, f.key)
    target = ColumnSpec(f.output, type=f.type or "text", is_nullable=True)
    return to_mart_type(json_field(c, f.key), target, profile, on_bad_cast)


def _not_null(c: Column, table: TableSpec, col: ColumnSpec) -> Column:
    problem = F.lit(f"null value in column {col.target} of {table.key}")
    return F.when(c.isNull(), F.raise_error(problem)).otherwise(c)


def staged_columns(
    df: DataFrame,
    table: TableSpec,
    profile: str = "full",
    on_bad_cast: str = "fail",
    check_nulls: bool = False,
) -> dict[str, Column]:
    """Mart column name → expression over the source table, in mart order.

    A deleted column is never read: it stays as typed NULLs. With ``check_nulls`` a NULL in a column
    declared not nullable fails the load.
    """
    reject_duplicates(table)
    have = {c.lower() for c in df.columns}
    out: dict[str, Column] = {}
    for col in table.columns:
        if col.is_deleted:
            kept = spark_type(col, profile) if col.has_type else T.StringType()
            out[col.target] = F.lit(None).cast(kept)
            continue
        if col.name.lower() not in have:
            raise SpecError(f"column {col.name} is not in {table.key}")
        value = to_mart_type(F.col(f"`{col.name}`"), col, profile, on_bad_cast)
        out[col.target] = _not_null(value, table, col) if check_nulls and not col.is_nullable else value
    for col in table.columns:
        source = F.lit(None).cast("string") if col.is_deleted else F.col(f"`{col.name}`")
        for f in col.json_fields():
            out.setdefault(f.output, _flatten(source.cast("string"), f, profile, on_bad_cast))
        mapped = col.value_map()
        if mapped:
            out.setdefault(mapped[0], map_value(source, mapped[1]))
    return out


def stage(df: DataFrame, table: TableSpec, **options) -> DataFrame:
    """The staged form of a table: selected, aliased, typed and transformed columns."""
    return df.select(*(c.alias(n) for n, c in staged_columns(df, table, **options).items()))


def align(df: DataFrame, table: TableSpec) -> DataFrame:
    """The table's mart columns that the data has, sorted by name; an error when there are none."""
    wanted = {c.target for c in table.mart_columns()}
    shared = sorted(n for n in df.columns if n in wanted)
    if not shared:
        raise SpecError(f"no column to load for {table.key}")
    return df.select(*shared)


def staging_schema(table: TableSpec, profile: str = "full") -> T.StructType:
    """The typed schema of the staged table; repeated names collapse to the first."""
    return T.StructType(
        [
            T.StructField(
                c.target,
                spark_type(c, profile) if c.has_type else T.StringType(),
                c.is_nullable,
                {"mart_type": mart_type(c).ddl, "primary_key": c.is_primary_key},
            )
            for c in table.mart_columns()
        ]
    )
