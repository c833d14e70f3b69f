"""Source discovery over catalog DataFrames: schemas, tables, columns, column facts and the source tree.

A column catalog has one row per column:
``source, schema, table, column, ordinal, data_type, udt_schema, udt_name, is_nullable, char_max_len,
num_precision, num_scale, column_default, description``. Missing facets may be left out.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmart.functions.types import type_name
from sparkmart.operators.paging import paginate
from sparkmart.plans.spec import TableKey
from sparkmart.session import local_frame
from sparkmart.sources.catalog import JdbcSource, SourceCatalog

_TABLE = ("source", "schema", "table")

COLUMN_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("schema", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("is_nullable", T.BooleanType()),
    ]
)


def column_catalog(spark: SparkSession, catalog: SourceCatalog, keys: Iterable[TableKey]) -> DataFrame:
    """The column catalog of tables whose schema Spark knows; reads no data."""
    rows = [
        (k.source, k.schema, k.table, f.name, i, type_name(f.dataType), f.nullable)
        for k in keys
        for i, f in enumerate(catalog.table(k).schema.fields, 1)
    ]
    return local_frame(spark, rows, COLUMN_SCHEMA)


# Where PostgreSQL keeps the comments on columns.
_COMMENTS = """(
SELECT current_database() AS table_catalog, n.nspname AS table_schema, c.relname AS table_name,
       a.attname AS column_name, d.description
FROM pg_catalog.pg_description d
JOIN pg_catalog.pg_class c ON c.oid = d.objoid AND d.classoid = 'pg_catalog.pg_class'::regclass
JOIN pg_catalog.pg_namespace n ON n.oid = c.relnamespace
JOIN pg_catalog.pg_attribute a ON a.attrelid = c.oid AND a.attnum = d.objsubid) AS comments"""

_KEY = ("table_catalog", "table_schema", "table_name")


@dataclass(frozen=True)
class InformationSchema:
    """The views of an information schema that discovery reads, with the columns the standard gives them.

    ``descriptions`` is ``(table_catalog, table_schema, table_name, column_name, description)``. Without a
    ``source`` the frames may hold the views of many databases, and each database is a source of its own name.
    """

    columns: DataFrame
    key_usage: DataFrame
    constraints: DataFrame
    schemata: DataFrame
    descriptions: DataFrame | None = None
    source: str | None = None

    def _table(self) -> list:
        source = F.col("table_catalog") if self.source is None else F.lit(self.source)
        return [source.alias("source"), F.col("table_schema").alias("schema"), F.col("table_name").alias("table")]

    def column_catalog(self) -> DataFrame:
        """The column catalog with each column's database and description."""
        raw = self.columns
        if self.descriptions is not None:
            # Repeated comments of one column must not repeat the column.
            named = self.descriptions.groupBy(*_KEY, "column_name").agg(F.max("description").alias("description"))
            raw = raw.join(named, [*_KEY, "column_name"], "left")
        else:
            raw = raw.withColumn("description", F.lit(None).cast("string"))
        return raw.select(
            *self._table(),
            F.col("table_catalog").alias("database"),
            F.col("column_name").alias("column"),
            F.col("ordinal_position").alias("ordinal"),
            "data_type",
            "udt_schema",
            "udt_name",
            (F.col("is_nullable") == "YES").alias("is_nullable"),
            F.col("character_maximum_length").alias("char_max_len"),
            F.col("numeric_precision").alias("num_precision"),
            F.col("numeric_scale").alias("num_scale"),
            "column_default",
            "description",
        )

    def key_columns(self) -> DataFrame:
        return self.key_usage.select(*self._table(), F.col("column_name").alias("column"), "constraint_name").distinct()

    def table_constraints(self) -> DataFrame:
        return self.constraints.select(*self._table(), "constraint_name", "constraint_type").distinct()

    def schemas(self) -> DataFrame:
        """Every schema with its database, also those without tables."""
        source = F.col("catalog_name") if self.source is None else F.lit(self.source)
        return self.schemata.select(
            source.alias("source"), F.col("catalog_name").alias("database"), F.col("schema_name").alias("schema")
        ).distinct()

    def facts(self) -> DataFrame:
        """The column catalog with key flags."""
        return column_facts(self.column_catalog(), self.key_columns(), self.table_constraints())


def jdbc_information_schema(spark: SparkSession, source: str, jdbc: JdbcSource) -> InformationSchema:
    """The information schema of a database, one query per view; comments are read from PostgreSQL only."""

    def view(table: str) -> DataFrame:
        return spark.read.format("jdbc").option("url", jdbc.url).options(**jdbc.options).option("dbtable", table).load()

    standard = ("columns", "key_column_usage", "table_constraints", "schemata")
    comments = view(_COMMENTS) if jdbc.url.startswith("jdbc:postgresql") else None
    return InformationSchema(*(view(f"information_schema.{name}") for name in standard), comments, source)


def jdbc_column_catalog(spark: SparkSession, source: str, jdbc: JdbcSource) -> DataFrame:
    """The column catalog of a database, from its information schema."""
    return jdbc_information_schema(spark, source, jdbc).column_catalog()


def list_schemas(columns: DataFrame) -> DataFrame:
    """Schemas of each source, without the database's own.

    Takes a column catalog, or the schemas of an information schema, which also name those without tables.
    """
    own = F.col("schema").rlike("^pg_") | (F.col("schema") == "information_schema")
    return columns.where(~own).select("source", "schema").distinct()


def list_tables(columns: DataFrame, schema: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """One page of the tables of a schema, by name."""
    tables = columns.select(*_TABLE).distinct()
    if schema is not None:
        tables = tables.where(F.col("schema") == schema)
    return paginate(tables, ["table", "schema", "source"], page, size, default_size=20)


def shown_type(columns: DataFrame):
    """The type text shown to users: the element type of arrays, the real name of user-defined types."""
    data = F.upper("data_type")
    has_udt = F.length(F.coalesce("udt_name", F.lit(""))) > 0
    qualified = F.when(
        F.length(F.coalesce("udt_schema", F.lit(""))) > 0, F.concat_ws(".", "udt_schema", "udt_name")
    ).otherwise(F.col("udt_name"))
    return (
        F.when((data == "ARRAY") & has_udt, F.col("udt_name"))
        .when((data == "USER-DEFINED") & has_udt, qualified)
        .otherwise(F.col("data_type"))
    )


def column_facts(columns: DataFrame, key_usage: DataFrame, constraints: DataFrame) -> DataFrame:
    """Columns with primary-key, foreign-key and unique flags.

    ``key_usage`` is ``(source, schema, table, column, constraint_name)``, ``constraints`` is
    ``(source, schema, table, constraint_name, constraint_type)``. A column under several constraints
    keeps all its flags; tables are matched with their schema.
    """

    def under(kind: str, name: str):
        return F.max(F.col("constraint_type") == kind).alias(name)

    flags = (
        key_usage.join(constraints, [*_TABLE, "constraint_name"])
        .groupBy(*_TABLE, "column")
        .agg(under("PRIMARY KEY", "is_pk"), under("FOREIGN KEY", "is_fk"), under("UNIQUE", "is_unique"))
    )
    return columns.join(flags, [*_TABLE, "column"], "left").fillna(False, ["is_pk", "is_fk", "is_unique"])


def table_columns(columns: DataFrame, fields: Iterable[str] = ("column", "data_type")) -> DataFrame:
    """One row per table with its columns as an array in ordinal order (a table has at most ~1600)."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", *fields)))
    return columns.groupBy(*_TABLE).agg(
        F.transform(ordered, lambda c: F.struct(*[c[f].alias(f) for f in fields])).alias("columns")
    )


def source_tree(
    columns: DataFrame,
    fields: Iterable[str] = ("column", "data_type"),
    page: int = 1,
    size: int = 20,
) -> DataFrame:
    """One row per schema of each source with one page of its tables and their columns.

    The page bounds the tables of a schema, so no row grows with the size of the source. The tables of
    the page are picked on names alone, and every task keeps only the first names of a schema before the
    shuffle (Spark's group limit), so one large schema does not end up whole in one task.
    """
    start = (max(page, 1) - 1) * size
    in_schema = Window.partitionBy("source", "schema").orderBy("table")
    tables = (
        columns.select(*_TABLE)
        .distinct()
        .withColumn("_rank", F.row_number().over(in_schema))
        .where(F.col("_rank") <= start + size)
        .where(F.col("_rank") > start)
    )
    filled = table_columns(columns.join(tables, [*_TABLE], "left_semi"), fields)
    page_tables = F.array_sort(F.collect_list(F.struct(F.col("table").alias("name"), "columns")))
    return filled.groupBy("source", "schema").agg(page_tables.alias("tables"))


# What the assembly tells of a column, where the catalog knows it.
FACTS = ("column", "data_type", "is_nullable", "is_pk", "is_fk", "is_unique", "column_default", "description")


def source_assembly(
    facts: DataFrame,
    schemas: DataFrame,
    fields: Iterable[str] = FACTS,
    page: int = 1,
    size: int = 20,
    schema_page: int = 1,
    schema_size: int = 20,
) -> DataFrame:
    """One row per database: ``source``, ``database`` and its schemas, with their tables, with their columns.

    ``facts`` is a column catalog with flags, ``schemas`` is ``(source, database, schema)``. A schema without
    tables has an empty list. Both lists are paged, schemas in a database and tables in a schema, so a
    row is bounded by its pages however large a source is; the pages are picked on names alone.
    """
    start = (max(schema_page, 1) - 1) * schema_size
    rank = F.row_number().over(Window.partitionBy("source", "database").orderBy("schema"))
    own = list_schemas(schemas)
    shown = schemas.distinct().join(own, ["source", "schema"], "left_semi").withColumn("_rank", rank)
    shown = shown.where(F.col("_rank") <= start + schema_size).where(F.col("_rank") > start).drop("_rank")
    tree = source_tree(facts.join(shown, ["source", "schema"], "left_semi"), tuple(fields), page, size)
    filled = shown.join(tree, ["source", "schema"], "left")
    tables = F.coalesce("tables", F.array().cast(tree.schema["tables"].dataType))
    nested = F.array_sort(F.collect_list(F.struct(F.col("schema").alias("name"), tables.alias("tables"))))
    return filled.groupBy("source", "database").agg(nested.alias("schemas"))


def database_name(url):
    """The database a connection URL points to: its path without the leading slash."""
    return F.substring(F.try_parse_url(url, F.lit("PATH")), 2, 2_147_483_647)
