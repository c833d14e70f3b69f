"""Query registration and the pieces the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkmart.files import Files
from sparkmart.plans.spec import ColumnSpec, Endpoint, JoinRule, MartSpec, TableKey, TableSpec
from sparkmart.session import tune
from sparkmart.sources.catalog import FileSource, FrameSource, SourceCatalog

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SHOP, CRM = "shop", "crm"
PUBLIC = "public"


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark, Files(spark, sf_dir).size(sf_dir)), sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def catalog(spark: SparkSession, sf_dir: str, **frames: DataFrame) -> SourceCatalog:
    """Both file sources, plus a source ``derived`` with the given frames as its tables."""
    files = FileSource(sf_dir + "/{table}.parquet")
    derived = FrameSource({f"{PUBLIC}.{name}": df for name, df in frames.items()})
    return SourceCatalog(spark, {SHOP: files, CRM: files, "derived": derived})


def table_key(name: str, source: str = SHOP) -> TableKey:
    return TableKey(source, PUBLIC, name)


def column(name: str, alias: str = "", **facts) -> ColumnSpec:
    return ColumnSpec(name, alias=alias, is_nullable=facts.pop("is_nullable", True), **facts)


def table(name: str, *columns: ColumnSpec | str, source: str = SHOP) -> TableSpec:
    return TableSpec(table_key(name, source), tuple(column(c) if isinstance(c, str) else c for c in columns))


def on(left: str, right: str, left_source: str = SHOP, right_source: str = SHOP) -> JoinRule:
    """A join rule from two ``table.column`` texts."""

    def end(text: str, source: str) -> Endpoint:
        name, col = text.split(".")
        return Endpoint(table_key(name, source), col)

    return JoinRule(end(left, left_source), end(right, right_source))


def mart(name: str, *tables: TableSpec, joins: tuple[JoinRule, ...] = ()) -> MartSpec:
    return MartSpec(name, tables, joins)
