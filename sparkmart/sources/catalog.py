"""Named sources: where the tables of a spec are read from."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmart.errors import NotFound
from sparkmart.plans.spec import MartSpec, TableKey
from sparkmart.sources.extract import Extraction, equi_depth_bounds, range_conditions


@dataclass(frozen=True)
class FileSource:
    """Tables kept as files; ``path`` may use ``{schema}`` and ``{table}``.

    ``schemas`` gives the columns of tables in formats that do not carry them, as DDL by table name.
    """

    path: str
    format: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)
    schemas: Mapping[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession, key: TableKey) -> DataFrame:
        path = self.path.format(schema=key.schema, table=key.table)
        reader = spark.read.format(self.format).options(**self.options)
        if key.table in self.schemas:
            reader = reader.schema(self.schemas[key.table])
        return reader.load(path)


@dataclass(frozen=True)
class TableSource:
    """Tables of the session catalog, addressed as ``schema.table``."""

    prefix: str = ""

    def read(self, spark: SparkSession, key: TableKey) -> DataFrame:
        return spark.table(f"{self.prefix}`{key.schema}`.`{key.table}`")


# A whole number from any column, by the dialect in the URL.
_HASHES = {
    "postgresql": "abs(hashtext(cast({column} as text))::bigint)",
    "mysql": "crc32(cast({column} as char))",
    "sqlserver": "abs(cast(checksum({column}) as bigint))",
    "oracle": "ora_hash({column})",
}


# A sample of a table's key column, by the dialect in the URL.
_SAMPLES = {
    "postgresql": "SELECT {column} FROM {table} TABLESAMPLE SYSTEM ({percent})",
    "mysql": "SELECT {column} FROM {table} WHERE rand() * 100 < {percent}",
    "sqlserver": "SELECT {column} FROM {table} TABLESAMPLE ({percent} PERCENT)",
    "oracle": "SELECT {column} FROM {table} SAMPLE ({percent})",
}


@dataclass(frozen=True)
class JdbcSource:
    """Tables of a database, read in parallel parts of a key when one is named.

    ``partition_by`` maps a table name to its key column. A numeric key is read in ranges between its smallest and
    largest value, any other key by its hash. The number of parts follows the row count, ``rows_per_part``
    rows each; how many are read at a time is up to the cores of the session. Needs the database's driver jar on the class path.
    """

    url: str
    options: Mapping[str, str] = field(default_factory=dict)
    partition_by: Mapping[str, str] = field(default_factory=dict)
    rows_per_part: int = 500_000
    fetch_size: int = 10_000
    sample_rows: int = 200_000

    def _reader(self, spark: SparkSession):
        return spark.read.format("jdbc").option("url", self.url).options(**self.options)

    def _quoted(self, name: str) -> str:
        return f"`{name}`" if self.url.startswith("jdbc:mysql") else f'"{name}"'

    def _table(self, key: TableKey) -> str:
        return f"{self._quoted(key.schema)}.{self._quoted(key.table)}"

    def range_query(self, key: TableKey, column: str) -> str:
        c = self._quoted(column)
        return f"SELECT MIN({c}) AS lo, MAX({c}) AS hi, COUNT(*) AS n FROM {self._table(key)}"

    def parts(self, rows: int) -> int:
        return max(1, -(-rows // self.rows_per_part))

    def scan_options(self, key: TableKey, column: str, low, high, rows: int) -> dict[str, str]:
        return {
            "dbtable": self._table(key),
            "partitionColumn": column,
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(self.parts(rows)),
            "fetchsize": str(self.fetch_size),
        }

    def sample_query(self, key: TableKey, column: str, rows: int) -> str:
        """About ``sample_rows`` keys of a table; all of them where the dialect is unknown or the table small."""
        percent = 100 * self.sample_rows / max(rows, 1)
        found = next((q for d, q in _SAMPLES.items() if self.url.startswith(f"jdbc:{d}")), None)
        if found is None or percent >= 50:
            return f"SELECT {self._quoted(column)} FROM {self._table(key)}"
        return found.format(column=self._quoted(column), table=self._table(key), percent=f"{percent:.6f}")

    def equi_depth_conditions(self, spark: SparkSession, key: TableKey, column: str) -> list[str]:
        """A condition per part of about ``rows_per_part`` rows, cut at quantiles of the key."""
        rows = self._reader(spark).option("query", self.range_query(key, column)).load().first()["n"]
        keys = self._reader(spark).option("query", self.sample_query(key, column, rows)).load()
        return range_conditions(self._quoted(column), equi_depth_bounds(keys, keys.columns[0], self.parts(rows)))

    def read_conditions(self, spark: SparkSession, key: TableKey, conditions: Sequence[str]) -> DataFrame:
        """The rows of some conditions, each read over a connection of its own."""
        settings = {**self.options, "fetchsize": str(self.fetch_size)}
        return spark.read.jdbc(self.url, self._table(key), predicates=list(conditions), properties=settings)

    def extraction(self, spark: SparkSession, key: TableKey, column: str, path: str, wave: int = 64) -> Extraction:
        """A restartable copy of a table, read in parts of equal depth."""
        return Extraction(
            spark,
            path,
            lambda conditions: self.read_conditions(spark, key, conditions),
            lambda: self.equi_depth_conditions(spark, key, column),
            wave,
        )

    def hash_predicates(self, column: str, rows: int) -> list[str]:
        """One condition per part; together they cover every row once, rows without a key in the first."""
        number = next((h for d, h in _HASHES.items() if self.url.startswith(f"jdbc:{d}")), None)
        parts = self.parts(rows)
        if number is None or parts == 1:
            return ["1 = 1"]
        c = self._quoted(column)
        rest = f"mod({number.format(column=c)}, {parts})" if "sqlserver" not in self.url else f"{number.format(column=c)} % {parts}"
        return [f"{c} IS NULL OR {rest} = 0", *(f"{rest} = {i}" for i in range(1, parts))]

    def read(self, spark: SparkSession, key: TableKey) -> DataFrame:
        column = self.partition_by.get(key.table)
        reader = self._reader(spark).option("fetchsize", self.fetch_size)
        if not column:
            return reader.option("dbtable", self._table(key)).load()
        low, high, rows = self._reader(spark).option("query", self.range_query(key, column)).load().first()
        if low is not None and isinstance(low, (int, Decimal)):
            return self._reader(spark).options(**self.scan_options(key, column, low, high, rows)).load()
        return self.read_conditions(spark, key, self.hash_predicates(column, rows))


@dataclass(frozen=True)
class FrameSource:
    """Tables given as DataFrames, keyed by ``schema.table``."""

    frames: Mapping[str, DataFrame]

    def read(self, spark: SparkSession, key: TableKey) -> DataFrame:
        try:
            return self.frames[f"{key.schema}.{key.table}"]
        except KeyError:
            raise NotFound(f"no table {key.schema}.{key.table} in source {key.source}") from None


# Spark gives data of unknown size a size near the largest long.
_UNKNOWN_SIZE = 1 << 60


class SourceCatalog:
    """Source name → reader."""

    def __init__(
        self, spark: SparkSession, sources: Mapping[str, object], frames: Mapping[TableKey, DataFrame] | None = None
    ):
        self.spark = spark
        self.sources = dict(sources)
        self._frames = dict(frames or {})

    def opened(self, keys: Iterable[TableKey]) -> SourceCatalog:
        """This catalog with some tables opened, so that their files are listed only once."""
        return SourceCatalog(self.spark, self.sources, {k: self.table(k) for k in keys})

    def table(self, key: TableKey) -> DataFrame:
        if key in self._frames:
            return self._frames[key]
        if key.source not in self.sources:
            raise ValueError(f"unknown source {key.source}")
        return self.sources[key.source].read(self.spark, key)

    def size(self, key: TableKey) -> int | None:
        """The planner's size of a table in bytes, if it knows one."""
        size = int(str(self.table(key)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return size if size < _UNKNOWN_SIZE else None


def count_tables(catalog: SourceCatalog, keys: Iterable[TableKey]) -> DataFrame:
    """Row count of every table as one DataFrame ``(source, schema, table, rows)``."""
    counts = [
        catalog.table(k).agg(
            F.lit(k.source).alias("source"),
            F.lit(k.schema).alias("schema"),
            F.lit(k.table).alias("table"),
            F.count("*").alias("rows"),
        )
        for k in dict.fromkeys(keys)
    ]
    return reduce(DataFrame.unionByName, counts)


def count_spec_tables(catalog: SourceCatalog, spec: MartSpec) -> DataFrame:
    return count_tables(catalog, [t.key for t in spec.tables])
