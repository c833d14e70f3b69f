"""What the operators of this package share: text rules, row identity, registration and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmart.files import Files
from sparkmart.session import settle, tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The white space of all text rules, as regular-expression class members and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


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


def small_batches(spark: SparkSession) -> None:
    """Send rows with texts to Python a thousand at a time, so that a worker's memory does not grow with them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def bounded(batches: Iterator[pa.RecordBatch], column: str, rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut by rows and by the bytes of a text or binary column, so that what is made of one stays small."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        begin = held = 0
        for k, length in enumerate(lengths):
            if k > begin and (k - begin >= rows or held + length > size):
                yield batch.slice(begin, k - begin)
                begin, held = k, 0
            held += length
        if begin < len(lengths):
            yield batch.slice(begin)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; ``lower`` does just that to text of ASCII characters alone."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def _forest(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` of a bounded number of links, joined up in one task."""
    kind = links.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def root(x):
            while (up := above.setdefault(x, x)) != x:
                above[x] = above[up]
                x = above[x]
            return x

        schema = None
        for batch in batches:
            schema = batch.schema
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(x), root(y)
                above[max(x, y)] = min(x, y)
        if schema is not None:
            of = schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(list(above), of), pa.array([root(x) for x in list(above)], of)], names=["u", "component"])

    return links.coalesce(1).mapInArrow(run, f"u {kind}, component {kind}")


def _stars(links: DataFrame, mark: tuple) -> DataFrame:
    """The same of any number of links, by rounds of star contractions."""
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, the minima join as an input of their own, whose hot keys Spark can split.
        low = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large, "links")
        low = settle(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(low, "u")
        under = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        links = settle(small.select(under.alias("u"), F.col("m").alias("v")), "links")
        now = _mark(links)
        if now == mark:
            return links.groupBy("u").agg(F.min("v").alias("component"))
        mark = now


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(nodes: DataFrame, edges: DataFrame, in_one_task: int = 200_000) -> DataFrame:
    """The smallest node id reachable from each node.

    ``nodes`` has ``node``; ``edges`` has ``a`` and ``b``, in any direction, repeats allowed. Returns ``node``
    and ``component``. Up to ``in_one_task`` links are joined up in one task. More alternate the two star
    contractions: every node hangs its larger neighbours under its smallest one, then its smaller neighbours and
    itself under the smallest of them, until nothing changes, which takes about the square of the logarithm
    of the largest component rounds. Each step is a minimum per node, combined before the shuffle, and a join
    whose hot keys can be split; no neighbour list is ever gathered, the number of links never grows, and each round
    is written to the shared folder. Both ways give the same.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = settle(links, "links")
    mark = _mark(links)
    roots = settle(_forest(links) if mark[0] <= in_one_task else _stars(links, mark), "components")
    return nodes.join(roots, nodes["node"] == roots["u"], "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def numbered(df: DataFrame, *order: Column, name: str = "n") -> DataFrame:
    """Number all rows from 0 in the given order, with no task holding more than a range of them.

    Rows are sorted in range partitions and written with their place in the partition; the sizes of the
    partitions (one row each) then give where each begins.
    """
    place = F.monotonically_increasing_id()
    rows = settle(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place), "numbered"
    )
    part = F.shiftright("_place", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    begins = sizes.withColumn("_begin", F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    begins = settle(begins.select("_part", F.coalesce("_begin", F.lit(0)).alias("_begin")), "begins")
    return (
        rows.withColumn("_of", part)
        .join(begins, F.col("_of") == F.col("_part"))
        .withColumn(name, F.col("_begin") + F.col("_place").bitwiseAND((1 << 33) - 1))
        .drop("_of", "_part", "_begin", "_place")
    )


def let(value: Column, body) -> Column:
    """An expression of a value that is computed once, however often the expression names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sum(values: Column, block: int = 256) -> Column:
    """The sums of an array's elements before each element.

    Sums are taken per block and then over the blocks, so that the work of growing arrays stays small however
    long the array is. Sums that several elements read are computed once: inside a lambda an expression is
    evaluated for every element.
    """
    zero = F.array(F.lit(0).cast("long"))
    sums = lambda xs: F.aggregate(xs, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    numbers = lambda vs: F.coalesce(
        F.when(F.size(vs) > 0, F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / block).cast("int"))), F.array().cast("array<int>")
    )

    def shifted(inner: Column) -> Column:
        begins = sums(F.transform(inner, lambda s: F.element_at(s, -1)))
        return let(begins, lambda bs: F.flatten(F.transform(
            inner, lambda s, k: let(F.get(bs, k), lambda b: F.transform(F.slice(s, 1, F.size(s) - 1), lambda x: x + b))
        )))

    def by_blocks(vs: Column) -> Column:
        return let(F.transform(numbers(vs), lambda k: sums(F.slice(vs, k * block + 1, block))), shifted)

    return let(values, by_blocks)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows with equal leading columns, which come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        columns = [np.array(batch.column(k).to_pylist()) for k in range(keys)]
        change = np.zeros(max(batch.num_rows - 1, 0), bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            if begin == end:
                continue
            part = batch.slice(begin, end - begin)
            if held and any(held[0].column(k)[0] != part.column(k)[0] for k in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)
