"""Exact top-k search by distributed histogram selection.

Every query is scored against every vector, block by block. No score is kept: a round counts the scores into a
histogram per query, over the range that is known to hold the k-th highest one. Counts of all blocks are
summed, the bin with the k-th score becomes the next range, and after a few rounds the range is that score.
A last pass gives the scores above it, and of those equal to it the ones with the smallest ids that are still needed.

A block reports its bins from the top down to the one with its own k-th score: the k-th score overall is never
lower. Neither side is broadcast, whatever Spark takes their sizes for: blocks of queries meet blocks of vectors by a
sort-merge join on the block number.
Ranges are powers of two, so bins are shifts. Scores are exact: products of matrices in single or double
precision as far as the sums fit, else in whole numbers.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; vectors of
different lengths have no score, empty ones score 0 with each other; rows that repeat an id are rows of their
own, each of them a query where the id is one; a null id is no query and comes last among equal scores; scores beyond
2**62 count as 2**62; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkmart.llm.common import numbered, query, read, runs
from sparkmart.session import settle

_BITS = 62
_MOST = (1 << _BITS) - 1
_NONE = -(1 << _BITS) - 1  # below every score


@dataclass(frozen=True)
class Settings:
    """``k`` scores per query; rows in a block of queries and of vectors; ``bin_bits``: a histogram has 2**bin_bits bins."""

    k: int = 20
    scale: int = 64
    query_rows: int = 1024
    block_rows: int = 8192
    bin_bits: int = 10


def _whole(values: np.ndarray, size: int, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * values.reshape(-1, size)), -(2.0**_BITS), 2.0**_BITS)


def _packed(rows: DataFrame, block_rows: int, id_kind: str, s: Settings) -> DataFrame:
    """A row per block and vector length: row ``numbers`` and ``ids`` of its vectors, by id, and their ``matrix``."""
    dealt = rows.withColumn("block", F.floor(F.col("at") / block_rows)).withColumn("size", F.size("vector"))
    dealt = dealt.select("block", "size", "n", "id", "vector").repartition("block")
    dealt = dealt.sortWithinPartitions("block", "size", F.col("id").asc_nulls_last(), "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 2):
            group = group.combine_chunks()
            block, size = group.column("block")[0].as_py(), group.column("size")[0].as_py()
            flat = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            whole = _whole(flat, size, s.scale) if size else np.zeros((group.num_rows, 0))
            norm = float(np.sqrt((whole * whole).sum(1)).max())
            small = np.abs(whole).max(initial=0) < 1 << 24
            listed = lambda name: pa.array([group.column(name).to_pylist()], pa.list_(group.schema.field(name).type))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([size], pa.int32()), listed("n"), listed("id"), pa.array([norm]),
                 pa.array([small]), pa.array([whole.astype(np.float32 if small else np.float64).tobytes()], pa.binary())],
                names=["block", "size", "numbers", "ids", "norm", "small", "matrix"],
            )

    kinds = f"block long, size int, numbers array<long>, ids array<{id_kind}>, norm double, small boolean, matrix binary"
    return dealt.mapInArrow(run, kinds)


def _matrix(data: bytes, small: bool, size: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if small else np.float64).reshape(rows, size)


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers given as floats, exactly."""
    bound = left.shape[1] * float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0))
    if bound < 1 << 24:
        return (left.astype(np.float32) @ right.astype(np.float32).T).astype(np.int32)
    if bound < 1 << 53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    ints = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    exact = ints(left).dot(ints(right).T) if left.shape[1] else np.zeros((len(left), len(right)), object)
    return np.clip(exact, -_MOST, _MOST).astype(np.int64)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Per pair of blocks and slice of queries: the queries' place and state, ids, scores; a query's own row is masked."""
    for batch in batches:
        for row in batch.to_pylist():
            numbers, rows = np.array(row["numbers"], np.int64), len(row["numbers"])
            queries = np.array(row["q_numbers"], np.int64)
            right = _matrix(row["matrix"], row["small"], row["size"], rows)
            left = _matrix(row["q_matrix"], row["q_small"], row["size"], len(queries))
            order = np.argsort(numbers)
            state = {k: np.array(row["state"][k], np.int64) for k in ("lo", "bits", "need")}
            for at in range(0, len(queries), 256):
                part = slice(at, at + 256)
                found = scores(left[part], right)
                place = np.minimum(np.searchsorted(numbers, queries[part], sorter=order), rows - 1)
                own = numbers[order[place]] == queries[part]
                other = np.ones(found.shape, bool)
                other[np.flatnonzero(own), order[place[own]]] = False
                yield row, part, {k: v[part] for k, v in state.items()}, found, other


def _pairs(queries: DataFrame, state: DataFrame, blocks: DataFrame, count: int) -> DataFrame:
    """Every block of queries, with its queries' state, next to every block of vectors of the same length.

    Spark judges matrices by the size of their files, and blocks of queries by that of a single copy, so without the
    hints it would send all copies through the driver.
    """
    order = F.sort_array(F.collect_list(F.struct("place", "lo", "bits", "need")))
    states = state.groupBy("block", "size").agg(order.alias("s"))
    state = F.struct(*[F.col(f"s.{k}").alias(k) for k in ("lo", "bits", "need")]).alias("state")
    states = states.select(F.col("block").alias("_block"), F.col("size").alias("_size"), state)
    asked = queries.join(states.hint("merge"), (F.col("block") == F.col("_block")) & (F.col("size") == F.col("_size")))
    asked = asked.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("block"),
        "size",
        *[F.col(c).alias(f"q_{c}") for c in ("numbers", "ids", "matrix", "small")],
        F.col("block").alias("q_block"),
        "state",
    )
    return asked.join(blocks.drop("norm").hint("merge"), ["block", "size"])


def _start(queries: DataFrame, norm: float) -> DataFrame:
    """The first range of every query: no score lies beyond the product of the lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                count = len(row["numbers"])
                whole = _matrix(row["matrix"], row["small"], row["size"], count).astype(np.float64)
                most = np.sqrt((whole * whole).sum(1)) * norm * (1 + 1e-9) + 2
                half = np.minimum(np.ceil(np.log2(most)).astype(np.int64), _BITS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(count, row["block"], np.int64)), pa.array(np.full(count, row["size"], np.int32)),
                     pa.array(np.arange(count, dtype=np.int32)), pa.array(-(np.int64(1) << half)), pa.array(half + 1)],
                    names=["block", "size", "place", "lo", "bits"],
                )

    return queries.mapInArrow(run, "block long, size int, place int, lo long, bits long")


def _histograms(pairs: DataFrame, s: Settings) -> DataFrame:
    """``bin`` and ``count`` by query (``q_block``, ``size``, ``place``), for every pair of blocks."""
    bins = 1 << s.bin_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, part, state, found, other in _scored(batches):
            shift, range_bits = np.maximum(state["bits"] - s.bin_bits, 0), np.minimum(state["bits"], s.bin_bits)
            # Scores beyond the range are below it, or above it and counted in an earlier round.
            rows, columns = np.nonzero(other & (found >= state["lo"][:, None]))
            at = (found[rows, columns].astype(np.int64) - state["lo"][rows]) >> shift[rows]
            within = (at >= 0) & (at < np.int64(1) << range_bits[rows])
            counts = np.bincount(rows[within] * bins + at[within], minlength=len(found) * bins).reshape(-1, bins)
            above = counts[:, ::-1].cumsum(1)[:, ::-1] - counts
            rows, kept = np.nonzero((counts > 0) & (above < state["need"][:, None]))
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, row["q_block"], np.int64)), pa.array(np.full(n, row["size"], np.int32)),
                 pa.array((rows + part.start).astype(np.int32)), pa.array(kept.astype(np.int64)), pa.array(counts[rows, kept])],
                names=["q_block", "size", "place", "bin", "count"],
            )

    return pairs.mapInArrow(run, "q_block long, size int, place int, bin long, count long")


def _narrowed(state: DataFrame, histograms: DataFrame, s: Settings) -> DataFrame:
    """The ranges one round on: the bin with the score that is still needed, and what is needed from within it.

    A query with fewer scores than it needs keeps all of them: its range ends below every score.
    """
    summed = histograms.groupBy("q_block", "size", "place", "bin").agg(F.sum("count").alias("count"))
    down = Window.partitionBy("q_block", "size", "place").orderBy(F.desc("bin"))
    summed = summed.withColumn("until", F.sum("count").over(down))
    key = [F.col("q_block") == F.col("block"), F.col("_size") == F.col("size"), F.col("_place") == F.col("place")]
    summed = summed.withColumnsRenamed({"size": "_size", "place": "_place"})
    both = state.join(summed, [*key, F.col("until") >= F.col("need"), F.col("until") - F.col("count") < F.col("need")], "left")
    shift = F.greatest(F.col("bits") - s.bin_bits, F.lit(0))
    few = F.col("bin").isNull()
    step = F.expr(f"bin * shiftleft(1L, cast(greatest(bits - {s.bin_bits}, 0) as int))")
    return both.select(
        "block",
        "size",
        "place",
        F.when(few, F.lit(_NONE)).otherwise(F.col("lo") + step).alias("lo"),
        F.when(few, F.lit(0)).otherwise(shift).cast("long").alias("bits"),
        F.when(few, F.lit(0)).otherwise(F.col("need") - (F.col("until") - F.col("count"))).cast("long").alias("need"),
    )


def _selected(pairs: DataFrame, id_kind: str, s: Settings) -> DataFrame:
    """Of every pair of blocks the scores above a query's k-th, and the first of those equal to it."""
    id_type = to_arrow_type(pairs.schema["ids"].dataType.elementType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, part, state, found, other in _scored(batches):
            rows, columns = np.nonzero(other & (found >= state["lo"][:, None]))
            score = found[rows, columns].astype(np.int64)
            tie = score == state["lo"][rows]
            # Vectors of a block come by id, so a query's first ties are those with the smallest ids.
            before = np.concatenate(([0], np.cumsum(tie)))
            first = np.searchsorted(rows, rows)
            keep = ~tie | (before[:-1] - before[first] < state["need"][rows])
            rows, columns, score = rows[keep], columns[keep], score[keep]
            of = lambda ids, at: pa.array(ids, id_type).take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), row["q_block"], np.int64)), pa.array(np.full(len(rows), row["size"], np.int32)),
                 pa.array((rows + part.start).astype(np.int32)), of(row["q_ids"], rows + part.start), of(row["ids"], columns), pa.array(score)],
                names=["q_block", "size", "place", "query_id", "id", "score"],
            )

    return pairs.mapInArrow(run, f"q_block long, size int, place int, query_id {id_kind}, id {id_kind}, score long")


def top_scores(vectors: DataFrame, asked: Column, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """``query_id``, ``rank``, ``id`` and ``score``: the highest scores of every row for which ``asked`` holds."""
    s = settings
    kind = vectors.schema[id_col].dataType.simpleString()
    vector = F.col(vector_col).cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(vector_col).isNotNull() & fine)
    rows = rows.select(F.col(id_col).alias("id"), vector.alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = numbered(rows.withColumn("_in", F.monotonically_increasing_id()), F.col("_in"))
    rows = settle(rows.select("n", "id", "vector", "asked"), "vectors")
    blocks = settle(_packed(rows.withColumn("at", F.col("n")), s.block_rows, kind, s), "blocks")
    queries = numbered(rows.where("asked").drop("asked"), F.col("n"), name="at")
    queries = settle(_packed(queries, s.query_rows, kind, s), "queries")
    count, norm = blocks.agg(F.max("block"), F.max("norm")).first()
    if count is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score long")
    state = settle(_start(queries, norm).withColumn("need", F.lit(s.k).cast("long")), "ranges")
    while (state.agg(F.max("bits")).first()[0] or 0) > 0:
        pairs = _pairs(queries, state, blocks, count + 1)
        state = settle(_narrowed(state, _histograms(pairs, s), s), "ranges")
    found = _selected(_pairs(queries, state, blocks, count + 1), kind, s)
    best = Window.partitionBy("q_block", "size", "place").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= s.k)
    return found.select("query_id", "rank", "id", "score")


@query("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS whole FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.whole, v.whole) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
  FROM s)
SELECT * FROM r WHERE "rank" <= 20
""")
def op13_topk_search(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return top_scores(vectors, F.col("vec_id") % 20 == 0).withColumnRenamed("id", "vec_id")
