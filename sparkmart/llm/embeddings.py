"""Embedding near-duplicates by E8 lattice hashing.

In every table, seeded random projections map a direction to blocks of 8 numbers, each decoded to the nearest
point of the scaled E8 lattice; the points together are the vector's cell. A vector also visits the cells
next to its own: minimal vectors of the lattice are added to its points, nearest cells first. Vectors that share a
cell, at least one of them at home there, are candidates; a bitmap of signs rules out those far from the
threshold, and the cosine in double precision decides.

Equal vectors are one class. Large cells are cut into blocks, and pairs of blocks are compared as matrices, so
that no task holds a whole cell. Only pairs of different vectors that pass the signs leave a task.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing;
vectors of different lengths do not link; rows that repeat an id are vectors of their own; labels and other
columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmart.llm.common import connected_components, numbered, query, read, runs, same
from sparkmart.session import settle


@dataclass(frozen=True)
class Settings:
    """At cosine 0.9 a table with these blocks, scale and visits finds half of the pairs, so eight miss 0.4 %.

    ``far_bits`` of ``sign_bits`` differing signs rule a pair out: six deviations above the mean at 0.9.
    """

    cosine: float = 0.9
    tables: int = 8
    blocks: int = 2
    scale: float = 2.0
    visits: int = 16
    nearest: int = 8
    sign_bits: int = 128
    far_bits: int = 43
    block_rows: int = 1024
    seed: int = 23


@lru_cache(maxsize=1)
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of one, or all entries of a half with an even number of minuses."""
    rows = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            row = np.zeros(8)
            row[i], row[j] = a, b
            rows.append(row)
    halves = (np.array(s) for s in itertools.product((0.5, -0.5), repeat=8))
    return np.array(rows + [h for h in halves if (h < 0).sum() % 2 == 0])


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: round, then turn the least certain entry if the sum is odd."""
    point = np.rint(y)
    odd = np.flatnonzero(point.sum(1) % 2 != 0)
    rest = y - point
    worst = np.abs(rest).argmax(1)[odd]
    point[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
    return point


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest E8 points: E8 is the even-sum integer points and the same moved by one half."""
    whole, half = _nearest_even(y), _nearest_even(y - 0.5) + 0.5
    nearer = ((y - whole) ** 2).sum(1) <= ((y - half) ** 2).sum(1)
    return np.where(nearer[:, None], whole, half)


def _cell_keys(table: int, size: int, points: np.ndarray) -> np.ndarray:
    """64-bit keys of cells given as rows of twice the lattice points (whole numbers)."""
    out = np.full(len(points), (table + 1) * 0x9E3779B1 + size, np.uint64)
    for column in np.rint(2 * points).astype(np.int64).view(np.uint64).T:
        out = (out ^ column) * np.uint64(0xD6E8FEB86659FD93)
        out = out ^ (out >> np.uint64(29))
    return out.view(np.int64)


class Lattice:
    """The tables' projections for vectors of one length."""

    def __init__(self, size: int, s: Settings):
        rng = np.random.default_rng([s.seed, size])
        self.size, self.s = size, s
        self.by = rng.normal(size=(s.tables, s.blocks, size, 8)) / s.scale
        self.planes = rng.normal(size=(size, s.sign_bits))

    def signs(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.planes > 0, axis=1)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Keys by vector and table: first the own cell, then those visited."""
        s, least = self.s, minimal_vectors()
        moves = list(itertools.product(range(s.nearest + 1), repeat=s.blocks))
        out = np.empty((len(unit), s.tables, s.visits + 1), np.int64)
        for t in range(s.tables):
            points, offers, costs = [], [], []
            for b in range(s.blocks):
                y = unit @ self.by[t, b]
                point = decode(y)
                # Squared distance gained by adding a minimal vector v: |v|^2 - 2 (y - point) v, and |v|^2 is 2.
                gain = 2 - 2 * ((y - point) @ least.T)
                best = np.argsort(gain, axis=1, kind="stable")[:, : s.nearest]
                stay = np.zeros((len(unit), 1))
                costs.append(np.concatenate([stay, np.take_along_axis(gain, best, 1)], 1))
                offers.append(np.concatenate([stay[:, :, None] + np.zeros(8), least[best]], 1))
                points.append(point)
            total = sum(costs[b][:, [m[b] for m in moves]] for b in range(s.blocks))
            # Staying comes first whatever the other costs.
            total[:, 0] = -np.inf
            order = np.argsort(total, axis=1, kind="stable")[:, : s.visits + 1]
            chosen = np.array(moves)[order]
            for k in range(s.visits + 1):
                cell = [points[b] + offers[b][np.arange(len(unit)), chosen[:, k, b]] for b in range(s.blocks)]
                out[:, t, k] = _cell_keys(t, self.size, np.concatenate(cell, 1))
        return out


def _unit(vectors: list) -> np.ndarray:
    """Vectors of one length in double precision, scaled to length one."""
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _clean(vector) -> bool:
    return (
        vector is not None
        and len(vector) > 0
        and None not in vector
        and bool(np.isfinite(np.array(vector, np.float64)).all())
        and any(vector)
    )


def digests(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``digest`` of the vector, null if it can link with nothing."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                hashlib.blake2b((np.array(v, np.float64) + 0.0).tobytes(), digest_size=16).digest() if _clean(v) else None
                for v in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(1)], names=["id", "digest", "vector"])

    typed = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return typed.mapInArrow(run, f"id {kind}, digest binary, vector array<double>")


def cell_rows(classes: DataFrame, s: Settings) -> DataFrame:
    """``cell``, ``n`` (the class), ``home`` and ``signs`` for every cell a class lies in or visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, Lattice] = {}
        for batch in batches:
            numbers, vectors = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes).tolist():
                picked = np.flatnonzero(sizes == size)
                lattice = of.setdefault(size, Lattice(size, s))
                for at in range(0, len(picked), 512):
                    pick = picked[at : at + 512]
                    unit = _unit([vectors[i] for i in pick])
                    cells = lattice.cells(unit)
                    each = s.tables * (s.visits + 1)
                    home = np.zeros(cells.shape, bool)
                    home[:, :, 0] = True
                    signs = pa.array([x.tobytes() for x in lattice.signs(unit)], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells.ravel()), pa.array(np.repeat(numbers[pick], each)), pa.array(home.ravel()),
                         signs.take(pa.array(np.repeat(np.arange(len(pick)), each)))],
                        names=["cell", "n", "home", "signs"],
                    )

    return classes.select("n", "vector").mapInArrow(run, "cell long, n long, home boolean, signs binary")


def candidate_pairs(rows: DataFrame, s: Settings) -> DataFrame:
    """Pairs ``a`` < ``b`` of classes that share a cell at home and agree in enough signs."""
    sizes = rows.groupBy("cell").agg(F.count("*").alias("rows"), F.bool_or("home").alias("_home"))
    sizes = settle(sizes.where("rows > 1 and _home").select(F.col("cell").alias("_cell"), "rows"), "cells")
    kept = rows.join(sizes, F.col("cell") == F.col("_cell"))
    count = F.ceil(F.col("rows") / s.block_rows)
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("n"), count)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    )
    dealt = dealt.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "n", "home", "signs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 3):
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            block, n = group.column("block").to_numpy(), group.column("n").to_numpy()
            home = group.column("home").to_numpy()
            signs = np.frombuffer(b"".join(group.column("signs").to_pylist()), np.uint64).reshape(len(n), -1)
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            found = []
            for at in range(0, len(left), 256):
                part = left[at : at + 256]
                far = sum(np.bitwise_count(signs[part, k][:, None] ^ signs[right, k][None]).astype(np.int16) for k in range(signs.shape[1]))
                ok = (far <= s.far_bits) & (home[part][:, None] | home[right][None]) & (n[part][:, None] != n[right][None])
                if i == j:
                    ok &= n[part][:, None] < n[right][None]
                x, y = np.nonzero(ok)
                found.append((n[part[x]], n[right[y]]))
            a, b = (np.concatenate(c) if c else np.empty(0, np.int64) for c in zip(*found))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    grouped = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return grouped.mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    left = classes.select(F.col("n").alias("a"), F.col("vector").alias("x"))
    right = classes.select(F.col("n").alias("b"), F.col("vector").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            x, y = batch.column(2), batch.column(3)
            sizes = x.value_lengths().to_numpy()
            alike = sizes == y.value_lengths().to_numpy()
            for size in np.unique(sizes[alike]).tolist():
                pick = np.flatnonzero(alike & (sizes == size))
                u, v = (_unit(c.take(pa.array(pick)).flatten().to_numpy().reshape(-1, size)) for c in (x, y))
                keep[pick] = (u * v).sum(1) >= s.cosine
            yield batch.select([0, 1]).filter(pa.array(keep))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """One row per vector: ``id``, ``n_links`` and ``component_id``."""
    s = settings
    rows = settle(digests(vectors, id_col, vector_col), "vectors")
    classes = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.count("*").alias("size"), F.min("id").alias("least_id"), F.first("vector").alias("vector")
    )
    classes = settle(numbered(classes, F.col("digest")), "classes")
    links = settle(_confirmed(settle(candidate_pairs(settle(cell_rows(classes, s), "cells"), s), "pairs"), classes, s), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("n").alias("_n"), "size")
    others = both.join(sizes, F.col("b") == F.col("_n")).groupBy("a").agg(F.sum("size").alias("others"))
    components = settle(connected_components(classes.select(F.col("n").alias("node")), links), "components")
    named = classes.join(components, F.col("n") == F.col("node"))
    lowest = settle(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "lowest")
    named = named.join(lowest, "component").join(others, F.col("n") == F.col("a"), "left")
    named = settle(
        named.select(F.col("digest").alias("_digest"), "component_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")),
        "named",
    )
    return rows.join(named, F.col("digest") == F.col("_digest"), "left").select(
        "id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


@query()
def op6_embedding_near_dedup(spark, sf_dir):
    done = embedding_links(read(spark, sf_dir, "embeddings"))
    return done.select(F.col("id").alias("vec_id"), "n_links", "component_id", same(F.col("id"), F.col("component_id")).alias("kept"))
