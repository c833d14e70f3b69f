"""MinHash near-de-duplication verified with odd sketches.

A document is its set of distinct five-word shingles, A-Z lower-cased; with fewer words, all of them are one
shingle. Documents with equal sets form a class, of which one row goes on. MinHash values, cut into bands,
give candidate buckets; folded into a parity bitmap, an odd sketch, they estimate the similarity of a
candidate pair from the population count of an XOR, which is precise where similarity is high. Pairs that
pass are confirmed on the full shingle sets, and links make components.

A bucket is never expanded into all its pairs. Buckets that overlap make a cluster, and every member of it is compared
with one, the pivot, exactly; where all members are linked with it, nothing is left to do. Other members meet those of their
cluster block by block within tasks: sketches and the most that two members can share rule pairs out, the others are
confirmed by what they do share, the pivot's shingles that both have and the equal ones among the rest. A task returns a
spanning forest of the links it finds, never the links themselves.

Defined cases: a null text, or one without words, has an empty set and links with nothing; rows with a null
id take part, an id is smaller than none; rows that repeat an id each have their own text; other columns are
ignored; no rows give no rows. Texts of any length are used whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmart.llm.common import LOWER, UPPER, connected_components, query, read, runs, same, small_batches
from sparkmart.session import settle

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


@dataclass(frozen=True)
class Settings:
    """Shingle length and threshold; bands of MinHash rows; bits of an odd sketch.

    A pair at similarity 0.85 misses all 25 bands of 6 rows with a probability of 7e-6. ``margin`` is how far
    below the threshold an estimate may lie before a pair is ruled out: five standard deviations.
    """

    words: int = 5
    percent: int = 85
    bands: int = 25
    rows: int = 6
    bits: int = 512
    margin: float = 0.16
    block_rows: int = 256
    block_bytes: int = 8 << 20
    seed: int = 11

    def most_bits(self, margin: float | None = None) -> float:
        """The expected number of differing bits of two odd sketches ``margin`` below the threshold."""
        least = self.percent / 100 - (self.margin if margin is None else margin)
        return self.bits / 2 * (1 - math.exp(4 * self.bands * self.rows / self.bits * (least - 1)))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes half of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2**64."""
    up = np.full(size, _BASE, np.uint64)
    down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    data = np.frombuffer((text or "").encode().translate(_LOWER), np.uint8)
    edge = np.diff(np.concatenate(([0], (~_SPACE[data]).view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _powers(1 << (len(data) + 1).bit_length())
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)])))
    word = _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    span = min(words, len(word))
    out = np.full(len(word) - span + 1, span, np.uint64)
    for k in range(span):
        out = _mix(out * np.uint64(_BASE) + word[k : len(word) - span + 1 + k])
    return np.unique(out)


def linked(shared, sizes, percent: int):
    """Whether sets that share so many elements, their sizes added up, are at least that similar, exactly."""
    return (shared > 0) & ((100 + percent) * shared >= percent * sizes)


class Sketcher:
    """MinHash bands and odd sketch of shingle sets."""

    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        count = s.bands * s.rows
        self.s = s
        self.flip = rng.integers(0, 1 << 32, count, np.uint32)
        self.by = rng.integers(0, 1 << 32, count, np.uint32) | np.uint32(1)
        self.salt = rng.integers(0, 1 << 63, count, np.uint64)

    def minhash(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(len(self.by), 0xFFFFFFFF, np.uint32)
        narrow = (hashes >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(narrow), 1024):
            part = (narrow[at : at + 1024, None] ^ self.flip) * self.by
            np.minimum(low, part.min(0), out=low)
        return low

    def bands(self, low: np.ndarray) -> np.ndarray:
        out = np.arange(1, self.s.bands + 1, dtype=np.uint64)
        for column in low.reshape(self.s.bands, self.s.rows).T.astype(np.uint64):
            out = _mix(out * np.uint64(_BASE) + column)
        return out.view(np.int64)

    def odd(self, low: np.ndarray) -> np.ndarray:
        at = _mix(low.astype(np.uint64) ^ self.salt) % np.uint64(self.s.bits)
        parity = np.bincount(at.astype(np.int64), minlength=self.s.bits) & 1
        return np.packbits(parity.astype(np.uint8)).view(np.int64)


def sketch_table(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """A row per document: ``id``, ``version`` of the text, ``n`` shingles, ``set`` digest, ``bands``, ``odd``."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        sketcher = Sketcher(s)
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                found = shingles(text, s.words)
                low = sketcher.minhash(found)
                out.append((len(found), hashlib.md5(found.tobytes()).digest(), sketcher.bands(low), sketcher.odd(low)))
            n, sets, bands, odd = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sets, pa.binary()),
                 pa.array(list(bands), pa.list_(pa.int64())), pa.array(list(odd), pa.list_(pa.int64()))],
                names=["id", "version", "n", "set", "bands", "odd"],
            )

    return rows.mapInArrow(run, f"id {kind}, version long, n long, set binary, bands array<long>, odd array<long>")


def _described(rows: DataFrame, s: Settings) -> DataFrame:
    """Cluster members by their pivot, the text of one member: ``bits`` tells which of the pivot's shingles they have.

    ``others`` are the hashes of those they have besides, ``size`` their number of shingles, and ``linked`` whether they are linked with the
    pivot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(maxsize=64)(lambda text: shingles(text, s.words))
        for batch in batches:
            bits, others, sizes, near = [], [], [], []
            for text, pivot in zip(batch.column("text").to_pylist(), batch.column("pivot").to_pylist()):
                own, base = shingles(text, s.words), of(pivot)
                has = np.isin(base, own, assume_unique=True)
                bits.append(np.packbits(np.pad(has, (0, -len(has) % 64))).tobytes())
                others.append(np.setdiff1d(own, base, assume_unique=True).tobytes())
                sizes.append(len(own))
                near.append(linked(int(has.sum()), len(own) + len(base), s.percent))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("cluster", "set", "odd")), pa.array(bits, pa.binary()),
                 pa.array(others, pa.binary()), pa.array(sizes, pa.int32()), pa.array(near, pa.bool_())],
                names=["cluster", "set", "odd", "bits", "others", "size", "linked"],
            )

    columns = rows.select("cluster", "set", "odd", "text", "pivot")
    kinds = "cluster binary, set binary, odd array<long>, bits binary, others binary, size int, linked boolean"
    return columns.mapInArrow(run, kinds)


def _popcounts(x: np.ndarray, y: np.ndarray, combine) -> np.ndarray:
    out = np.zeros((len(x), len(y)), np.int32)
    for k in range(x.shape[1]):
        out += np.bitwise_count(combine(x[:, k][:, None], y[:, k][None]))
    return out


def _shared(left: list[bytes], right: list[bytes], columns: int = 4096) -> np.ndarray:
    """How many hashes every two members have in common, by products of matrices over the hashes found on both sides."""
    flat = [np.frombuffer(b"".join(side), np.uint64) for side in (left, right)]
    of = [np.repeat(np.arange(len(side)), [len(x) // 8 for x in side]) for side in (left, right)]
    both = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), np.float32)
    kept = [np.isin(hashes, both) for hashes in flat]
    at = [np.searchsorted(both, hashes[k]) for hashes, k in zip(flat, kept)]
    rows = [r[k] for r, k in zip(of, kept)]
    for begin in range(0, len(both), columns):
        sides = []
        for side, place, row in zip((left, right), at, rows):
            here = (place >= begin) & (place < begin + columns)
            has = np.zeros((len(side), min(columns, len(both) - begin)), np.float32)
            has[row[here], place[here] - begin] = 1
            sides.append(has)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _forest(x: np.ndarray, y: np.ndarray, component: np.ndarray) -> list[int]:
    """Places of the links between members ``x`` and ``y`` that join components, just enough of them."""
    names, at = np.unique(np.concatenate((component[x], component[y])), return_inverse=True)
    u, v = at[: len(x)], at[len(x) :]
    link = np.full((len(names), len(names)), -1, np.int64)
    link[u, v] = link[v, u] = np.arange(len(x))
    seen, out = np.zeros(len(names), bool), []
    for start in range(len(names)):
        ahead = [] if seen[start] else [start]
        seen[start] = True
        while ahead:
            node = ahead.pop()
            new = np.flatnonzero((link[node] >= 0) & ~seen)
            seen[new] = True
            out += link[node, new].tolist()
            ahead += new.tolist()
    return out


def _compare(described: DataFrame, s: Settings) -> DataFrame:
    """Links ``a``, ``b`` that join what the clusters' members form with their pivots, found block by block.

    Members linked with the pivot lie in blocks of their own, which are not compared with each other. Two sets share at
    most the pivot's shingles that both have and the smaller of their numbers of others; pairs that could not be linked
    with that many, or whose odd sketches are too far apart, are ruled out, and the others confirmed.
    """
    weight = F.octet_length("bits") + F.octet_length("others")
    sizes = described.groupBy("cluster", "linked").agg(F.count("*").alias("rows"), F.sum(weight).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("rows") / s.block_rows), F.ceil(F.col("bytes") / s.block_bytes))
    sizes = sizes.groupBy(F.col("cluster").alias("_cluster")).agg(
        *(F.coalesce(F.max(F.when(F.col("linked") == flag, blocks)), F.lit(0)).alias(name) for name, flag in (("free", False), ("bound", True)))
    )
    sizes = settle(sizes.where("free > 0"), "sizes")
    block = F.pmod(F.xxhash64("set"), F.when(F.col("linked"), F.col("bound")).otherwise(F.col("free")))
    last = F.when(F.col("linked"), F.col("free")).otherwise(F.col("free") + F.col("bound"))
    dealt = described.join(sizes, F.col("cluster") == F.col("_cluster"))
    dealt = dealt.withColumn("block", F.when(F.col("linked"), F.col("free")).otherwise(F.lit(0)) + block)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt = dealt.select("cluster", "i", "j", "block", "set", "linked", "odd", "bits", "others", "size")
    loose = s.most_bits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 3):
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            block, sets = group.column("block").to_numpy(), group.column("set").to_pylist()
            odd = np.array(group.column("odd").to_pylist(), np.int64).view(np.uint64)
            bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint64).reshape(len(sets), -1)
            others, size = group.column("others").to_pylist(), group.column("size").to_numpy().astype(np.int64)
            extra = np.array([len(x) // 8 for x in others], np.int64)
            # Members linked with the pivot are one component, every other member is its own.
            component = np.where(group.column("linked").to_numpy(zero_copy_only=False), -1, np.arange(len(sets)))
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            pivots = _popcounts(bits[left], bits[right], np.bitwise_and)
            sums = size[left][:, None] + size[right][None]
            ok = linked(pivots + np.minimum(extra[left][:, None], extra[right][None]), sums, s.percent)
            ok &= _popcounts(odd[left], odd[right], np.bitwise_xor) <= loose
            ok &= left[:, None] < right[None] if i == j else True
            rows, columns = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
            if not len(rows):
                continue
            cut = np.ix_(rows, columns)
            shared = pivots[cut] + _shared([others[k] for k in left[rows]], [others[k] for k in right[columns]])
            x, y = np.nonzero(ok[cut] & linked(shared, sums[cut], s.percent))
            x, y = left[rows[x]], right[columns[y]]
            kept = _forest(x, y, component)
            if kept:
                ends = [pa.array([sets[k] for k in side[kept]], pa.binary()) for side in (x, y)]
                yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    grouped = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return grouped.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per document: ``id``, ``version`` of its text, ``n_shingles`` and ``component_id``.

    ``stays`` marks the first row of a component, and rows equal to it in id and text.
    """
    s = settings
    small_batches(docs.sparkSession)
    sketches = settle(sketch_table(docs, id_col, text_col, s), "sketches")
    filled = sketches.where("n > 0")
    # One row per distinct set, that of the smallest id; copies meet as one row per task.
    row = F.struct("id", "version", "bands", "odd")
    classes = filled.groupBy("set").agg(F.min_by(row, _order()).alias("r"))
    classes = settle(classes.select("set", "r.*"), "classes")
    banded = classes.select("set", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("set").alias("head"), F.max("set").alias("_last")).where("head <> _last")
    members = settle(banded.join(settle(buckets.drop("_last"), "buckets"), "band"), "members")
    in_play = members.select("set").distinct().withColumnRenamed("set", "_set")
    known = classes.join(in_play, F.col("set") == F.col("_set")).select("set", "id", "version", "odd")
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_version"), F.col(text_col).alias("text"))
    known = known.join(texts, same(F.col("id"), F.col("_id")) & (F.col("version") == F.col("_version")))
    known = settle(known.select("set", "odd", "text").dropDuplicates(["set"]), "texts")

    # Buckets that overlap are one cluster.
    overlaps = members.where("set <> head").select(F.col("head").alias("a"), F.col("set").alias("b"))
    clusters = settle(connected_components(in_play.select(F.col("_set").alias("node")), overlaps), "clusters")
    clusters = clusters.select(F.col("node").alias("_node"), F.col("component").alias("cluster"))
    placed = clusters.join(known, F.col("_node") == F.col("set"))
    pivots = known.select(F.col("set").alias("_pivot"), F.col("text").alias("pivot"))
    described = settle(_described(placed.join(pivots, F.col("cluster") == F.col("_pivot")), s), "described")
    nodes = described.select(F.col("set").alias("node"))
    near = described.where("linked").select(F.col("set").alias("a"), F.col("cluster").alias("b"))
    joined = connected_components(nodes, near.unionByName(_compare(described, s)))
    named = classes.select("set", "id", "version").join(joined, F.col("set") == F.col("node"), "left")
    named = settle(named.withColumn("component", F.coalesce("component", "set")), "named")
    lowest = settle(named.groupBy("component").agg(F.min(_order()).alias("first")), "lowest")
    named = settle(named.join(lowest, "component").select(F.col("set").alias("_set"), "first"), "classes")
    found = sketches.join(named, F.when(F.col("n") > 0, F.col("set")) == F.col("_set"), "left")
    own = F.col("n") == 0
    return found.select(
        "id",
        "version",
        F.col("n").alias("n_shingles"),
        F.when(own, F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
        (own | (same(F.col("id"), F.col("first.id")) & (F.col("version") == F.col("first.version")))).alias("stays"),
    )


def _order():
    """The order in which rows come first in their component: by id, none last."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "version")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows that stay, one of each component, and all rows with an empty set; columns as they are."""
    found = near_duplicates(docs, id_col, text_col, settings)
    gone = found.where(~F.col("stays")).select("id", "version").distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_version"))
    rows = rows.join(gone, same(F.col("_id"), F.col("id")) & (F.col("_version") == F.col("version")), "left_anti")
    empty = F.coalesce(~F.col("_row")[text_col].rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    once = F.row_number().over(Window.partitionBy("_id", "_version").orderBy(F.lit(0)))
    return rows.withColumn("_copy", once).where(empty | (F.col("_copy") == 1)).select("_row.*")


@query()
def op10_minhash_near_dedup(spark, sf_dir):
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", same(F.col("id"), F.col("component_id")).alias("kept")
    )
