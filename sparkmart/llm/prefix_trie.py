"""The prefix trie of conversations, kept as flat arrays behind minimal perfect hashes.

A node is a distinct sequence of first turns. Every turn adds a pseudo-random term of its content and position to
the digest of the prefix before it, so digests are running sums, which tasks build for pieces of a conversation.
Nodes are the distinct digests, copies counted before the shuffle. Two sequences with one digest would show as a
node whose rows differ in depth, last turn or parent; then everything is done again with other terms.

The nodes, ordered by smallest member and depth, are cut into shards. A shard gives every node its slot by a
minimal perfect hash of the digests, checked against the digests that the slots hold, finds the parents' slots
the same way, and adds up subtrees in flat arrays, deepest nodes first. What the nodes above a shard have to get
from it goes out as one row per node above. These nodes form a smaller trie, in which every node hangs under the next node above
its own shard, and which is added up in the same way; a second pass adds the sums it gives to each shard's nodes.
Members are smaller the higher a node is, so a path crosses each border of shards once. No shard grows with a
conversation, a first turn or a group of copies.

Defined cases: turns come by number, null first, equal numbers by a digest of role and text; a null role or
text is empty; rows without a conversation are left out; other columns are ignored; no rows give no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmart.llm.common import numbered, query, read, runs
from sparkmart.session import settle

_NODE = ["a", "b"]
_NOWHERE = -1  # both words of the digest that stands for the root's parent; no node may have it


@dataclass(frozen=True)
class Settings:
    """``shard_nodes``: nodes of a shard, about; ``chunk_ids``: ids of a node's conversations joined in one piece."""

    shard_nodes: int = 1 << 15
    chunk_ids: int = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes half of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# -- slots ----------------------------------------------------------------------------------------


class PerfectHash:
    """Slots 0 to n - 1 for n distinct keys of two 64-bit words.

    Keys are hashed into a bitmap a little larger than their number. Those alone in their place have it; the others
    go to the next, smaller bitmap. A key's slot is the number of places taken before its own.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        left, size = keys, 0
        while len(left):
            at = self._place(left, len(self.levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            self.levels.append(np.where(alone, np.cumsum(alone) - 1 + size, -1))
            size += int(alone.sum())
            left = left[~alone[at]]
        self.held = np.zeros((size, 2), np.uint64)
        self.held[self._slots(keys)] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) % 2**64)
        return (_mix(keys[:, 0] ^ _mix(keys[:, 1] + salt)) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, slots in enumerate(self.levels):
            found = slots[self._place(keys[open_], level, len(slots))]
            out[open_] = found
            open_ = open_[found < 0]
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys, -1 for those the table does not hold."""
        out = self._slots(keys)
        known = out >= 0
        known[known] = (self.held[out[known]] == keys[known]).all(1)
        return np.where(known, out, -1)


def subtree_sums(parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``values`` summed over every slot's subtree; ``parent`` is -1 at the top."""
    out = values.copy()
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        under = level[parent[level] >= 0]
        np.add.at(out, parent[under], out[under])
    return out


def _top(parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The highest slot above every slot, itself included."""
    out = np.arange(len(parent))
    order = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        under = level[parent[level] >= 0]
        out[under] = out[parent[under]]
    return out


# -- digests --------------------------------------------------------------------------------------


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes for a turn's role and text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))


def ordered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``place`` from 0, ``digest`` and ``bytes`` of every turn, numbered in ranges, not per conversation."""
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        turn_digest(F.col(role), F.col(text)).alias("digest"),
        F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("bytes"),
    )
    rows = settle(numbered(rows, F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")), "turns")
    first = rows.groupBy(F.col("conv").alias("_conv")).agg(F.min("n").alias("_first"))
    placed = rows.join(first, F.col("conv") == F.col("_conv"))
    return placed.select("conv", (F.col("n") - F.col("_first")).alias("place"), "digest", "bytes")


def prefixes(turns: DataFrame, seed: int) -> DataFrame:
    """A row per conversation and depth from 1: the prefix's digest ``a``, ``b`` and its parent's, ``digest`` and ``bytes`` of the last turn.

    Rows are sorted in ranges, whose tasks sum up their own terms. What a conversation that goes on over a border has before
    it is the sum of its parts in the ranges before, one row each.
    """
    ranges = turns.repartitionByRange("conv", "place").sortWithinPartitions("conv", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, conv, carry = TaskContext.get().partitionId(), None, np.zeros(2, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            convs, places = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint64)
            words = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, 2)
            salt = (np.arange(2, dtype=np.uint64) + np.uint64(2 * seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
            terms = _mix(_mix(words + salt) ^ _mix(words[:, ::-1] + places[:, None] * np.uint64(0xD1342543DE82EF95) + salt))
            starts = np.flatnonzero(np.concatenate(([convs[0] != conv], convs[1:] != convs[:-1])))
            sums = np.cumsum(terms, 0)
            base = np.zeros((len(convs), 2), np.uint64)
            first = np.searchsorted(starts, np.arange(len(convs)), side="right") - 1
            begun = first >= 0
            base[~begun] = -carry
            base[begun] = (sums - terms)[starts[first[begun]]]
            sums, conv = sums - base, convs[-1]
            carry = sums[-1].copy()
            before = sums - terms
            columns = [sums[:, 0], sums[:, 1], before[:, 0], before[:, 1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c.view(np.int64)) for c in map(np.ascontiguousarray, columns)),
                 batch.column(2), batch.column(3), pa.array(np.full(len(convs), part, np.int32))],
                names=["conv", "place", "a", "b", "pa", "pb", "digest", "bytes", "part"],
            )

    kinds = "conv long, place long, a long, b long, pa long, pb long, digest binary, bytes long, part int"
    rows = settle(ranges.select("conv", "place", "digest", "bytes").mapInArrow(run, kinds), "prefixes")
    # The last row of a part holds the part's sum; of a conversation in several parts, all but the last pass it on.
    ends = rows.groupBy("conv", "part").agg(F.max_by(F.struct("a", "b"), "place").alias("sum"))
    several = ends.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "sum.a", "sum.b"))).alias("parts"))
    several = settle(several.where(F.size("parts") > 1), "several")

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums = np.cumsum(np.array([[p["a"], p["b"]] for p in parts], np.int64), 0)
                out += [(conv, p["part"], *sums[k].tolist()) for k, p in enumerate(parts[1:])]
            columns = list(zip(*out)) or [()] * 4
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["_conv", "_part", "ca", "cb"])

    carry = settle(several.mapInArrow(carried, "_conv long, _part int, ca long, cb long"), "carried")
    rows = rows.join(carry, (F.col("conv") == F.col("_conv")) & (F.col("part") == F.col("_part")), "left")
    return rows.select(
        "conv",
        (F.col("place") + 1).alias("depth"),
        *[_wrapped(F.col(c), F.coalesce(F.col(f"c{c[-1]}"), F.lit(0))).alias(c) for c in ("a", "b")],
        *[_wrapped(F.col(c), F.coalesce(F.col(f"c{c[-1]}"), F.lit(0))).alias(c) for c in ("pa", "pb")],
        "digest",
        "bytes",
    )


def _wrapped(x: Column, y: Column) -> Column:
    """The sum of two longs modulo 2**64, by halves, as sums that overflow are errors."""
    low = x.bitwiseAND(0xFFFFFFFF) + y.bitwiseAND(0xFFFFFFFF)
    high = F.shiftrightunsigned(x, 32) + F.shiftrightunsigned(y, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(0xFFFFFFFF))


# -- nodes ----------------------------------------------------------------------------------------


def distinct_nodes(rows: DataFrame) -> tuple[DataFrame, bool]:
    """The nodes below the root, and whether their digests tell all sequences apart."""
    same = ["depth", "pa", "pb", "digest", "bytes"]
    nodes = rows.groupBy(*_NODE).agg(
        F.count("*").alias("n_convs"),
        F.min("conv").alias("conv"),
        *[F.min(c).alias(c) for c in same],
        *[F.max(c).alias(f"_{c}") for c in same],
    )
    nodes = nodes.withColumn("clash", ~F.expr(" AND ".join(f"{c} = _{c}" for c in same)) | F.expr(f"a = b AND a IN (0, {_NOWHERE})"))
    nodes = settle(nodes.select(*_NODE, "n_convs", "conv", "depth", "pa", "pb", "bytes", "clash"), "nodes")
    return nodes.drop("clash"), nodes.where("clash").isEmpty()


def _shards(nodes: DataFrame, s: Settings) -> DataFrame:
    """Nodes with sums over their shard's part of their subtree, the ``shard``, and the node above the shard (``ua``, ``ub``).

    ``out`` marks the nodes that hang under a node of another shard themselves.
    """
    count = max(1, -(-nodes.count() // s.shard_nodes))
    ranges = nodes.repartitionByRange(count, "conv", "depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        keys, above, depth, values = _columns(table)
        hashed = PerfectHash(keys)
        slot = hashed.slots(keys)
        parent = np.full(len(keys), -1, np.int64)
        parent[slot] = hashed.slots(above)
        scattered = lambda x: _scattered(x, slot)
        sums = subtree_sums(parent, scattered(depth), scattered(values))[slot]
        top = _top(parent, scattered(depth))[slot]
        up = scattered(above)[top]
        out = parent[slot] < 0
        yield from _with(
            table, {"leaves": sums[:, 0], "saved": sums[:, 1], "ua": up[:, 0].view(np.int64), "ub": up[:, 1].view(np.int64), "out": out,
                    "shard": np.full(len(keys), TaskContext.get().partitionId(), np.int32)},
        )

    kinds = "a long, b long, pa long, pb long, conv long, depth long, leaves long, saved long, ua long, ub long, out boolean, shard int"
    return settle(ranges.select(*_INPUT).mapInArrow(run, kinds), "shards")


_INPUT = ["a", "b", "pa", "pb", "conv", "depth", "leaves", "saved"]


def _columns(table: pa.Table):
    of = lambda name: table.column(name).to_numpy()
    pair = lambda x, y: np.stack([of(x), of(y)], 1).view(np.uint64)
    return pair("a", "b"), pair("pa", "pb"), of("depth"), np.stack([of("leaves"), of("saved")], 1)


def _scattered(x: np.ndarray, slot: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[slot] = x
    return out


def _with(table: pa.Table, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    kept = table.select(["a", "b", "pa", "pb", "conv", "depth"]).to_batches()
    at = 0
    for batch in kept:
        part = slice(at, at + batch.num_rows)
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array(np.ascontiguousarray(c[part])) for c in columns.values())],
            names=[*batch.schema.names, *columns],
        )


def summed(nodes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``a``, ``b`` and the sums of ``leaves`` and ``saved`` over every node's subtree.

    ``nodes`` has the digests of node and parent, ``conv``, ``depth`` and the node's own two values. Every parent but
    that of the top node is a node.
    """
    shards = _shards(nodes, s)
    given = shards.where(f"out AND NOT (ua = {_NOWHERE} AND ub = {_NOWHERE})").groupBy("ua", "ub").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    given = settle(given.withColumnsRenamed({"ua": "_a", "ub": "_b"}), "given")
    if given.isEmpty():
        return shards.select(*_NODE, "leaves", "saved")
    # The nodes that get something from other shards, each under the next such node above its own shard.
    above = shards.drop("leaves", "saved").join(given, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    above = above.select("a", "b", F.col("ua").alias("pa"), F.col("ub").alias("pb"), "conv", "depth", "leaves", "saved")
    above = settle(above, "above")
    wider = Settings(2 * s.shard_nodes, s.chunk_ids)
    total = summed(above, wider).select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("leaves").alias("_l"), F.col("saved").alias("_s"))
    with_given = shards.drop("ua", "ub", "out").join(total, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    with_given = with_given.select(
        "shard", *_NODE, "pa", "pb", "conv", "depth", "leaves", "saved", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("_l", "_s")]
    )
    dealt = with_given.repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 1):
            keys, above, depth, values = _columns(table)
            hashed = PerfectHash(keys)
            slot = hashed.slots(keys)
            parent = np.full(len(keys), -1, np.int64)
            parent[slot] = hashed.slots(above)
            more = np.stack([table.column("_l").to_numpy(), table.column("_s").to_numpy()], 1)
            values = values + subtree_sums(parent, _scattered(depth, slot), _scattered(more, slot))[slot]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(c)) for c in (*keys.view(np.int64).T, *values.T)], names=["a", "b", "leaves", "saved"]
            )

    return settle(dealt.mapInArrow(run, "a long, b long, leaves long, saved long"), "summed")


def joined_digests(ends: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``a``, ``b`` and ``ends_sha256`` of every node where conversations end: their ids, ascending, joined by commas.

    Ids are joined to pieces in ranges; a node's digest then runs over its pieces, which are never held together.
    """
    ranges = ends.repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def cut():
            rows = [(*key, held[0], ",".join(map(str, held)))] if held else []
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["a", "b", "first", "ids"])

        out = []
        for batch in batches:
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (a, b) or len(held) >= s.chunk_ids:
                    out.append(cut()) if held else None
                    key, held = (a, b), []
                held.append(conv)
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if held:
            yield cut()

    made = ranges.select("a", "b", "conv").mapInArrow(pieces, "a long, b long, first long, ids string")
    made = made.repartition("a", "b").sortWithinPartitions("a", "b", "first")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None

        def row(rows):
            kinds = [pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*rows)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["a", "b", "ends_sha256"])

        for batch in batches:
            rows = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
                if key != (a, b):
                    if key is not None:
                        rows.append((*key, running.hexdigest()))
                    key, running = (a, b), hashlib.sha256(ids.encode())
                else:
                    running.update(f",{ids}".encode())
            yield row(rows)
        if key is not None:
            yield row([(*key, running.hexdigest())])

    return made.mapInArrow(digests, "a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row per node of the trie of conversations.

    ``turns`` has ``conv``, ``place`` from 0, ``digest`` and ``bytes``; ``members`` has every ``conv`` once, those without turns too.
    """
    s, seed = settings, 0
    while True:
        rows = settle(prefixes(turns, seed), "rows")
        nodes, clear = distinct_nodes(rows)
        if clear:
            break
        seed += 1
    root = members.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(
        zero.alias("a"), zero.alias("b"), "n_convs", "conv", zero.alias("depth"), F.lit(None).cast("long").alias("pa"),
        F.lit(None).cast("long").alias("pb"), zero.alias("bytes"),
    )
    nodes = nodes.select(root.columns).unionByName(root)
    kids = nodes.groupBy(F.col("pa").alias("_a"), F.col("pb").alias("_b")).agg(F.count("*").alias("n_children"))
    named = nodes.join(kids, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left").drop("_a", "_b")
    parents = nodes.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("conv").alias("parent"))
    named = named.join(parents, (F.col("pa") == F.col("_a")) & (F.col("pb") == F.col("_b")), "left").drop("_a", "_b")
    named = settle(named.withColumn("n_children", F.coalesce("n_children", zero)), "named")
    own = named.select(
        "a", "b", *[F.coalesce(c, F.lit(_NOWHERE).cast("long")).alias(c) for c in ("pa", "pb")], "conv", "depth",
        (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    sums = summed(own, s).select(F.col("a").alias("_a"), F.col("b").alias("_b"), "leaves", "saved")
    done = named.join(sums, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).drop("_a", "_b")
    last = rows.groupBy(F.col("conv").alias("_conv")).agg(F.max_by(F.struct("a", "b"), "depth").alias("last"))
    ends = members.join(last, F.col("conv") == F.col("_conv"), "left")
    ends = ends.select(F.coalesce("last.a", zero).alias("a"), F.coalesce("last.b", zero).alias("b"), "conv")
    ends = joined_digests(ends, s).withColumnsRenamed({"a": "_a", "b": "_b"})
    done = done.join(ends, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    return done.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def sharing_starts(turns: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their block of ids, and their members.

    The first h turns of conversation c are those of c - c % ``every``, h being the unsigned crc32 of c modulo ``most``; c's own turns
    after its first h follow.
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(most))
    members = settle(turns.select("conv").distinct(), "members")
    asked = members.select("conv", (F.col("conv") - F.col("conv") % every).alias("_base"), h.alias("_h"))
    starts = turns.where(F.col("place") < most - 1).withColumnRenamed("conv", "_conv")
    given = asked.join(starts, (F.col("_base") == F.col("_conv")) & (F.col("place") < F.col("_h")))
    given = given.select("conv", "place", "digest", "bytes")
    own = turns.where(F.col("place") >= h)
    # Own turns follow those given, of which there may be fewer than h.
    short = given.groupBy(F.col("conv").alias("_conv")).agg(F.count("*").alias("_given"))
    own = own.join(short, F.col("conv") == F.col("_conv"), "left")
    own = own.select("conv", (F.col("place") - h + F.coalesce("_given", F.lit(0))).alias("place"), "digest", "bytes")
    return settle(given.unionByName(own), "rebuilt"), members


_SQL = """
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) AS r(i)),
turn AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
member AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda c, x: xor(t[CAST(xor(c, x) % 256 AS BIGINT) + 1], c // 256))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turn), crc),
rebuilt AS (
  SELECT m.conv_id, 0 AS own, place, role, text FROM member AS m JOIN turn ON turn.conv_id = base AND place < h
  UNION ALL
  SELECT m.conv_id, 1, place, role, text FROM member AS m JOIN turn ON turn.conv_id = m.conv_id AND place >= h),
pref AS (
  SELECT conv_id, row_number() OVER w AS depth, text, list(sha256(len(role) || ':' || role || text)) OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, place ROWS UNBOUNDED PRECEDING)),
r AS (
  SELECT conv_id, depth, strlen(text) AS bytes, sha256(array_to_string(path, ',')) AS id,
         CASE WHEN depth > 1 THEN sha256(array_to_string(path[:depth - 1], ',')) ELSE '' END AS parent FROM pref
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM member),
node AS (SELECT id, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent, count(*) AS n_convs, any_value(bytes) AS bytes
         FROM r GROUP BY id),
kids AS (SELECT parent AS id, count(*) AS n FROM node GROUP BY parent),
own AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (id)),
sums AS (
  SELECT r.id, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * own.bytes) AS saved_tokens
  FROM own JOIN r ON r.conv_id = own.conv_id AND r.depth <= own.depth GROUP BY r.id),
last AS (SELECT conv_id, arg_max(id, depth) AS id FROM r GROUP BY conv_id),
ends AS (SELECT id, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest FROM last GROUP BY id)
SELECT own.conv_id, own.depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM own JOIN sums USING (id) LEFT JOIN ends USING (id) LEFT JOIN node AS up ON up.id = own.parent
"""


@query(_SQL)
def op11_prefix_trie(spark, sf_dir):
    turns = settle(ordered_turns(read(spark, sf_dir, "conversations")), "ordered")
    rebuilt, members = sharing_starts(turns, 5, 9)
    return prefix_trie(rebuilt, members)
