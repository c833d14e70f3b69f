"""Removal of repeated byte strings by sparse prefix doubling.

Every byte covered by a string of ``length`` bytes that also starts somewhere else goes. Ranking all positions
would sort a row per byte in every round. So only sampled positions are ranked: the anchor of a window of
``length`` bytes is the place of the smallest hash among its substrings of ``gram`` bytes, the leftmost on a
tie. Equal windows have equal anchors at equal offsets, so a repeated window is found among the anchors that
share a rank. An anchor stands for all windows it is the anchor of, told by their offsets to it.

The first rank of an anchor is that of its ``gram`` bytes. Anchors with a unique rank are dropped: none of
their windows is repeated. The next is the pair of that rank and the rank of all bytes their windows reach;
anchors that share it are past the threshold, all their windows are repeated, and one of them goes on to be
compared with others. What is left is sorted by rank, and windows of anchors of one rank are ranked by prefix
doubling: pairs of ranks at growing offsets, until the rank of whole windows tells which are repeated.

Ranks are hashes of the bytes, so a round is a count per rank, combined before the shuffle, and a join whose
hot ranks can be split; windows are compared by 128 bits. Texts are compressed and written once, bucketed by
the task that wrote them; after that only anchors and spans move.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; rows that repeat id and text
are two occurrences, each treated alike; ids may be null or repeated, rows are numbered; other columns are
ignored. A text of any length is one row of bytes, its anchors are found piece by piece.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmart.llm.common import bounded, query, read
from sparkmart.session import scratch_path, settle

_PIECE = 1 << 17  # window starts hashed at a time


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a multiple of 8) at every position that has them."""
    count = len(data) - gram + 1
    words = np.lib.stride_tricks.as_strided(data[: len(data) - 7].view(), (len(data) - 7, 8), (1, 1))
    words = np.ascontiguousarray(words).view(np.uint64)[:, 0]
    out = np.zeros(count, np.uint64)
    for k in range(0, gram, 8):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[k : k + count]
    return _mixed(out)


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, position, smallest and largest offset of every anchor of a text."""
    starts, width = len(data) - length + 1, length - gram + 1
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(starts, 0), _PIECE):
        here = min(_PIECE, starts - at)
        hashes = gram_hashes(data[at : at + here + length - 1], gram)
        # Hash and position in one number: its minimum is the leftmost smallest hash. Minima of sliding windows
        # are those of the end of one block and the beginning of the next.
        ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        blocks = np.full(-(-len(ranked) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        blocks[: len(ranked)] = ranked
        blocks = blocks.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:here], ahead[width - 1 : width - 1 + here]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], here) - 1
        place = place[first]
        keys = hashes[place].view(np.int64)
        found.append((keys, place + at, first + at, last + at))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    keys, place, first, last = (np.concatenate(x) for x in zip(*found))
    # An anchor whose windows begin in two pieces is one.
    new = np.flatnonzero(np.diff(place, prepend=-1))
    last = last[np.append(new[1:], len(place)) - 1]
    return keys[new], place[new], place[new] - last, place[new] - first[new]


def _reach(length: int, gram: int) -> tuple[int, int]:
    """Bytes before and after an anchor's position that its windows can reach."""
    return length - gram, length


def packed_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents with compressed bytes, written once: ``p``, ``n``, ``id``, ``size``, ``digest``, ``data``.

    ``n`` numbers the rows and ``p`` is the task that wrote a row. The table is bucketed by ``p``, so every task
    writes one file, and what later steps find out about documents joins it without moving a text again.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.monotonically_increasing_id().alias("n"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in bounded(batches, "text"):
            raw = [t.encode() for t in batch.column(1).to_pylist()]
            n = batch.column(2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(n.to_numpy() >> 33), n, batch.column(0), pa.array(list(map(len, raw)), pa.int64()),
                 pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()),
                 pa.array(list(map(pack.compress, raw)), pa.binary())],
                names=["p", "n", "id", "size", "digest", "data"],
            )

    packed = rows.mapInArrow(run, f"p long, n long, id {kind}, size long, digest binary, data binary")
    name = f"packed_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed.write.bucketBy(buckets, "p").option("path", scratch_path(spark, name)).option("compression", "none").saveAsTable(name)
    return spark.table(name)


def _with_lists(packed: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Documents joined with rows by ``n``; only the rows move, to where the documents' buckets are."""
    lists = lists.withColumnRenamed("n", "_n").withColumn("_p", F.shiftright("_n", 33))
    return packed.join(lists, (F.col("p") == F.col("_p")) & (F.col("n") == F.col("_n")), how)


def _anchor_rows(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """``rank`` (hash of the gram), ``around`` (of all bytes its windows reach), ``n``, ``at``, ``open`` per anchor.

    ``at`` holds the position and the smallest and largest offset. Anchors of documents known to be repeated as
    a whole are not open: they only stand for their bytes.
    """
    left, right = _reach(length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in bounded(batches, "data"):
            n, opened = batch.column(0), batch.column(1)
            columns: list[list[np.ndarray]] = [[] for _ in range(4)]
            for k, data in enumerate(batch.column(2).to_pylist()):
                raw = unpack.decompress(data)
                keys, pos, low, high = anchors(np.frombuffer(raw, np.uint8), length, gram)
                begin, end = np.maximum(pos - left, 0), np.minimum(pos + right, len(raw))
                around = b"".join(
                    hashlib.blake2b(raw[b:e], digest_size=8).digest() for b, e in zip(begin.tolist(), end.tolist())
                )
                # Strings cut off by the ends of the text are equal only if cut off alike.
                around = np.frombuffer(around, np.int64) + (pos - begin) * 1_000_003 + (end - pos)
                for out, part in zip(columns, (np.full(len(pos), k), keys, around, pos << 24 | low << 12 | high)):
                    out.append(part)
            k, keys, around, at = (np.concatenate(c) if c else np.empty(0, np.int64) for c in columns)
            k = pa.array(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(around), n.take(k), pa.array(at), opened.take(k)],
                names=["rank", "around", "n", "at", "open"],
            )

    return documents.select("n", "open", "data").mapInArrow(run, "rank long, around long, n long, at long, open boolean")


def _place(at: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(at, 24), F.shiftright(at, 12).bitwiseAND(4095), at.bitwiseAND(4095)


def _surroundings(anchors_of: DataFrame, packed: DataFrame, length: int, gram: int) -> DataFrame:
    """The anchors with the bytes their windows can reach, ``left`` of them before the anchor."""
    left, right = _reach(length, gram)
    lists = anchors_of.groupBy("n").agg(F.collect_list(F.struct("rank", "at", "open")).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in bounded(batches, "data"):
            out = []
            for n, data, items in zip(*(c.to_pylist() for c in batch.columns)):
                raw = unpack.decompress(data)
                for a in items:
                    pos = a["at"] >> 24
                    begin = max(pos - left, 0)
                    out.append((a["rank"], n, a["at"], a["open"], pos - begin, raw[begin : pos + right]))
            for at in range(0, len(out), 10_000):
                rank, n, place, opened, before, around = zip(*out[at : at + 10_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rank, pa.int64()), pa.array(n, pa.int64()), pa.array(place, pa.int64()),
                     pa.array(opened, pa.bool_()), pa.array(before, pa.int32()), pa.array(around, pa.binary())],
                    names=["rank", "n", "at", "open", "left", "around"],
                )

    rows = _with_lists(packed, lists, "inner").select("n", "data", "list")
    return rows.mapInArrow(run, "rank long, n long, at long, open boolean, left int, around binary")


def window_ranks(around: list[bytes], begins: np.ndarray, counts: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Two 64-bit ranks of the windows that begin at ``begins`` (and the next ``counts`` places) of each string.

    Prefix doubling: the rank of twice as many bytes is that of the pair of ranks at a place and so many bytes
    on; the last pair overlaps so as to end with the window. Two kinds of ranks make chance matches impossible
    in practice.
    """
    sizes = np.array(list(map(len, around)), np.int64)
    offsets = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(around) + bytes(length), np.uint8)
    first = np.repeat(offsets + begins, counts)
    starts = first + np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
    grams = gram_hashes(data, gram).view(np.uint64)
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        rank, size = _mixed(grams ^ np.uint64(salt)), gram
        while size < length:
            on = min(size, length - size)
            rank = _mixed(rank[: len(rank) - on] * np.uint64(salt) + (rank[on:] ^ (rank[on:] >> np.uint64(33))))
            size += on
        out.append(rank[starts].view(np.int64))
    return np.stack(out, 1)


def _offsets(at: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where an anchor's first window begins in its surroundings, how many there are, and where in the text."""
    pos, low, high = at >> 24, at >> 12 & 4095, at & 4095
    return left - high, high - low + 1, pos - high


def _by_rank(batches: Iterator[pa.RecordBatch], rows: int = 4_000) -> Iterator[pa.Table]:
    """The rows in pieces that end with a rank; they come sorted by rank."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ranks = batch.column(0).to_numpy()
        ends = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        fresh = held and held[-1].column(0)[-1].as_py() != ranks[0] if len(ranks) else False
        if fresh and sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
        if len(ends) and sum(b.num_rows for b in held) + int(ends[-1]) >= rows:
            yield pa.Table.from_batches([*held, batch.slice(0, int(ends[-1]))])
            held = [batch.slice(int(ends[-1]))]
        elif batch.num_rows:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _windows_of(piece, length: int, gram: int):
    """Of rows of surroundings: each window's row, its two ranks, and where in its text it begins."""
    at, left = piece.column("at").to_numpy(), piece.column("left").to_numpy()
    begins, counts, starts = _offsets(at, left)
    ranks = window_ranks(piece.column("around").to_pylist(), begins, counts, length, gram)
    row = np.repeat(np.arange(len(at)), counts)
    start = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(row))
    return row, ranks, start


def _repeated_in_ranks(around: DataFrame, length: int, gram: int) -> DataFrame:
    """``n``, ``begin``, ``end`` of the repeated windows of open anchors, compared within their rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _by_rank(batches):
            row, ranks, start = _windows_of(piece, length, gram)
            keys = (ranks[:, 1], ranks[:, 0], piece.column("rank").to_numpy()[row])
            order = np.lexsort(keys)
            as_before = np.ones(len(order) - 1, bool)
            for key in keys:
                as_before &= key[order[1:]] == key[order[:-1]]
            hit = np.zeros(len(order), bool)
            hit[order] = np.append(as_before, False) | np.append(False, as_before)
            hit &= piece.column("open").to_numpy()[row]
            row, start = row[hit], start[hit]
            if not len(row):
                continue
            # Windows of one anchor that follow each other are one span.
            new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))))
            last = np.append(new[1:], len(row)) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece.column("n").to_numpy()[row[new]]), pa.array(start[new]), pa.array(start[last] + length)],
                names=["n", "begin", "end"],
            )

    sorted_rows = around.repartition("rank").sortWithinPartitions("rank")
    return sorted_rows.mapInArrow(run, "n long, begin long, end long")


def _repeated_anywhere(around: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for ranks too frequent for one task: a row per window, counted by its ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                piece = batch.slice(at, 2000)
                row, ranks, start = _windows_of(piece, length, gram)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ranks[:, 0].copy()), pa.array(ranks[:, 1].copy()), piece.column("n").take(row), pa.array(start),
                     piece.column("open").take(row)],
                    names=["x", "y", "n", "begin", "open"],
                )

    windows = settle(around.mapInArrow(run, "x long, y long, n long, begin long, open boolean"), "windows")
    again = settle(windows.groupBy(F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.count("*").alias("c")).where("c > 1"), "again")
    hits = windows.where("open").join(again, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")))
    return hits.select("n", "begin", (F.col("begin") + length).alias("end"))


def repeated_spans(packed: DataFrame, length: int = 200, gram: int = 32, most_in_rank: int = 4_000) -> DataFrame:
    """``n`` and ``spans``: byte ranges of the packed documents, perhaps overlapping, that occur elsewhere too.

    ``most_in_rank`` is the number of different surroundings of one rank that a task compares by itself; ranks
    with more are counted by window, with the same result.
    """
    # Documents that are equal as a whole are repeated as a whole; one of them stands for their bytes.
    same_text = packed.where(F.col("size") >= length).groupBy("digest").agg(F.count("*").alias("c"), F.min("n").alias("first"))
    same_text = settle(same_text.where("c > 1").select(F.col("digest").alias("_digest"), "first"), "equal")
    equal = packed.select("n", "size", "digest").join(same_text, F.col("digest") == F.col("_digest"))
    equal = settle(equal.select("n", "size", (F.col("n") == F.col("first")).alias("stands")), "equal")
    whole = equal.select("n", F.lit(0).cast("long").alias("begin"), F.col("size").alias("end"))
    documents = _with_lists(packed.where(F.col("size") >= length), equal.select("n", "stands"), "left")
    documents = documents.where(F.coalesce("stands", F.lit(True))).withColumn("open", F.col("stands").isNull())

    all_anchors = settle(_anchor_rows(documents, length, gram), "anchors")
    shared = all_anchors.groupBy("rank").agg(F.count("*").alias("c")).where("c > 1").select(F.col("rank").alias("_rank"))
    left = settle(all_anchors.join(settle(shared, "ranks"), F.col("rank") == F.col("_rank")).drop("_rank"), "shared")
    # Equal surroundings are past the threshold: all windows of the anchor are repeated. One of them goes on.
    classes = left.groupBy("rank", "around").agg(
        F.count("*").alias("c"), F.bool_or("open").alias("open"), F.first("n").alias("n"), F.first("at").alias("at")
    )
    classes = settle(classes, "classes")
    again = classes.where("c > 1 and open").select(F.col("rank").alias("_rank"), F.col("around").alias("_around"))
    done = left.where("open").join(again, (F.col("rank") == F.col("_rank")) & (F.col("around") == F.col("_around")))
    pos, low, high = _place(F.col("at"))
    done = done.select("n", (pos - high).alias("begin"), (pos - low + length).alias("end"))
    ranks = classes.groupBy("rank").agg(F.count("*").alias("classes"), F.bool_or(F.col("open") & (F.col("c") == 1)).alias("_open"))
    ranks = settle(ranks.where("classes > 1 and _open").select(F.col("rank").alias("_rank"), "classes"), "ranks")
    onward = classes.join(ranks, F.col("rank") == F.col("_rank")).withColumn("open", F.col("open") & (F.col("c") == 1))
    usual = onward.where(F.col("classes") <= most_in_rank).select("rank", "n", "at", "open")
    found = _repeated_in_ranks(_surroundings(usual, packed, length, gram), length, gram)
    if not ranks.where(F.col("classes") > most_in_rank).isEmpty():
        hot = onward.where(F.col("classes") > most_in_rank).select("rank", "n", "at", "open")
        found = found.unionByName(_repeated_anywhere(_surroundings(hot, packed, length, gram), length, gram))
    spans = done.unionByName(found).unionByName(whole)
    return spans.groupBy("n").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 32) -> DataFrame:
    """One row per document: ``id``, ``n_bytes``, ``removed`` byte ranges and the ``kept`` bytes.

    ``gram`` is a multiple of 8 below ``length``, which is at most 4,000.
    """
    # Buckets are by the writing task alone, while joins also compare the row number.
    docs.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    packed = packed_table(docs, id_col, text_col)
    rows = _with_lists(packed, repeated_spans(packed, length, gram), "left")
    kind = packed.schema["id"].dataType.simpleString()
    pairs = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in bounded(batches, "data"):
            sizes, gone, kept = [], [], []
            for data, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = unpack.decompress(data)
                runs = merged([(s["begin"], s["end"]) for s in at or ()])
                cuts = [0, *(x for r in runs for x in r), len(raw)]
                sizes.append(len(raw))
                gone.append([{"begin": b, "end": e} for b, e in runs])
                kept.append(b"".join(raw[b:e] for b, e in zip(cuts[::2], cuts[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pairs), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "removed", "kept"],
            )

    return rows.select("id", "data", "spans").mapInArrow(
        run, f"id {kind}, n_bytes long, removed array<struct<begin:long,end:long>>, kept binary"
    )


@query()
def op5_suffix_array_dedup(spark, sf_dir):
    done = remove_repeats(read(spark, sf_dir, "documents"))
    return done.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
