"""Exact de-duplication by Grace hashing.

Equal texts are those identical once every run of white space is one space; a null text counts as empty. Each
task partitions its records to spill files by bytes of their digest, again and again, until the distinct texts
of a bucket fit a bounded open-addressing table, which compares complete texts. Every scan task does so first
for its own rows, so that a group of copies reaches the shuffle as one row per task, and every shuffle
partition then for the rows that remain.

Defined cases: rows with a null id belong to their group, but an id is smaller than none; rows that repeat id
and text are one document of which one row stays; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmart.llm.common import SPACE_CLASS, query, read, same

_FIELDS = "digest binary, text string, first_id {id}, n long"
_FAN_OUT = 16


class ContentTable:
    """An open-addressing table from whole texts to their smallest id and number of rows."""

    def __init__(self, capacity: int = 1024):
        self.slots = np.full(capacity, -1, np.int64)
        self.digests: list[bytes] = []
        self.texts: list[str] = []
        self.ids: list = []
        self.counts: list[int] = []
        self.size = 0

    def _slot(self, digest: bytes, text: str) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (entry := self.slots[at]) >= 0 and not (
            self.digests[entry] == digest and self.texts[entry] == text
        ):
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, text: str, first, n: int) -> None:
        at = self._slot(digest, text)
        entry = self.slots[at]
        if entry >= 0:
            held = self.ids[entry]
            if first is not None and (held is None or first < held):
                self.ids[entry] = first
            self.counts[entry] += n
            return
        self.slots[at] = len(self.texts)
        self.digests.append(digest)
        self.texts.append(text)
        self.ids.append(first)
        self.counts.append(n)
        self.size += len(text) + 200
        if 2 * len(self.texts) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            for i, (d, t) in enumerate(zip(self.digests, self.texts)):
                self.slots[self._slot(d, t)] = i

    def records(self) -> Iterator[tuple]:
        return zip(self.digests, self.texts, self.ids, self.counts)


def _read(file) -> Iterator[tuple]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def grace(records: Iterator[tuple], budget: int, level: int = 0) -> Iterator[ContentTable]:
    """Tables that together hold each distinct text once, none much larger than the budget.

    Records go into a table as long as it fits. From then on, the texts it holds are still counted there and
    all others are partitioned to spill files by the next byte of their digest, each treated the same way.
    So a group of copies of any size never needs to be split.
    """
    table, files = ContentTable(), None
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        for digest, text, first, n in records:
            if table.size < budget or level >= 31 or table.slots[table._slot(digest, text)] >= 0:
                table.add(digest, text, first, n)
                continue
            if files is None:
                files = [open(os.path.join(folder, str(i)), "w+b") for i in range(_FAN_OUT)]
            pickle.dump((digest, text, first, n), files[digest[level] % _FAN_OUT])
        try:
            yield table
            del table
            for file in files or ():
                yield from grace(_read(file), budget, level + 1)
        finally:
            for file in files or ():
                file.close()


def _deduplicate(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def records():
            nonlocal schema
            for batch in batches:
                schema = batch.schema
                yield from zip(*(column.to_pylist() for column in batch.columns))

        for table in grace(records(), budget):
            held = list(table.records())
            for at in range(0, len(held), 2000):
                columns = zip(*held[at : at + 2000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
                )

    return run


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+", " ")


def distinct_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 64 << 20
) -> DataFrame:
    """One row per distinct normalised text: ``digest``, ``text``, ``first_id`` and ``n`` rows."""
    text = normalised(F.col(text_col))
    rows = docs.select(text.alias("text"), F.col(id_col).alias("first_id"), F.lit(1).cast("long").alias("n")).select(
        F.unhex(F.sha2("text", 256)).alias("digest"), "text", "first_id", "n"
    )
    schema = _FIELDS.format(id=docs.schema[id_col].dataType.simpleString())
    local = rows.mapInArrow(_deduplicate(bucket_bytes), schema)
    return local.repartition("digest").mapInArrow(_deduplicate(bucket_bytes), schema)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 64 << 20
) -> DataFrame:
    """One row per document: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``bucket_bytes`` bounds the texts one table holds in memory; the rest of a partition waits in spill files.
    """
    groups = distinct_texts(docs, id_col, text_col, bucket_bytes).select(
        F.col("digest").alias("_of"), F.col("first_id").alias("keep_id"), F.col("n").alias("group_size")
    )
    members = (
        docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("_digest"))
        .groupBy("_id", "_digest")
        .agg(F.count("*").alias("_rows"))
    )
    return (
        members.join(groups, F.col("_digest") == F.col("_of"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")))
        .select(
            F.col("_id").alias(id_col),
            "keep_id",
            "group_size",
            (same(F.col("_id"), F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
            F.lower(F.hex("_digest")).alias("text_sha256"),
        )
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their columns as they are."""
    stays = distinct_texts(docs, id_col, text_col).select("digest", "first_id")
    rows = docs.select(
        F.struct("*").alias("_row"),
        F.col(id_col).alias("_id"),
        F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("_digest"),
    )
    rows = rows.join(stays, same(F.col("_id"), F.col("first_id")) & (F.col("_digest") == F.col("digest")), "left_semi")
    once = Window.partitionBy("_digest", "_id").orderBy(F.lit(0))
    return rows.withColumn("_copy", F.row_number().over(once)).where("_copy = 1").select("_row.*")


@query(
    r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
    g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
    FROM t JOIN g USING (norm)
    """
)
def op4_exact_dedup(spark, sf_dir):
    return exact_dedup(read(spark, sf_dir, "documents"))
