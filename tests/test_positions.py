"""Changes over several batches: late records, replays, folding together, and what appending leaves alone."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkmart.files import Files
from sparkmart.operators.positions import marks, newest, not_late, positioned, with_flags
from sparkmart.operators.registry import Registry
from sparkmart.plans.build import build_mart
from sparkmart.plans.spec import ColumnSpec, MartSpec, TableKey, TableSpec
from sparkmart.sources.catalog import FrameSource, SourceCatalog
from sparkmart.streaming.appended import AppendedMart, ChangeFolder, table_folder
from sparkmart.streaming.cdc import ChangeApplier

KEY = TableKey("db", "s", "people")
COLUMNS = (("id", "bigint"), ("name", "text"), ("age", "int4"))
SPEC = MartSpec(
    "people_mart",
    (TableSpec(KEY, tuple(ColumnSpec(c, type=t, is_update_key=c == "id", is_nullable=True) for c, t in COLUMNS)),),
    (),
)


def record(lsn, partition=0, offset=0, **after):
    value = {"before": None, "after": {k: None if v is None else str(v) for k, v in after.items()}, "op": "u"}
    value["source"] = {"db": "db", "schema": "s", "table": "people", "lsn": lsn}
    return json.dumps(value), "dbserver_db.s.people", partition, offset


def raw(spark, *records):
    return spark.createDataFrame(records, "value string, topic string, partition int, offset long")


def people(spark):
    rows = [(1, "ann", 30), (2, "bob", 40), (None, "nobody", None)]
    frame = spark.createDataFrame(rows, "id bigint, name string, age int")
    return SourceCatalog(spark, {"db": FrameSource({"s.people": frame})})


class Stored:
    """A mart in a store, kept by the applier that rewrites buckets."""

    def __init__(self, spark, store, tmp_path):
        registry = Registry(store)
        registry.add(SPEC)
        build_mart(store, SPEC, people(spark), buckets=2)
        self.apply, self.store = ChangeApplier(store, registry), store

    def read(self):
        return self.store.read(SPEC.name)


class Appended:
    def __init__(self, spark, store, tmp_path):
        self.apply = AppendedMart(spark, str(tmp_path / "appended"), SPEC)
        self.apply.build(people(spark))

    def read(self):
        return self.apply.read()


def rows(mart):
    return sorted((tuple(r) for r in mart.read().collect()), key=repr)


@pytest.mark.parametrize("kind", [Stored, Appended])
def test_late_record_of_another_partition(spark, store, tmp_path, kind):
    mart = kind(spark, store, tmp_path)
    mart.apply(raw(spark, record(11, 0, 5, id=1, name="newer")), 0)
    mart.apply(raw(spark, record(10, 1, 9, id=1, name="older", age=31), record(9, 1, 8, id=3, name="cy")), 1)
    mart.apply(raw(spark, record(8, 1, 9, id=3, name="before cy", age=7), record(12, 0, 6, id=2, name=None)), 2)
    assert rows(mart) == sorted([(1, "newer", 31), (2, None, 40), (3, "cy", 7), (None, "nobody", None)], key=repr)


@pytest.mark.parametrize("kind", [Stored, Appended])
def test_marts_do_not_depend_on_batches(spark, store, tmp_path, kind):
    rng, records = random.Random(7), []
    for lsn in range(60):
        after = {"id": rng.choice([1, 2, 3, 4, None])}
        after |= {c: rng.choice([None, lsn]) for c in ("name", "age") if rng.random() < 0.6}
        records.append(record(lsn, lsn % 3, lsn // 3, **after))
    want = {1: ["ann", 30], 2: ["bob", 40]}
    alone = [(None, "nobody", None)]
    for text, *_ in records:
        after = json.loads(text)["after"]
        row = [after.get("name"), None if after.get("age") is None else int(after["age"])]
        if after["id"] is None:
            alone.append((None, *row))
            continue
        held = want.setdefault(int(after["id"]), [None, None])
        for k, c in enumerate(("name", "age")):
            held[k] = row[k] if c in after else held[k]
    rng.shuffle(records)
    mart = kind(spark, store, tmp_path)
    for k in range(3):
        mart.apply(raw(spark, *records[20 * k : 20 * k + 20]), k)
    assert rows(mart) == sorted([*((k, *v) for k, v in want.items()), *alone], key=repr)


def test_replayed_and_folded_batches(spark, store, tmp_path):
    mart = Appended(spark, store, tmp_path)
    batches = [raw(spark, record(k, 0, k, id=1 + k % 2, name=f"n{k}"), record(90 + k, 0, 90 + k, id=None, name="x")) for k in range(3)]
    for k in (0, 1, 1, 2):
        mart.apply(batches[k], k)
    once = rows(mart)
    assert once == sorted([(1, "n2", 30), (2, "n1", 40), (None, "nobody", None)] + 3 * [(None, "x", None)], key=repr)
    folder = mart.apply.changes(KEY)
    mart.apply.compact(folders=4)
    assert len(folder._folders()) == 3
    mart.apply.compact(folders=2)
    assert len(folder._folders()) == 1 and rows(mart) == once
    mart.apply(batches[2], 2)  # a replay after its batch was folded
    mart.apply.compact(folders=2)
    assert rows(mart) == once


def test_appending_rewrites_nothing(spark, store, tmp_path):
    mart = Appended(spark, store, tmp_path)
    stamps = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "appended").rglob("part-*.parquet")}
    mart.apply(raw(spark, record(1, id=1, name="a")), 0)
    before = stamps()
    mart.apply(raw(spark, record(2, id=1, name="b"), record(3, id=9, age=1)), 1)
    after = stamps()
    assert before.items() <= after.items() and len(after) > len(before)


def test_unusable_records_are_kept(spark, store, tmp_path):
    mart = Appended(spark, store, tmp_path)
    mart.apply(raw(spark, record(1, name="no key"), record(2, id=1, age="old"), ("broken", "t", 0, 1), record(3, id=2, age=41)), 0)
    assert rows(mart) == sorted([(1, "ann", 30), (2, "bob", 41), (None, "nobody", None)], key=repr)
    found = {r["reason"]: r["batch"] for r in mart.apply.bad_records().collect()}
    assert found == {f"{KEY}: key column missing": 0, f"{KEY}: bad value for age": 0, "not an envelope": 0}
    mart.apply(raw(spark), 1)
    assert len(rows(mart)) == 3


def test_positions_survive_a_failure_before_the_mart_is_published(spark, store, tmp_path):
    kinds = "seq long, at struct<lsn:long,offset:long>, id long, name string, _has_id boolean, _has_name boolean"
    partial = lambda *r: spark.createDataFrame([(l, (l, 0), i, n, True, h) for l, i, n, h in r], kinds)
    seen, keys = ChangeFolder(spark, str(tmp_path / "seen")), ["id"]
    found = newest(positioned(partial((5, 1, "a", True), (4, 1, "b", True), (6, 2, None, True), (7, 3, "c", False)), keys), keys)
    assert seen.read() is None
    seen.append(marks(found, keys), 0)
    again = with_flags(not_late(found, seen.read(), keys), keys)
    assert {(r["id"], r["name"], r["_has_name"]) for r in again.collect()} == {(1, "a", True), (2, None, True), (3, None, False)}
    late = newest(positioned(partial((3, 1, "late", True), (8, 2, "d", True), (1, 3, "first", True)), keys), keys)
    flags = {r["id"]: r["_has_name"] for r in with_flags(not_late(late, seen.read(), keys), keys).collect()}
    assert flags == {1: False, 2: True, 3: True}


def test_folders_tell_tables_apart(spark, tmp_path):
    names = {table_folder(TableKey("a.b", "c", "d")), table_folder(TableKey("a", "b.c", "d")), table_folder(TableKey("a/b", "c", "d"))}
    assert len(names) == 3 and not any("/" in n for n in names)
    assert Files(spark, str(tmp_path)).names(str(tmp_path / "none")) == []
