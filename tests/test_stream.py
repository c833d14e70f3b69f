import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkmart.operators.changes import events_of
from sparkmart.operators.evolve import Evolution, Resolution
from sparkmart.operators.registry import Registry
from sparkmart.operators.runlog import COMPLETED, FAILED, RunLog
from sparkmart.plans.build import build_mart, layout_columns, run_build
from sparkmart.plans.mart import current_view
from sparkmart.plans.spec import ColumnSpec, Endpoint, JoinRule, JsonField, MartSpec, TableKey, TableSpec, Transform
from sparkmart.sources import change_log
from sparkmart.sources.catalog import FrameSource, SourceCatalog
from sparkmart.streaming.cdc import BAD_RECORDS, OBSERVED, ChangeApplier, apply_stream, by_table, touched_buckets

USERS, ORDERS = TableKey("db", "public", "users"), TableKey("db", "public", "orders")


def spec_named(name, *columns, table=USERS):
    return MartSpec(name, (TableSpec(table, (ColumnSpec("id", type="int8", is_update_key=True), *columns)),))


NAMES = spec_named("names", ColumnSpec("name", type="text"))


def record(seq, after, table="users", op="u"):
    source = {"db": "db", "schema": "public", "table": table, "lsn": seq}
    return json.dumps({"before": None, "after": after, "source": source, "op": op})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


class Setup:
    def __init__(self, spark, store, **options):
        self.spark, self.store = spark, store
        self.registry = Registry(store)
        self.evolution = Evolution(store, self.registry)
        self.applier = ChangeApplier(store, self.registry, self.evolution, **options)
        users = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "id long, name string")
        orders = spark.createDataFrame([(i, i % 5, 1.0) for i in range(40)], "oid long, user_id long, total double")
        self.catalog = SourceCatalog(spark, {"db": FrameSource({"public.users": users, "public.orders": orders})})

    def add(self, spec, **options):
        view_id = self.registry.add(spec)
        build_mart(self.store, spec, self.catalog, **options)
        return view_id

    def batch(self, batch_id, *records):
        raw = self.spark.createDataFrame([(r,) for r in records], "value string")
        self.applier(raw, batch_id)


def test_restart_from_checkpoint(spark, store, tmp_path):
    s = Setup(spark, store)
    s.add(NAMES, buckets=4)
    folder = tmp_path / "log"
    folder.mkdir()
    expected = {i: f"n{i}" for i in range(20)}
    seq = 0

    def write(name, n):
        nonlocal seq
        lines = []
        for _ in range(n):
            seq += 1
            key = seq % 30
            expected[key] = f"v{seq}"
            lines.append(record(seq, {"id": key, "name": f"v{seq}"}))
        Path(folder / name).write_text("\n".join([*lines, "{broken " + name]) + "\n")

    write("a.txt", 40)
    checkpoint = str(tmp_path / "checkpoint")
    apply_stream(spark, change_log.read_files(spark, str(folder), 1), s.applier, checkpoint)
    assert rows_of(store.read("names")) == sorted(expected.items(), key=repr)
    write("b.txt", 25)
    write("c.txt", 25)
    # The applier of a restarted job is a new one; the position comes from the checkpoint.
    fresh = Setup(spark, store)
    apply_stream(spark, change_log.read_files(spark, str(folder)), fresh.applier, checkpoint)
    assert rows_of(store.read("names")) == sorted(expected.items(), key=repr)
    bad = rows_of(store.read(BAD_RECORDS).select("value", "batch_id"))
    assert [v for v, _ in bad] == ["{broken a.txt", "{broken b.txt", "{broken c.txt"]


def test_a_replayed_batch_changes_nothing(spark, store):
    s = Setup(spark, store)
    s.add(NAMES)
    records = [record(1, {"id": None, "name": "x"}), record(2, {"id": 1, "name": "y"}), "bad"]
    s.batch(0, *records)
    first, version = rows_of(store.read("names")), store.version("names").number
    s.batch(0, *records)
    assert rows_of(store.read("names")) == first and store.version("names").number == version
    assert store.read(BAD_RECORDS).count() == 1
    s.batch(1, *records)
    assert store.read("names").count() == len(first) + 1


def test_fan_out_and_missing_mart(spark, store):
    s = Setup(spark, store)
    s.add(NAMES)
    other = spec_named("copies", ColumnSpec("name", alias="label", type="text"))
    s.add(other, buckets=2)
    s.registry.add(spec_named("never_built", ColumnSpec("name")))
    s.batch(0, record(1, {"id": 3, "name": "new"}), record(2, {"id": 3, "name": "gone"}, op="d"))
    assert store.read("names").where("id = 3").first()["name"] == "new"
    assert store.read("copies").where("id = 3").first()["label"] == "new"
    assert not store.exists("never_built")


def test_events_without_key_are_kept_aside(spark, store):
    s = Setup(spark, store)
    s.add(NAMES)
    s.add(spec_named("copies", ColumnSpec("name", type="text")))
    s.batch(0, record(1, {"name": "lost"}), record(2, {"unrelated": 1}), "same", "same")
    assert [r[0] for r in store.read(BAD_RECORDS).select("reason").orderBy("reason").collect()] == [
        "mart copies, db.public.users: key column missing", "mart names, db.public.users: key column missing",
        "not an envelope", "not an envelope",
    ]
    assert store.read("names").count() == 20


def order_spec():
    return MartSpec(
        "order_users",
        (
            TableSpec(ORDERS, (ColumnSpec("oid", type="int8", is_update_key=True), ColumnSpec("total", type="float8"))),
            TableSpec(USERS, (ColumnSpec("id", alias="uid", type="int8", is_update_key=True), ColumnSpec("name", type="text"))),
        ),
        (JoinRule(Endpoint(ORDERS, "user_id"), Endpoint(USERS, "id")),),
    )


def test_a_dimension_change_updates_rows_in_all_buckets(spark, store):
    s = Setup(spark, store)
    spec = order_spec()
    assert layout_columns(spec) == ("oid",)
    s.add(spec, buckets=8)
    before = store.version("order_users")
    s.batch(
        0,
        record(1, {"id": 2, "name": "two"}),
        record(2, {"id": 77, "name": "nobody"}),
        record(3, {"oid": 5, "total": 9.5}, table="orders"),
        record(4, {"oid": 500, "total": 0.5}, table="orders"),
    )
    out = store.read("order_users")
    assert out.where("uid = 2").select("name").distinct().collect() == [("two",)]
    assert out.where("uid = 2").count() == 8
    assert rows_of(out.where("uid = 77 or oid in (5, 500)")) == [(5, 9.5, 0, "n0"), (500, 0.5, None, None), (None, None, 77, "nobody")]
    assert out.count() == 42 and before.number + 2 == store.version("order_users").number


def test_touched_buckets_are_few(spark, store):
    s = Setup(spark, store)
    spec = order_spec()
    s.add(spec, buckets=8)
    base = store.version("order_users")
    one = spark.createDataFrame([(5,), (9999,)], "oid int")
    assert len(touched_buckets(store, "order_users", base, one, ["oid"])) == 1
    users = spark.createDataFrame([(2,)], "uid long")
    expected = {r[0] for r in store.read_version("order_users", base).where("uid = 2").select("_bucket").distinct().collect()}
    assert touched_buckets(store, "order_users", base, users, ["uid"]) == expected


def test_no_layout_by_columns_another_table_overwrites():
    # The key of users is a plain column of orders, whose events may change it.
    spec = MartSpec(
        "m",
        (
            TableSpec(USERS, (ColumnSpec("id", is_update_key=True),)),
            TableSpec(ORDERS, (ColumnSpec("oid"), ColumnSpec("user", alias="id"))),
        ),
    )
    assert layout_columns(spec) == ()


def test_versioned_mart_appends(spark, store):
    s = Setup(spark, store)
    s.add(NAMES, versioned=True)
    s.batch(0, record(1, {"id": 1, "name": "a"}), record(2, {"id": 1, "name": "b"}), record(3, {"id": 2}))
    s.batch(1, record(4, {"id": 1, "name": "c"}))
    assert store.read("names").count() == 24
    now = current_view(store.read("names"), ["id"])
    assert rows_of(now.where("id in (1, 2)").select("id", "name")) == [(1, "c"), (2, None)]


# -- drift in the stream ------------------------------------------------------------------------


def source_columns(spark, *columns):
    rows = [("db", "public", "users", c, t) for c, t in columns]
    return spark.createDataFrame(rows, "db string, schema string, table string, column string, type string")


def test_drift_opens_a_group_and_suggestion_gates_writes(spark, store):
    columns = [("id", "bigint"), ("name_full", "text")]
    s = Setup(spark, store, source_columns=lambda keys: source_columns(spark, *columns), auto_suggest=True)
    view_id = s.add(NAMES)
    s.batch(0, record(1, {"id": 1, "name_full": "x"}))
    group = s.evolution.list_groups(status="open").first()
    assert (group.schema_id, group.table_name) == (view_id, "users")
    full = s.evolution.group(group.id)
    assert [(i.mismatch_type, i.old_column_name, i.new_column_name) for i in full["items"]] == [
        ("rename_candidate", "name", "name_full"), ("schema_only", "name", None),
    ]
    assert s.evolution.suggestions().count() == 1
    # Pending: nothing is written, and the same finding is not suggested twice.
    s.batch(1, record(2, {"id": 1, "name": "blocked"}))
    assert store.read("names").where("name = 'blocked'").count() == 0
    assert s.evolution.suggestions().count() == 1 and s.evolution.groups().count() == 1
    # Accepting renames mart and spec; changes flow again.
    suggestion = s.evolution.list_suggestions(newest_first=False, view_id=view_id).first()
    s.evolution.accept(suggestion.id)
    assert [c.name for c in s.registry.get(view_id).tables[0].columns] == ["id", "name_full"]
    s.batch(2, record(3, {"id": 1, "name_full": "flows"}))
    assert store.read("names").where("name_full = 'flows'").count() == 1
    assert s.evolution.suggestions().count() == 0


def test_no_findings_write_nothing_and_other_tables_do_not_count(spark, store):
    s = Setup(spark, store, source_columns=lambda keys: source_columns(spark, ("id", "bigint"), ("name", "text")))
    s.add(order_spec())
    s.batch(0, record(1, {"id": 1, "name": "x"}))
    assert s.evolution.groups().count() == 0


def test_partial_images_show_no_drift(spark, store):
    s = Setup(spark, store, source_columns="observed", auto_suggest=True)
    s.add(NAMES)
    s.batch(0, record(1, {"id": 1, "nick": "x"}))
    s.batch(1, record(2, {"id": 1, "name": "NEW"}))
    s.batch(1, record(2, {"id": 1, "name": "NEW"}))
    assert s.evolution.groups().count() == 0 and s.evolution.suggestions().count() == 0
    assert store.read("names").where("id = 1").first()["name"] == "NEW"
    assert rows_of(store.read(OBSERVED).select("table", "column")) == [("users", "id"), ("users", "name"), ("users", "nick")]


def test_observed_columns_show_what_a_mart_lacks(spark, store):
    s = Setup(spark, store, source_columns="observed")
    view_id = s.add(NAMES, versioned=True)
    s.registry.update(view_id, spec_named("names", ColumnSpec("name", type="text"), ColumnSpec("nick", type="text")))
    s.batch(0, record(1, {"id": 1, "nick": "x"}))
    (group,) = s.evolution.groups().collect()
    assert [(i.mismatch_type, i.new_column_name) for i in s.evolution.group(group.id)["items"]] == [("missing_in_dwh", "nick")]


class Stopped(Exception):
    pass


def stop_at(monkeypatch, owner, name, call):
    """Let the given call of a method fail."""
    real, calls = getattr(owner, name), []

    def run(*args, **options):
        calls.append(name)
        if len(calls) == call:
            raise Stopped
        return real(*args, **options)

    monkeypatch.setattr(owner, name, run)


@pytest.mark.parametrize("call", [1, 2])
def test_recording_a_report_can_be_repeated(spark, store, monkeypatch, call):
    s = Setup(spark, store, source_columns=lambda keys: source_columns(spark, ("id", "bigint")))
    s.add(NAMES)
    with monkeypatch.context() as m:
        stop_at(m, s.store, "publish", call)
        with pytest.raises(Stopped):
            s.batch(0, record(1, {"id": 1, "name": "x"}))
    for _ in range(2):
        s.batch(0, record(1, {"id": 1, "name": "x"}))
    (group,) = s.evolution.groups().collect()
    assert rows_of(s.evolution.items().select("group_id", "old_column_name")) == [(group.id, "name")]
    assert store.read("names").where("id = 1").first()["name"] == "x"


@pytest.mark.parametrize("owner,name", [("store", "alter"), ("registry", "update"), ("store", "publish")])
@pytest.mark.parametrize("alias", ["", "label"])
def test_a_resolution_can_be_repeated(spark, store, monkeypatch, owner, name, alias):
    s = Setup(spark, store, source_columns=lambda keys: source_columns(spark, ("id", "bigint"), ("nick", "text")))
    view_id = s.add(spec_named("names", ColumnSpec("name", type="text", alias=alias)))
    s.batch(0, record(1, {"id": 1}))
    group = s.evolution.groups().first()
    decision = Resolution(renames=(("name", "nick"),), drops=("id",))
    with monkeypatch.context() as m:
        stop_at(m, getattr(s, owner), name, 1)
        with pytest.raises(Stopped):
            s.evolution.apply(group.id, decision)
    s.evolution.apply(group.id, decision)
    assert store.read("names").columns == [alias or "nick"]
    assert [c.name for c in s.registry.get(view_id).tables[0].columns] == ["nick"]
    assert s.evolution.group(group.id).status == "resolved"


def test_resolution_changes_mart_and_spec_together(spark, store):
    s = Setup(spark, store, source_columns=lambda keys: source_columns(spark, ("id", "bigint"), ("nick", "text")))
    view_id = s.add(spec_named("names", ColumnSpec("name", type="text")))
    s.batch(0, record(1, {"id": 1}))
    group = s.evolution.groups().first()
    # Ignoring closes the group, and the next check opens a new one.
    s.evolution.apply(group.id, Resolution(ignores=("name",)))
    assert s.evolution.group(group.id).status == "resolved" and s.evolution.group(group.id).resolved_at is not None
    s.batch(1, record(2, {"id": 1}))
    again = s.evolution.list_groups(status="open").first()
    assert again.id != group.id and s.evolution.list_groups(status="all").count() == 2
    s.evolution.apply(again.id, Resolution.from_dict({"renames": [{"old_name": "name", "new_name": "nick"}]}))
    assert store.read("names").columns == ["id", "nick"]
    assert [c.name for c in s.registry.get(view_id).tables[0].columns] == ["id", "nick"]
    s.batch(2, record(3, {"id": 1}))
    assert s.evolution.list_groups(status="open").count() == 0


def test_run_log(spark, store):
    runs = RunLog(store)
    task = runs.create()
    runs.change(task, COMPLETED, "done")
    assert runs.get(task).status == COMPLETED and runs.get(task).comment == "done"
    assert runs.frame().where(F.col("task_id") == task).count() == 2
    with pytest.raises(ValueError):
        runs.create("Sleeping")
    with pytest.raises(ValueError):
        runs.create(FAILED, "")
    with pytest.raises(LookupError):
        runs.get("none")


def test_builds_are_logged(spark, store):
    s = Setup(spark, store)
    runs = RunLog(store)
    task = run_build(store, s.registry, runs, s.registry.add(NAMES), s.catalog, buckets=2)
    assert runs.get(task).status == COMPLETED and store.read("names").count() == 20
    broken = s.registry.add(spec_named("broken", ColumnSpec("no_such_column")))
    with pytest.raises(ValueError):
        run_build(store, s.registry, runs, broken, s.catalog)
    assert runs.frame().where("status = 'Execution error' and comment like '%no_such_column%'").count() == 1
    assert not store.exists("broken")


def test_additions_are_gathered_again(spark, store, monkeypatch):
    monkeypatch.setattr("sparkmart.streaming.cdc.MAX_FOLDERS", 3)
    s = Setup(spark, store, keep_versions=2)
    s.add(NAMES)
    for i in range(4):
        s.batch(i, record(i, {"id": 100 + i, "name": "new"}))
    assert max(len(f) for f in store.version("names").folders.values()) <= 3
    assert store.read("names").count() == 24
    assert len(store._numbers("names")) == 2


def test_scratch_folders_of_a_batch_are_removed(spark, store, tmp_path, monkeypatch):
    used = []

    def scratch(session, name):
        used.append(tmp_path / name)
        return str(tmp_path / name)

    monkeypatch.setattr("sparkmart.streaming.cdc.scratch_path", scratch)
    s = Setup(spark, store)
    s.add(NAMES)
    s.batch(0, record(1, {"id": 1, "name": "x"}))
    assert used == [tmp_path / "batch-0"] and not used[0].exists()


def test_marts_without_update_key(spark, store):
    s = Setup(spark, store)
    plain = MartSpec("plain", (TableSpec(USERS, (ColumnSpec("id", type="int8"), ColumnSpec("name", type="text"))),))
    s.add(plain)
    s.add(spec_named("history", ColumnSpec("name", type="text")), versioned=True)
    s.batch(0, record(1, {"id": 1, "name": "x"}), record(2, {"name": "no key"}))
    # Nothing can be matched in the one, so its events are kept aside; the other appends whatever comes.
    assert store.read("plain").count() == 20
    assert rows_of(store.read("history").where("_seq > 0").select("id", "name")) == [(1, "x"), (None, "no key")]
    kept = store.read(BAD_RECORDS).select("reason").distinct().collect()
    assert store.read(BAD_RECORDS).count() == 2 and kept == [("mart plain, db.public.users: no update key",)]


def test_transforms_in_the_stream(spark, store):
    s = Setup(spark, store, source_columns=lambda keys: source_columns(spark, ("id", "bigint"), ("name", "text")))
    flat = Transform("JSON", fields=(JsonField("n", "n", "int"),))
    labels = Transform("FieldTransform", values={"a": "first"}, output="label")
    s.add(spec_named("flat", ColumnSpec("name", type="jsonb", transform=flat)), buckets=2)
    s.add(spec_named("labels", ColumnSpec("name", type="text", transform=labels)))
    s.batch(0, record(1, {"id": 1, "name": '{"n": 5}'}), record(2, {"id": 2, "name": "a"}))
    assert rows_of(store.read("flat").where("n is not null").select("id", "n")) == [(1, 5)]
    assert rows_of(store.read("labels").where("label is not null").select("id", "label")) == [(2, "first")]
    # Transform outputs are part of the spec, so they are no drift.
    assert s.evolution.groups().count() == 0


def test_bad_values_do_not_stop_the_stream(spark, store):
    s = Setup(spark, store)
    flat = Transform("JSON", fields=(JsonField("n", "n", "int"),))
    s.add(spec_named("typed", ColumnSpec("name", type="jsonb", transform=flat)))
    s.batch(
        0,
        record(1, {"id": "one", "name": "{}"}),
        record(2, {"id": 2, "name": '{"n": "many"}'}),
        record(3, {"id": 3, "name": '{"n": 3}'}),
        record(4, {"id": 4, "name": None}),
    )
    assert rows_of(store.read("typed").where("n is not null or name is null").select("id", "n")) == [(3, 3), (4, None)]
    assert rows_of(store.read("typed").where("id = 2").select("name")) == [("n2",)]
    assert [r[0] for r in store.read(BAD_RECORDS).select("reason").orderBy("reason").collect()] == [
        "mart typed, db.public.users: bad value for id", "mart typed, db.public.users: bad value for n",
    ]


def test_a_mart_reads_the_events_of_its_tables_only(spark, store, tmp_path):
    raw = spark.createDataFrame([(record(i, {"id": i}, table=f"t{i % 5}"),) for i in range(100)], "value string")
    events = by_table(change_log.decode(raw), str(tmp_path))
    mine = events_of(events, TableKey("db", "public", "t3"))
    assert mine.count() == 20
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(db" in plan
    scanned = mine.select(F.input_file_name()).distinct().collect()
    assert len(scanned) == 1 and "table=t3" in scanned[0][0]


def test_two_specs_of_one_mart(spark, store):
    s = Setup(spark, store, parallel=4)
    s.add(NAMES)
    s.registry.add(spec_named("names"))
    s.batch(0, record(1, {"id": 1, "name": "x"}), record(2, {"id": 50}))
    assert rows_of(store.read("names").where("id in (1, 50)")) == [(1, "x"), (50, None)]


def test_many_checks_are_split(spark, store, monkeypatch):
    monkeypatch.setattr("sparkmart.streaming.cdc.MAX_UNION", 2)
    s = Setup(spark, store)
    s.add(NAMES)
    s.add(spec_named("copies", ColumnSpec("name", type="text")))
    for _ in range(2):
        s.batch(0, record(1, {"name": "lost"}), "bad", record(2, {"id": "x"}))
    assert store.read(BAD_RECORDS).count() == 5
