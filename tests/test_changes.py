import json
import random

import pytest
from pyspark.sql import functions as F

from sparkmart.errors import SpecError
from sparkmart.operators import routing
from sparkmart.operators.changes import conflict_columns, fold, keyless_events, partial_rows
from sparkmart.operators.upsert import append_rows, apply_events, merge, merge_into, upsert
from sparkmart.plans.mart import current_view, stamp
from sparkmart.plans.spec import ColumnSpec, JsonField, MartSpec, TableKey, TableSpec, Transform
from sparkmart.sources import change_log

USERS = TableKey("db", "public", "users")


def record(after, table="users", op="u", db="db", **source):
    return json.dumps({"before": None, "after": after, "source": {"db": db, "schema": "public", "table": table, **source}, "op": op})


def log(spark, *records):
    return spark.createDataFrame([(r, i) for i, r in enumerate(records, 1)], "value string, seq long")


def user_spec(*columns):
    return MartSpec("m", (TableSpec(USERS, (ColumnSpec("id", type="int8", is_update_key=True), *columns)),))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- decoding -----------------------------------------------------------------------------------


def test_unusable_records_are_told_from_events(spark):
    supplier = record({"s_suppkey": 7, "s_phone": None}, table="supplier", op="c", db="shop", lsn=41)
    truncated = supplier[: len(supplier) // 2]
    raw = log(spark, supplier, truncated, "7", '{"op": "u", "after": {"s_suppkey": 8}}', None)
    (event,) = change_log.decode(raw).collect()
    assert (event.seq, event.op, event.db, event.table, event.lsn) == (1, "c", "shop", "supplier", 41)
    assert event.after == {"s_suppkey": "7", "s_phone": None}
    bad = change_log.bad_records(raw).collect()
    assert {r.reason for r in bad} == {"not an envelope"}
    assert sorted((r.value for r in bad), key=repr) == sorted([truncated, "7", '{"op": "u", "after": {"s_suppkey": 8}}', None], key=repr)


def test_positions_of_files(spark):
    at_log, at_time, nowhere = record({"id": 1}, lsn=77), record({"id": 2}, ts_ms=5), record({"id": 3})
    raw = spark.createDataFrame([(at_log,), (at_time,), (nowhere,)], "value string")
    events = {e["after"]["id"]: e for e in change_log.decode(raw).collect()}
    assert (events["1"].seq, events["1"].at.lsn, events["1"].at.micros) == (77, 77, None)
    assert (events["2"].seq, events["2"].at.lsn, events["2"].at.micros) == (5000, None, 5000)
    assert [tuple(r) for r in change_log.bad_records(raw).collect()] == [(nowhere, "no position")]


def topic_log(spark, *records):
    """Records as ``(partition, offset, value)``."""
    rows = [(value, "dbserver_db.public.users", p, o) for p, o, value in records]
    return spark.createDataFrame(rows, "value string, topic string, partition int, offset long")


def test_offsets_repeat_across_partitions(spark):
    spec = user_spec(ColumnSpec("a", type="text"))
    mart = spark.createDataFrame([(1, "old")], "id long, a string")
    raw = topic_log(
        spark,
        (0, 7, record({"id": None, "a": "p"})), (1, 7, record({"id": None, "a": "p"})),
        (0, 9, record({"id": 1, "a": "early"}, lsn=10)), (1, 2, record({"id": 1, "a": "late"}, lsn=11)),
    )
    out = apply_events(mart, change_log.decode(raw), spec)
    assert rows_of(out) == [(1, "late"), (None, "p"), (None, "p")]


@pytest.mark.parametrize("seed", range(3))
def test_partitioned_fold_equals_the_log_order(spark, seed):
    rng = random.Random(seed)
    spec = user_spec(*(ColumnSpec(c, type="text") for c in COLUMNS))
    events = [
        {"id": rng.choice([3, rng.randrange(10), None]), **{c: rng.choice([None, f"v{n}"]) for c in COLUMNS if rng.random() < 0.5}}
        for n in range(150)
    ]
    offsets, records = [0, 0, 0], []
    for lsn, after in enumerate(events):
        p = rng.randrange(3)
        records.append((p, offsets[p], record(after, lsn=lsn)))
        offsets[p] += rng.randrange(1, 3)
    rng.shuffle(records)
    empty = spark.createDataFrame([], "id long, a string, b string, c string")
    got = rows_of(apply_events(empty, change_log.decode(topic_log(spark, *records)), spec))
    assert got == sorted(((r["id"], *(r[c] for c in COLUMNS)) for r in one_at_a_time([], events)), key=repr)


def test_deleted_columns_are_not_written(spark):
    spec = user_spec(ColumnSpec("a", type="text"), ColumnSpec("secret", type="text", is_deleted=True))
    mart = spark.createDataFrame([(1, "x", None)], "id long, a string, secret string")
    raw = log(spark, record({"id": 1, "a": "y", "secret": "s"}), record({"secret": "only"}))
    events = change_log.decode(raw)
    assert rows_of(apply_events(mart, events, spec)) == [(1, "y", None)]
    assert keyless_events(events, spec, USERS).count() == 0
    assert spec.tables[0].written_columns() == ("id", "a")


def test_op_codes(spark):
    ops = spark.createDataFrame([("c",), ("u",), ("d",), ("r",), ("x",)], "op string")
    assert [r[0] for r in ops.select(routing.known_op(F.col("op"))).collect()] == ["c", "u", "d", "r", ""]


def test_topics_and_kafka_options(spark):
    topics = spark.createDataFrame([("dbserver_a.public.t",), ("dbserver_a.public.temp_x",)], "topic string")
    assert change_log.drop_staging_topics(topics).count() == 1
    assert change_log.kafka_options("h:1", ["a", "b"])["subscribe"] == "a,b"
    options = change_log.kafka_options("h:1")
    assert options["startingOffsets"] == "earliest" and options["subscribePattern"].startswith("dbserver_")
    assert int(options["maxOffsetsPerTrigger"]) > 0


def test_routing_and_gate(spark):
    events = change_log.decode(
        log(spark, record({"id": 1}), record({"id": 2}, table="orders"), record({"id": 3}, db="other"), record(None, op="d"))
    )
    routes = spark.createDataFrame(
        [(1, "a", "db", "public", "users"), (2, "b", "db", "public", "users"), (2, "b", "db", "public", "orders")],
        "view_id long, view string, db string, schema string, table string",
    )
    routed = routing.route(routing.data_events(events), routes)
    assert rows_of(routed.select("view_id", "seq")) == [(1, 1), (2, 1), (2, 2)]
    pending = routes.where("view_id = 2 and table = 'users'")
    assert rows_of(routing.write_gate(routed, pending).select("view_id", "seq")) == [(1, 1), (2, 2)]


# -- partial rows and folding -------------------------------------------------------------------


def test_present_null_is_a_value_and_absent_is_not(spark):
    spec = user_spec(ColumnSpec("a", type="int"), ColumnSpec("b", type="text"))
    mart = spark.createDataFrame([(1, 10, "x"), (2, 20, "y")], "id long, a int, b string")
    raw = log(spark, record({"id": 1, "a": None}), record({"id": 1, "b": "z"}), record({"id": 2}), record({"id": 3, "b": "n"}))
    out = apply_events(mart, change_log.decode(raw), spec)
    assert rows_of(out) == [(1, None, "z"), (2, 20, "y"), (3, None, "n")]


def test_update_touches_every_matching_row(spark):
    spec = user_spec(ColumnSpec("a", type="text"))
    mart = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "id long, a string")
    out = apply_events(mart, change_log.decode(log(spark, record({"id": 1, "a": "new"}))), spec)
    assert rows_of(out) == [(1, "new"), (1, "new"), (2, "z")]


def test_null_keys_insert_every_time_and_null_mart_keys_never_match(spark):
    spec = user_spec(ColumnSpec("a", type="text"))
    mart = spark.createDataFrame([(None, "old")], "id long, a string")
    raw = log(spark, record({"id": None, "a": "p"}), record({"id": None, "a": "p"}))
    assert rows_of(apply_events(mart, change_log.decode(raw), spec)) == [(None, "old"), (None, "p"), (None, "p")]


def test_deletes_snapshots_and_foreign_columns_change_nothing(spark):
    spec = user_spec(ColumnSpec("a", type="text"))
    mart = spark.createDataFrame([(1, "x")], "id long, a string")
    raw = log(spark, record({"id": 1, "a": "d"}, op="d"), record({"id": 1, "a": "r"}, op="r"), record({"zzz": 1}))
    events = change_log.decode(raw)
    assert rows_of(apply_events(mart, events, spec)) == [(1, "x")]
    assert keyless_events(events, spec, USERS).count() == 0


def test_events_without_key_are_reported(spark):
    spec = user_spec(ColumnSpec("a", type="text"))
    events = change_log.decode(log(spark, record({"a": "x"}), record({"id": 1, "a": "y"})))
    assert keyless_events(events, spec, USERS).count() == 1
    assert partial_rows(events, spec, USERS).count() == 1


def test_value_map_keeps_the_old_label(spark):
    values = {"1": "one", "true": "yes", "<nil>": "none"}
    labelled = ColumnSpec("st", type="numeric", transform=Transform("FieldTransform", values=values, output="label"))
    spec = user_spec(labelled)
    mart = spark.createDataFrame([(i, None, "old") for i in range(1, 5)], "id long, st decimal(38,18), label string")
    raw = log(spark, record({"id": 1, "st": 1.0}), record({"id": 2, "st": 7}), record({"id": 3, "st": None}), record({"id": 4}))
    out = apply_events(mart, change_log.decode(raw), spec)
    assert [r[1] for r in rows_of(out.select("id", "label"))] == ["one", "old", "none", "old"]


def test_json_flatten_writes_only_fields_that_are_there(spark):
    flat = ColumnSpec("doc", type="jsonb", transform=Transform("JSON", fields=(JsonField("n", "n", "int"), JsonField("t", "t"))))
    spec = user_spec(flat)
    mart = spark.createDataFrame([(i, "{}", 5, "old") for i in range(1, 6)], "id long, doc string, n int, t string")
    docs = ['{"n": 6}', '{"n": null, "t": "new"}', "[1]", "broken", None]
    raw = log(spark, *[record({"id": i, "doc": d}) for i, d in enumerate(docs, 1)])
    out = rows_of(apply_events(mart, change_log.decode(raw), spec).select("id", "n", "t"))
    assert out == [(1, 6, "old"), (2, None, "new"), (3, 5, "old"), (4, 5, "old"), (5, 5, "old")]


def test_typed_values(spark):
    spec = user_spec(
        ColumnSpec("ts", type="timestamp"), ColumnSpec("d", type="date"), ColumnSpec("flag", type="bool"),
        ColumnSpec("tags", udt_name="_text"), ColumnSpec("nums", udt_name="_int4"), ColumnSpec("short", type="varchar(2)"),
    )
    after = {"id": 1.0, "ts": 1704067200000000, "d": 19723, "flag": True, "tags": ["a", "b"], "nums": [1, 2.0], "short": "abc"}
    row = partial_rows(change_log.decode(log(spark, record(after))), spec, USERS).first()
    assert (row.id, str(row.ts), str(row.d), row.flag, row.tags, row.nums, row.short) == (
        1, "2024-01-01 00:00:00", "2024-01-01", True, ["a", "b"], [1, 2], "ab",
    )


def test_missing_types_come_from_the_mart(spark):
    spec = MartSpec("m", (TableSpec(USERS, (ColumnSpec("id", is_update_key=True), ColumnSpec("ts"))),))
    mart = spark.sql("SELECT 1L AS id, TIMESTAMP_NTZ '2020-01-01 00:00:00' AS ts")
    out = apply_events(mart, change_log.decode(log(spark, record({"id": 1, "ts": 1704067200000000}))), spec)
    assert str(out.first().ts) == "2024-01-01 00:00:00"


def test_view_key_writes_both_columns_and_matches_on_both(spark):
    members = TableKey("db", "public", "members")
    spec = MartSpec(
        "m",
        (
            TableSpec(USERS, (ColumnSpec("id", type="int8", is_update_key=True, view_key="user_id"), ColumnSpec("a", type="text"))),
            TableSpec(members, (ColumnSpec("user_id", type="int8", is_update_key=True, view_key="id"), ColumnSpec("b", type="text"))),
        ),
    )
    assert conflict_columns(spec.table(USERS)) == ["id", "user_id"]
    mart = spark.createDataFrame([(1, "x", 1, "y"), (2, "x", 9, "y")], "id long, a string, user_id long, b string")
    raw = log(spark, record({"user_id": 1, "b": "B"}, table="members"), record({"id": 2, "a": "A"}), record({"id": 1, "a": "A"}))
    out = apply_events(mart, change_log.decode(raw), spec)
    assert rows_of(out) == [(1, "A", 1, "B"), (2, "A", 2, None), (2, "x", 9, "y")]


def test_upsert_needs_keys_and_known_columns(spark):
    keyless = MartSpec("m", (TableSpec(USERS, (ColumnSpec("a"),)),))
    with pytest.raises(SpecError):
        conflict_columns(keyless.table(USERS))
    spec = user_spec(ColumnSpec("a", type="text"))
    mart = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(SpecError, match="no column a"):
        apply_events(mart, change_log.decode(log(spark, record({"id": 1, "a": "x"}))), spec)


def test_merge_statement_reaches_the_table_format(spark):
    spark.sql("DROP TABLE IF EXISTS merge_target")
    spark.sql("CREATE TABLE merge_target (id BIGINT, a STRING) USING parquet")
    rows = partial_rows(change_log.decode(log(spark, record({"id": 1, "a": "x"}))), user_spec(ColumnSpec("a", type="text")), USERS)
    with pytest.raises(Exception, match="(?i)merge"):
        merge_into("merge_target", fold(rows, ["id"]), ["id"])
    spark.sql("DROP TABLE merge_target")


def test_versioned_append_replaces_whole_rows(spark):
    spec = user_spec(ColumnSpec("a", type="text"), ColumnSpec("b", type="text"))
    mart = stamp(spark.createDataFrame([(1, "x", "y"), (2, "x", "y")], "id long, a string, b string"),
                 F.lit("2020-01-01").cast("timestamp"))
    raw = log(spark, record({"id": 1, "a": "p"}), record({"id": 1, "a": "q"}))
    rows = append_rows(mart, partial_rows(change_log.decode(raw), spec, USERS))
    out = current_view(mart.unionByName(rows), ["id"]).select("id", "a", "b")
    assert rows_of(out) == [(1, "q", None), (2, "x", "y")]


# -- the fold equals one-at-a-time application --------------------------------------------------

COLUMNS = ("a", "b", "c")


def one_at_a_time(mart, events):
    """The meaning of an upsert, event by event."""
    rows = [dict(r) for r in mart]
    for after in events:
        key = after["id"]
        hits = [r for r in rows if key is not None and r["id"] == key]
        for r in hits:
            r.update({c: v for c, v in after.items() if c != "id"})
        if not hits:
            rows.append({"id": key, **{c: after.get(c) for c in COLUMNS}})
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_sequential_application(spark, seed):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, "x", "y", f"v{rng.randrange(1000)}"])
    mart = [{"id": rng.choice([None, *range(12)]), **{c: value() for c in COLUMNS}} for _ in range(25)]
    # One key takes a third of all events.
    events = [
        {"id": rng.choice([3, rng.randrange(20), rng.randrange(20), None]),
         **{c: value() for c in COLUMNS if rng.random() < 0.5}}
        for _ in range(250)
    ]
    spec = user_spec(*(ColumnSpec(c, type="text") for c in COLUMNS))
    frame = spark.createDataFrame([(r["id"], *(r[c] for c in COLUMNS)) for r in mart], "id long, a string, b string, c string")
    raw = log(spark, *(record(e) for e in events)).repartition(6)
    got = rows_of(apply_events(frame, change_log.decode(raw), spec))
    want = sorted(((r["id"], *(r[c] for c in COLUMNS)) for r in one_at_a_time(mart, events)), key=repr)
    assert got == want


def test_batches_compose(spark):
    spec = user_spec(ColumnSpec("a", type="text"))
    events = change_log.decode(log(spark, *(record({"id": i % 5, "a": f"v{i}"}) for i in range(40))))
    empty = spark.createDataFrame([], "id long, a string")
    rows = partial_rows(events, spec, USERS)
    half = upsert(empty, rows.where("seq <= 17"), ["id"])
    both = merge(half, fold(rows.where("seq > 17"), ["id"]), ["id"])
    assert rows_of(both) == rows_of(upsert(empty, rows, ["id"]))


def test_observed_columns(spark):
    events = change_log.decode(log(spark, record({"id": 1, "a": 1}), record({"id": 2, "b": None}), record({"x": 1}, table="t")))
    assert rows_of(routing.observed_columns(events).select("table", "column")) == [
        ("t", "x"), ("users", "a"), ("users", "b"), ("users", "id"),
    ]
