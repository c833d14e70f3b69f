import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmart.errors import NotFound, SpecError
from sparkmart.functions.types import row_type
from sparkmart.operators import dedup, drift, paging, registry
from sparkmart.operators.evolve import Evolution, Resolution, plan_resolution, project_change
from sparkmart.operators.registry import Registry
from sparkmart.plans.spec import ColumnSpec, JsonField, MartSpec, TableKey, TableSpec, Transform
from sparkmart.sources import discovery
from sparkmart.sources.catalog import FrameSource, SourceCatalog, count_tables

KEY = TableKey("shop", "stock", "part")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def spec_with(*columns, name="parts", key=KEY):
    return MartSpec(name, (TableSpec(key, tuple(columns)),))


# -- drift --------------------------------------------------------------------------------------


def frames(spark, source, spec, mart, table="supplier"):
    """Catalogs from lists; a spec entry is name, (name, type) or (name, type, target)."""
    def facts(entry):
        name, kind, target = (entry, None, None) if isinstance(entry, str) else (*entry, None)[:3]
        return name, kind, target or name

    src = [("shop", "stock", table, *(e if isinstance(e, tuple) else (e, None))) for e in source]
    spc = [(1, "shop", "stock", table, facts(e)[0], facts(e)[2], facts(e)[1]) for e in spec]
    text, num = T.StringType(), T.LongType()
    return (
        spark.createDataFrame(src, row_type(db=text, schema=text, table=text, column=text, type=text)),
        spark.createDataFrame(spc, row_type(view_id=num, db=text, schema=text, table=text, column=text, target=text, type=text)),
        spark.createDataFrame([(1, c) for c in mart], row_type(view_id=num, column=text)),
    )


def findings(report):
    return sorted((r.type, r.old, r.new) for r in report.collect())


def test_a_supplier_column_gets_a_longer_name(spark):
    spec = [("s_suppkey", "bigint"), ("s_phone", "text"), ("s_acctbal", "numeric")]
    source = [("s_suppkey", "bigint"), ("s_phone_no", "text"), ("s_acctbal", "numeric")]
    cats = frames(spark, source, spec, [name for name, _ in spec])
    assert findings(drift.drift_report(*cats)) == [("rename_candidate", "s_phone", "s_phone_no"), ("schema_only", "s_phone", None)]


def test_supplier_columns_go(spark):
    spec = ["s_suppkey", "s_comment", "s_phone"]
    cats = frames(spark, ["s_suppkey"], spec, spec)
    assert findings(drift.drift_report(*cats)) == [("schema_only", "s_comment", None), ("schema_only", "s_phone", None)]


def test_observed_columns_prove_nothing_gone(spark):
    seen, spec, mart = frames(spark, ["s_suppkey", "s_phone_no"], [("s_suppkey", "bigint"), ("s_phone", "text"), ("s_rank", "int")], ["s_suppkey", "s_phone", "s_old"])
    assert findings(drift.observed_report(seen, spec, mart)) == [("dwh_only", "s_old", None), ("missing_in_dwh", None, "s_rank")]


def test_missing_and_unknown_mart_columns_ignore_case(spark):
    cats = frames(spark, ["ID", "Name"], ["id", "name"], ["Id", "stray", "made"])
    extra = spark.createDataFrame([(1, "Made")], "view_id long, target string")
    assert findings(drift.drift_report(*cats, extra)) == [("dwh_only", "stray", None), ("missing_in_dwh", None, "name")]


def test_alias_aware(spark):
    cats = frames(spark, ["id", "name"], ["id", ("name", "text", "label")], ["id", "label"])
    assert findings(drift.drift_report(*cats)) == []
    unaware = findings(drift.drift_report(*cats, alias_aware=False))
    assert ("schema_only", "label", None) in unaware and ("rename_candidate", "label", "name") in unaware


def test_types_gate_renames(spark):
    cats = frames(spark, [("id", "int4"), ("name_new", "integer")], [("id", "int4"), ("name", "text")], ["id", "name"])
    assert findings(drift.drift_report(*cats)) == [("schema_only", "name", None)]
    # With spec types only, a new column has no type and nothing speaks against the pair.
    assert ("rename_candidate", "name", "name_new") in findings(drift.drift_report(*cats, source_types=False))
    same = frames(spark, [("id", "int4"), ("names", "TEXT")], [("id", "int4"), ("name", "text")], ["id", "name"])
    best = drift.drift_report(*same).where("type = 'rename_candidate'").first()
    assert best.score > 1  # the bonus is added on top
    assert findings(drift.drift_report(*same, renames=False)) == [("schema_only", "name", None)]


def test_candidates_need_a_known_type(spark):
    schema = "g long, name string, type string"
    old = spark.createDataFrame([(1, "name", ""), (1, "title", "Text ")], schema)
    new = spark.createDataFrame([(1, "names", None), (1, "titles", "text"), (2, "name", "text")], schema)
    pairs = drift.rename_candidates(old, new, ["g"])
    assert {(r.old, r.new) for r in pairs.collect()} == {("title", "titles"), ("title", "names"), ("name", "titles")}


def test_groups_are_opened_refreshed_and_closed(spark):
    now = F.lit("2030-01-01").cast("timestamp")
    empty = spark.createDataFrame([], drift.GROUPS), spark.createDataFrame([], drift.ITEMS)
    first = drift.drift_report(*frames(spark, ["id"], ["id", "a", "b"], ["id", "a", "b"]))
    groups, items = drift.upsert_groups(first, *empty, now)
    assert [r.status for r in groups.collect()] == ["open"] and items.count() == 2
    second = drift.drift_report(*frames(spark, ["id", "b"], ["id", "a", "b"], ["id", "a", "b"]))
    groups2, items2 = drift.upsert_groups(second, groups, items, F.lit("2031-01-01").cast("timestamp"))
    assert [r.id for r in groups2.collect()] == [groups.first().id]
    assert [r.old_column_name for r in items2.where("mismatch_type = 'schema_only'").collect()] == ["a"]
    none = first.where("false")
    assert drift.upsert_groups(none, groups, items, now)[1].count() == 2
    closed = drift.resolve_group(groups2, groups.first().id, now)
    reopened, _ = drift.upsert_groups(second, closed, items2, F.lit("2032-01-01").cast("timestamp"))
    assert sorted(r.status for r in reopened.collect()) == ["open", "resolved"]


# -- resolutions --------------------------------------------------------------------------------

PARTS = ("p_partkey", "p_brand", "p_size", "p_comment")


@pytest.mark.parametrize(
    "decision,left,renames,drops",
    [
        (Resolution(ignores=PARTS), PARTS, {}, ()),
        (Resolution(deletes=("P_Size", "p_size")), ("p_partkey", "p_brand", "p_comment"), {}, ()),
        (Resolution(drops=("P_COMMENT",), deletes=("p_brand",)), ("p_partkey", "p_size"), {}, ("P_COMMENT",)),
        (
            Resolution(renames=(("p_size", "p_width"), ("p_width", "p_depth"))),
            ("p_partkey", "p_brand", "p_depth", "p_comment"),
            {"p_size": "p_width", "p_width": "p_depth"},
            (),
        ),
        (
            Resolution(renames=(("p_brand", "p_maker"),), drops=("p_maker",)),
            ("p_partkey", "p_size", "p_comment"),
            {"p_brand": "p_maker"},
            ("p_maker",),
        ),
    ],
    ids=["ignored", "deleted twice", "dropped and deleted", "renamed twice", "renamed and dropped"],
)
def test_decisions_on_part_columns(decision, left, renames, drops):
    change = plan_resolution(spec_with(*map(ColumnSpec, PARTS)), KEY, decision)
    assert tuple(c.name for c in change.spec.tables[0].columns) == left
    assert (change.renames, change.drops, change.spec_changed) == (renames, drops, left != PARTS)


def test_resolution_of_an_alias_keeps_the_mart_name(spark):
    spec = spec_with(ColumnSpec("col1", alias="label"))
    change = plan_resolution(spec, KEY, Resolution(renames=(("col1", "new_col"),)))
    assert change.renames == {} and change.spec.tables[0].columns[0].name == "new_col"
    with pytest.raises(SpecError):
        plan_resolution(spec, KEY, Resolution(renames=(("none", "x"),)))
    mart = spark.range(1).toDF("other")
    broken = plan_resolution(spec_with(ColumnSpec("a")), KEY, Resolution(renames=(("a", "b"),)))
    with pytest.raises(NotFound):
        project_change(mart, broken)


def test_unknown_ids(spark, store):
    reg = Registry(store)
    evolution = Evolution(store, reg)
    with pytest.raises(NotFound):
        reg.get(1)
    with pytest.raises(NotFound):
        reg.update(1, spec_with(ColumnSpec("a")))
    for call in (lambda: evolution.group(1), lambda: evolution.accept(1), lambda: evolution.reject(1)):
        with pytest.raises(NotFound):
            call()


def test_suggestions_can_be_rejected(spark, store):
    evolution = Evolution(store, Registry(store))
    spec = [("id", "text"), ("name", "text")]
    report = drift.drift_report(*frames(spark, [("id", "text"), ("names", "text")], spec, ["id", "name"]))
    evolution.suggest(report)
    evolution.suggest(report)
    only = evolution.list_suggestions(db="shop", limit="x", offset=-3).collect()
    assert [(s.old_column_name, s.new_column_name) for s in only] == [("name", "names")]
    evolution.reject(only[0].id)
    assert evolution.suggestions().count() == 0


# -- registry -----------------------------------------------------------------------------------


def test_registry(spark, store):
    reg = Registry(store)
    value_map = Transform("FieldTransform", values={"1": "x"})
    flat = Transform("JSON", fields=(JsonField("f", "Flat", "int"),))
    one = spec_with(
        ColumnSpec("id", is_update_key=True, view_key="other_id"), ColumnSpec("st", transform=value_map),
        ColumnSpec("doc", transform=flat, type="jsonb"), name="one",
    )
    two = MartSpec("two", (TableSpec(KEY, (ColumnSpec("ID", alias="Key"),)), TableSpec(TableKey("db2", "s", "t"), (ColumnSpec("a"),))))
    assert (reg.add(one), reg.add(two)) == (1, 2)
    assert reg.get(1) == one and reg.specs() == {1: one, 2: two}
    only = spark.createDataFrame([("db2", "s", "t"), ("db3", "s", "t")], "db string, schema string, table string")
    assert reg.specs(only) == {2: two}
    reg.update(2, one)
    reg.update(1, two)
    reg.update(1, one)
    assert reg.specs(only) == {} and reg.specs() == {1: one, 2: one}
    reg.update(2, two)
    assert store.read(Registry.TABLE).count() == 6
    frame = reg.frame()
    assert rows_of(registry.topics(frame)) == [("dbserver_db2.s.t",), ("dbserver_shop.stock.part",)]
    assert [tuple(r) for r in registry.summary(frame).orderBy(F.desc("id")).collect()] == [(2, "two", 2, 2), (1, "one", 1, 1)]
    assert rows_of(registry.views_using(frame, "shop", "stock", "part")) == [(1, "one"), (2, "two")]
    assert rows_of(registry.views_using(frame, "db2", "stock", "t")) == []
    assert rows_of(registry.routes(frame).select("view", "table")) == [("one", "part"), ("two", "part"), ("two", "t")]
    assert rows_of(registry.spec_columns(frame).where("view_id = 2").select("column", "target")) == [("a", "a"), ("id", "key")]
    assert [r[0] for r in rows_of(registry.extra_targets(frame).where("view_id = 1").select("target"))] == [
        "_seq", "flat", "other_id", "st_transformed", "updated_at",
    ]
    reg.update(2, one)
    assert reg.get(2) == one and reg.get(1) == one


def test_registry_tolerates_odd_specs(spark):
    odd = spark.createDataFrame([(1, '{"view_name": "A"}'), (2, '{"view_name": "b", "sources": [{"name": "s"}]}')], "id long, schema_view string")
    assert rows_of(registry.summary(odd)) == [(1, "a", 0, 0), (2, "b", 1, 0)]
    assert registry.topics(odd).count() == 0


# -- listings -----------------------------------------------------------------------------------


def test_paging_defaults(spark):
    df = spark.range(200)
    assert paging.ordered_page(df, ["id"]).count() == 50
    assert paging.ordered_page(df, ["id"], 0, "x").first()[0] == 199
    assert [r[0] for r in paging.ordered_page(df, ["id"], "2", "1", descending=False).collect()] == [1, 2]
    assert [r[0] for r in paging.paginate(df, ["id"], 0, -1).collect()] == list(range(10))
    assert [r[0] for r in paging.paginate(df, ["id"], 3, 2).collect()] == [4, 5]
    assert [r[0] for r in paging.page_after(df, ["id"], (5,), 2).collect()] == [6, 7]
    assert [r[0] for r in paging.page_after(df, ["id"], (5,), 2, descending=True).collect()] == [4, 3]
    assert [r[0] for r in paging.page_after(df, ["id"], None, 2).collect()] == [0, 1]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, s string")
    assert paging.match_all(df, {"s": None}).count() == 3
    assert rows_of(paging.match_all(df, {"s": "b", "id": 2})) == [(2, "b")]
    assert paging.in_range(df, "id", 2, 3).count() == 2 and paging.in_range(df, "id").count() == 3


def test_dedup(spark):
    ints = spark.createDataFrame(list(enumerate([1, 2, 2, 3, 1])), "pos int, v int")
    assert [r.v for r in dedup.keep_first(ints, "v", "pos").orderBy("pos").collect()] == [1, 2, 3]
    assert [r.v for r in dedup.repeats(ints, "v", "pos").orderBy("pos").collect()] == [2, 1]
    names = spark.createDataFrame(list(enumerate(["A", "b", "a", "B"])), "pos int, name string")
    assert rows_of(dedup.unique_ignore_case(names, "name", "pos")) == [("A", 0), ("b", 1)]


def test_dedup_meets_no_hot_value_in_one_task(spark):
    df = spark.range(10).select("id", F.lit("same").alias("v"))
    for result in (dedup.keep_first(df, "v", "id"), dedup.repeats(df, "v", "id")):
        plan = result._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "collect" not in plan


# -- discovery ----------------------------------------------------------------------------------


def test_catalog_of_known_tables(spark):
    frame = spark.createDataFrame([(1, "x", datetime.date(2024, 1, 1))], "id long, name string, day date")
    catalog = SourceCatalog(spark, {"shop": FrameSource({"stock.part": frame})})
    columns = discovery.column_catalog(spark, catalog, [KEY])
    assert rows_of(columns.select("column", "ordinal", "data_type")) == [("day", 3, "date"), ("id", 1, "bigint"), ("name", 2, "text")]
    assert rows_of(discovery.list_tables(columns)) == [("shop", "stock", "part")]
    tree = discovery.source_tree(columns).first()
    assert [(c["column"], c["data_type"]) for c in tree["tables"][0]["columns"]] == [("id", "bigint"), ("name", "text"), ("day", "date")]
    assert rows_of(count_tables(catalog, [KEY, KEY])) == [("shop", "stock", "part", 1)]
    with pytest.raises(NotFound):
        catalog.table(TableKey("shop", "stock", "none"))


def test_system_schemas_are_hidden(spark):
    columns = spark.createDataFrame([("db", s) for s in ("public", "pg_toast", "information_schema", "pgx")], "source string, schema string")
    assert rows_of(discovery.list_schemas(columns)) == [("db", "pgx"), ("db", "public")]


def test_database_name(spark):
    urls = spark.createDataFrame([("postgres://u:p@h:5432/shop?sslmode=disable",), ("no url at all",)], "u string")
    assert [r[0] for r in urls.select(discovery.database_name(F.col("u"))).collect()][0] == "shop"


def test_information_schema_of_a_named_source(spark):
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    key = "table_catalog string, table_schema string, table_name string"
    columns = frame(
        [("shop", "public", "t", c, i, "integer", "", "int4", "NO", None, None, None, None) for i, c in ((2, "b"), (1, "a"))],
        f"{key}, column_name string, ordinal_position int, data_type string, udt_schema string, udt_name string, "
        "is_nullable string, character_maximum_length int, numeric_precision int, numeric_scale int, column_default string",
    )
    usage = frame(
        [("shop", "public", "t", "a", n) for n in ("pk", "fk", "fk")], f"{key}, column_name string, constraint_name string"
    )
    constraints = frame(
        [("shop", "public", "t", "pk", "PRIMARY KEY"), ("shop", "public", "t", "fk", "FOREIGN KEY")],
        f"{key}, constraint_name string, constraint_type string",
    )
    schemata = frame([("shop", s) for s in ("public", "empty", "pg_toast")], "catalog_name string, schema_name string")
    comments = frame([("shop", "public", "t", "b", x) for x in ("one", "two")], f"{key}, column_name string, description string")
    info = discovery.InformationSchema(columns, usage, constraints, schemata, comments, "main")
    assert rows_of(discovery.list_schemas(info.schemas())) == [("main", "empty"), ("main", "public")]
    facts = info.facts()
    found = rows_of(facts.select("source", "database", "column", "is_pk", "is_fk", "is_unique", "description"))
    assert found == [("main", "shop", "a", True, True, False, None), ("main", "shop", "b", False, False, False, "two")]
    (row,) = discovery.source_assembly(facts, info.schemas()).collect()
    assert (row.source, row.database) == ("main", "shop")
    assert [(s.name, [t.name for t in s.tables]) for s in row.schemas] == [("empty", []), ("public", ["t"])]
    assert [c.column for c in row.schemas[1].tables[0].columns] == ["a", "b"]
    without = discovery.InformationSchema(columns, usage, constraints, schemata)
    assert {r.description for r in without.facts().collect()} == {None}


def test_line_catalogs_group_by_hash_and_write_no_table_names(spark, tmp_path, monkeypatch):
    from sparkmart.queries import drifts

    parts = [(1, "a b", 5), (2, "a b", 30), (3, "c", 45)]
    lines = [(7, 1, "N", "O"), (7, 2, "A", "F"), (7, 3, "R", "O"), (None, 1, "R", "F")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    settled = []
    monkeypatch.setattr(drifts, "settle", lambda df, name: settled.append(df) or df)
    source, spec, mart = drifts.line_catalogs(spark, str(tmp_path))
    assert "SortAggregate" not in settled[0]._jdf.queryExecution().executedPlan().toString() and "table" not in settled[0].columns
    assert sorted(map(tuple, source.collect())) == [("shop", "public", "orders_7", "a_b_30", "text"), ("shop", "public", "orders_7", "a_b_5", "int4")]
    assert sorted(map(tuple, spec.select("view_id", "table", "column", "type", "target").collect()), key=str) == [
        (7, "orders_7", "a_b_5", "int4", "a_b_5"), (7, "orders_7", "c_45", None, "c_45"), (None, None, "a_b_5", "int4", "a_b_5"),
    ]
    assert sorted(map(tuple, mart.collect())) == [(7, "a_b_5"), (7, "c_45")]


def test_findings_alone_are_written(spark, monkeypatch):
    settled = []
    monkeypatch.setattr(drift, "settle", lambda df, *_: settled.append(df) or df)
    drift.drift_report(*frames(spark, ["id", "a", "new"], ["id", "a", "gone"], ["id", "a", "gone"]))
    assert sorted(r["name"] for r in settled[0].collect()) == ["gone", "new"]


def test_groups_of_a_table_are_read_once(spark):
    report = drift.drift_report(*frames(spark, ["id"], ["id", "a"], ["id", "a"]), renames=False)
    first = report.first()
    place = (first["view_id"], first["db"], first["schema"], first["table"])
    rows = [(k, *place, status, None, None) for k, status in ((5, "resolved"), (6, "open"), (7, "open"))]
    groups = spark.createDataFrame(rows, drift.GROUPS)
    now = F.lit("2030-01-01").cast("timestamp")
    after, items = drift.upsert_groups(report, groups, spark.createDataFrame([], drift.ITEMS), now)
    assert after.count() == 3 and sorted(r["group_id"] for r in items.collect()) == [6, 7]
    after, items = drift.upsert_groups(report, groups.where("id = 5"), spark.createDataFrame([], drift.ITEMS), now)
    assert after.count() == 2 and items.first()["group_id"] not in (5, 6, 7)
