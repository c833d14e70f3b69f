import pytest

from sparkmart.errors import SpecError
from sparkmart.plans.join_graph import hang_from, plan_joins
from sparkmart.plans.mart import mart_columns, mart_frame, order_key
from sparkmart.plans.spec import (
    ColumnSpec,
    Endpoint,
    JoinRule,
    MartSpec,
    TableKey,
    TableSpec,
    collapse_duplicates,
    remove_columns,
    rename_column,
    unique_names,
)
from sparkmart.sources.catalog import FileSource, FrameSource, JdbcSource, SourceCatalog, TableSource

SEGMENTS = {"type": "FieldTransform", "mode": "Mapping", "output_column": "segment",
            "mapping": {"type_map": "FieldTransform", "alias_new_column_transform": "segment_label",
                        "mapping": {"BUILDING": "construction", "MACHINERY": "industry"}}}
NOTES = {"type": "JSON", "mode": "Mapping", "output_column": "o_notes",
         "mapping": {"type_map": "JSON", "mapping_json": [{"type_field": "int", "mapping": {"floor": "ship_floor"}},
                                                          {"type_field": "text", "mapping": {"gate": "ship_gate"}}]}}


def wire(name, **facts):
    return {"name": name, "is_nullable": True, **facts}


BASIC = {
    "view_name": "Order_Desk",
    "joins": [{"inner": {"main_table": "orders", "source": "shop", "schema": "sales", "table": "customer",
                         "column_first": "o_custkey", "column_second": "c_custkey"}}],
    "sources": [{"name": "shop", "schemas": [{"name": "sales", "tables": [
        {"name": "orders", "columns": [
            wire("o_orderkey", type="int8", is_primary_key=True),
            wire("o_custkey", type="int8", is_update_key=True, view_key="c_custkey",
                 reference={"source": "shop", "schema": "sales", "table": "customer", "column": "c_custkey"}),
            wire("o_notes", type="jsonb", transform=NOTES),
        ]},
        {"name": "customer", "columns": [
            wire("c_custkey", type="int8", is_update_key=True),
            wire("c_mktsegment", type="text", transform=SEGMENTS),
            wire("c_fax", type="varchar", is_deleted=True),
        ]},
    ]}]}],
}


def key(name, source="a"):
    return TableKey(source, "public", name)


def spec_of(*names, joins=()):
    rules = tuple(JoinRule(Endpoint(key(a), "id"), Endpoint(key(b), "id")) for a, b in joins)
    return MartSpec("m", tuple(TableSpec(key(n), (ColumnSpec(f"{n}_c"),)) for n in names), rules)


def test_json_round_trip():
    spec = MartSpec.from_json(BASIC)
    assert spec.name == "order_desk"
    assert MartSpec.from_json(spec.to_json()) == spec
    orders, customer = (t["columns"] for t in spec.to_dict()["sources"][0]["schemas"][0]["tables"])
    assert orders[1]["reference"]["table"] == "customer"
    assert orders[2]["transform"]["mapping"]["type_map"] == "JSON"
    assert (customer[1]["transform"]["mode"], customer[1]["transform"]["output_column"]) == ("Mapping", "segment")


def test_mart_columns_list_selected_before_derived():
    spec = MartSpec.from_json(BASIC)
    assert mart_columns(spec) == [
        "o_orderkey", "o_custkey", "o_notes", "ship_floor", "ship_gate", "c_custkey", "c_mktsegment", "c_fax", "segment_label",
    ]
    assert order_key(spec) == "o_orderkey"
    assert spec.tables[0].conflict_columns() == ("o_custkey", "c_custkey")
    assert spec.tables[1].conflict_columns() == ("c_custkey",)
    assert spec.tables[1].written_columns() == ("c_custkey", "c_mktsegment", "segment_label")


def test_value_map_output_defaults_to_name_transformed():
    col = ColumnSpec.from_dict({"name": "st", "transform": {"type": "FieldTransform", "mapping": {"mapping": {"1": "x"}}}})
    assert col.value_map() == ("st_transformed", {"1": "x"})


def test_columns_with_one_mart_name_collapse_to_the_first():
    columns = [ColumnSpec("p_brand"), ColumnSpec("p_mfgr", alias="maker"), ColumnSpec("p_brand"), ColumnSpec("maker"), ColumnSpec("p_type")]
    clean, again = collapse_duplicates(columns)
    assert [(c.name, c.target) for c in clean] == [("p_brand", "p_brand"), ("p_mfgr", "maker"), ("p_type", "p_type")]
    assert again == ("p_brand", "maker")


def test_scan_rejects_duplicates(spark):
    spec = MartSpec("m", (TableSpec(key("users"), (ColumnSpec("id"), ColumnSpec("id"))),))
    catalog = SourceCatalog(spark, {"a": FrameSource({"public.users": spark.range(1)})})
    with pytest.raises(SpecError, match="equal names"):
        mart_frame(spec, catalog)


def test_chain_join_across_sources():
    users, profiles, sessions = key("users"), key("profiles", "b"), key("sessions", "b")
    tables = tuple(TableSpec(k, (ColumnSpec("x"),)) for k in (users, profiles, sessions))
    rules = (
        JoinRule(Endpoint(profiles, "profile_id"), Endpoint(sessions, "profile_id")),
        JoinRule(Endpoint(users, "id"), Endpoint(profiles, "user_id")),
    )
    plan = plan_joins(MartSpec("m", tables, rules))
    assert plan.root == users
    assert [s.table for s in plan.steps] == [profiles, sessions]


def test_rule_may_attach_its_left_side():
    plan = plan_joins(spec_of("a", "b", "c", joins=[("a", "b"), ("c", "b")]))
    assert plan.root == key("a") and [s.table.table for s in plan.steps] == ["b", "c"]


@pytest.mark.parametrize(
    "tables,joins",
    [
        (["a"], [("a", "b")]),  # endpoint not in the spec
        (["a", "b", "c", "d"], [("a", "b"), ("c", "d")]),  # two trees
        (["a", "b", "c"], [("a", "b"), ("b", "c"), ("a", "c")]),  # cycle
        (["a", "b"], [("a", "b"), ("a", "b")]),  # second rule for one pair
    ],
)
def test_bad_join_graphs(tables, joins):
    with pytest.raises(SpecError):
        plan_joins(spec_of(*tables, joins=joins))


def test_joins_hang_from_any_table():
    plan = plan_joins(spec_of("a", "b", "c", "d", joins=[("a", "b"), ("b", "c"), ("b", "d")]))
    below = hang_from(plan, key("c"))
    assert {t.table: [c.table for c, _ in links] for t, links in below.items()} == {
        "c": ["b"], "b": ["a", "d"], "a": [], "d": [],
    }
    (_, pairs), = below[key("c")]
    assert [(x.table.table, y.table.table) for x, y in pairs] == [("c", "b")]
    cycle = plan_joins(spec_of("a", "b", "c", joins=[("a", "b"), ("b", "c"), ("a", "c")]), composite=True)
    assert hang_from(cycle, key("a")) is None


def test_composite_folds_extra_rules_into_the_condition():
    plan = plan_joins(spec_of("a", "b", "c", joins=[("a", "b"), ("b", "c"), ("a", "c")]), composite=True)
    assert [len(s.pairs) for s in plan.steps] == [1, 2]


def test_tables_without_rule():
    spec = spec_of("a", "b")
    assert plan_joins(spec).tables == {key("a")}
    with pytest.raises(SpecError):
        plan_joins(spec, strict=True)
    assert mart_columns(spec_of("a", "b", "c", joins=[("a", "b")])) == ["a_c", "b_c"]


def test_equal_names_across_tables_are_an_error(spark):
    tables = tuple(TableSpec(key(n), (ColumnSpec("id"),)) for n in ("a", "b"))
    spec = MartSpec("m", tables, (JoinRule(Endpoint(key("a"), "id"), Endpoint(key("b"), "id")),))
    frames = {"public.a": spark.range(2), "public.b": spark.range(2)}
    with pytest.raises(SpecError, match="equal name"):
        mart_frame(spec, SourceCatalog(spark, {"a": FrameSource(frames)}))


def test_aliased_join_key_and_same_table_name_in_two_sources(spark):
    left, right = key("t", "x"), key("t", "y")
    spec = MartSpec(
        "m",
        (TableSpec(left, (ColumnSpec("id", alias="left_id"),)), TableSpec(right, (ColumnSpec("v"),))),
        (JoinRule(Endpoint(left, "id"), Endpoint(right, "id")),),
    )
    frames_y = {"public.t": spark.createDataFrame([(1, "one"), (7, "seven")], "id long, v string")}
    catalog = SourceCatalog(spark, {"x": FrameSource({"public.t": spark.range(3)}), "y": FrameSource(frames_y)})
    assert [tuple(r) for r in mart_frame(spec, catalog).collect()] == [(1, "one")]


def test_unknown_table_and_source(spark):
    with pytest.raises(SpecError):
        spec_of("customers").table(key("orders"))
    with pytest.raises(ValueError):
        SourceCatalog(spark, {}).table(key("t"))


def test_empty_input_gives_an_empty_mart(spark):
    spec = spec_of("a", "b", joins=[("a", "b")])
    frames = {
        "public.a": spark.createDataFrame([], "id long, a_c string"),
        "public.b": spark.createDataFrame([(1, "x")], "id long, b_c string"),
    }
    assert mart_frame(spec, SourceCatalog(spark, {"a": FrameSource(frames)})).count() == 0


def test_rename_and_remove_in_spec():
    spec = MartSpec.from_json(BASIC)
    orders = TableKey("shop", "sales", "orders")
    renamed = rename_column(spec, TableKey("SHOP", "Sales", "ORDERS"), "O_NOTES", "remarks")
    assert [c.name for c in renamed.table(orders).columns][2] == "remarks"
    with pytest.raises(SpecError, match="table"):
        rename_column(spec, key("none"), "o_notes", "x")
    with pytest.raises(SpecError, match="column"):
        rename_column(spec, orders, "none", "x")
    removed, changed = remove_columns(spec, orders, ["O_NOTES"])
    assert changed and "o_notes" not in [c.name for c in removed.table(orders).columns]
    same, changed = remove_columns(spec, TableKey("SHOP", "sales", "orders"), ["o_notes"])
    assert not changed and same == spec
    assert unique_names(["P_Size", "p_type", "p_size", "P_TYPE", "p_name"]) == ["P_Size", "p_type", "p_name"]


def test_jdbc_parts_follow_the_rows():
    source = JdbcSource("jdbc:postgresql://h/db", partition_by={"orders": "o_orderkey"}, rows_per_part=1000)
    options = source.scan_options(key("orders"), "o_orderkey", 1, 900_000, 3500)
    assert options["partitionColumn"] == "o_orderkey" and options["numPartitions"] == "4"
    assert (options["lowerBound"], options["upperBound"]) == ("1", "900000")
    query = source.range_query(key("orders"), "o_orderkey")
    assert query == 'SELECT MIN("o_orderkey") AS lo, MAX("o_orderkey") AS hi, COUNT(*) AS n FROM "public"."orders"'
    conditions = source.hash_predicates("o_clerk", 2500)
    assert len(conditions) == 3 and conditions[0].startswith('"o_clerk" IS NULL OR mod(abs(hashtext(')
    assert conditions[2].endswith(", 3) = 2")
    assert source.hash_predicates("o_clerk", 10) == ["1 = 1"]
    assert "`o_clerk`" in JdbcSource("jdbc:mysql://h/db", rows_per_part=1).hash_predicates("o_clerk", 2)[1]


def test_file_and_table_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id long, name string")
    df.write.json(str(tmp_path / "public" / "j"))
    df.write.csv(str(tmp_path / "public" / "c"), header=True)
    df.createOrReplaceTempView("unused")
    path = str(tmp_path) + "/{schema}/{table}"
    ddl = "id long, name string"
    catalog = SourceCatalog(
        spark,
        {
            "j": FileSource(path, "json", schemas={"j": ddl}),
            "c": FileSource(path, "csv", {"header": "true"}, {"c": ddl}),
            "t": TableSource(),
        },
    )
    for k in (key("j", "j"), key("c", "c")):
        assert [tuple(r) for r in catalog.table(k).collect()] == [(1, "x")]
    spark.sql("CREATE DATABASE IF NOT EXISTS spec_db")
    df.write.mode("overwrite").saveAsTable("spec_db.people")
    assert catalog.table(TableKey("t", "spec_db", "people")).count() == 1
    spark.sql("DROP DATABASE spec_db CASCADE")
