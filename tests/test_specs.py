"""Verdicts and decisions on all specs of a registry against the functions for one spec."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkmart.errors import SpecError
from sparkmart.operators import specs
from sparkmart.operators.evolve import Resolution, plan_resolution
from sparkmart.plans.join_graph import plan_joins
from sparkmart.plans.spec import MartSpec, TableKey, reject_duplicates
from sparkmart.queries.drifts import order_registry


def spec_text(tables, rules, name="M", legacy=()):
    """A spec of tables ``name → columns`` in one schema; a column may be (name, alias)."""
    def column(c):
        return {"name": c, "is_update_key": True} if isinstance(c, str) else {"name": c[0], "alias": c[1], "default": "0"}

    end = lambda t: {"source": "s", "schema": "p", "table": t, "column": "id"}
    joins = [{"inner": {"left": end(x), "right": end(y)}} for x, y in rules]
    joins += [{"inner": {"main_table": m, "source": "s", "schema": "p", "table": t, "column_first": "id", "column_second": "id"}} for m, t in legacy]
    listed = [{"name": t, "columns": [column(c) for c in cs]} for t, cs in tables.items()]
    return json.dumps({"view_name": name, "sources": [{"name": "s", "schemas": [{"name": "p", "tables": listed}]}], "joins": joins})


def one_verdict(text, strict):
    spec = MartSpec.from_json(text)
    try:
        plan = plan_joins(spec, strict=strict)
    except SpecError as e:
        return next(v for mark, v in {"selects no": specs.NO_TABLE, "endpoint": specs.UNKNOWN_TABLE, "no join rule": specs.NO_RULE, "one tree": specs.NO_TREE}.items() if mark in str(e)), None
    try:
        for t in spec.tables:
            reject_duplicates(t)
    except SpecError:
        return specs.EQUAL_NAMES, None
    return specs.OK, sorted(str(t.key) for t in spec.tables if t.key not in plan.tables)


@pytest.mark.parametrize("strict", [False, True])
def test_verdicts(spark, strict):
    rng, texts = random.Random(6), [spec_text({}, []), json.dumps({"view_name": "x"}), json.dumps({"view_name": "y", "sources": [], "joins": None})]
    for _ in range(120):
        tables = {f"t{k}": rng.sample(["id", "a", ("b", "a"), ("c", ""), "b"], rng.randrange(4)) for k in range(rng.randrange(1, 6))}
        names = [*tables, *tables, *tables, "unknown"]
        texts.append(spec_text(tables, [(rng.choice(names), rng.choice(names)) for _ in range(rng.randrange(4))]))
    chain = {f"t{k}": ["id"] for k in range(6)}
    texts += [spec_text(chain, [(f"t{k}", f"t{k + 1}") for k in reversed(range(5))]), spec_text(chain, [("t1", "t0")], legacy=[("", "t2"), ("t1", "t3")])]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, schema_view string")
    got = {r["id"]: r for r in specs.verdicts(frame, strict).collect()}
    seen = set()
    for k, text in enumerate(texts):
        verdict, left_out = one_verdict(text, strict)
        seen.add(verdict)
        assert got[k]["verdict"] == verdict, text
        assert left_out is None or sorted(got[k]["left_out"]) == left_out
        assert got[k]["name"] == MartSpec.from_json(text).name
    assert seen >= {specs.OK, specs.NO_TABLE, specs.NO_TREE, specs.UNKNOWN_TABLE, specs.EQUAL_NAMES} and (specs.NO_RULE in seen) == strict


def test_decisions(spark):
    rng, cases = random.Random(8), []
    for k in range(60):
        tables = {t: rng.sample(["id", "Note", ("b", "x"), ("C", ""), "e", "note"], rng.randrange(1, 6)) for t in ("t0", "t1")}
        decisions = [
            (rng.choice(["t0", "t1"]), rng.choice([specs.RENAME, specs.DELETE, specs.DROP]), rng.choice(["id", "NOTE", "b", "c", "e", "new"]), rng.choice(["new", "b"]))
            for _ in range(rng.randrange(4))
        ]
        decisions = [d for d in decisions if d[0] == decisions[0][0]]  # a resolution is of one table
        cases.append((k, spec_text(tables, [("t0", "t1")], f"M{k}"), decisions))
    registry = spark.createDataFrame([c[:2] for c in cases], "id long, schema_view string")
    rows = [(k, "s", "p", t, kind, old, new if kind == specs.RENAME else None, n) for k, _, ds in cases for n, (t, kind, old, new) in enumerate(ds)]
    frame = spark.createDataFrame(rows, "view_id long, db string, schema string, table string, decision string, old string, new string, seq int")
    got = {r["id"]: r for r in specs.resolved(registry, frame).collect()}
    failed = 0
    for k, text, ds in cases:
        spec = MartSpec.from_json(text)
        of = lambda kind: tuple(d[2] for d in ds if d[1] == kind)
        wanted = Resolution(renames=tuple((d[2], d[3]) for d in ds if d[1] == specs.RENAME), deletes=of(specs.DELETE), drops=of(specs.DROP))
        try:
            want = plan_resolution(spec, TableKey("s", "p", ds[0][0]), wanted).spec if ds else spec
        except SpecError:
            failed += 1
            assert got[k]["problem"] is not None and got[k]["schema_view"] == text
            continue
        assert got[k]["problem"] is None and MartSpec.from_json(got[k]["schema_view"]) == want
    assert 5 < failed < 50


def test_specs_without_decisions_or_sense(spark):
    registry = spark.createDataFrame([(1, "no spec"), (2, None), (3, spec_text({"t": ["id"]}, []))], "id long, schema_view string")
    kinds = "view_id long, db string, schema string, table string, decision string, old string, new string, seq int"
    none = spark.createDataFrame([], kinds)
    assert {r["id"]: r["schema_view"] for r in specs.resolved(registry, none).collect()} == {r["id"]: r["schema_view"] for r in registry.collect()}
    one = spark.createDataFrame([(k, "s", "p", "none", specs.RENAME, "id", "x", 1) for k in (1, 2, 3, 9)], kinds)
    assert {r["id"]: r["problem"] for r in specs.resolved(registry, one).collect()} == {1: "not a spec", 2: "not a spec", 3: "id"}
    assert {r["verdict"] for r in specs.verdicts(registry).collect()} == {specs.NO_TABLE, specs.OK}


def test_rules_part_their_tables(spark):
    rows = [([["a", "b"], ["c", "d"], ["b", "c"]], 1), ([["a", "b"], ["c", "d"], ["d", "e"]], 2), ([["a", "a"]], 1), ([["d", "c"], ["c", "b"], ["b", "a"]], 1), ([], 0)]
    frame = spark.createDataFrame(rows, "rules array<array<string>>, want int")
    joined = F.array_distinct(F.flatten("rules"))
    assert all(r[0] == r[1] for r in frame.select(specs._parts(F.col("rules"), joined), "want").collect())


def test_order_registry_groups_lines_once(spark, tmp_path):
    lines = [(1, 1, 4, 3, 10.0), (1, 2, 4, 4, 60.0), (1, 7, 9, 5, 3.0), (2, 7, 1, 1, 1.0), (None, 1, 1, 1, 1.0), (3, 1, None, 2, 7.0)]
    kinds = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"
    spark.createDataFrame(lines, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    registry = order_registry(spark, str(tmp_path))
    plan = registry._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    got = {r[0]: json.loads(r[1]) for r in registry.collect()}
    tables = {k: v["sources"][0]["schemas"][0].get("tables") for k, v in got.items()}
    assert tables[1] == [{"name": "p0", "columns": [{"name": "c10"}, {"name": "c10"}]}, {"name": "s0", "columns": []}, {"name": "s1", "columns": []}]
    assert tables[2] is None and tables[None] is None
    assert tables[3] == [{"columns": [{"name": "c7"}]}, {"name": "s2", "columns": []}]
    assert [len(got[k]["joins"]) for k in (1, 2, None, 3)] == [3, 1, 1, 1]
    assert {r["id"]: r["verdict"] for r in specs.verdicts(registry).collect()} == {1: specs.UNKNOWN_TABLE, 2: specs.NO_TABLE, None: specs.NO_TABLE, 3: specs.UNKNOWN_TABLE}
