"""Plan checks: what is read, what is shuffled, and what happens to a key that holds a third of all rows."""

import re
import subprocess
import sys
from contextlib import contextmanager
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkmart.operators import dedup
from sparkmart.operators.changes import fold, has
from sparkmart.operators.upsert import overlay, unmatched
from sparkmart.plans.mart import current_view, mart_frame
from sparkmart.plans.spec import ColumnSpec, Endpoint, JoinRule, MartSpec, TableKey, TableSpec
from sparkmart.plans.build import source_sizes
from sparkmart.queries.marts import CUSTOMER_ORDERS, FIVE_TABLES
from sparkmart.session import clear_scratch, settle, size_conf, tune, tuned
from sparkmart.sources.catalog import FileSource, FrameSource, SourceCatalog

ROWS = 300_000
HOT = "CASE WHEN id % 3 = 0 THEN 5 ELSE id % 1000 END AS k"


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# No broadcast, and small thresholds that make a local partition count as skewed.
SKEW = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "100KB",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "100KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
}


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def hot_rows(spark, path, name, *columns):
    """A table on disk whose column ``k`` is 5 in a third of all rows."""
    target = str(path / name)
    spark.range(0, ROWS, 1, 16).select("id", F.expr(HOT), *columns).write.parquet(target)
    return spark.read.parquet(target)


def test_settings_follow_the_input_size():
    assert size_conf(40 << 20) == {}
    assert size_conf(100 << 30)["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == "400"
    large = size_conf(100 << 40)
    assert large["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == "409600"
    assert large["spark.sql.files.maxPartitionBytes"] == str(512 << 20)


def test_settings_go_back_after_a_large_input(spark):
    keys = list(size_conf(100 << 40))
    tune(spark)
    before = {k: spark.conf.get(k, None) for k in keys}
    with tuned(spark, 100 << 40):
        assert spark.conf.get(keys[0]) == "409600"
        tune(spark, 1 << 40)
        assert spark.conf.get(keys[0]) == "4096"
    assert {k: spark.conf.get(k, None) for k in keys} == before
    tune(spark, 100 << 40)
    tune(spark)
    assert {k: spark.conf.get(k, None) for k in keys} == before


def test_scratch_data_can_be_cleared(spark, tmp_path):
    kept = settle(spark.range(3), "some")
    folder = Path(kept.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists() and spark.sparkContext.applicationId in str(folder)
    clear_scratch(spark)
    assert not folder.exists()


def test_the_package_reaches_workers_that_lack_it(tmp_path):
    """Started elsewhere, with the package not on the workers' path, its Python functions still run."""
    script = f"""
import sys
sys.path.insert(0, {str(Path(__file__).parents[1])!r})
from sparkmart.session import local_session, ship_package
spark = local_session(2, "ship", memory="1g")
ship_package(spark)
sys.path.pop(0)
from pyspark.sql import functions as F
from sparkmart.functions.similarity import jaro_winkler
rows = spark.createDataFrame([("abc", "abd")], "a string, b string")
assert 0.8 < rows.select(jaro_winkler(F.col("a"), F.col("b"))).first()[0] < 0.9
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_build_measures_its_sources(spark, sf_dir):
    files = SourceCatalog(spark, {"shop": FileSource(sf_dir + "/{table}.parquet")})
    keys = [t.key for t in CUSTOMER_ORDERS.tables]
    sizes = source_sizes(files, keys)
    assert len(sizes) == 3 and all(0 < s < 1 << 30 for s in sizes)
    unsized = {f"public.{k.table}": spark.createDataFrame([(1,)], "a int") for k in keys}
    assert source_sizes(SourceCatalog(spark, {"shop": FrameSource(unsized)}), keys) == []


def test_a_hot_join_key_is_split(spark, tmp_path):
    facts = hot_rows(spark, tmp_path, "facts", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    dims = spark.range(1000).select(F.col("id").alias("d"), F.col("id").cast("string").alias("name"))
    a, b = TableKey("s", "p", "facts"), TableKey("s", "p", "dims")
    spec = MartSpec(
        "m",
        (TableSpec(a, (ColumnSpec("id", is_nullable=True), ColumnSpec("v", is_nullable=True))),
         TableSpec(b, (ColumnSpec("name", is_nullable=True),))),
        (JoinRule(Endpoint(a, "k"), Endpoint(b, "d")),),
    )
    with settings(spark, **SKEW):
        df = mart_frame(spec, SourceCatalog(spark, {"s": FrameSource({"p.facts": facts, "p.dims": dims})}))
        plan = final_plan(df)
        assert "skew=true" in plan
        assert df.count() == ROWS


def changes_frame(spark, n=1000):
    return spark.range(n).select(
        F.col("id").alias("k"), F.lit(1).cast("bigint").alias("seq"), F.concat(F.lit("new"), "id").alias("v"), F.lit(True).alias(has("v"))
    )


def test_a_hot_mart_key_is_split_when_updated(spark, tmp_path):
    mart = hot_rows(spark, tmp_path, "mart", F.sha2(F.col("id").cast("string"), 256).alias("v")).select("k", "v")
    with settings(spark, **SKEW):
        out = overlay(mart, changes_frame(spark), ["k"])
        assert "skew=true" in final_plan(out)
        assert out.where("v like 'new%'").count() == ROWS


def test_hot_null_keys_of_a_mart_are_split(spark, tmp_path):
    key = F.when(F.col("k") != 5, F.col("k")).alias("k")
    mart = hot_rows(spark, tmp_path, "mart", F.sha2(F.col("id").cast("string"), 256).alias("v")).select(key, "v")
    with settings(spark, **SKEW):
        out = overlay(mart, changes_frame(spark), ["k"])
        assert "skew=true" in final_plan(out)
        assert out.count() == ROWS


def test_the_largest_table_is_shuffled_once(spark, sf_dir):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false"):
        df = mart_frame(FIVE_TABLES, SourceCatalog(spark, {"shop": FileSource(sf_dir + "/{table}.parquet")}))
        plan = df._jdf.queryExecution().executedPlan().toString()
    # Five tables, four joins, and every join shuffles its two sides; no shuffle carries line items twice.
    assert plan.count("Exchange hashpartitioning") == 8
    carrying = [p for p in plan.split("Exchange hashpartitioning")[1:] if "l_quantity" in p.split("\n")[1]]
    assert len(carrying) == 1


def shuffled_rows(df):
    """Rows written by each shuffle of an executed plan."""
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return found


def test_folding_shuffles_one_row_per_key_and_task(spark, tmp_path):
    rows = hot_rows(spark, tmp_path, "log", F.col("id").cast("string").alias("v")).select(
        "k", F.col("id").alias("seq"), "v", F.lit(True).alias(has("v"))
    )
    out = fold(rows, ["k"])
    out.collect()
    tasks = rows.rdd.getNumPartitions()
    assert max(shuffled_rows(out)) <= 1000 * tasks < ROWS


def test_null_keys_do_not_meet_in_one_group(spark):
    rows = spark.range(1000).select(
        F.lit(None).cast("bigint").alias("k"), F.col("id").alias("seq"), F.lit("x").alias("v"), F.lit(True).alias(has("v"))
    )
    out = fold(rows, ["k"])
    assert out.count() == 1000
    with settings(spark, spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="16"):
        sizes = fold(rows, ["k"]).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 300


def test_newest_version_shuffles_one_row_per_key_and_task(spark, tmp_path):
    rows = hot_rows(spark, tmp_path, "versions", F.col("id").cast("string").alias("v"))
    out = current_view(rows, ["k"], ("id",))
    out.collect()
    assert max(shuffled_rows(out)) <= 1000 * rows.rdd.getNumPartitions() < ROWS
    assert out.where("k = 5").first()["id"] == ROWS - 3


def test_repeats_of_a_hot_value_stay_spread(spark, tmp_path):
    rows = hot_rows(spark, tmp_path, "copies")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        out = dedup.repeats(rows, "k", "id")
        plan = final_plan(out)
        # The rows meet on their unique position, not on their value.
        assert "hashpartitioning(k" not in re.sub(r"_value", "k", plan.split("LeftAnti")[0])
        assert out.count() == ROWS - rows.select("k").distinct().count()


def test_unmatched_reads_only_key_columns(spark, tmp_path):
    mart = hot_rows(spark, tmp_path, "mart", F.lit("x").alias("v")).select("k", "v")
    out = unmatched(mart, changes_frame(spark, 2000), ["k"])
    plan = final_plan(out)
    assert "ReadSchema: struct<k:bigint>" in plan
    assert out.count() == 2000 - mart.select("k").distinct().count()


def test_scans_are_pruned_and_joins_stay_equi_joins(spark, sf_dir):
    df = entry.queries()["mart_customer_orders"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan and "o_orderpriority" not in plan and "n_regionkey" not in plan
    assert "IsNotNull(c_custkey)" in plan


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith("cdc_stream")))
def test_no_query_uses_a_cross_join_or_a_single_task_window(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython"):
        assert forbidden not in plan
    assert not ("Window" in plan and "SinglePartition" in plan)
