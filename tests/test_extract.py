import datetime

import pytest

from sparkmart.files import Files
from sparkmart.plans.spec import TableKey
from sparkmart.sources.catalog import JdbcSource
from sparkmart.sources.extract import Extraction, equi_depth_bounds, frame_part, literal, range_conditions

ORDERS = TableKey("shop", "public", "orders")


def test_parts_of_a_skewed_key_are_alike(spark):
    keys = spark.range(10_000).selectExpr("id * id * id AS k")
    bounds = equi_depth_bounds(keys, "k", 8)
    sizes = [frame_part(keys, [c]).count() for c in range_conditions("k", bounds)]
    assert len(sizes) == 8 and sum(sizes) == 10_000 and max(sizes) <= 2 * min(sizes)


def test_hot_null_and_missing_keys(spark):
    keys = spark.range(900).selectExpr("CASE WHEN id < 300 THEN 5 WHEN id < 310 THEN NULL ELSE id END AS k")
    conditions = range_conditions("k", equi_depth_bounds(keys, "k", 9))
    sizes = [frame_part(keys, [c]).count() for c in conditions]
    assert sum(sizes) == 900 and min(sizes) > 0 and max(sizes) <= 420  # the hot key, the null keys and a part
    assert equi_depth_bounds(keys.where("k IS NULL"), "k", 4) == []
    assert equi_depth_bounds(keys.where("false"), "k", 4) == [] and equi_depth_bounds(keys, "k", 1) == []
    assert equi_depth_bounds(keys.where("k = 5"), "k", 4) == []
    assert range_conditions("k", []) == ["1 = 1"]


def test_bounds_as_text():
    assert literal(datetime.datetime(2024, 1, 2, 3)) == "TIMESTAMP '2024-01-02 03:00:00'"
    assert literal(datetime.date(2024, 1, 2)) == "DATE '2024-01-02'" and literal(7) == "7"
    with pytest.raises(ValueError):
        literal("x")


def test_an_extraction_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id AS k", "id % 7 AS v")
    read, plans, stop = [], [], [True]

    def parts(conditions):
        if len(read) == 2 and stop[0]:
            raise RuntimeError("connection lost")
        read.append(conditions)
        return frame_part(rows, conditions)

    def plan():
        plans.append(1)
        return range_conditions("k", equi_depth_bounds(rows, "k", 10))

    job = lambda: Extraction(spark, str(tmp_path / "copy"), parts, plan, wave=3)
    with pytest.raises(RuntimeError):
        job().run()
    with pytest.raises(ValueError):
        job().read()
    # A wave that was cut off in the middle has files but no mark.
    frame_part(rows, ["k < 50"]).write.parquet(str(tmp_path / "copy" / "wave=2"))
    Files(spark, str(tmp_path)).remove(str(tmp_path / "copy" / "wave=2" / "_SUCCESS"))
    stop[0] = False
    copy = job().run()
    assert sorted(tuple(r) for r in copy.collect()) == [(i, i % 7) for i in range(1000)]
    assert len(read) == 4 and len({tuple(c) for c in read}) == 4 and plans == [1]
    job().run()
    assert len(read) == 4


def test_an_empty_table_is_extracted(spark, tmp_path):
    rows = spark.range(0).toDF("k")
    copy = Extraction(spark, str(tmp_path / "copy"), lambda c: frame_part(rows, c), lambda: range_conditions("k", equi_depth_bounds(rows, "k", 5)))
    assert copy.run().columns == ["k"] and copy.read().count() == 0


def test_sampled_keys_by_dialect():
    big, small = 10**9, 1000
    pg = JdbcSource("jdbc:postgresql://h/db")
    assert pg.sample_query(ORDERS, "id", big) == 'SELECT "id" FROM "public"."orders" TABLESAMPLE SYSTEM (0.020000)'
    assert pg.sample_query(ORDERS, "id", small) == 'SELECT "id" FROM "public"."orders"'
    assert "rand() * 100 < 0.020000" in JdbcSource("jdbc:mysql://h/db").sample_query(ORDERS, "id", big)
    assert "SAMPLE" not in JdbcSource("jdbc:other://h/db").sample_query(ORDERS, "id", big)
