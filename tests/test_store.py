import pytest
from pyspark.sql import functions as F

from sparkmart.errors import NotFound, SpecError
from sparkmart.store import BUCKET, TableStore, suggest_buckets


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_publish_modes(spark, store):
    assert not store.exists("t")
    with pytest.raises(NotFound):
        store.read("t")
    store.publish("t", spark.range(3), if_exists="error")
    with pytest.raises(SpecError):
        store.publish("t", spark.range(9), if_exists="error")
    store.publish("t", spark.range(9), if_exists="keep")
    assert store.read("t").count() == 3
    store.publish("t", spark.range(5))
    assert store.read("t").count() == 5 and store.read("t", 1).count() == 3
    with pytest.raises(NotFound):
        store.read("t", 9)


def test_a_failed_write_publishes_nothing(spark, store):
    store.publish("t", spark.range(3))
    broken = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="boom"):
        store.publish("t", broken)
    assert store.version("t").number == 1 and store.read("t").count() == 3
    store.publish("t", spark.range(4))
    assert store.read("t").count() == 4


def test_two_writers_cannot_publish_one_version(spark, store):
    base = store.publish("t", spark.range(3))
    store.mark_batch("t", base, ("s", 1))
    with pytest.raises(RuntimeError, match="another writer"):
        store.mark_batch("t", base, ("s", 2))


def test_a_batch_rewrites_only_touched_buckets(spark, store):
    df = spark.range(200).select("id", F.lit("old").alias("v"))
    base = store.publish("t", df, ["id"], 8)
    assert len(base.folders) == 8
    one = store.read_version("t", base, {2})
    new = one.withColumn("v", F.lit("new"))
    after = store.publish_buckets("t", base, new, {2}, ("s", 4))
    same = [b for b in base.folders if base.folders[b] == after.folders[b]]
    assert sorted(same) == [b for b in sorted(base.folders) if b != "2"]
    assert store.read("t").where("v = 'new'").count() == one.count() > 0
    assert store.read("t").count() == 200 and after.batches == {"s": 4}
    assert store.read("t", 1).where("v = 'new'").count() == 0


def test_rows_for_other_buckets_are_added(spark, store):
    base = store.publish("t", spark.range(50), ["id"], 4)
    extra = spark.createDataFrame([(1000, 1)], f"id long, {BUCKET} int")
    store.publish_buckets("t", base, extra, set())
    assert store.read("t").count() == 51
    compacted = store.compact("t")
    assert all(len(f) == 1 for f in compacted.folders.values()) and store.read("t").count() == 51


def test_append_and_alter_without_rewriting(spark, store):
    df = spark.createDataFrame([(1, "x", 2.0)], "id long, name string, old double")
    base = store.publish("t", df, ["id"], 2)
    after = store.alter("t", {"name": "title"}, ["old", "never"])
    assert after.folders == base.folders
    store.append("t", spark.createDataFrame([("y", 5)], "title string, id int"))
    assert rows_of(store.read("t")) == [(1, "x"), (5, "y")]
    assert rows_of(store.columns("t").select("column", "ordinal")) == [("id", 1), ("title", 2)]
    store.alter("t", {"id": "key"})
    assert store.version("t").bucket_by == ("key",)
    with pytest.raises(NotFound):
        store.alter("t", {"nope": "x"})
    with pytest.raises(SpecError):
        store.alter("t", {"key": "title"})
    with pytest.raises(SpecError):
        store.append("t", spark.range(1).toDF("zzz"))
    store.alter("t", drops=["key"])
    store.append("t", spark.createDataFrame([("z",)], "title string"))
    assert rows_of(store.read("t")) == [("x",), ("y",), ("z",)]


def test_empty_tables_need_no_data(spark, store):
    store.create("t", spark.range(0).schema)
    assert store.is_empty("t") and store.read("t").count() == 0
    store.append("t", spark.range(2))
    assert store.create("t", spark.range(0).schema).number == 2
    store.publish("u", spark.range(0), ["id"], 4)
    assert store.read("u").columns == ["id"] and store.read("u").count() == 0


def test_prune_keeps_what_is_still_used(spark, store):
    base = store.publish("t", spark.range(100), ["id"], 4)
    for batch in range(3):
        one = store.read_version("t", base, {1})
        base = store.publish_buckets("t", base, one, {1}, ("s", batch))
    store.prune("t", keep=1)
    assert store.read("t").count() == 100
    with pytest.raises(NotFound):
        store.version("t", 1)


def test_a_large_bucket_is_split_into_several_files(spark, tmp_path):
    # A third of all rows share one layout key.
    store = TableStore(spark, str(tmp_path / "s"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100KB")
    try:
        hot = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))
        df = spark.range(300_000).select(hot.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")).repartition(8)
        version = store.publish("t", df, ["k"], 4)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {b: store._files.names(f"{store.root}/t/data/{f[0]}") for b, f in version.folders.items()}
    counts = sorted(len([n for n in names if n.endswith(".parquet")]) for names in files.values())
    assert counts[-1] > 4
    assert store.read("t").count() == 300_000


def test_suggested_buckets():
    assert suggest_buckets(0) == 1 and suggest_buckets(100 << 40) == 25600
