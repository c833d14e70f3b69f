import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmart.functions import convert, similarity, transform
from sparkmart.functions.types import mart_type, spark_type, type_name
from sparkmart.operators import similar
from sparkmart.plans.spec import ColumnSpec, JsonField, TableKey, TableSpec, Transform

KEY = TableKey("a", "public", "t")


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return list(row)


@pytest.mark.parametrize(
    "facts,ddl,expected",
    [
        (dict(type="int2"), "smallint", T.ShortType()),
        (dict(type="integer"), "integer", T.IntegerType()),
        (dict(data_type="ARRAY", udt_name="_int4"), "integer[]", T.ArrayType(T.IntegerType())),
        (dict(data_type="ARRAY"), "text[]", T.ArrayType(T.StringType())),
        (dict(type="_uuid"), "uuid[]", T.ArrayType(T.StringType())),
        (dict(data_type="USER-DEFINED", udt_name="citext"), "text", T.StringType()),
        (dict(data_type="USER-DEFINED", udt_name="_mood"), "text[]", T.ArrayType(T.StringType())),
        (dict(data_type="character varying", char_max_len=20), "varchar(20)", T.StringType()),
        (dict(type="varchar(7)"), "varchar(7)", T.StringType()),
        (dict(type="varchar"), "text", T.StringType()),
        (dict(type="numeric", num_precision=10, num_scale=2), "numeric(10,2)", T.DecimalType(10, 2)),
        (dict(type="numeric(12,4)"), "numeric(12,4)", T.DecimalType(12, 4)),
        (dict(type="numeric", num_precision=9), "numeric(9)", T.DecimalType(9, 0)),
        (dict(type="numeric"), "numeric", T.DecimalType(38, 18)),
        (dict(type="numeric", num_precision=50, num_scale=2), "numeric(50,2)", T.StringType()),
        (dict(type="money"), "money", T.DecimalType(19, 2)),
        (dict(type="timestamp without time zone"), "timestamp", T.TimestampNTZType()),
        (dict(type="timestamptz"), "timestamptz", T.TimestampType()),
        (dict(type="timestamp(6) without time zone"), "timestamp", T.TimestampNTZType()),
        (dict(type="time"), "time", T.StringType()),
        (dict(type="bit(8)"), "varbit", T.StringType()),
        (dict(type="bytea"), "bytea", T.BinaryType()),
        (dict(type="no_such_type"), "text", T.StringType()),
        (dict(udt_name="int8", data_type="integer", type="text"), "bigint", T.LongType()),
        (dict(data_type="integer", type="text"), "integer", T.IntegerType()),
    ],
)
def test_type_resolution(facts, ddl, expected):
    col = ColumnSpec("c", **facts)
    assert mart_type(col).ddl == ddl
    assert spark_type(col) == expected


@pytest.mark.parametrize(
    "name,expected",
    [
        ("text", T.StringType()),
        ("int4", T.IntegerType()),
        ("int8", T.LongType()),
        ("float8", T.DoubleType()),
        ("real", T.FloatType()),
        ("bool", T.ShortType()),
        ("date", T.DateType()),
        ("timestamptz", T.TimestampType()),
        ("timestamp with time zone", T.StringType()),
        ("smallint", T.StringType()),
        ("numeric", T.StringType()),
        ("uuid", T.StringType()),
    ],
)
def test_compact_profile(name, expected):
    assert spark_type(ColumnSpec("c", type=name), "compact") == expected


def test_type_names_invert():
    for dtype in (T.LongType(), T.DoubleType(), T.StringType(), T.DateType(), T.TimestampNTZType(),
                  T.DecimalType(10, 2), T.ArrayType(T.IntegerType())):
        assert spark_type(ColumnSpec("c", type=type_name(dtype))) == dtype


def test_truncate_counts_characters(spark):
    assert one(spark, convert.truncate(F.lit("Привет мир"), 3)) == ["При"]
    col = ColumnSpec("c", type="_varchar(2)")
    assert one(spark, convert.to_mart_type(F.array(F.lit("abc"), F.lit("d")), col)) == [["ab", "d"]]


def test_bits(spark):
    def bits(text, n=None):
        return convert.normalise_bits(F.lit(text), n)

    assert one(spark, bits("1x0-1"), bits("101", 5), bits("10111", 3), bits("none", 4), bits("none")) == [
        "101", "10100", "101", "none", "none",
    ]


def test_bytes(spark):
    assert one(spark, convert.to_hex(F.lit(b"\x01\xff")), convert.from_hex(F.lit("\\x01ff")), convert.from_hex(F.lit("01FF"))) == [
        "01ff", bytearray(b"\x01\xff"), bytearray(b"\x01\xff"),
    ]


def test_temporal_text(spark):
    moment = F.lit("2024-03-05 06:07:08.9").cast("timestamp")
    names = ("timestamptz", "timestamp", "timetz", "time", "date", "other")
    assert one(spark, *[convert.temporal_text(moment, n) for n in names]) == [
        "2024-03-05 06:07:08+00", "2024-03-05 06:07:08", "06:07:08+00", "06:07:08", "2024-03-05", "2024-03-05 06:07:08",
    ]


def test_temporal_numbers(spark):
    micros = "1704067200000000"
    values = [
        convert.temporal_value(F.lit(micros), "timestamp"),
        convert.temporal_value(F.lit("1.7040672E15"), "timestamp"),
        convert.temporal_value(F.lit("1704067200000"), "timestamp", "ms"),
        convert.temporal_value(F.lit("19723"), "date"),
        convert.temporal_value(F.lit("3661000000"), "time"),
        convert.temporal_value(F.lit(micros), "timestamptz").cast("long"),
        convert.temporal_value(F.lit(None).cast("string"), "timestamp"),
    ]
    day = datetime.datetime(2024, 1, 1)
    assert one(spark, *values) == [day, day, day, day.date(), "01:01:01.000000", 1704067200, None]


def test_temporal_texts(spark):
    def ts(text, kind="timestamp"):
        return convert.temporal_value(F.lit(text), kind)

    assert one(
        spark,
        ts(" 2025-12-31T21:00:00.000000Z "),
        ts("2025-12-31T21:00:00.123456"),
        ts("2025-12-31T21:00:00+03:00"),
        ts("2025-12-31"),
        ts("rubbish"),
        ts("2025-12-31", "date"),
        ts("2025-13-31", "date"),
        ts("20:59:01+03:00", "timetz"),
        ts("2025-12-31T21:00:00", "timestamptz").cast("long"),
    ) == [
        datetime.datetime(2025, 12, 31, 21),
        datetime.datetime(2025, 12, 31, 21, 0, 0, 123456),
        datetime.datetime(2025, 12, 31, 18),
        None,
        None,
        datetime.date(2025, 12, 31),
        None,
        "20:59:01+03:00",
        1767214800,
    ]


def test_utc_clock_does_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 2024-03-10 02:30 does not exist on that zone's clock.
        expected = datetime.datetime(2024, 3, 10, 2, 30)
        assert one(
            spark,
            convert.temporal_value(F.lit("2024-03-10T02:30:00Z"), "timestamp"),
            convert.temporal_value(F.lit("2024-03-10T02:30:00"), "timestamp"),
            convert.temporal_value(F.lit("1710037800000000"), "timestamp"),
        ) == [expected] * 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_arrays(spark):
    def both(text):
        c = convert.normalise_array(F.lit(text))
        return [c["ints"], c["texts"]]

    assert one(spark, *both("[1, 2.0, 3]")) == [[1, 2, 3], None]
    assert one(spark, *both('["1", "2"]')) == [None, ["1", "2"]]
    assert one(spark, *both("[1, 2.5]")) == [None, ["1", "2.5"]]
    assert one(spark, *both("[]")) == [[], None]


def test_flags_and_names(spark):
    assert one(spark, convert.flag(F.lit("true")), convert.flag(F.lit("false"), "compact")) == [True, 0]
    assert one(spark, convert.clean_name(F.lit("  a  b\tc \n"), 10), convert.clean_name(F.lit("one two"), 4)) == ["a_b_c", "_two"]


def test_value_map(spark):
    m = {"1": "one", "true": "yes"}
    assert one(
        spark,
        transform.map_value(F.lit(1), m),
        transform.map_value(F.lit("x"), m),
        transform.map_value(F.lit(True), m),
        transform.map_value(F.lit(None).cast("int"), m),
        transform.map_value(F.lit("1"), {}),
    ) == ["one", None, "yes", None, None]


def test_json_fields(spark):
    doc = F.lit('{"a": "x", "odd name\'s": 1, "n": null, "o": {"q": [1]}}')
    assert one(spark, *[transform.json_field(doc, k) for k in ("a", "odd name's", "n", "o", "zz")]) == [
        "x", "1", None, '{"q":[1]}', None,
    ]
    assert one(spark, *[transform.json_field_compact(doc, k) for k in ("a", "odd name's", "n", "zz")]) == ["x", "", "", ""]
    assert one(spark, transform.json_field(F.lit("[1]"), "a"), transform.json_field(F.lit("no json"), "a")) == [None, None]


def test_staging(spark):
    table = TableSpec(
        KEY,
        (
            ColumnSpec("id", type="int8", is_primary_key=True),
            ColumnSpec("meta", alias="m", type="jsonb", is_nullable=True,
                       transform=Transform("JSON", fields=(JsonField("city", "city", "text"), JsonField("n", "n", "int")))),
            ColumnSpec("old", type="date", is_deleted=True, is_nullable=True),
            ColumnSpec("st", is_nullable=True, transform=Transform("FieldTransform", values={"1": "new"})),
        ),
    )
    df = spark.createDataFrame([(1, '{"city": "Rome", "n": 5}', 1), (2, "{}", 2)], "id int, meta string, st int")
    staged = transform.stage(df, table)
    assert staged.columns == ["id", "m", "old", "st", "city", "n", "st_transformed"]
    assert [tuple(r)[2:] for r in staged.orderBy("id").collect()] == [(None, 1, "Rome", 5, "new"), (None, 2, None, None, None)]
    schema = transform.staging_schema(table)
    assert schema.names == staged.columns
    assert not schema["id"].nullable and schema["city"].nullable
    assert schema["id"].metadata == {"mart_type": "bigint", "primary_key": True}
    assert schema["n"].dataType == T.IntegerType()


def test_null_check_fails_the_load(spark):
    table = TableSpec(KEY, (ColumnSpec("id", type="int8"),))
    df = spark.createDataFrame([(None,)], "id long")
    assert transform.stage(df, table).count() == 1
    with pytest.raises(Exception, match="null value in column id"):
        transform.stage(df, table, check_nulls=True).collect()


def test_bad_cast_fails_or_becomes_null(spark):
    table = TableSpec(KEY, (ColumnSpec("v", type="int", is_nullable=True),))
    df = spark.createDataFrame([("x",)], "v string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        transform.stage(df, table).collect()
    assert transform.stage(df, table, on_bad_cast="null").first()[0] is None


def test_alignment(spark):
    table = TableSpec(KEY, (ColumnSpec("id", alias="route_id"), ColumnSpec("title"), ColumnSpec("gone")))
    df = spark.createDataFrame([("Route 123", 123, 0)], "title string, route_id int, other int")
    assert transform.align(df, table).columns == ["route_id", "title"]
    with pytest.raises(ValueError):
        transform.align(df.select("other"), table)


def test_jaro_winkler():
    # Published textbook values.
    assert round(similarity.jaro_text("MARTHA", "MARHTA"), 4) == 0.9444
    assert round(similarity.jaro_winkler_text("MARTHA", "MARHTA"), 4) == 0.9611
    assert round(similarity.jaro_winkler_text("DIXON", "DICKSONX"), 4) == 0.8133
    assert round(similarity.jaro_winkler_text("DWAYNE", "DUANE"), 4) == 0.84
    assert similarity.jaro_winkler_text("", "") == 1 and similarity.jaro_winkler_text("a", "") == 0


def test_jaro_winkler_column_runs_once(spark):
    df = spark.createDataFrame([("plan_id", "PLAN id"), (None, "x")], "a string, b string")
    score = similarity.jaro_winkler(similarity.normal_name(F.col("a")), similarity.normal_name(F.col("b")))
    scored = df.withColumn("s", score).where("s >= 0.45")
    assert [r.s for r in scored.collect()] == [1.0]
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_jaro_winkler_of_many_pairs():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcé日 ") for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 30])))
    a, b = [word() for _ in range(3000)], [word() for _ in range(3000)]
    b[::3] = [x[: k % 9] + "b" + x[k % 9 :] for k, x in enumerate(a[::3])]
    b[:50] = a[:50]
    want = [similarity.jaro_winkler_text(x, y) for x, y in zip(a, b)]
    assert similarity.jaro_winkler_many(a, b).tolist() == pytest.approx(want, abs=1e-12)


def test_jaro_winkler_of_long_and_missing_texts(spark):
    rows = [("a" * 3000 + "b", "a" * 3000 + "c"), (None, "x"), ("x", None), ("", ""), ("", "x"), ("a\0b", "a\0c"), ("MARTHA", "MARHTA")]
    frame = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    got = [r[0] for r in frame.select(similarity.jaro_winkler(F.col("a"), F.col("b"))).collect()]
    want = [None if None in r else similarity.jaro_winkler_text(*r) for r in rows]
    assert got == [w if w is None else pytest.approx(w) for w in want]


@pytest.mark.parametrize("least", [0.85, 0.95])
def test_similar_values_are_all_found(spark, least):
    rng = random.Random(11)
    words = {"".join(rng.choice("abcde ü") for _ in range(rng.choice([1, 2, 4, 8, 12]))) for _ in range(150)}
    words |= {w[:k] + "x" + w[k + 1 :] for w in list(words) for k in (1, 5)} | {w[1:] + w[:1] for w in list(words)} | {w + "q" for w in list(words)}
    frame = spark.createDataFrame([(w, 1) for w in sorted(words)] + [(None, 2), ("", 3), ("ab", 4)], "v string, text int")
    got = {(r["a"], r["b"]): r["score"] for r in similar.similar_values(frame, "v", least).collect()}
    filled = sorted(w for w in words | {"ab"} if w)
    score = {(x, y): similarity.jaro_winkler_text(x, y) for x in filled for y in filled if x < y}
    want = {k: s for k, s in score.items() if s >= least}
    assert got == {k: pytest.approx(s) for k, s in want.items()} and len(want) > 50
    with pytest.raises(ValueError):
        similar.similar_values(frame, "v", 0.8)
