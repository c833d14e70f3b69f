"""Queries over the scalar conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmart.functions import convert
from sparkmart.functions.similarity import jaro_winkler
from sparkmart.operators.similar import similar_values
from sparkmart.queries.base import query, read
from sparkmart.sources.discovery import database_name


@query("SELECT event_id, ts, CAST(ts AS DATE) AS day FROM events")
def temporal_micros(spark, sf_dir):
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col("ts")).cast("string")
    days = F.unix_date(F.col("ts").cast("date")).cast("string")
    return read(spark, sf_dir, "events").select(
        "event_id",
        convert.temporal_value(micros, "timestamp").alias("ts"),
        convert.temporal_value(days, "date").alias("day"),
    )


@query("""
SELECT event_id, ts, ts - INTERVAL 3 HOUR AS zoned, CAST(ts AS DATE) AS day, CAST(NULL AS TIMESTAMP) AS bad
FROM events
""")
def temporal_text(spark, sf_dir):
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return read(spark, sf_dir, "events").select(
        "event_id",
        convert.temporal_value(plain, "timestamp").alias("ts"),
        convert.temporal_value(F.concat(plain, F.lit("+03:00")), "timestamp").alias("zoned"),
        convert.temporal_value(F.date_format("ts", " yyyy-MM-dd "), "date").alias("day"),
        convert.temporal_value(F.col("event_type"), "timestamp").alias("bad"),
    )


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS as_timestamp, strftime(ts, '%H:%M:%S') AS as_time,
       strftime(ts, '%Y-%m-%d') AS as_date
FROM events
""")
def temporal_format(spark, sf_dir):
    return read(spark, sf_dir, "events").select(
        "event_id",
        *(convert.temporal_text(F.col("ts"), t).alias(f"as_{t}") for t in ("timestamp", "time", "date")),
    )


@query("SELECT doc_id, substr(text, 1, 40) AS head FROM documents")
def varchar_truncate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", convert.truncate(F.col("text"), 40).alias("head"))


@query("""
WITH b AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag,
         l_returnflag || translate(l_linestatus || l_returnflag, 'FOANR', '01101') || '-' AS raw
  FROM lineitem
), c AS (SELECT *, regexp_replace(raw, '[^01]', '', 'g') AS bits FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN bits = '' THEN raw ELSE rpad(bits, 8, '0') END AS bits8,
       CASE WHEN bits = '' THEN raw ELSE left(bits, 1) END AS bit1,
       l_returnflag AS no_bits
FROM c
""")
def bit_normalise(spark, sf_dir):
    pair = F.translate(F.concat("l_linestatus", "l_returnflag"), "FOANR", "01101")
    raw = F.concat("l_returnflag", pair, F.lit("-"))
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        convert.normalise_bits(raw, 8).alias("bits8"),
        convert.normalise_bits(raw, 1).alias("bit1"),
        convert.normalise_bits(F.col("l_returnflag"), 8).alias("no_bits"),
    )


@query("SELECT doc_id, lower(hex(encode(text))) AS hexed, text AS back FROM documents")
def bytes_hex(spark, sf_dir):
    hexed = convert.to_hex(F.col("text").cast("binary"))
    return read(spark, sf_dir, "documents").select(
        "doc_id", hexed.alias("hexed"), convert.from_hex(hexed).cast("string").alias("back")
    )


@query("""
SELECT vec_id, label + label + 1 + vec_id AS int_sum, CAST(NULL AS VARCHAR) AS int_texts,
       CAST(NULL AS BIGINT) AS text_sum, label || '|a' AS text_items, len(embedding) AS width,
       CAST(list_sum([CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT) FOR x IN embedding]) AS BIGINT) AS thousandths
FROM embeddings
""")
def array_normalise(spark, sf_dir):
    ints = F.concat(F.lit("["), "label", F.lit(", "), "label", F.lit(".0, 1, "), "vec_id", F.lit("]"))
    texts = F.concat(F.lit("["), "label", F.lit(', "a"]'))
    floats = convert.normalise_array(F.to_json("embedding"))["texts"]

    def total(c):
        return F.aggregate(c["ints"], F.lit(0).cast("bigint"), lambda s, x: s + x)

    a, b = convert.normalise_array(ints), convert.normalise_array(texts)
    return read(spark, sf_dir, "embeddings").select(
        "vec_id",
        total(a).alias("int_sum"),
        F.array_join(a["texts"], "|").alias("int_texts"),
        total(b).alias("text_sum"),
        F.array_join(b["texts"], "|").alias("text_items"),
        F.size(floats).cast("bigint").alias("width"),
        F.aggregate(
            floats, F.lit(0).cast("bigint"), lambda s, x: s + F.round(x.cast("float").cast("double") * 1000).cast("bigint")
        ).alias("thousandths"),
    )


@query("""
SELECT doc_id, CAST(quality = 1 AS SMALLINT) AS quality, toxic = 1 AS toxic FROM labels
""")
def boolean_profiles(spark, sf_dir):
    return read(spark, sf_dir, "labels").select(
        "doc_id",
        convert.flag(F.col("quality"), "compact").alias("quality"),
        convert.flag(F.col("toxic")).alias("toxic"),
    )


@query(r"""
SELECT doc_id, right(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', '_', 'g'), 60) AS tail
FROM documents
""")
def text_cleanup(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", convert.clean_name(F.col("text"), 60).alias("tail"))


@query("""
WITH p AS (
  SELECT p_partkey, p_name AS a, lower(p_type) || ' ' || p_name AS b, lower(p_brand) AS c FROM part
), s AS (
  SELECT *, jaro_similarity(a, b) AS ab, jaro_similarity(c, 'brand') AS cd FROM p
)
SELECT p_partkey,
       round(ab + 0.1 * (1 - ab) * CASE WHEN left(a, 4) = left(b, 4) THEN 4 WHEN left(a, 3) = left(b, 3) THEN 3
             WHEN left(a, 2) = left(b, 2) THEN 2 WHEN left(a, 1) = left(b, 1) THEN 1 ELSE 0 END, 9) AS name_score,
       round(cd + 0.1 * (1 - cd) * 4, 9) AS brand_score
FROM s
""")
def name_similarity(spark, sf_dir):
    with_type = F.concat(F.lower("p_type"), F.lit(" "), "p_name")
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(jaro_winkler(F.col("p_name"), with_type), 9).alias("name_score"),
        F.round(jaro_winkler(F.lower("p_brand"), F.lit("brand")), 9).alias("brand_score"),
    )


@query("""
WITH v AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS t FROM part),
s AS (SELECT x.t AS a, y.t AS b, jaro_similarity(x.t, y.t) AS j,
             CASE WHEN left(x.t, 4) = left(y.t, 4) THEN 4 WHEN left(x.t, 3) = left(y.t, 3) THEN 3
                  WHEN left(x.t, 2) = left(y.t, 2) THEN 2 WHEN left(x.t, 1) = left(y.t, 1) THEN 1 ELSE 0 END AS p
      FROM v AS x JOIN v AS y ON x.t < y.t)
SELECT a, b, round(j + 0.1 * p * (1 - j), 9) AS score FROM s WHERE j + 0.1 * p * (1 - j) >= 0.96
""")
def name_blocking(spark, sf_dir):
    """All pairs of similar part descriptions."""
    described = F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("described")
    found = similar_values(read(spark, sf_dir, "part").select(described), "described", 0.96)
    return found.select("a", "b", F.round("score", 9).alias("score"))


@query(r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS database FROM pages
""")
def url_database(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", database_name(F.col("url")).alias("database"))
