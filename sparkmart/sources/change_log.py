"""The change stream: topics, Debezium-style envelopes and their decoding."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOPIC_PREFIX = "dbserver_"
STAGING_MARK = "temp"
AT = "_at"

_TEXT_MAP = T.MapType(T.StringType(), T.StringType())

# The part of the envelope that is read. Row images keep their dynamic columns as a text map, which
# tells an explicit null from an absent column.
ENVELOPE = T.StructType(
    [
        T.StructField("before", _TEXT_MAP),
        T.StructField("after", _TEXT_MAP),
        T.StructField(
            "source",
            T.StructType(
                [
                    T.StructField("db", T.StringType()),
                    T.StructField("schema", T.StringType()),
                    T.StructField("table", T.StringType()),
                    T.StructField("lsn", T.LongType()),
                    T.StructField("txId", T.LongType()),
                    T.StructField("ts_ms", T.LongType()),
                    T.StructField("snapshot", T.StringType()),
                ]
            ),
        ),
        T.StructField("op", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("ts_ns", T.LongType()),
    ]
)


def topic_name(source: Column, schema: Column, table: Column) -> Column:
    return F.concat(F.lit(TOPIC_PREFIX), source, F.lit("."), schema, F.lit("."), table)


def drop_staging_topics(df: DataFrame, column: str = "topic") -> DataFrame:
    return df.where(~F.col(column).contains(STAGING_MARK))


def kafka_options(
    servers: str,
    topics: Iterable[str] | None = None,
    min_partitions: int | None = None,
    per_trigger: int | None = 10_000_000,
) -> dict[str, str]:
    """Reader options: named topics, or every topic of the prefix so that new ones join by themselves.

    ``min_partitions`` splits large topic partitions, so that parsing is not bound to their number.
    ``per_trigger`` bounds the records of a batch, so that a backlog is worked off in several.
    """
    subject = (
        {"subscribe": ",".join(topics)}
        if topics is not None
        else {"subscribePattern": f"{TOPIC_PREFIX}(?!.*{STAGING_MARK}).*"}
    )
    more = {"minPartitions": str(min_partitions)} if min_partitions else {}
    more |= {"maxOffsetsPerTrigger": str(per_trigger)} if per_trigger else {}
    return {"kafka.bootstrap.servers": servers, "startingOffsets": "earliest", **subject, **more}


def read_kafka(spark: SparkSession, servers: str, topics: Iterable[str] | None = None, **options) -> DataFrame:
    """The change stream from Kafka as ``(value, topic, partition, offset)``; needs the connector on the class path.

    An offset orders the records of one partition only; ``parse`` makes a position of all partitions of it.
    """
    stream = spark.readStream.format("kafka").options(**kafka_options(servers, topics, **options)).load()
    return drop_staging_topics(stream).select(
        F.col("value").cast("string").alias("value"), "topic", "partition", "offset"
    )


def read_files(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """The change stream from text files with one envelope per line, as ``(value)``."""
    reader = spark.readStream.format("text")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def parse(raw: DataFrame) -> DataFrame:
    """Envelope fields next to the record's own text (``_value``), order and identity.

    Records with a ``seq`` column come in that order, which must not repeat. All others get a position
    ``_at``: log sequence number, then time in microseconds, then topic, partition and offset, or the place in the
    input for records that are not from a topic. Numbers of different meaning are never compared, and no two
    records share a position.

    The envelope is unpacked by a generator: filters on its fields then stay above it, where Spark would
    otherwise parse the text once per filter.
    """
    parsed = F.inline(F.array(F.from_json("value", ENVELOPE)))
    if "seq" in raw.columns:
        return raw.select(F.col("value").alias("_value"), F.col("seq").alias("_seq"), parsed)
    from_topic = {"topic", "partition", "offset"} <= set(raw.columns)
    places = ["topic", "partition", "offset"] if from_topic else [F.monotonically_increasing_id().alias("place")]
    rows = raw.select(F.col("value").alias("_value"), F.struct(*places).alias("_place"), parsed)
    micros = F.coalesce("ts_us", F.floor(F.col("ts_ns") / 1000), F.col("ts_ms") * 1000, F.col("source.ts_ms") * 1000)
    at = F.struct(F.col("source.lsn").alias("lsn"), micros.alias("micros"), "_place.*")
    known = F.col("source.lsn").isNotNull() | micros.isNotNull()
    if from_topic:
        known = known | F.col("_place.offset").isNotNull()
    return rows.withColumn(AT, F.when(known, at)).drop("_place")


def in_batch(parsed: DataFrame, batch_id: int) -> DataFrame:
    """Parsed records whose positions can be compared with those of other batches.

    A place in the input tells apart the records of one batch only, so the batch comes before it. Offsets of topics
    are left as they are: the position of a record does not depend on the batch that brings it.
    """
    if AT not in parsed.columns or "place" not in parsed.schema[AT].dataType.names:
        return parsed
    at = F.struct(f"{AT}.lsn", f"{AT}.micros", F.lit(batch_id).cast("bigint").alias("batch"), f"{AT}.place")
    return parsed.withColumn(AT, F.when(F.col(AT).isNotNull(), at))


def _is_envelope() -> Column:
    return F.col("op").isNotNull() & F.col("source.table").isNotNull()


def _has_position(parsed: DataFrame) -> Column:
    return F.col("_seq" if "_seq" in parsed.columns else AT).isNotNull()


def events_in(parsed: DataFrame) -> DataFrame:
    """The parsed envelopes as rows ``(seq, at, op, db, schema, table, before, after, lsn, ts_ms)``.

    ``seq`` is one number for a version stamp; ``at``, where there is one, orders and tells apart events.
    """
    positioned = AT in parsed.columns
    seq = F.coalesce("source.lsn", f"{AT}.micros", F.lit(0)) if positioned else F.col("_seq")
    return parsed.where(_is_envelope() & _has_position(parsed)).select(
        seq.cast("bigint").alias("seq"),
        *([F.col(AT).alias("at")] if positioned else []),
        "op",
        F.col("source.db").alias("db"),
        F.col("source.schema").alias("schema"),
        F.col("source.table").alias("table"),
        "before",
        "after",
        F.col("source.lsn").alias("lsn"),
        "ts_ms",
    )


def bad_in(parsed: DataFrame) -> DataFrame:
    """``value`` and ``reason`` of parsed records that are no envelope or have no position."""
    good = F.coalesce(_is_envelope(), F.lit(False))
    reason = F.when(~good, F.lit("not an envelope")).when(~_has_position(parsed), F.lit("no position"))
    return parsed.select(F.col("_value").alias("value"), reason.alias("reason")).where(F.col("reason").isNotNull())


def decode(raw: DataFrame) -> DataFrame:
    """Raw records as event rows; ``bad_records`` has the others."""
    return events_in(parse(raw))


def bad_records(raw: DataFrame) -> DataFrame:
    """``value`` and ``reason`` of records that cannot be used."""
    return bad_in(parse(raw))


def envelope(
    after: Column,
    db: Column | str,
    schema: Column | str,
    table: Column | str,
    op: Column | str = "c",
    lsn: Column | None = None,
) -> Column:
    """Write an envelope as JSON text; NULL columns of ``after`` are kept as explicit nulls."""

    def lit(x):
        return F.lit(x) if isinstance(x, str) else x

    source = [lit(db).alias("db"), lit(schema).alias("schema"), lit(table).alias("table")]
    if lsn is not None:
        source.append(lsn.alias("lsn"))
    return F.to_json(
        F.struct(
            F.lit(None).cast(_TEXT_MAP).alias("before"),
            after.alias("after"),
            F.struct(*source).alias("source"),
            lit(op).alias("op"),
        ),
        {"ignoreNullFields": "false"},
    )
