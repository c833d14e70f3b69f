"""Scalar conversions as Column expressions; all of them stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmart.functions.types import MartType, mart_type, spark_type
from sparkmart.plans.spec import ColumnSpec


def truncate(c: Column, length: int) -> Column:
    """Cut text to a declared length, counted in characters."""
    return F.substring(c, 1, length)


def normalise_bits(c: Column, length: int | None = None) -> Column:
    """Keep only 0 and 1, then pad with zeros or cut to the length; text without any bit is left alone."""
    bits = F.regexp_replace(c, "[^01]", "")
    sized = F.rpad(bits, length, "0") if length else bits
    return F.when(F.length(bits) == 0, c).otherwise(sized)


def to_hex(c: Column) -> Column:
    """Bytes as lower-case hex text."""
    return F.lower(F.hex(c))


def from_hex(c: Column) -> Column:
    """Hex text, with or without a leading ``\\x``, as bytes."""
    return F.unhex(F.regexp_replace(c, r"^\\x", ""))


def temporal_text(c: Column, type_name: str) -> Column:
    """Text of a temporal value in whole seconds; zoned types carry a whole-hour offset."""
    zoned = F.date_format(c, "xxx").substr(1, 3)
    if type_name == "timestamptz":
        return F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), zoned)
    if type_name == "timetz":
        return F.concat(F.date_format(c, "HH:mm:ss"), zoned)
    patterns = {"time": "HH:mm:ss", "date": "yyyy-MM-dd"}
    return F.date_format(c, patterns.get(type_name, "yyyy-MM-dd HH:mm:ss"))


def flag(c: Column, profile: str = "full") -> Column:
    """A boolean, as 1/0 in the compact profile."""
    return c.cast("boolean").cast("smallint") if profile == "compact" else c.cast("boolean")


def clean_name(c: Column, length: int) -> Column:
    """Trim, turn runs of whitespace into one underscore, keep the last ``length`` characters."""
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.right(F.regexp_replace(trimmed, r"\s+", "_"), F.lit(length))


# Units a change stream may use for a number in a temporal column, as microseconds per unit.
_TICKS = {"s": 1_000_000, "ms": 1_000, "us": 1}


def temporal_from_number(c: Column, type_name: str, unit: str = "us") -> Column:
    """A number in a temporal column: days for a date, else time units since the epoch."""
    number = c.try_cast("bigint")
    if type_name == "date":
        return F.date_from_unix_date(number.cast("int"))
    micros = number * F.lit(_TICKS[unit])
    return F.timestamp_micros(micros) if type_name == "timestamptz" else _utc_clock(micros)


def _utc_clock(micros: Column) -> Column:
    """The UTC clock reading at an epoch offset, whatever the session zone."""
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.expr("INTERVAL '0.000001' SECOND") * micros


_ZONED = r"[Zz]$|[+-]\d{2}:?\d{2}$"


def temporal_from_text(c: Column, type_name: str) -> Column:
    """RFC 3339 or zone-less text for timestamps, ``yyyy-MM-dd`` for dates; anything else gives NULL.

    Times of day stay text.
    """
    text = F.trim(c)
    if type_name in ("time", "timetz"):
        return text
    if type_name == "date":
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}")
    clock = F.regexp_replace(text, _ZONED, "")
    local = clock.try_cast("timestamp_ntz")
    if type_name == "timestamptz":
        # Zone-less text means UTC.
        instant = F.when(text.rlike(_ZONED), text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")
        return F.when(shaped, instant)
    zoned = _utc_clock(F.unix_micros(text.try_cast("timestamp")))
    return F.when(shaped, F.when(text.rlike(_ZONED), zoned).otherwise(local))


def temporal_value(c: Column, type_name: str, unit: str = "us") -> Column:
    """Decode a change-stream value of a temporal column, number or text."""
    if type_name in ("time", "timetz"):
        number = c.try_cast("bigint")
        clock = F.date_format(_utc_clock(number * F.lit(_TICKS[unit])), "HH:mm:ss.SSSSSS")
        return F.when(number.isNotNull(), clock).otherwise(temporal_from_text(c, type_name))
    is_number = F.trim(c).rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")
    digits = F.when(is_number, c).try_cast("double").cast("bigint")
    exact = F.coalesce(c.try_cast("bigint"), digits)
    return F.when(is_number, temporal_from_number(exact, type_name, unit)).otherwise(
        temporal_from_text(c, type_name)
    )


def normalise_array(c: Column) -> Column:
    """Elements of a JSON array as text: all-integral numbers as integers, otherwise every element as text.

    Returns ``struct(ints array<bigint>, texts array<string>)`` with exactly one side set for an array.
    """
    texts = F.from_json(c, T.ArrayType(T.StringType()))
    whole = F.from_json(c, T.ArrayType(T.DoubleType()))
    # A bare JSON number never starts with a quote, so ["1","2"] stays text.
    numeric = ~c.contains('"') & F.forall(
        F.arrays_zip(texts.alias("t"), whole.alias("w")),
        lambda e: e["w"].isNotNull() & (e["w"] == F.floor(e["w"]).cast("double")),
    )
    ints = F.transform(texts, lambda t: F.coalesce(t.try_cast("bigint"), t.try_cast("double").try_cast("bigint")))
    return F.struct(F.when(numeric, ints).alias("ints"), F.when(~numeric, texts).alias("texts"))


def _shape(c: Column, kind: MartType) -> Column:
    """Apply the declared length of a text or bit type."""
    if kind.name in ("varchar", "char") and kind.length:
        return truncate(c, kind.length)
    if kind.name == "varbit":
        return normalise_bits(c, kind.length)
    return c


def to_mart_type(c: Column, col: ColumnSpec, profile: str = "full", on_bad_cast: str = "fail") -> Column:
    """Cast a source value to the column's mart type.

    A bad value fails the load, or becomes NULL with ``on_bad_cast="null"``. A column without any type
    facts keeps the type it has in the source.
    """
    if not col.has_type:
        return c
    target = spark_type(col, profile)
    if profile == "compact" and isinstance(target, T.ShortType):
        return flag(c, profile)
    kind = mart_type(col)
    cast = c.try_cast if on_bad_cast == "null" else c.cast
    if kind.name == "bytea" and not kind.is_array:
        return c
    if profile == "compact" or not kind.is_array:
        return _shape(cast(target), kind)
    if kind.length:
        return F.transform(cast(target), lambda e: _shape(e, kind))
    return cast(target)


def _whole(c: Column) -> Column:
    """Integral text without the fraction it may be spelt with ("1.0")."""
    return F.when(c.contains("."), F.regexp_replace(c, r"\.0+$", "")).otherwise(c)


_INTEGRAL = (T.ShortType, T.IntegerType, T.LongType)


def decode_change(
    c: Column, col: ColumnSpec, profile: str = "full", unit: str = "us", on_bad_cast: str = "fail"
) -> Column:
    """Type a change-stream value, which arrives as text, for its mart column."""
    if not col.has_type:
        return c
    kind = mart_type(col)
    if kind.is_array and profile != "compact":
        items = F.from_json(c, T.ArrayType(T.StringType()))
        if isinstance(spark_type(col).elementType, _INTEGRAL):
            items = F.transform(items, _whole)
        return to_mart_type(items, col, profile, on_bad_cast)
    if kind.is_temporal and profile != "compact":
        return temporal_value(c, kind.name, unit)
    if kind.name == "bytea" and profile != "compact":
        return F.try_to_binary(c, F.lit("base64")) if on_bad_cast == "null" else F.unbase64(c)
    target = spark_type(col, profile)
    if isinstance(target, _INTEGRAL) and kind.name != "boolean":
        return _whole(c).try_cast(target) if on_bad_cast == "null" else _whole(c).cast(target)
    return to_mart_type(c, col, profile, on_bad_cast)
