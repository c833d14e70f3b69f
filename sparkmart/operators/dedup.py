"""Distinct-with-order operators: keep the first of equal values, report the repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first_positions(df: DataFrame, value: Column, position: str) -> DataFrame:
    # The minimum combines on the map side, so a value with very many copies stays cheap to group.
    return df.groupBy(value.alias("_value")).agg(F.min(position).alias(position)).select(position)


def keep_first(df: DataFrame, value: Column | str, position: str) -> DataFrame:
    """The first row of every value. ``position`` orders the rows and is unique.

    Rows are picked by position, so the copies of a value never meet in one task.
    """
    value = F.col(value) if isinstance(value, str) else value
    return df.join(_first_positions(df, value, position), position, "left_semi")


def repeats(df: DataFrame, value: Column | str, position: str) -> DataFrame:
    """The rows whose value occurred before."""
    value = F.col(value) if isinstance(value, str) else value
    return df.join(_first_positions(df, value, position), position, "left_anti")


def unique_ignore_case(df: DataFrame, name: str, position: str) -> DataFrame:
    """``(name, position)`` of every name without case: first spelling at its first position."""
    return (
        df.groupBy(F.lower(name).alias("_folded"))
        .agg(F.min_by(name, position).alias(name), F.min(position).alias(position))
        .drop("_folded")
    )


def having_match(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with at least one match."""
    return df.join(other.select(*keys).distinct(), keys, "left_semi")


def without_match(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with no match."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def with_match_flag(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """All rows, with a flag that tells whether the other side has their key: one join for both answers."""
    there = other.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(there, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
