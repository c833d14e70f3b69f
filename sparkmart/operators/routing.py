"""Which marts a change event concerns, and whether it may be written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Only creates and updates change data. Deletes and snapshot reads are accepted and ignored.
DATA_OPS = ("c", "u")
KNOWN_OPS = ("c", "u", "d", "r")

TABLE = ("db", "schema", "table")


def known_op(op):
    """The op code, or the empty string when it is not a known one."""
    return F.when(op.isin(*KNOWN_OPS), op).otherwise(F.lit(""))


def data_events(events: DataFrame) -> DataFrame:
    """Events that carry row data."""
    return events.where(F.col("op").isin(*DATA_OPS) & F.col("after").isNotNull())


def route(events: DataFrame, routes: DataFrame) -> DataFrame:
    """One row per event and mart that uses its table.

    ``routes`` is the exploded registry ``(view_id, view, db, schema, table)``. Spark broadcasts it while
    it is small; beyond that the join is a shuffle whose hot tables AQE splits.
    """
    return events.join(routes.distinct(), list(TABLE), "inner")


def write_gate(routed: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Routed events without those whose mart has a pending rename suggestion for the table."""
    pending = suggestions.select("view_id", *TABLE).distinct()
    return routed.join(pending, ["view_id", *TABLE], "left_anti")


def observed_columns(events: DataFrame) -> DataFrame:
    """The columns seen in event payloads, as ``(db, schema, table, column)``.

    Rows with the same set of columns collapse on the map side before the sets are exploded.
    """
    images = events.select(*TABLE, F.array_sort(F.map_keys("after")).alias("names"))
    return images.distinct().select(*TABLE, F.explode("names").alias("column")).distinct()
