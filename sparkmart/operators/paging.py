"""Optional filters, ordered pages and inclusive ranges over listing tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_all(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Rows equal to every given filter; a filter of None does not apply."""
    given = [F.col(k) == F.lit(v) for k, v in filters.items() if v is not None]
    return df.where(reduce(Column.__and__, given)) if given else df


def in_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Rows between two inclusive bounds, either of which may be missing."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end))
    return df


def _sort_keys(keys: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(k).desc() if descending else F.col(k).asc() for k in keys]


def ordered_page(
    df: DataFrame,
    keys: Sequence[str],
    limit=None,
    offset=None,
    descending: bool = True,
    default_limit: int = 50,
) -> DataFrame:
    """``limit`` rows after ``offset`` in key order; invalid values fall back to the defaults.

    Give a unique last key so that pages do not overlap.
    """
    limit, offset = _whole(limit), _whole(offset)
    limit = limit if limit is not None and limit > 0 else default_limit
    offset = offset if offset is not None and offset >= 0 else 0
    return df.orderBy(*_sort_keys(keys, descending)).offset(offset).limit(limit)


def _whole(value) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def paginate(
    df: DataFrame,
    keys: Sequence[str],
    page: int = 1,
    size: int = 10,
    descending: bool = False,
    default_size: int = 10,
) -> DataFrame:
    """Page ``page`` (from 1) of ``size`` rows in key order."""
    size = size if size and size > 0 else default_size
    page = max(page or 1, 1)
    return df.orderBy(*_sort_keys(keys, descending)).offset((page - 1) * size).limit(size)


def page_after(
    df: DataFrame, keys: Sequence[str], last: Sequence | None, size: int = 10, descending: bool = False
) -> DataFrame:
    """The ``size`` rows following the row whose keys are ``last``.

    The way to walk a long listing: a page costs one filtered top-k, where a deep offset makes Spark keep
    every skipped row.
    """
    if last is not None:
        # Written out key by key, so that the bound on the leading key reaches the scan.
        after = F.lit(False)
        for k, v in reversed(list(zip(keys, last))):
            beyond = F.col(k) < F.lit(v) if descending else F.col(k) > F.lit(v)
            after = beyond | ((F.col(k) == F.lit(v)) & after)
        lead = F.col(keys[0]) <= F.lit(last[0]) if descending else F.col(keys[0]) >= F.lit(last[0])
        df = df.where(lead & after)
    return df.orderBy(*_sort_keys(keys, descending)).limit(size)
