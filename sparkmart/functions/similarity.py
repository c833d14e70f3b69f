"""Jaro-Winkler similarity, the one measure Spark has no built-in function for, and bounds of it that Spark can compute."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the measure: longest counted prefix and its weight.
PREFIX_LIMIT = 4
PREFIX_WEIGHT = 0.1


def jaro_text(a: str, b: str) -> float:
    """Jaro similarity of two strings."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                left.append(ch)
                break
    if not left:
        return 1.0 if a == b else 0.0
    right = [ch for ch, hit in zip(b, taken) if hit]
    m = len(left)
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_text(a: str, b: str) -> float:
    """Jaro similarity raised by the common prefix."""
    base = jaro_text(a, b)
    prefix = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return base + min(prefix, PREFIX_LIMIT) * PREFIX_WEIGHT * (1 - base)


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points of texts, filled up with zeros to one width."""
    return np.array(texts, f"U{width}").view(np.uint32).reshape(len(texts), width)


def jaro_winkler_many(a: list[str], b: list[str]) -> np.ndarray:
    """``jaro_winkler_text`` of many pairs of texts without NUL characters, one array operation per place instead of per pair."""
    la, lb = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    n, rows = len(a), np.arange(len(a))
    x, y = _codes(a, max(1, la.max(initial=1))), _codes(b, max(1, lb.max(initial=1)))
    reach = np.maximum(la, lb) // 2 - 1
    hit_x, hit_y = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
    places = np.arange(y.shape[1])
    for i in range(x.shape[1]):
        free = (y == x[:, i : i + 1]) & ~hit_y & (np.abs(places[None] - i) <= reach[:, None]) & (places[None] < lb[:, None])
        free &= (i < la)[:, None]
        first = free.argmax(1)
        found = free[rows, first]
        hit_x[:, i] = found
        hit_y[rows[found], first[found]] = True
    m = hit_x.sum(1)
    # The k-th matched characters of both sides, compared for all pairs at once.
    of = np.repeat(rows, m)
    differ = x[hit_x] != y[hit_y]
    swaps = np.bincount(of, weights=differ, minlength=n).astype(np.int64) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        base = np.where(m > 0, (m / la + m / lb + (m - swaps) / m) / 3, 0.0)
    width = min(PREFIX_LIMIT, x.shape[1], y.shape[1])
    equal = (x[:, :width] == y[:, :width]) & (x[:, :width] != 0)
    prefix = np.logical_and.accumulate(equal, 1).sum(1)
    same = np.array([p == q for p, q in zip(a, b)], bool)
    return np.where(same, 1.0, base + prefix * PREFIX_WEIGHT * (1 - base))


# Cells of the comparison of one batch; longer texts are compared in smaller batches.
_CELLS = 1 << 21


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    scores = np.full(len(a), np.nan)
    left, right = a.to_numpy(), b.to_numpy()
    known = np.flatnonzero(a.notna().to_numpy() & b.notna().to_numpy())
    width = np.array([max(len(left[i]), len(right[i]), 1) for i in known], np.int64)
    odd = np.array(["\0" in left[i] or "\0" in right[i] for i in known], bool)
    for i in known[odd]:
        scores[i] = jaro_winkler_text(left[i], right[i])
    known, width = known[~odd], width[~odd]
    order = np.argsort(width, kind="stable")
    at = 0
    while at < len(order):
        # Texts come by length: the next one that would make the arrays too wide ends the piece.
        widths = width[order[at:]]
        take = max(1, int((widths * np.arange(1, len(widths) + 1) <= _CELLS).sum()))
        part = known[order[at : at + take]]
        scores[part] = jaro_winkler_many(left[part].tolist(), right[part].tolist())
        at += take
    return pd.Series(scores, dtype="float64").where(pd.Series(~np.isnan(scores)), None)


# Spark copies a deterministic function into every filter on its result, and would run it again there.
_once = _jaro_winkler.asNondeterministic()


def jaro_winkler(a: Column, b: Column) -> Column:
    """Similarity of two text columns, row by row, in Arrow batches."""
    return _once(a, b)


def normal_name(c: Column) -> Column:
    """Column name as compared: lower case, underscores as spaces, trimmed."""
    return F.trim(F.translate(F.lower(c), "_", " "))


def normal_type(c: Column) -> Column:
    return F.trim(F.lower(c))


def characters(c: Column) -> Column:
    """A text's characters, the k-th of a kind marked with k: what two texts share is the intersection of these."""
    chars = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c), F.lit(1))), lambda i: F.substring(c, i, F.lit(1)))
    marked = F.transform(
        chars, lambda x, i: F.concat(x, F.size(F.filter(F.slice(chars, 1, i + 1), lambda y: y == x)).cast("string"))
    )
    return F.when(F.char_length(c) > 0, marked).otherwise(F.array().cast("array<string>"))


def most_similar(shared: Column, a: Column, b: Column) -> Column:
    """The most that texts can score which share so many characters: all of them matched in order, and equal prefixes."""
    length = [F.char_length(x).cast("double") for x in (a, b)]
    base = F.when(shared > 0, (shared / length[0] + shared / length[1] + 1) / 3).otherwise(F.lit(0.0))
    equal = [F.when(F.left(a, F.lit(k)) == F.left(b, F.lit(k)), F.lit(k)) for k in range(PREFIX_LIMIT, 0, -1)]
    prefix = F.coalesce(*equal, F.lit(0))
    return base + prefix * PREFIX_WEIGHT * (1 - base)
