"""Similar values of a column: an exact Jaro-Winkler join without comparing all pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmart.functions.similarity import PREFIX_LIMIT, PREFIX_WEIGHT, characters, jaro_winkler, most_similar
from sparkmart.session import settle


def _shares(least: float) -> float:
    """The share of its characters that a text has in common with any text it scores ``least`` with.

    The score is at most j + 0.4 (1 - j), and j at most (m/|a| + m/|b| + 1) / 3, where m is not more than either length.
    """
    top = PREFIX_LIMIT * PREFIX_WEIGHT
    return 3 * (least - top) / (1 - top) - 2


def similar_values(values: DataFrame, column: str, least: float) -> DataFrame:
    """``a`` < ``b`` and ``score`` of all different values that score at least so much.

    Blocking by characters, exact: texts that score enough share a certain part of the characters of each, so they
    share one of each text's few rarest. The key is such a character and the shorter text's length, which lies within bounds of
    the longer one's. Blocks of one key are joined on the first place where both have it, so a pair meets once; what characters
    and prefixes allow at most is then found by built-in functions, and only pairs that could score enough are measured.
    Lower thresholds share less; 0.8 is the least that leaves anything to block by.
    """
    part = _shares(least)
    if part <= 1e-9:
        raise ValueError("a threshold of more than 0.8 is needed to block values by their characters")
    names = values.select(F.col(column).alias("text")).where(F.char_length(column) > 0).distinct()
    names = settle(names.select("text", characters(F.col("text")).alias("chars")), "values")
    counts = names.select(F.explode("chars").alias("char")).groupBy("char").agg(F.count("*").alias("rows"))
    rank = names.select("text", F.explode("chars").alias("char")).join(counts, "char")
    order = Window.partitionBy("text").orderBy("rows", "char")
    length = F.char_length("text")
    # Of n characters at least ceil(part n) are shared, so one of the n - ceil(part n) + 1 rarest is.
    firsts = length - F.ceil(part * length - 1e-9) + 1
    rare = rank.withColumn("place", F.row_number().over(order)).where(F.col("place") <= firsts)
    rare = rare.select("text", "char", F.char_length("text").alias("size"))
    rare = settle(rare, "characters")
    left = rare.select(F.col("text").alias("a"), "char", "size")
    # A longer text looks for all lengths a shorter one can have.
    shorter = F.sequence(F.ceil(part * F.col("size") - 1e-9).cast("int"), F.col("size"))
    right = rare.select(F.col("text").alias("b"), "char", F.explode(shorter).alias("size"))
    pairs = left.join(right, ["char", "size"])
    both = (F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))
    pairs = pairs.where(both).select("a", "b").distinct()
    sides = [names.select(F.col("text").alias(side), F.col("chars").alias(f"{side}_chars")) for side in ("a", "b")]
    pairs = pairs.join(sides[0], "a").join(sides[1], "b")
    shared = F.size(F.array_intersect("a_chars", "b_chars"))
    pairs = pairs.where(most_similar(shared, F.col("a"), F.col("b")) >= least - 1e-9)
    scored = pairs.select("a", "b", jaro_winkler(F.col("a"), F.col("b")).alias("score")).where(F.col("score") >= least)
    return scored.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
