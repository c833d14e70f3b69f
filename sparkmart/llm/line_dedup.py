"""Line de-duplication by range-partitioned line hashes.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least ``min_chars`` code
points found in at least ``min_docs`` documents lose all their lines except in the document with the largest
id. Only hashes, ids and positions are shuffled: they are partitioned by ranges of (hash, document), so that
a line in a third of all documents spreads over many tasks, and sorted by hash, then document from the
largest down, then position. The keeper of a hash is the document of its first occurrence in that order: every range
gives the first row of each of its hashes, and one aggregate of these settles hashes that straddle a border.
The decisions come back as one compressed bitmap per document, never as text.

Defined cases: a null or empty text is one empty line; rows with a null id are one document, smaller than all
others; rows sharing an id are one document, each with its own lines; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmart.llm.common import SPACE_CHARS, ascii_lower, query, read, same
from sparkmart.session import settle

_WORD = 63  # lines in one word of a bitmap; the sign bit stays free


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row per line long enough to count: ``hash`` (128 bits), ``id``, ``version`` of the text, ``pos``."""
    lines = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("version"),
        F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"),
    )
    lines = lines.select("id", "version", "pos", F.btrim("line", F.lit(SPACE_CHARS)).alias("line"))
    long_enough = lines.where(F.char_length("line") >= min_chars)
    return long_enough.select(F.unhex(F.md5(ascii_lower(F.col("line")))).alias("hash"), "id", "version", "pos")


def line_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """``id``, ``version`` and ``words`` of every document that loses lines.

    ``words`` is a list of (word, dropped): bit ``i`` of ``dropped`` tells that line ``63 * word + i`` goes.
    Words without a dropped line are left out, which is all the compression such sparse bitmaps need.
    """
    hashes = settle(line_hashes(docs, id_col, text_col, min_chars), "lines")
    stream = F.col("hash"), F.col("id").desc_nulls_last()
    ordered = hashes.repartitionByRange(*stream).sortWithinPartitions(*stream, F.col("pos"))
    # A row's place grows along the ranges and within each. Rows of one hash and document lie in one range, so that
    # their first place needs no further shuffle.
    firsts = ordered.withColumn("place", F.monotonically_increasing_id()).groupBy("hash", "id").agg(F.min("place").alias("place"))
    # Ranges combine their hashes to one first occurrence each before the shuffle.
    repeated = (
        firsts.groupBy("hash")
        .agg(F.count("*").alias("docs"), F.min_by("id", "place").alias("keeper"))
        .where(F.col("docs") >= min_docs)
        .select(F.col("hash").alias("_hash"), "keeper")
    )
    # Written first, the repeated lines join as an input of their own, whose hot hashes Spark can split.
    dropped = hashes.join(settle(repeated, "repeated"), F.col("hash") == F.col("_hash")).where(~same(F.col("id"), F.col("keeper")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % _WORD)
    words = (
        dropped.groupBy("id", "version", F.floor(F.col("pos") / _WORD).cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("dropped"))
        .groupBy("id", "version")
        .agg(F.sort_array(F.collect_list(F.struct("word", "dropped"))).alias("words"))
    )
    return words


def _dense(words: Column) -> Column:
    """The same bitmap with the left-out words filled in, so that a word is found by its number."""
    gap = lambda w, i: w["word"] - F.when(i == 0, F.lit(0)).otherwise(F.get(words, i - 1)["word"] + 1)
    return F.flatten(
        F.transform(words, lambda w, i: F.concat(F.array_repeat(F.lit(0).cast("long"), gap(w, i)), F.array(w["dropped"])))
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document as ``row``, with ``lines`` (all of them) and ``kept`` (those that stay)."""
    rows = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_version")
    )
    marks = bitmaps.select("id", "version", _dense(F.col("words")).alias("bits"))
    joined = rows.join(marks, same(F.col("_id"), F.col("id")) & (F.col("_version") == F.col("version")), "left")
    word = lambda i: F.coalesce(F.get("bits", F.floor(i / _WORD).cast("int")), F.lit(0).cast("long"))
    stays = lambda x, i: F.call_function("getbit", word(i), i % _WORD) == 0
    return joined.select("row", "bits", split_lines(F.col("row")[text_col]).alias("lines")).select(
        "row", "lines", F.when(F.col("bits").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)).alias("kept")
    )


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """The documents with the remaining lines as their text; all other columns as they are."""
    bitmaps = line_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    done = apply_bitmaps(docs, bitmaps, id_col, text_col)
    return done.select(F.col("row").withField(text_col, F.array_join("kept", "\n")).alias("row")).select("row.*")


@query(
    r"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
    k AS (SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
          GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT k.doc_id, k.line, k.pos, keeper IS NOT NULL AND keeper <> k.doc_id AS gone
          FROM k LEFT JOIN r USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """
)
def op1_line_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = apply_bitmaps(docs, line_bitmaps(docs))
    return done.select(
        "row.doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )
