"""Spelling variants by Bloom-guided neighbourhoods.

Words are near if one inserted, deleted or replaced code point makes one of the other. Every word tries its
deletions, and its replacements by larger code points: each near pair is found from one side, once. A try is a hash, which
follows from the word's own in one step; it is looked up in blocked Bloom filters of the vocabulary, sharded by
length. Only tries that a filter holds are shuffled, to an exact join with the vocabulary, whose strings then confirm
each pair.

Filters are made of segments of equal size. Segments are built where their words are, and as many at a time as fit
a fixed size are broadcast: a larger vocabulary takes more passes, not a larger broadcast.

A word's form is its near word of most occurrences, if these are enough times the word's own. Forms lead to more frequent words
alone, so following them ends; each round doubles the steps followed.

Defined cases: a null text has no words; a null id is empty in the key that decides on the lost code point; rows that
repeat an id, texts of any length and words of any length are used whole; of near words with equal counts the
smallest in code-point order comes first; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmart.llm.common import ascii_lower, query, read, runs
from sparkmart.session import settle

# The code points of words.
LETTERS = "[A-Za-zÀ-ÿ]"


@dataclass(frozen=True)
class Settings:
    """``ratio``: how many times as frequent a form is; ``longest``: longer words share a shard.

    A filter has 16 bits a word in blocks of 512, of which a word sets eight, so about one in a thousand other tries
    passes. ``pass_bytes`` is the most that is broadcast at once.
    """

    least_chars: int = 7
    least_count: int = 2
    ratio: int = 10
    longest: int = 64
    segment_blocks: int = 1024
    words_per_segment: int = 32768
    pass_bytes: int = 64 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes half of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _of_place(places: np.ndarray) -> np.ndarray:
    return _mix(places.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _of_char(codes: np.ndarray) -> np.ndarray:
    return _mix(codes.astype(np.uint64) + np.uint64(0xD1342543DE82EF95))


class Words:
    """Code points of words laid end to end, and the words' hashes: sums of a term per place and code point."""

    def __init__(self, words: list[str]):
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.length = np.array([len(w) for w in words], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.of = np.repeat(np.arange(len(words)), self.length)
        self.place = np.arange(len(self.codes)) - self.begin[self.of]
        self.by_place, self.by_char = _of_place(self.place), _of_char(self.codes)
        self.terms = self.by_place * self.by_char
        self.until = np.concatenate(([np.uint64(0)], np.cumsum(self.terms)))
        self.sums = self.until[self.begin + self.length] - self.until[self.begin]

    def hashes(self) -> np.ndarray:
        return _mix(self.sums)

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """The words and hashes of all different strings with one code point less.

        Within a run of equal code points it is always the first that goes.
        """
        moved = _of_place(self.place - 1) * self.by_char
        after = np.concatenate(([np.uint64(0)], np.cumsum(moved)))
        here = np.arange(len(self.codes))
        end = (self.begin + self.length)[self.of]
        sums = self.until[here] - self.until[self.begin[self.of]] + after[end] - after[here + 1]
        first = (self.place == 0) | np.concatenate(([True], self.codes[1:] != self.codes[:-1]))[: len(self.codes)]
        return self.of[first], _mix(sums[first])

    def replacements(self, letters: np.ndarray, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The words and hashes of all strings with one code point replaced by a larger one of ``letters``, in pieces."""
        of_letter = _of_char(letters)
        larger = np.searchsorted(letters, self.codes, side="right")
        order = np.argsort(larger, kind="stable")
        cuts = np.flatnonzero(np.diff(larger[order])) + 1
        for same in np.split(order, cuts):
            others = of_letter[larger[same[0]] :] if len(same) else of_letter[:0]
            if not len(others):
                continue
            step = max(1, cells // len(others))
            for at in range(0, len(same), step):
                here = same[at : at + step]
                base = self.sums[self.of[here]] - self.terms[here]
                sums = base[:, None] + self.by_place[here][:, None] * others[None]
                yield np.repeat(self.of[here], len(others)), _mix(sums.ravel())


# -- filters --------------------------------------------------------------------------------------


def _bits(source: np.ndarray, places: range, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bits of a block of eight words, nine bits of ``source`` each, as the word in the segment and a mask."""
    for k in places:
        bit = (source >> np.uint64(9 * k)) & np.uint64(511)
        yield block + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))


def _block(hashes: np.ndarray, s: Settings) -> np.ndarray:
    return ((hashes >> np.uint64(18)) & np.uint64(s.segment_blocks - 1)).astype(np.int64) * 8


def _first_bits(hashes: np.ndarray, block: np.ndarray):
    return _bits(hashes, range(2), block)


def _other_bits(hashes: np.ndarray, block: np.ndarray):
    return _bits(_mix(hashes ^ np.uint64(0xA0761D6478BD642F)), range(6), block)


def _segment_of(hashes: Column, segments: Column) -> Column:
    """Which of its shard's segments a hash belongs to, by its upper half."""
    return F.shiftrightunsigned(F.shiftrightunsigned(hashes, 32) * segments, 32).cast("int")


def built_filters(hashed: DataFrame, segments: dict[int, int], s: Settings) -> DataFrame:
    """``shard``, ``segment`` and ``bits`` of the filters of the words' hashes; no task holds more than a segment at once."""
    per_shard = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in segments.items() for x in kv]), F.col("shard").cast("long"))
    dealt = hashed.select("shard", _segment_of(F.col("h"), per_shard).alias("segment"), "h")
    dealt = dealt.repartition("shard", "segment").sortWithinPartitions("shard", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 2):
            hashes = group.column("h").to_numpy().view(np.uint64)
            words, block = np.zeros(s.segment_blocks * 8, np.uint64), _block(hashes, s)
            for word, mask in (*_first_bits(hashes, block), *_other_bits(hashes, block)):
                np.bitwise_or.at(words, word, mask)
            yield pa.RecordBatch.from_arrays(
                [group.column("shard").combine_chunks()[:1], group.column("segment").combine_chunks()[:1], pa.array([words.tobytes()], pa.binary())],
                names=["shard", "segment", "bits"],
            )

    return dealt.mapInArrow(run, "shard int, segment int, bits binary")


class Filters:
    """The segments of one pass; ``held`` maps (shard, segment) to its bits, ``segments`` has every shard's number."""

    def __init__(self, segments: dict[int, int], held: dict[tuple[int, int], bytes], s: Settings):
        self.s, self.segments = s, segments
        self.starts = {shard: np.full(n, -1, np.int64) for shard, n in segments.items()}
        for k, (shard, segment) in enumerate(held):
            self.starts[shard][segment] = k * s.segment_blocks * 8
        self.words = np.frombuffer(b"".join(held.values()), np.uint64)

    def has(self, shard: int, hashes: np.ndarray) -> np.ndarray:
        """The places of the hashes that the segments at hand hold, false ones among them."""
        count = self.segments.get(shard, 0)
        if not count or self.starts[shard].max() < 0:
            return np.empty(0, np.int64)
        at = ((hashes >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        start = self.starts[shard][at.astype(np.int64)]
        # Two bits rule out most; the others are made for what they leave.
        ok, block = start >= 0, start + _block(hashes, self.s)
        for word, mask in _first_bits(hashes, block):
            ok &= self.words[word] & mask != 0
        left = np.flatnonzero(ok)
        ok, hashes, block = np.ones(len(left), bool), hashes[left], block[left]
        for word, mask in _other_bits(hashes, block):
            ok &= self.words[word] & mask != 0
        return left[ok]


# -- words ----------------------------------------------------------------------------------------


def lossy_words(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """Every ``word`` of the texts as it counts: one in 31 loses a code point, by a checksum of document and run."""
    found = F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(f"{LETTERS}{{{s.least_chars},}}"), F.lit(0))
    words = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    words = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    place = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    return words.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, s: Settings) -> DataFrame:
    """``word`` and ``n`` of words long and frequent enough."""
    counted = words.where(F.char_length("word") >= s.least_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= s.least_count)


def _hashed(vocab: DataFrame, s: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(0).to_pylist())
            shard = np.minimum(words.length, s.longest).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(words.hashes().view(np.int64)), pa.array(shard)], names=["word", "n", "h", "shard"]
            )

    return vocab.select("word", "n").mapInArrow(run, "word string, n long, h long, shard int")


def _tries(hashed: DataFrame, tasks: int, letters: list[str], filters, s: Settings) -> DataFrame:
    """``tried`` and ``h``: the hash of a string one step from a word that a filter holds, and the word's own."""
    codes = np.array(sorted(map(ord, letters)), np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Filters = filters.value
        for batch in batches:
            shards, listed, own = batch.column("shard").to_numpy(), batch.column("word").to_pylist(), batch.column("h").to_numpy()
            for shard in np.unique(shards).tolist():
                picked = np.flatnonzero(shards == shard)
                words = Words([listed[i] for i in picked])
                fewer = np.minimum(words.length - 1, s.longest)
                of, hashes = words.deletions()
                tries = [(k, of[fewer[of] == k], hashes[fewer[of] == k]) for k in np.unique(fewer).tolist()]
                for to, of, hashes in (*tries, *((shard, *x) for x in words.replacements(codes))):
                    found = held.has(to, hashes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes[found].view(np.int64)), pa.array(own[picked[of[found]]])], names=["tried", "h"]
                    )

    dealt = hashed.select("word", "h", "shard").repartition(tasks)
    return dealt.mapInArrow(run, "tried long, h long")


def near_pairs(vocab: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``x``, ``n_x``, ``y``, ``n_y``: every two words one step apart, once."""
    s, spark = settings, vocab.sparkSession
    hashed = settle(_hashed(vocab, s), "hashed")
    counts = {r[0]: r[1] for r in hashed.groupBy("shard").count().collect()}  # a row per length up to the longest
    if not counts:
        return spark.createDataFrame([], "x string, n_x long, y string, n_y long")
    letters = [r[0] for r in hashed.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().where("c <> ''").collect()]
    segments = {shard: -(-n // s.words_per_segment) for shard, n in sorted(counts.items())}
    filters = settle(built_filters(hashed, segments, s), "filters")
    parts = [(shard, k) for shard, n in segments.items() for k in range(n)]
    step, tasks = max(1, s.pass_bytes // (s.segment_blocks * 64)), max(1, -(-sum(counts.values()) // 8192))
    found, held = None, []
    for at in range(0, len(parts), step):
        first, last = parts[at], parts[min(at + step, len(parts)) - 1]
        place = F.struct("shard", "segment")
        low, high = (F.struct(F.lit(shard).alias("shard"), F.lit(k).alias("segment")) for shard, k in (first, last))
        bits = {(r[0], r[1]): bytes(r[2]) for r in filters.where((place >= low) & (place <= high)).collect()}
        held.append(spark.sparkContext.broadcast(Filters(segments, bits, s)))
        asking = hashed.where(F.col("shard").between(first[0], last[0] + 1))
        tries = settle(_tries(asking, tasks, letters, held[-1], s), "tries")
        held[-1].unpersist()
        found = tries if found is None else found.unionByName(tries)
    near = hashed.select(F.col("h").alias("tried"), F.col("word").alias("y"), F.col("n").alias("n_y"))
    own = hashed.select("h", F.col("word").alias("x"), F.col("n").alias("n_x"))
    pairs = found.join(near, "tried").join(own, "h").where(F.levenshtein("x", "y", 1) == 1)
    # Words with one hash, if there are any, repeat each other's pairs.
    return pairs.select("x", "n_x", "y", "n_y").dropDuplicates(["x", "y"])


def spelling_groups(vocab: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word of a vocabulary of ``word`` and ``n``."""
    vocab = settle(vocab, "vocabulary")
    way = lambda x, y: F.struct(F.col(x).alias("word"), F.col(f"n_{x}").alias("own"), F.col(y).alias("near"), F.col(f"n_{y}").alias("n"))
    both = near_pairs(vocab, settings).select(F.inline(F.array(way("x", "y"), way("y", "x"))))
    best = both.groupBy(F.col("word").alias("_word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best")
    )
    near = vocab.join(best, F.col("word") == F.col("_word"), "left")
    most = -F.col("best.less")
    takes = most >= settings.ratio * F.col("n")
    near = near.select(
        "word",
        F.when(takes, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, most).alias("form_n"),
    )
    near = settle(near, "near")
    roots = near.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
    while True:
        further = roots.select(F.col("word").alias("_at"), F.col("root").alias("_root"))
        roots = roots.join(further, F.col("root") == F.col("_at"), "left")
        roots = roots.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved"))
        roots = settle(roots, "roots")
        if roots.where("moved").isEmpty():
            break
    roots = roots.select(F.col("word").alias("_word"), "root")
    done = near.join(roots, F.col("word") == F.col("_word"), "left")
    return done.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) AS r(i)),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents),
counted AS (SELECT id, run, hex(encode(id || ':' || run)) AS code, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY id, run),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(code) // 2), lambda i:
           16 * (instr('0123456789ABCDEF', code[2 * i + 1]) - 1) + instr('0123456789ABCDEF', code[2 * i + 2]) - 1)),
           lambda c, x: xor(t[CAST(xor(c, x) % 256 AS BIGINT) + 1], c // 256))) AS h
  FROM counted, crc),
lossy AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n
  FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM lossy WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pair AS (
  SELECT a.word, b.word AS near, b.n FROM cut AS a JOIN cut AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON rest = v.word
  UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON rest = v.word),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS most, min(near) FILTER (n = top) AS near
  FROM (SELECT *, max(n) OVER (PARTITION BY word) AS top FROM pair) GROUP BY word),
formed AS (
  SELECT v.word, CASE WHEN most >= 10 * v.n THEN near END AS form, v.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN most >= 10 * v.n THEN most END AS form_n
  FROM v LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS here FROM formed UNION ALL SELECT walk.word, form FROM walk JOIN formed ON here = formed.word WHERE form IS NOT NULL)
SELECT formed.word, formed.form, here AS root, formed.n, formed.n_near, formed.form_n
FROM formed JOIN walk USING (word) JOIN formed AS last ON here = last.word WHERE last.form IS NULL
"""


@query(_SQL)
def op12_spelling_variants(spark, sf_dir):
    s = Settings()
    words = lossy_words(read(spark, sf_dir, "documents"), "doc_id", "text", s)
    return spelling_groups(vocabulary(words, s), s)
