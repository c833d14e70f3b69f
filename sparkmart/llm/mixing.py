"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix takes ``share`` times the corpus. Sources in code-point order, null last, weigh ``weights``, repeating;
a target stops at ``most`` times its source's size and the excess is shared again by weight. The mix is then
cut into blocks of equal size, which go to the sources by the highest quotients ``target / (2 * seats + 1)``,
and within a source to its shards by their sizes in the same way. A shard is a seeded bucket of documents
with about ``shard_words`` words, so a hot source is only many shards; documents without words are in none.
In a shard, documents lie in seeded order
and blocks are taken in another seeded order: whole rounds first, then blocks up to the quota, the last one
as far as needed. All of it is arithmetic on ids and sizes; texts are read once, to count words.

Defined cases: a null text has size 0; documents of size 0 are never taken; a source without words has target 0; no rows give no rows; rows that
repeat an id are taken each for itself; other columns are ignored. Equal ids and sizes are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmart.llm.common import SPACE_CLASS, numbered, query, read, same
from sparkmart.session import settle

WORD = f"[^{SPACE_CLASS}]+"


def seeded(seed: int, *parts: str | Column) -> Column:
    """A reproducible hash, as text of 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("")) for p in parts)))


def _number(digest: Column) -> Column:
    return F.conv(F.substr(digest, F.lit(1), F.lit(12)), 16, 10).cast("long")


def source_targets(sources: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """``source``, ``source_size`` with ``target``; the capped sources are found in rounds of two sums."""
    ranked = numbered(sources, F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))
    ranked = settle(ranked.withColumn("weight", weight.cast("long")), "sources")
    total = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    size, weight_sum = total["size"] or 0, total["weight"] or 0
    capped = (0, 0)
    while True:
        goal, rest = share * size - most * capped[0], weight_sum - capped[1]
        over = F.col("weight") * F.lit(float(goal)) / F.lit(float(max(rest, 1)))
        above = ranked.where(over > F.lit(float(most)) * F.col("source_size"))
        sums = above.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
        now = (sums["size"] or 0, sums["weight"] or 0)
        if now == capped:
            break
        capped = now
    return ranked.select("source", "source_size", F.least(over, F.lit(float(most)) * F.col("source_size")).alias("target"))


def _seats_before(votes: Column, total: Column, seats: Column, parties: Column) -> Column:
    """Seats a party certainly gets: its rounded share at a divisor that gives out no more than all of them."""
    sure = F.greatest(2 * seats - parties, F.lit(0))
    return F.when(total > 0, F.floor(votes * sure / (2 * total) + F.when(sure > 0, 0.5).otherwise(0.0))).otherwise(0).cast("long")


def _claims(parties: DataFrame, votes: str, total: str, count: str) -> DataFrame:
    """The next quotients of every party, enough for the seats that are still open (no more than parties)."""
    most = F.ceil(F.col(votes) / F.when(F.col(total) > 0, F.col(total)).otherwise(1) * F.col(count) * 1.5) + 1
    return parties.withColumn("_next", F.explode(F.sequence(F.lit(0).cast("long"), most.cast("long")))).withColumn(
        "_quotient", F.col(votes) / (2 * (F.col("sure") + F.col("_next")) + 1)
    )


def source_quotas(targets: DataFrame, block_words: int, shard_words: int) -> DataFrame:
    """Whole blocks per source and the number of its shards."""
    total = targets.agg(F.sum("target").alias("t"), F.count("*").alias("k")).first()
    goal, parties = total["t"] or 0.0, total["k"]
    blocks = int(goal / block_words + 0.5)
    votes = targets.withColumn("_total", F.lit(float(goal))).withColumn("_count", F.lit(parties))
    sure = settle(votes.withColumn("sure", _seats_before(F.col("target"), F.col("_total"), F.lit(blocks), F.lit(parties))), "seats")
    left = blocks - (sure.agg(F.sum("sure")).first()[0] or 0)
    claims = _claims(sure, "target", "_total", "_count").where("_quotient > 0")
    won = numbered(claims, F.col("_quotient").desc(), F.col("source").isNull(), F.col("source"), F.col("_next"))
    won = won.where(F.col("n") < left).groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("won"))
    shards = F.greatest(F.floor(F.col("source_size") / shard_words), F.lit(1)).cast("long")
    return sure.join(won, same(F.col("source"), F.col("_source")), "left").select(
        "source", "source_size", "target", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota"), shards.alias("shards")
    )


def shard_words_taken(shards: DataFrame, block_words: int, most: float) -> DataFrame:
    """Words each shard gives: its whole blocks, and in the largest shard what the source's blocks leave over."""
    # All per source is an aggregate or a global order: the shards of a hot source are never in one task.
    totals = shards.groupBy(F.col("source").alias("_source")).agg(
        F.count("*").alias("_count"), F.max_by("shard", F.struct("size", -F.col("shard"))).alias("_largest")
    )
    counted = shards.join(settle(totals, "totals"), same(F.col("source"), F.col("_source"))).drop("_source")
    sure = counted.withColumn("sure", _seats_before(F.col("size"), F.col("source_size"), F.col("quota"), F.col("_count")))
    sure = settle(sure, "sure")
    claims = _claims(sure, "size", "source_size", "_count").select("source", "shard", "_quotient", "_next")
    ranked = numbered(claims, F.col("source").isNull(), F.col("source"), F.col("_quotient").desc(), F.col("shard"), F.col("_next"))
    ranked = settle(ranked, "claims")
    begins = ranked.groupBy(F.col("source").alias("_source")).agg(F.min("n").alias("_begin"))
    left = sure.groupBy(F.col("source").alias("_of")).agg((F.first("quota") - F.sum("sure")).alias("_left"))
    open_seats = begins.join(left, same(F.col("_source"), F.col("_of"))).drop("_of")
    won = ranked.join(settle(open_seats, "open_seats"), same(F.col("source"), F.col("_source"))).where(F.col("n") - F.col("_begin") < F.col("_left"))
    won = won.groupBy(F.col("source").alias("_source"), F.col("shard").alias("_shard")).agg(F.count("*").alias("won"))
    blocks = (F.col("sure") + F.coalesce("won", F.lit(0))) * block_words
    over = F.when(F.col("shard") == F.col("_largest"), F.round("target").cast("long") - F.col("quota") * block_words).otherwise(0)
    cap = F.floor(F.lit(float(most)) * F.col("size")).cast("long")
    words = F.when(F.col("target") >= F.lit(float(most)) * F.col("source_size"), cap).otherwise(
        F.least(F.greatest(blocks + over, F.lit(0)), cap)
    )
    return sure.join(won, same(F.col("source"), F.col("_source")) & (F.col("shard") == F.col("_shard")), "left").select(
        "source", "shard", "size", words.cast("long").alias("words")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple[int, ...] = (5, 2, 1),
    block_words: int = 512,
    shard_words: int = 1 << 17,
    seed: int = 17,
) -> DataFrame:
    """One row per document with what the mix takes of it.

    ``id``, ``version`` (hash of the text), ``size``, ``source``, ``source_size``, ``target``, ``rounds`` (times
    it is taken whole), ``cuts`` (word ranges taken once more) and ``taken`` (words, repeats counted).
    """
    sized = settle(
        docs.select(
            F.col(id_col).alias("id"),
            F.xxhash64(text_col).alias("version"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "sized",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, share, most, weights)
    quotas = settle(source_quotas(targets, block_words, shard_words), "quotas")
    place = quotas.withColumnRenamed("source", "_source")
    placed = sized.join(place, same(F.col("source"), F.col("_source"))).drop("_source")
    no_cuts = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    empty = placed.where("size = 0").select(
        "id", "version", "size", "source", "source_size", "target",
        F.lit(0).alias("rounds"), no_cuts.alias("cuts"), F.lit(0).cast("long").alias("taken"),
    )
    dealt = placed.where("size > 0")
    order = seeded(seed, "id")
    dealt = dealt.withColumn("order", order).withColumn("shard", _number(order) % F.col("shards"))
    per_shard = dealt.groupBy("source", "shard").agg(
        F.sum("size").alias("size"), *(F.first(c).alias(c) for c in ("source_size", "target", "quota"))
    )
    taken = settle(shard_words_taken(settle(per_shard, "shard_sizes"), block_words, most), "shards").select(
        F.col("source").alias("_source"), F.col("shard").alias("_shard"), F.col("size").alias("shard_size"), "words"
    )
    dealt = dealt.join(taken, same(F.col("source"), F.col("_source")) & (F.col("shard") == F.col("_shard")))
    of = Window.partitionBy("source", "shard")
    # Documents in seeded order make one row of words, cut into blocks; a piece is a document's part of a block.
    end = F.sum("size").over(of.orderBy("order", "id", "size", "version").rowsBetween(Window.unboundedPreceding, 0))
    laid = dealt.withColumn("end", end).withColumn("begin", F.col("end") - F.col("size"))
    last = F.floor((F.col("end") - 1) / block_words)
    pieces = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block_words), last)))
    pieces = pieces.withColumn("lo", F.greatest("begin", F.col("block") * block_words)).withColumn(
        "hi", F.least(F.col("end"), (F.col("block") + 1) * block_words)
    )
    turn = seeded(seed, "source", "shard", "block")
    upto = F.sum(F.col("hi") - F.col("lo")).over(
        of.orderBy(turn, "block", "lo", "order", "id", "size", "version").rowsBetween(Window.unboundedPreceding, 0)
    )
    rounds = F.floor(F.col("words") / F.col("shard_size"))
    pieces = pieces.withColumn("rounds", rounds).withColumn("before", upto - (F.col("hi") - F.col("lo")))
    rest = F.col("words") - F.col("rounds") * F.col("shard_size")
    got = F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("hi") - F.col("lo"))
    pieces = pieces.withColumn("got", got)
    cut = F.when(
        F.col("got") > 0, F.struct((F.col("lo") - F.col("begin")).alias("lo"), (F.col("lo") - F.col("begin") + F.col("got")).alias("hi"))
    )
    # A document is told by where it begins in its shard.
    return (
        pieces.groupBy("source", "shard", "id", "version", "begin", "size", "source_size", "target", "rounds")
        .agg(F.sum("got").alias("once"), F.sort_array(F.collect_list(cut)).alias("cuts"))
        .select(
            "id", "version", "size", "source", "source_size", "target",
            F.col("rounds").cast("int").alias("rounds"), "cuts",
            (F.col("rounds") * F.col("size") + F.col("once")).cast("long").alias("taken"),
        )
        .unionByName(empty)
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: a row for each time a document is taken, its text cut where only a part is.

    All columns stay. A document that is not taken has no row.
    """
    plan = mix(docs, id_col, text_col, source_col, **options)
    numbered_copies = Window.partitionBy("id", "version")
    plan = plan.withColumn("copy", F.row_number().over(numbered_copies.orderBy("source", "rounds", "cuts")))
    # All rows are numbered, as the documents are; only then those that are not taken go.
    plan = plan.where("taken > 0").select(*(F.col(c).alias(f"_{c}") for c in ("id", "version", "copy", "rounds", "cuts")))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"))
    rows = rows.withColumn("copy", F.row_number().over(numbered_copies.orderBy(F.col("row")[source_col])))
    both = rows.join(plan, same(F.col("id"), F.col("_id")) & (F.col("version") == F.col("_version")) & (F.col("copy") == F.col("_copy")))
    words = F.regexp_extract_all(F.col("row")[text_col], F.lit(f"[{SPACE_CLASS}]*{WORD}"), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("_cuts", lambda c: F.slice(words, c["lo"].cast("int") + 1, (c["hi"] - c["lo"]).cast("int")))), "")
    texts = F.concat(
        F.array_repeat(F.col("row")[text_col], F.col("_rounds")),
        F.when(F.size("_cuts") > 0, F.array(cut)).otherwise(F.array().cast("array<string>")),
    )
    return both.withColumn("_text", F.explode(texts)).select(F.col("row").withField(text_col, F.col("_text")).alias("row")).select("row.*")


@query(
    r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
               FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size,
                 [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight
          FROM d GROUP BY source),
    t AS (SELECT sum(source_size) AS size, sum(weight) AS weight, count(*) AS n FROM s),
    -- Sources by how soon they are full: one is capped if it would be above its cap after those before it are.
    c AS (SELECT s.*, coalesce(sum(source_size) OVER w, 0) AS size_before, coalesce(sum(s.weight) OVER w, 0) AS weight_before
          FROM s WINDOW w AS (ORDER BY source_size / s.weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    full_ones AS (SELECT coalesce(sum(source_size), 0) AS size, coalesce(sum(c.weight), 0) AS weight FROM c, t
                  WHERE c.weight * (1.5 * t.size - 2 * size_before) > 2 * source_size * (t.weight - weight_before)),
    g AS (SELECT source, source_size, least(s.weight * (1.5 * t.size - 2.0 * f.size)::DOUBLE / greatest(t.weight - f.weight, 1)::DOUBLE,
                                            2.0::DOUBLE * source_size) AS target FROM s, t, full_ones f),
    seats AS (SELECT floor(sum(target) / 512 + 0.5)::BIGINT AS n FROM g),
    won AS (SELECT source FROM (SELECT source, target / (2 * k + 1) AS quotient, k FROM g, seats, range(seats.n) r(k) WHERE target > 0
                                ORDER BY quotient DESC, source IS NULL, source, k LIMIT (SELECT n FROM seats))),
    q AS (SELECT g.*, (SELECT count(*) FROM won WHERE won.source IS NOT DISTINCT FROM g.source) AS quota,
                 greatest(source_size // 131072, 1) AS shards FROM g),
    e AS (SELECT d.*, source_size, target, quota, md5(concat_ws('|', '17', coalesce(doc_id::VARCHAR, ''))) AS ord, shards
          FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
    dealt AS (SELECT *, ('0x' || substr(ord, 1, 12))::BIGINT % shards AS shard FROM e),
    p AS (SELECT source, shard, sum(size)::BIGINT AS z, any_value(source_size) AS source_size, any_value(target) AS target,
                 any_value(quota) AS quota FROM dealt GROUP BY source, shard),
    claims AS (SELECT source, shard, quota, row_number() OVER (PARTITION BY source ORDER BY z::DOUBLE / (2 * k + 1) DESC, shard, k) AS place
               FROM p, range((SELECT max(quota) FROM p)) r(k) WHERE k < quota AND z > 0),
    blocks AS (SELECT source, shard, count(*) AS won FROM claims WHERE place <= quota GROUP BY ALL),
    w AS (SELECT p.*, coalesce(won, 0) * 512 + CASE WHEN row_number() OVER (PARTITION BY p.source ORDER BY z DESC, p.shard) = 1
                      THEN round(target)::BIGINT - quota * 512 ELSE 0 END AS wanted
          FROM p LEFT JOIN blocks b ON p.source IS NOT DISTINCT FROM b.source AND p.shard = b.shard),
    words AS (SELECT source, shard, z, CASE WHEN target >= 2.0 * source_size THEN 2 * z
                     ELSE least(greatest(wanted, 0), 2 * z) END AS words FROM w),
    laid AS (SELECT dealt.*, z, words, sum(size) OVER (PARTITION BY dealt.source, dealt.shard ORDER BY ord, doc_id, size
                    ROWS UNBOUNDED PRECEDING)::BIGINT AS fin
             FROM dealt JOIN words ON dealt.source IS NOT DISTINCT FROM words.source AND dealt.shard = words.shard),
    cut AS (SELECT *, fin - size AS beg, unnest(range((fin - size) // 512, (greatest(fin, fin - size + 1) - 1) // 512 + 1)) AS block FROM laid),
    pieces AS (SELECT *, greatest(beg, block * 512) AS lo, least(fin, (block + 1) * 512) AS hi,
                      md5(concat_ws('|', '17', coalesce(source, ''), shard::VARCHAR, block::VARCHAR)) AS turn FROM cut),
    taken AS (SELECT *, CASE WHEN z > 0 THEN words // z ELSE 0 END AS rounds,
                     sum(hi - lo) OVER (PARTITION BY source, shard ORDER BY turn, block, lo, ord, doc_id, size
                                        ROWS UNBOUNDED PRECEDING)::BIGINT - (hi - lo) AS before FROM pieces)
    SELECT doc_id, size, any_value(source_size) AS source_size, any_value(target) AS target,
           (any_value(rounds) * size + sum(least(greatest(words - rounds * z - before, 0), hi - lo)))::BIGINT AS taken
    FROM taken GROUP BY doc_id, source, shard, beg, size
    """
)
def op3_source_mixing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
