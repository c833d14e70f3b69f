"""The prefix trie, spelling variants and top-k search against plain versions."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmart.llm import prefix_trie, spelling, topk
from sparkmart.session import settle

TURNS = "conv_id long, turn int, role string, text string, place long, digest string, a long, n int"


def turn_rows():
    rng, rows = random.Random(5), []
    for c in [*range(60), *range(-7, 0), 10**12, 10**12 + 3]:
        for t in range(rng.randrange(7)):
            text = rng.choice(["ok", "é", "", None, "x" * 5000]) if t else "hello"
            rows.append((c, t if rng.random() < 0.95 else None, ["user", "assistant", None][t % 3], text))
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(0, 400, 5) for t in range(4)]  # copies
    rows += [(2000, t, "user", f"long {t % 7}") for t in range(150)]  # one long conversation, and another that follows it
    rows += [(2005, t, "user", f"long {t % 7}") for t in range(120)]
    rows += [(3000, 1, "user", "tie"), (3000, 1, "user", "tie"), (3000, 1, "a", "tie"), (None, 0, "user", "of none")]
    return rows


def turn_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2, 3) for r in rows], TURNS).repartition(5)


@pytest.mark.parametrize("shard, chunk", [(40, 3), (700, 5), (1 << 15, 4096)])
def test_trie(spark, shard, chunk):
    rows = turn_rows()
    turns = settle(prefix_trie.ordered_turns(turn_frame(spark, rows)), "turns")
    done = prefix_trie.prefix_trie(*prefix_trie.sharing_starts(turns, 5, 9), prefix_trie.Settings(shard, chunk))
    assert Counter(map(tuple, done.collect())) == Counter(brute.trie(brute.rebuilt(rows)))


def test_trie_of_nothing(spark):
    turns = settle(prefix_trie.ordered_turns(turn_frame(spark, [])), "turns")
    assert prefix_trie.prefix_trie(*prefix_trie.sharing_starts(turns, 5, 9)).count() == 0


def test_conversation_without_turns_is_a_member_of_the_root(spark):
    c = next(c for c in range(1, 5000, 5) if brute.rebuilt([(c, 0, "user", "x")]) == {c: []})
    rows = [(c, 0, "user", "x"), (7, 0, "user", "y"), (c + 1, 0, None, None)]
    turns = settle(prefix_trie.ordered_turns(turn_frame(spark, rows)), "turns")
    done = prefix_trie.prefix_trie(*prefix_trie.sharing_starts(turns, 5, 9))
    assert Counter(map(tuple, done.collect())) == Counter(brute.trie(brute.rebuilt(rows)))


def test_colliding_digests_are_noticed(spark):
    kinds = "a long, b long, conv long, depth long, pa long, pb long, digest binary, bytes long"
    row = (5, 6, 1, 1, 0, 0, b"x", 3)
    clear = lambda *rows: prefix_trie.distinct_nodes(spark.createDataFrame(rows, kinds))[1]
    assert clear(row, (5, 6, 2, 1, 0, 0, b"x", 3))
    for other in [(5, 6, 2, 2, 0, 0, b"x", 3), (5, 6, 2, 1, 0, 0, b"y", 3), (5, 6, 2, 1, 7, 7, b"x", 3), (0, 0, 2, 1, 0, 0, b"x", 3)]:
        assert not clear(row, other)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50_000):
        keys = rng.integers(0, 1 << 63, (n, 2), np.int64).view(np.uint64)
        hashed = prefix_trie.PerfectHash(keys)
        assert sorted(hashed.slots(keys).tolist()) == list(range(n))
        assert (hashed.slots(keys ^ np.uint64(1)) == -1).all()


def spelling_docs():
    rng = random.Random(2)
    base = ["lantern", "lanterns", "riverbank", "éclairage", "grünlich", "aabbccdd", "zzzzzzzz", "straße"]
    texts = [None, "", "short words", " ".join(["Riverbank"] * 9000 + ["riverbänk"] * 500 + ["riverbänks"] * 20)]
    for k in range(120):
        words = []
        for _ in range(60):
            w = list(rng.choice(base))
            if rng.random() < 0.25:
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], ["q"], [w[at], "ÿ"], [w[at].upper()]])
            words.append("".join(w))
        texts.append(rng.choice([" ", ", ", "1", "日"]).join(words))
    texts += ["x" * 3000 + " " + "x" * 3000 + "y" + "x" * 10, "x" * 3001, "x" * 3000, "x" * 64 + " " + "x" * 65, "x" * 64 + " " + "x" * 65 + " " + "x" * 63, "x" * 63]
    return [(i % 100, t) for i, t in enumerate(texts)] + [(None, texts[9]), (None, texts[9])]


@pytest.mark.parametrize("small", [False, True])
def test_spelling(spark, small):
    s = spelling.Settings(words_per_segment=7, segment_blocks=16, pass_bytes=8 << 10) if small else spelling.Settings()
    rows = spelling_docs()
    docs = spark.createDataFrame([(*r, "w", 1, "f") for r in rows], "doc_id long, text string, word string, n int, form string").repartition(4)
    done = spelling.spelling_groups(spelling.vocabulary(spelling.lossy_words(docs, "doc_id", "text", s), s), s)
    want = brute.spelling(brute.lossy_vocabulary(rows))
    assert Counter(map(tuple, done.collect())) == Counter(want)
    assert any(root != form for _, form, root, *_ in want if form) and sum(x[4] for x in want) > 100


def test_spelling_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "few short")], "doc_id long, text string")
    s = spelling.Settings()
    assert spelling.spelling_groups(spelling.vocabulary(spelling.lossy_words(docs, "doc_id", "text", s), s), s).count() == 0


def test_filters_hold_every_word_and_little_else(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.choice([8, 9]))) for _ in range(40_000)})
    s = spelling.Settings(words_per_segment=4096, segment_blocks=128)
    hashed = spelling._hashed(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), s)
    segments = {8: 5, 9: 5}
    held = {(r[0], r[1]): bytes(r[2]) for r in spelling.built_filters(hashed, segments, s).collect()}
    filters = spelling.Filters(segments, held, s)
    for n in (8, 9):
        own = spelling.Words([w for w in words if len(w) == n]).hashes()
        assert len(filters.has(n, own)) == len(own)
        others = spelling.Words(["".join(rng.choice("klmnopqrst") for _ in range(n)) for _ in range(20_000)]).hashes()
        assert len(filters.has(n, others)) < 0.01 * len(others)
    assert len(filters.has(10, own)) == 0


def vectors(rng, kind):
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(90)]
    if kind == "odd":
        rows += [(200 + i, [0.5] * 6) for i in range(40)]  # equal vectors
        rows += [(20, [0.1] * 6), (20, [0.1] * 6), (None, [0.9] * 6), (300, None), (320, [None] * 6), (340, [float("nan")] * 6), (360, [float("inf")] * 6)]
        rows += [(400, [1.0, 2.0]), (401, [3.0, -4.0]), (420, []), (421, []), (-40, [0.3] * 6)]
    if kind == "large":
        rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.randrange(3, 7) for _ in range(6)]) for i in range(60)]
        rows += [(60 + i, [rng.uniform(-1, 1) * 2.0**22 for _ in range(3)]) for i in range(50)]
    return rows


@pytest.mark.parametrize("kind", ["even", "odd", "large"])
@pytest.mark.parametrize("blocks", [(4, 7, 3), (1024, 8192, 10)])
def test_top_scores(spark, kind, blocks):
    s = topk.Settings(query_rows=blocks[0], block_rows=blocks[1], bin_bits=10 if kind == "large" else blocks[2])
    rows = vectors(random.Random(3), kind)
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, n int, score double").repartition(3)
    done = topk.top_scores(frame, F.col("vec_id") % 20 == 0, settings=s)
    assert Counter(map(tuple, done.collect())) == Counter(brute.top_scores(rows))


def test_blocks_meet_without_a_broadcast(spark, monkeypatch):
    pairs, plans = topk._pairs, []

    def kept(*args):
        found = pairs(*args)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(topk, "_pairs", kept)
    rows = vectors(random.Random(3), "even")
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    done = topk.top_scores(frame, F.col("vec_id") % 20 == 0, settings=topk.Settings(query_rows=4, block_rows=7))
    assert Counter(map(tuple, done.collect())) == Counter(brute.top_scores(rows))
    assert len(plans) > 1 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_top_scores_beyond_a_long(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    done = topk.top_scores(frame, F.col("vec_id") == 0, settings=topk.Settings(k=3)).orderBy("rank").collect()
    assert [tuple(r) for r in done] == [(0, 1, 1, 2**62 - 1), (0, 2, 3, 4096), (0, 3, 2, -(2**62) + 1)]


def test_top_scores_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_scores(empty, F.col("vec_id") % 20 == 0).count() == 0
    none_asked = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_scores(none_asked, F.col("vec_id") % 20 == 0).count() == 0
