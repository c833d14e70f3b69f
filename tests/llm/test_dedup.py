"""Line, exact, near and byte-string de-duplication against plain versions, with all defined cases."""

from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmart.llm import exact_dedup, line_dedup, near_dedup, repeats
from sparkmart.llm.common import connected_components, numbered, running_sum


def counted(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_lines(docs, pairs):
    done = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs))
    got = done.select("row.doc_id", F.size("lines"), F.size("lines") - F.size("kept"), F.sha2(F.array_join("kept", "\n"), 256))
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute.line_dedup(pairs))


def test_lines_of_long_documents(spark):
    shared = [f"line number {k:04d} is shared by all" for k in range(300)]
    rows = [(d, "\n".join(x for k, x in enumerate(shared) if (k * (d + 3)) % 7)) for d in range(5)]
    done = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    want = Counter((d, h) for d, _, _, h in brute.line_dedup(rows))
    assert Counter((r[0], brute.sha(r[1])) for r in done.collect()) == want


def test_first_occurrence_of_a_line_over_many_ranges(spark):
    rows = [(d if d % 50 else None, "this line stands in every document\n" * (d % 3) + f"a line of document {d // 3} alone") for d in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        done = line_dedup.line_dedup(docs)
        got = Counter((r[0], brute.sha(r[1])) for r in done.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == Counter((d, h) for d, _, _, h in brute.line_dedup(rows))


def test_exact(docs, pairs):
    done = exact_dedup.exact_dedup(docs).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in done) == Counter(brute.exact_dedup(pairs))
    # Of every text just one row stays.
    assert Counter(r["text_sha256"] for r in done if r["kept"]) == Counter({r["text_sha256"]: 1 for r in done})


def test_grace_spills_and_recurses():
    texts = [f"text {k % 700}" for k in range(3000)]
    rows = [(bytes.fromhex(brute.sha(t)), t, k, 1) for k, t in enumerate(texts)]
    # A budget of a few texts forces several levels of spill files.
    found = [r for table in exact_dedup.grace(iter(rows), 2000) for r in table.records()]
    assert len(found) == 700
    assert {(t, i, n) for _, t, i, n in found} == {(f"text {k}", k, 5 if k < 200 else 4) for k in range(700)}


def test_table_compares_whole_texts():
    table = exact_dedup.ContentTable(4)
    for text, key in (("a", 1), ("b", 2), ("a", 0), ("a", None)):
        table.add(b"same digest 1234", text, key, 1)
    assert sorted((t, i, n) for _, t, i, n in table.records()) == [("a", 0, 3), ("b", 2, 1)]


def test_kept_rows_have_all_columns(docs):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    once = exact_dedup.exact_dedup(docs).where("kept")
    assert counted(kept, "doc_id") == counted(once, "doc_id")


def test_near(docs, pairs):
    got = near_dedup.near_duplicates(docs).select("id", "n_shingles", "component_id")
    assert Counter(tuple(r) for r in got.collect()) == Counter(x[:3] for x in brute.near_dedup(pairs))


def test_near_keeps_one_of_each_component(docs, pairs):
    kept = [r["doc_id"] for r in near_dedup.keep_one(docs).collect()]
    found = brute.near_dedup(pairs)
    empty = [d for d, n, _, _ in found if n == 0]
    assert Counter(kept) == Counter(empty) + Counter(least for least, _ in {x[2:] for x in found if x[1]})


@pytest.mark.parametrize("rows", [256, 40])
def test_near_links_of_a_chain(spark, rows):
    """Every text is linked with its neighbours alone, and one family in the middle is cut in two."""
    words = [f"w{k}" for k in range(12_000)]
    texts = [words[10 * k : 10 * k + 200] for k in range(1000)]
    texts[600] = [f"v{k}" for k in range(200)]
    rows_in = [(k, " ".join(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows_in, "doc_id long, text string").repartition(4)
    got = near_dedup.near_duplicates(docs, settings=near_dedup.Settings(block_rows=rows))
    want = {k: 0 if k < 600 else 600 if k == 600 else 601 for k in range(1000)}
    assert {r["id"]: r["component_id"] for r in got.collect()} == want


def test_shared_hashes_and_forests():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40), np.uint64)) for _ in range(30)]
    packed = [x.tobytes() for x in sets]
    want = [[len(np.intersect1d(x, y)) for y in sets[20:]] for x in sets[:20]]
    for columns in (7, 4096):
        assert near_dedup._shared(packed[:20], packed[20:], columns).tolist() == want
    x, y, component = np.array([0, 1, 2, 0, 5, 6]), np.array([1, 2, 0, 3, 6, 5]), np.array([-1, 1, 2, -1, 4, 5, 6])
    kept = near_dedup._forest(x, y, component)
    assert len(kept) == 3 and {4, 5} & set(kept) and len({0, 1, 2} & set(kept)) == 2


def test_odd_sketches_estimate_high_similarities():
    s = near_dedup.Settings()
    sketcher = near_dedup.Sketcher(s)
    a = near_dedup.shingles(" ".join(f"w{k}" for k in range(1000)), 5)
    for share in (0.85, 0.9, 0.97):
        b = a[: int(len(a) * share)]
        differing = sum(int(x ^ y).bit_count() for x, y in zip(sketcher.odd(sketcher.minhash(a)).view("u8"), sketcher.odd(sketcher.minhash(b)).view("u8")))
        import math

        estimate = 1 + s.bits / (4 * s.bands * s.rows) * math.log(1 - 2 * differing / s.bits)
        assert abs(estimate - share) < 0.12


@pytest.mark.parametrize("most", [4000, 1])
def test_repeats(docs, pairs, most, monkeypatch):
    spans = repeats.repeated_spans
    monkeypatch.setattr(repeats, "repeated_spans", lambda p, n, g: spans(p, n, g, most_in_rank=most))
    done = repeats.remove_repeats(docs)
    got = done.select("id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("removed"), F.sha2("kept", 256))
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute.repeats(pairs))


def test_repeats_at_edits(spark):
    import random

    rng = random.Random(5)
    base = "".join(rng.choice("abcde ") for _ in range(3000))
    rows = [(0, base)]
    for k in range(1, 12):
        at, size = rng.randrange(2500), rng.randrange(150, 900)
        cut = base[at : at + size]
        rows.append((k, "".join(rng.choice("abcde ") for _ in range(rng.randrange(60))) + cut + "zq" * (k % 3)))
    done = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = done.select("id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("removed"), F.sha2("kept", 256))
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute.repeats(rows))


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    import numpy as np

    data = np.random.default_rng(1).integers(97, 100, 5000, np.uint8)
    data[1000:1800] = 97
    whole = repeats.anchors(data, 200, 32)
    monkeypatch.setattr(repeats, "_PIECE", 128)
    assert all((a == b).all() for a, b in zip(whole, repeats.anchors(data, 200, 32)))


@pytest.mark.parametrize(
    "run",
    [
        lambda d: line_dedup.line_dedup(d),
        lambda d: exact_dedup.exact_dedup(d),
        lambda d: exact_dedup.keep_first(d),
        lambda d: near_dedup.near_duplicates(d),
        lambda d: near_dedup.keep_one(d),
        lambda d: repeats.remove_repeats(d),
    ],
)
def test_no_rows(no_docs, run):
    assert run(no_docs).collect() == []


@pytest.mark.parametrize("in_one_task", [0, 200_000])
def test_components(spark, in_one_task):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 3), (200, 200)]
    nodes = sorted({x for e in edges for x in e} | {300})
    node_frame, edge_frame = spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long")
    done = connected_components(node_frame, edge_frame, in_one_task)
    want = {n: 0 if n <= 40 else 100 if n < 200 else n for n in nodes}
    assert {r["node"]: r["component"] for r in done.collect()} == want


def test_numbers_and_running_sums(spark):
    rows = numbered(spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("k")), F.col("k"))
    assert all(r["k"] == r["n"] for r in rows.collect()) and rows.count() == 1000
    sums = spark.range(1).select(running_sum(F.sequence(F.lit(1), F.lit(1000))).alias("s"), running_sum(F.array().cast("array<int>")).alias("e"))
    assert sums.first()["s"] == [k * (k + 1) // 2 for k in range(1000)] and sums.first()["e"] == []


def test_batches_are_cut_by_rows_and_bytes():
    import pyarrow as pa

    from sparkmart.llm.common import bounded

    texts = ["x" * 5, None, "", "y" * 40, "z" * 3, "é" * 4, *["w"] * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["n", "text"])
    cut = list(bounded([batch, batch.slice(0, 0)], "text", rows=4, size=12))
    assert [b.num_rows for b in cut] == [3, 1, 3, 4, 4] and pa.Table.from_batches(cut).column("text").to_pylist() == texts
