"""The registered queries and the pipeline over whole tables, against SQL or plain versions."""

import re
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from compare import connect, duck_rows, spark_rows
from sparkmart.llm import pieces
from sparkmart.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_all_are_registered():
    numbers = [re.match(r"op(\d+)_", name)[1] for name in QUERIES]
    assert sorted(map(int, numbers)) == list(range(1, 14))
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()
    assert entry.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(connect(sf_dir), ORACLES[name])


def test_languages_of_held_out_documents(spark, sf_dir):
    langs = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect())
    held = [r for r in QUERIES["op2_language_id"](spark, sf_dir).collect() if r["held_out"]]
    right = sum(r["lang_pred"] == langs[r["doc_id"]] for r in held)
    assert len(held) > len(langs) / 4 and right >= 0.97 * len(held)


def test_repeats_of_whole_tables(spark, sf_dir, texts):
    assert Counter(tuple(r) for r in QUERIES["op5_suffix_array_dedup"](spark, sf_dir).collect()) == Counter(brute.repeats(texts))


def test_embedding_links(spark, sf_dir):
    import numpy as np

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    unit = np.array([r["embedding"] for r in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = dict(zip((r["vec_id"] for r in rows), ((unit @ unit.T >= 0.9).sum(1) - 1).tolist()))
    got = {r["vec_id"]: r["n_links"] for r in QUERIES["op6_embedding_near_dedup"](spark, sf_dir).collect()}
    assert got.keys() == links.keys() and all(got[k] <= links[k] for k in got)
    assert sum(got.values()) >= 0.99 * sum(links.values())


def test_pieces_of_whole_tables(spark, sf_dir, texts):
    done = QUERIES["op7_sentencepiece"](spark, sf_dir)
    assert done.count() == len(texts) and done.where("not round_trip or n_tokens > 4 * n_chars + 1").count() == 0


def test_strict_spans_of_whole_tables(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in QUERIES["op8_pii"](spark, sf_dir).collect()}
    for d, t in texts:
        names = brute.pii(t)
        assert got[d]["base_sha256"] == brute.sha(",".join(names)) and set(names) <= set(got[d]["spans"].split(",") + [""])
        assert [got[d][f"n_{k}"] for k in brute.PII] == [sum(n.startswith(k) for n in names) for k in brute.PII]


def test_near_duplicates_of_whole_tables(spark, sf_dir, texts):
    got = QUERIES["op10_minhash_near_dedup"](spark, sf_dir).select("doc_id", "n_shingles", "component_id")
    assert Counter(tuple(r) for r in got.collect()) == Counter(x[:3] for x in brute.near_dedup(texts))


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "src0", None), (10**6 + 1, " 12 ", None, None, 4)], docs.schema)
    docs, after = docs.unionByName(extra), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, before, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after[name] = (before.collect(), docs.collect())
        if name != "sentencepiece":
            assert docs.columns == before.columns
    pairs = lambda rows: [(r["doc_id"], r["text"]) for r in rows]
    ids = lambda rows: Counter(r["doc_id"] for r in rows)
    given, kept = after["language_id"]
    assert ids(kept) == ids([r for r in given if r["text"] and any(c.isalpha() for c in r["text"])])
    given, kept = after["exact_dedup"]
    assert ids(kept) == Counter({keep for _, keep, _, _ in brute.exact_dedup(pairs(given))})
    given, kept = after["minhash_near_dedup"]
    assert ids(kept) == Counter({c for _, _, c, _ in brute.near_dedup(pairs(given), 80)})
    given, mixed = after["source_mixing"]
    text, total = dict(pairs(given)), sum(len((r["text"] or "").split()) for r in given)
    assert all(r["n_chars"] == len(r["text"]) and set(r["text"].split()) <= set(text[r["doc_id"]].split()) for r in mixed)
    assert abs(sum(len(r["text"].split()) for r in mixed) - 1.5 * total) <= 0.01 * total
    given, tokens = after["sentencepiece"]
    assert ids(tokens) == ids(given)
    back = pieces.decode(docs, pieces.Vocabulary.load()).select("doc_id", "decoded").collect()
    assert Counter(map(tuple, back)) == Counter(pairs(given))
    assert docs.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_pipeline_of_nothing(spark, no_docs, sf_dir, tmp_path):
    docs = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_near_stage_links_from_four_fifths(spark, sf_dir, texts):
    import random

    rng = random.Random(3)
    given = [(d, t) for d, t in texts if t]
    for k in range(60):  # a text and its beginning, of 76 to 85 of its 100 shingles
        words = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        given += [(10**6 + 2 * k, " ".join(words)), (10**6 + 2 * k + 1, " ".join(words[: 80 + k % 10]))]
    rows = [(d, t, "en", "a", len(t)) for d, t in given]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, docs, sf_dir)
    found = brute.near_dedup(given, 80)
    want = Counter(d for d, n, _, _ in found if not n) + Counter(least for least, _ in {x[2:] for x in found if x[1]})
    assert Counter(r["doc_id"] for r in kept.collect()) == want
    assert not {10**6 + 2 * k + 1 for k in range(60) if k % 10 >= 4} & want.keys()
