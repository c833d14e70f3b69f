import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id string, row int, n int, hash string"
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "Über", "naïve", "日本", "x", "END."]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def sample():
    """Documents with copies, near copies, shared lines, nulls, empty and long texts, ties and repeated rows."""
    passage, line = prose("passage", 60), "  This Line stands in MANY documents "
    texts = [None, "", " \t\n ", "short", "A b\tc  D", "a B c d", line, line.upper() + "\n" + line, "x" * 900, "é" * 300]
    base = prose("base", 200).split(" ")
    for k in range(8):
        words = list(base)
        for e in range(k):
            words[17 * e + 3] = f"edit{k}-{e}"
        texts.append(" ".join(words))
    texts += [prose(k, 30 + k) + "\n" + line.strip() + "\n" + passage for k in range(6)]
    texts += [prose("twin", 80), prose("twin", 80).replace(" ", " \n", 3), prose("twin", 80)]
    texts += [passage + passage, prose("long", 6000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(4, "A b\tc  D"), (4, "A b\tc  D"), (7, "another text of the same id"), (None, prose("none", 50)), (None, "short")]
    return rows


@pytest.fixture(scope="session")
def pairs():
    return sample()


@pytest.fixture(scope="session")
def docs(spark, pairs):
    rows = [
        (d, t, [None, "en", "de"][k % 3], [None, "b", "a"][k % 3 if k % 5 else 1], None, True, "x", 1, 2, "h")
        for k, (d, t) in enumerate(pairs)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
