"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over them, each filter's largest response in a window of
fixed length is kept, and a softmax layer turns these into languages. The network is trained in numpy on a
bounded sample of labelled texts. A text is predicted from all its windows: the mean of their log-probabilities.
For prediction, a filter's response is the sum of one table entry per pair of bytes it covers, so a window
costs a few table look-ups per byte.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any labelled text every
row is ``und``, and ``in_known_language`` keeps what has a letter; equal labelled rows count each; other columns
are ignored. Very long texts are whole: they are
more windows. Ids, sources and labels are no inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmart.llm.common import query, read, small_batches
from sparkmart.session import settle

UNKNOWN = "und"
_CHUNK = 1 << 16  # bytes convolved at a time
_CELLS = 1 << 22  # windows, or texts, times languages held at a time


@dataclass(frozen=True)
class Settings:
    """Size of the network and of its training.

    ``sample_per_lang`` and ``sample_rows`` bound the labelled rows it sees, per language and in all.
    """

    window: int = 128
    widths: tuple[int, ...] = (2, 4, 6)
    filters: int = 12
    embedding: int = 8
    sample_per_lang: int = 400
    windows_per_text: int = 4
    sample_rows: int = 80_000
    epochs: int = 12
    batch: int = 64
    rate: float = 0.01
    seed: int = 5


class ByteNet:
    """Embedding, filters per width, max pooling, softmax."""

    def __init__(self, langs: list[str], s: Settings):
        rng = np.random.default_rng(s.seed)
        self.langs, self.s = langs, s
        self.p = {"e": rng.normal(0, 0.5, (256, s.embedding)).astype(np.float32)}
        for w in s.widths:
            self.p[f"f{w}"] = rng.normal(0, (w * s.embedding) ** -0.5, (w * s.embedding, s.filters)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(s.filters, np.float32)
        pooled = len(s.widths) * s.filters
        self.p["o"] = rng.normal(0, pooled**-0.5, (pooled, len(langs))).astype(np.float32)
        self.p["c"] = np.zeros(len(langs), np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the cross entropy for windows ``x`` of bytes and labels ``y``."""
        p, s, n = self.p, self.s, len(x)
        seen = p["e"][x]
        kept, pooled = [], []
        for w in s.widths:
            spans = np.lib.stride_tricks.sliding_window_view(seen, w, axis=1).swapaxes(2, 3).reshape(n, -1, w * s.embedding)
            out = spans @ p[f"f{w}"] + p[f"b{w}"]
            best = out.argmax(1)
            kept.append((spans, best))
            pooled.append(np.take_along_axis(out, best[:, None], 1)[:, 0])
        raw = np.concatenate(pooled, 1)
        hidden = np.maximum(raw, 0)
        logits = hidden @ p["o"] + p["c"]
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(n), y] -= 1
        prob /= n
        g = {"o": hidden.T @ prob, "c": prob.sum(0), "e": np.zeros_like(p["e"])}
        back = (prob @ p["o"].T) * (raw > 0)
        for k, w in enumerate(s.widths):
            spans, best = kept[k]
            d = back[:, k * s.filters : (k + 1) * s.filters]
            at = np.take_along_axis(spans, best[:, :, None], 1)  # the span behind each filter's maximum
            g[f"f{w}"] = np.einsum("nfe,nf->ef", at, d)
            g[f"b{w}"] = d.sum(0)
            to = (d[:, :, None] * p[f"f{w}"].T[None]).reshape(n, s.filters, w, s.embedding)
            bytes_at = np.take_along_axis(x, (best[:, :, None] + np.arange(w)).reshape(n, -1), 1)
            np.add.at(g["e"], bytes_at.ravel(), to.reshape(-1, s.embedding))
        return g

    def train(self, x: np.ndarray, y: np.ndarray) -> "ByteNet":
        """Adam over shuffled batches."""
        s = self.s
        rng = np.random.default_rng(s.seed + 1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(s.epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), s.batch):
                pick = order[at : at + s.batch]
                step += 1
                for k, g in self.gradients(x[pick], y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] -= s.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def tables(self) -> list[tuple[int, list[np.ndarray], np.ndarray]]:
        """Per width: one table per pair of bytes, indexed by the pair, and the bias."""
        out = []
        for w in self.s.widths:
            per_byte = np.einsum("be,wef->wbf", self.p["e"], self.p[f"f{w}"].reshape(w, self.s.embedding, -1))
            pairs = [(per_byte[k][:, None] + per_byte[k + 1][None]).reshape(65536, -1) for k in range(0, w, 2)]
            out.append((w, [np.ascontiguousarray(t, np.float32) for t in pairs], self.p[f"b{w}"]))
        return out

    def log_probabilities(self, data: np.ndarray, tables) -> np.ndarray:
        """A row per window of ``data``, whose length is a whole number of windows."""
        size, out = self.s.window, []
        step = _CHUNK // size * size
        for at in range(0, len(data), step):
            part = data[at : at + step].astype(np.uint16)
            pairs = np.zeros(len(part), np.uint16)
            pairs[:-1] = (part[:-1] << 8) | part[1:]
            pooled = []
            for w, pair_tables, bias in tables:
                total = pair_tables[0][pairs]
                for k, table in enumerate(pair_tables[1:], 1):
                    total[: -2 * k] += table[pairs[2 * k :]]
                spans = total.reshape(-1, size, total.shape[1])[:, : size - w + 1]
                pooled.append(spans.max(1) + bias)
            logits = np.maximum(np.concatenate(pooled, 1), 0) @ self.p["o"] + self.p["c"]
            logits -= logits.max(1, keepdims=True)
            out.append(logits - np.log(np.exp(logits).sum(1, keepdims=True)))
        return np.concatenate(out)

    def predict(self, texts: list[bytes], tables) -> tuple[np.ndarray, np.ndarray]:
        """Most probable language of each text, which must not be empty, and its share of the mean."""
        size, langs = self.s.window, len(self.langs)
        data, first = windows(texts, size)
        mean, count = np.zeros((len(texts), langs), np.float32), len(data) // size
        step = max(1, min(_CHUNK // size, _CELLS // langs))
        for at in range(0, count, step):
            end = min(at + step, count)
            held = slice(np.searchsorted(first, at, "right") - 1, np.searchsorted(first, end))
            found = self.log_probabilities(data[at * size : end * size], tables)
            mean[held] += np.add.reduceat(found, np.maximum(first[held] - at, 0), axis=0)
        mean /= np.diff(np.append(first, count))[:, None]
        prob = np.exp(mean - mean.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        best = prob.argmax(1)
        return best, prob[np.arange(len(best)), best]


def windows(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, each filled up with zeros to whole windows, and each text's first window."""
    lengths = np.array([-(-len(t) // size) for t in texts], np.int64)
    joined = b"".join(t + bytes(n * size - len(t)) for t, n in zip(texts, lengths.tolist()))
    return np.frombuffer(joined, np.uint8), np.cumsum(lengths) - lengths


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def labelled_windows(docs: DataFrame, text_col: str, lang_col: str, id_col: str, s: Settings) -> list:
    """The training sample: (language, bytes) of up to ``windows_per_text`` windows of each sampled text.

    About ``sample_per_lang`` rows of every language are drawn by a hash of id and text, the same in every
    run, and windows are taken from all over a text. Every language is learned, from one row at least; with very
    many languages, fewer rows are drawn of each, so that they stay within ``sample_rows``.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & has_letter(F.col(text_col)))
    rows = rows.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), F.xxhash64(id_col, text_col).alias("_draw"))
    sizes = rows.groupBy(F.col("_lang").alias("lang")).agg(F.count("*").alias("rows"), F.min("_draw").alias("least"))
    sizes = settle(sizes, "languages")
    per_lang = max(1, min(s.sample_per_lang, s.sample_rows // max(1, sizes.count())))
    rows = rows.join(sizes, F.col("_lang") == F.col("lang"))
    share = (F.col("_draw") + 2.0**63) / 2.0**64
    drawn = rows.where((share < F.lit(float(per_lang)) / F.col("rows")) | (F.col("_draw") == F.col("least")))
    data = F.encode("_text", "UTF-8")
    count = F.ceil(F.octet_length("_text") / s.window)
    picks = F.transform(F.sequence(F.lit(0), F.lit(s.windows_per_text - 1)), lambda k: F.pmod(F.xxhash64("_draw", k), count))
    picks = F.array_distinct(F.when(count <= s.windows_per_text, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(picks))
    cut = drawn.withColumn("pick", F.explode(picks)).select(
        "lang", F.substr(data, (F.col("pick") * s.window + 1).cast("int"), F.lit(s.window)).alias("bytes")
    )
    # The draw already holds the expected number; the order makes the bound hard and every run alike. Copies meet as one row.
    most = 2 * per_lang * s.windows_per_text
    copies = cut.groupBy("lang", "bytes").agg(F.least(F.count("*"), F.lit(most)).alias("copies"))
    each = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("bytes"), "bytes"))
    bounded = each.withColumn("rank", rank).where(F.col("rank") <= most)
    return bounded.select("lang", "bytes").orderBy(F.xxhash64("lang", "bytes"), "lang", "bytes").collect()


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", settings: Settings = Settings()) -> ByteNet | None:
    """A network for the labelled rows of ``docs``; None when there are none."""
    sample = labelled_windows(docs, text_col, lang_col, id_col, settings)
    if not sample:
        return None
    langs = sorted({r["lang"] for r in sample})
    data, _ = windows([bytes(r["bytes"]) for r in sample], settings.window)
    place = {lang: k for k, lang in enumerate(langs)}
    y = np.array([place[r["lang"]] for r in sample])
    # Languages with few rows are repeated, so that each has the same weight.
    counts = np.bincount(y, minlength=len(langs))
    pick = np.concatenate([np.resize(np.flatnonzero(y == k), counts.max()) for k in range(len(langs))])
    return ByteNet(langs, settings).train(data.reshape(-1, settings.window)[pick].astype(np.int64), y[pick])


def identify(docs: DataFrame, net: ByteNet | None, text_col: str = "text") -> DataFrame:
    """Every row as ``row`` with ``lang_pred`` and ``score``."""
    rows = docs.select(F.struct("*").alias("row"))
    if net is None:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    small_batches(docs.sparkSession)
    parameters = docs.sparkSession.sparkContext.broadcast((net.langs, net.s, net.p))  # some 60 kB and 150 bytes a language

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, settings, p = parameters.value
        model = ByteNet(langs, settings)
        model.p = p
        tables = model.tables()
        for texts in batches:
            found = texts.notna().to_numpy()
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            held = [t.encode() for t in texts[found]]
            at, places, names = 0, np.flatnonzero(found), np.array(langs, object)
            while at < len(held):
                end, size = at, 0
                while end < len(held) and (end == at or size < 4 << 20 and (end - at) * len(langs) < _CELLS):
                    size += len(held[end])
                    end += 1
                best, share = model.predict(held[at:end], tables)
                lang[places[at:end]], score[places[at:end]] = names[best], share
                at = end
            yield pd.DataFrame({"lang": lang, "score": score})

    text = F.col("row")[text_col]
    # Spark copies a deterministic function into filters on its result and would run it again there.
    once = predict.asNondeterministic()
    done = rows.select("row", once(F.when(has_letter(text), text)).alias("found"))
    return done.select("row", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def in_known_language(docs: DataFrame, net: ByteNet | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is found, with their columns; a missing label is filled with it.

    Without a network only rows without a letter go, and labels stay as they are.
    """
    if net is None:
        return docs.where(has_letter(F.col(text_col)))
    found = identify(docs, net, text_col).where(F.col("lang_pred") != UNKNOWN)
    label = F.coalesce(F.col("row")[lang_col], F.col("lang_pred"))
    return found.select(F.col("row").withField(lang_col, label).alias("row")).select("row.*")


def held_out(id_col: str = "doc_id") -> Column:
    """True for the third of documents that training never sees."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


@query()
def op2_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), net)
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")
