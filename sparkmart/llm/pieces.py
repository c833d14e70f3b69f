"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text, with a space before it and spaces written as the vocabulary's mark, is cut into the pieces whose
scores add up to the most; characters without a piece become byte pieces. Between certain characters no
piece of the vocabulary can lie across: before a mark that follows another character, and around characters
of no piece. Texts fall into words there, and equal words of a batch are cut once, all words side by side.

A giant document is split into chunks. A chunk's boundary state is the number of its first characters that a
piece of the chunk before it covers. Every chunk alone gives the matrix of best scores from entry state to
exit state; products of these matrices in max-plus arithmetic, which are associative, give the true scores of
every entry state. With them each chunk tells the entry state behind every exit state, and composed from the end
these maps give each chunk's states. Then every chunk is cut into pieces independently. All scores are whole
numbers, so a split text is cut exactly as an unsplit one.

The vocabulary's file is read on the driver and sent to the tasks: its size is fixed. Vocabularies made by merging
hold no probabilities, only ranks; their scores are logarithms of Zipf probabilities, one over the rank. Cuts then
mostly agree with the merges, but need not repeat them.

Defined cases: a null text has null pieces, an empty text none; decoding gives back every text exactly, also
literal marks, which become byte pieces; rows that repeat an id are encoded each; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmart.llm.common import query, read, same, small_batches
from sparkmart.session import settle

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, LITERAL = 0x2581, 0x110000  # the mark of a space; the same character standing for itself
LOW = -(1 << 61)
SCALE = 1 << 20  # scores are kept as whole numbers of this fraction
NO_EDGE = -(1 << 31)
_BYTES_OF = 1 << 24  # added to a code point: its byte pieces


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as text, their scores as whole numbers, and the ids of the 256 byte pieces."""

    pieces: tuple[str, ...]
    scores: tuple[int, ...]
    byte_ids: tuple[int, ...]
    ids: tuple[int, ...]

    @staticmethod
    def load(path: str = MODEL) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        scores = np.array([model.get_score(i) for i in ids], np.float64)
        if (scores == np.round(scores)).all():  # ranks, the first merge highest
            rank = np.empty(len(ids), np.int64)
            rank[np.argsort(-scores, kind="stable")] = np.arange(1, len(ids) + 1)
            scores = -np.log(rank) - np.log((1 / rank).sum())
        byte_ids = tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256))
        whole = np.round(scores * SCALE).astype(np.int64).tolist()
        return Vocabulary(tuple(model.id_to_piece(i) for i in ids), tuple(whole), byte_ids, tuple(ids))


class Lexicon:
    """The vocabulary as tables for numpy: a trie in an open-addressing table, scores, and where texts fall apart."""

    def __init__(self, v: Vocabulary):
        self.v = v
        letters = sorted(set("".join(v.pieces)))
        self.letter = np.zeros(LITERAL + 1, np.int64)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.longest = max(map(len, v.pieces))
        # Marks inside pieces, other than at their beginning, would keep words together.
        mark = chr(MARK)
        self.apart = not any(p.lstrip(mark).find(mark) >= 0 for p in v.pieces)
        nodes: dict[tuple[int, int], int] = {}
        of_node = [-1]
        for number, piece in enumerate(v.pieces):
            at = 0
            for c in piece:
                key = (at, int(self.letter[ord(c)]))
                if key not in nodes:
                    nodes[key] = len(of_node)
                    of_node.append(-1)
                at = nodes[key]
            of_node[at] = number
        self.of_node = np.array(of_node, np.int64)
        self.bits = max(16, (8 * len(nodes)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.next = np.zeros(1 << self.bits, np.int64)
        self.reach = 1
        for (at, c), to in nodes.items():
            key = at << 21 | c
            slot, tries = self._slot(np.array([key]))[0], 1
            while self.keys[slot] >= 0:
                slot, tries = (slot + 1) & ((1 << self.bits) - 1), tries + 1
            self.keys[slot], self.next[slot], self.reach = key, to, max(self.reach, tries)
        self.score = np.array(v.scores, np.int64)
        self.unknown = int(self.score.min()) - 10 * SCALE
        # A missing edge must cost more than the worst way over the characters of the longest piece.
        if self.unknown * self.longest <= NO_EDGE:
            raise ValueError("the scores of the vocabulary are too low")
        self.ids = np.array(v.ids, np.int32)
        self.byte_ids = np.array(v.byte_ids, np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The nodes reached, 0 where there is none."""
        key = node << 21 | letter
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.next[slot], 0)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(1, self.reach):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.next[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def edges(self, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every position and length: the token that begins there, -1 if none, and its score.

        ``room`` is how many characters a piece may have that begins at the position. Tokens are numbers of
        pieces, or ``_BYTES_OF`` plus the code point for characters without a piece of their own.
        """
        width = min(self.longest, int(room.max(initial=1)))
        token = np.full((len(codes), width), -1, np.int32)
        score = np.full((len(codes), width), NO_EDGE, np.int32)
        letters = self.letter[codes]
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for length in range(1, width + 1):
            fits = room[at] >= length
            at, node = at[fits], node[fits]
            node = self._child(node, letters[at + length - 1])
            at, node = at[node > 0], node[node > 0]
            if not len(at):
                break
            number = self.of_node[node]
            whole = number >= 0
            token[at[whole], length - 1] = number[whole]
            score[at[whole], length - 1] = self.score[number[whole]]
        alone = token[:, 0] < 0
        token[alone, 0] = _BYTES_OF + codes[alone]
        score[alone, 0] = self.unknown
        return token, score

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """True at positions that no piece can lie across from the character before."""
        known = self.letter[codes] > 0
        out = ~known
        out[1:] |= ~known[:-1]
        if self.apart:
            out[1:] |= (codes[1:] == MARK) & (codes[:-1] != MARK)
        return out

    def expand(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of tokens, and how many each has."""
        counts = np.ones(len(tokens), np.int64)
        raw = np.flatnonzero(tokens >= _BYTES_OF)
        codes = tokens[raw] - _BYTES_OF
        codes[codes == LITERAL] = MARK
        data = [chr(c).encode("utf-8", "surrogatepass") for c in codes.tolist()]
        counts[raw] = [len(d) for d in data]
        ids = np.repeat(self.ids[np.where(tokens >= _BYTES_OF, 0, tokens)], counts)
        begins = np.cumsum(counts) - counts
        for k in range(4):
            has = [i for i, d in enumerate(data) if len(d) > k]
            ids[begins[raw[has]] + k] = self.byte_ids[[data[i][k] for i in has]]
        return ids, counts


def codes_of(text: str) -> np.ndarray:
    """Code points with spaces as marks and marks as literals."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes[codes == MARK] = LITERAL
    codes[codes == 32] = MARK
    return codes


def best_cuts(lexicon: Lexicon, codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of words, one after the other, and how many each has. All words advance one character at a time."""
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    starts = np.cumsum(lengths) - lengths
    flat = np.repeat(begins - starts, lengths) + np.arange(lengths.sum())
    room = np.repeat(starts + lengths, lengths) - np.arange(len(flat))
    token, score = lexicon.edges(codes[flat], room)
    # Best score up to each position; a word's slots are its positions and its end.
    slots = starts + np.arange(len(lengths))
    best = np.full(len(flat) + len(lengths), LOW, np.int64)
    step = np.zeros(len(best), np.int64)
    best[slots] = 0
    for end in range(1, int(lengths.max(initial=0)) + 1):
        active = int(np.searchsorted(-lengths, -end, side="right"))
        # The longest piece wins a tie.
        back = np.arange(min(end, token.shape[1]), 0, -1)
        value = best[slots[:active, None] + end - back] + score[starts[:active, None] + end - back, back - 1]
        choice = value.argmax(1)
        best[slots[:active] + end] = np.maximum(value[np.arange(active), choice], LOW)
        step[slots[:active] + end] = back[choice]
    at, word = lengths.copy(), np.arange(len(lengths))
    found_word, found_token = [], []
    while len(word):
        size = step[slots[word] + at[word]]
        at[word] -= size
        found_word.append(word)
        found_token.append(token[starts[word] + at[word], size - 1])
        word = word[at[word] > 0]
    counts = np.zeros(len(lengths), np.int64)
    for w in found_word:
        counts[w] += 1
    out_counts = np.empty(len(lengths), np.int64)
    out_counts[order] = counts
    last = np.cumsum(out_counts) - 1
    out = np.empty(int(out_counts.sum()), np.int64)
    for k, (w, t) in enumerate(zip(found_word, found_token)):
        out[last[order[w]] - k] = t
    return out, out_counts


def encode_words(lexicon: Lexicon, codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words that begin at ``begins`` and cover all of ``codes``, and how many each has."""
    lengths = np.diff(np.append(begins, len(codes)))
    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    up = np.full(len(codes) + 1, base, np.uint64)
    down = np.full(len(codes) + 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    mixed ^= mixed >> np.uint64(29)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * up[:-1])))
    word = (sums[begins + lengths] - sums[begins]) * down[begins] * np.uint64(131) + lengths.astype(np.uint64)
    _, first, which = np.unique(word, return_index=True, return_inverse=True)
    # Words are one only if they are letter for letter.
    twin = np.repeat(begins[first][which] - begins, lengths) + np.arange(len(codes))
    if not np.array_equal(codes[twin], codes):
        first, which = np.arange(len(begins)), np.arange(len(begins))
    tokens, counts = best_cuts(lexicon, codes, begins[first], lengths[first])
    ids, each = lexicon.expand(tokens)
    id_counts = np.add.reduceat(each, np.cumsum(counts) - counts) if len(counts) else counts
    id_begins = np.cumsum(id_counts) - id_counts
    out_counts = id_counts[which]
    out_begins = np.cumsum(out_counts) - out_counts
    out = ids[np.repeat(id_begins[which] - out_begins, out_counts) + np.arange(out_counts.sum())]
    return out, out_counts


def encode_texts(lexicon: Lexicon, texts: list[str]) -> list[np.ndarray]:
    """Ids of whole texts, none of them empty."""
    parts = [codes_of(" " + t) for t in texts]
    codes = np.concatenate(parts)
    ends = np.cumsum([len(p) for p in parts])
    cut = lexicon.cuts(codes)
    cut[np.concatenate(([0], ends[:-1]))] = True
    begins = np.flatnonzero(cut)
    ids, counts = encode_words(lexicon, codes, begins)
    words = np.searchsorted(begins, ends)  # words up to each text's end
    return np.split(ids, np.cumsum(counts)[words - 1][:-1])


class Chunk:
    """A part of a giant text: ``before`` is the character before it, ``ahead`` those that its last piece may reach."""

    def __init__(self, lexicon: Lexicon, text: str, has_before: bool, size: int):
        self.lexicon = lexicon
        codes = codes_of(text)
        cut = lexicon.cuts(codes)
        self.codes = codes[1:] if has_before else codes
        self.cut = cut[1:] if has_before else cut
        if not has_before:
            self.cut[0] = True
        self.size = min(size, len(self.codes))
        self.states = lexicon.longest
        inside = np.flatnonzero(self.cut[: self.size + 1])
        if self.size == len(self.codes):
            inside = np.append(inside, self.size)
        self.first, self.last = (int(inside[0]), int(inside[-1])) if len(inside) else (None, None)

    def _forward(self, begin: int, end: int, entry: np.ndarray):
        """Best scores and steps at positions ``begin`` on, for pieces that begin before ``end``.

        ``entry`` has a row per state and a column per lane.
        """
        stop = min(end + self.states - 1, len(self.codes))
        nearest = np.flatnonzero(self.cut[end + 1 : stop]) if end < len(self.codes) else []
        stop = end + 1 + int(nearest[0]) if len(nearest) else stop
        stop = end if end < len(self.codes) and self.cut[end] else stop
        token, score = self.lexicon.edges(self.codes[begin:stop], stop - np.arange(begin, stop))
        lanes = entry.shape[1]
        best = np.full((end - begin + self.states, lanes), LOW, np.int64)
        rows = min(len(entry), len(best))
        best[:rows] = entry[:rows]
        step = np.zeros(best.shape, np.int64)
        for at in range(1, min(stop - begin, len(best) - 1) + 1):
            back = np.arange(min(at, token.shape[1]), max(0, at - (end - begin)), -1)
            value = np.maximum(best[at - back] + score[at - back, back - 1][:, None], LOW)
            choice = value.argmax(0)
            top = value[choice, np.arange(lanes)]
            better = top > best[at]
            best[at] = np.where(better, top, best[at])
            step[at] = np.where(better, back[choice], 0)
        return best, step, token

    def _states(self, entry) -> np.ndarray:
        out = np.full((self.states, entry.shape[1]), LOW, np.int64)
        out[: min(self.states, len(entry))] = entry[: self.states]
        return out

    def _middle(self) -> int:
        """The score of all words between the first and the last cut."""
        if self.first == self.last:
            return 0
        cut = np.flatnonzero(self.cut[self.first : self.last])
        codes = self.codes[self.first : self.last]
        lengths = np.diff(np.append(cut, len(codes)))
        tokens, _ = best_cuts(self.lexicon, codes, cut, lengths)
        raw = tokens >= _BYTES_OF
        return int(self.lexicon.score[tokens[~raw]].sum()) + int(raw.sum()) * self.lexicon.unknown

    def _start(self) -> np.ndarray:
        entry = np.full((self.states, 1), LOW, np.int64)
        entry[0] = 0
        return entry

    def matrix(self) -> np.ndarray:
        """Best scores from each entry state to each exit state."""
        lanes = np.where(np.eye(self.states, dtype=bool), 0, LOW).astype(np.int64)
        if self.first is None:
            best, _, _ = self._forward(0, self.size, lanes)
            return best[self.size : self.size + self.states].T
        head = lanes[self.first] if self.first < self.states else np.full(self.states, LOW, np.int64)
        if self.first:
            head = self._forward(0, self.first, lanes)[0][self.first]
        tail = self._forward(self.last, self.size, self._start())[0][self.size - self.last :][: self.states, 0]
        return np.maximum(head[:, None] + tail[None] + self._middle(), LOW)

    def _trace(self, step, at: int) -> int:
        while step[at, 0]:
            at -= int(step[at, 0])
        return at

    def entries(self, entry: np.ndarray) -> np.ndarray:
        """The entry state behind every exit state, given the true scores of the entry states."""
        if self.first is not None:
            if self.first == 0:
                return np.zeros(self.states, np.int64)
            _, step, _ = self._forward(0, self.first, entry[:, None])
            return np.full(self.states, self._trace(step, self.first))
        _, step, _ = self._forward(0, self.size, entry[:, None])
        return np.array([self._trace(step, self.size + j) for j in range(self.states)])

    def _tokens(self, begin: int, end: int, entry: np.ndarray, at: int) -> list[int]:
        """Tokens from the entry state to position ``at``, counted from ``begin``."""
        _, step, token = self._forward(begin, end, entry)
        out = []
        while step[at, 0]:
            size = int(step[at, 0])
            at -= size
            out.append(int(token[at, size - 1]))
        return out[::-1]

    def ids(self, entry: np.ndarray, exit_state: int) -> np.ndarray:
        """Ids of the pieces that begin in the chunk."""
        if self.first is None:
            tokens = np.array(self._tokens(0, self.size, entry[:, None], self.size + exit_state), np.int64)
            return self.lexicon.expand(tokens)[0]
        head = self._tokens(0, self.first, entry[:, None], self.first) if self.first else []
        tail = self._tokens(self.last, self.size, self._start(), self.size - self.last + exit_state)
        middle = np.empty(0, np.int32)
        if self.first < self.last:
            cut = np.flatnonzero(self.cut[self.first : self.last])
            middle = encode_words(self.lexicon, self.codes[self.first : self.last], cut)[0]
        outer = [self.lexicon.expand(np.array(t, np.int64))[0] for t in (head, tail)]
        return np.concatenate((outer[0], middle, outer[1]))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two transfer matrices: it is associative."""
    return np.maximum((a[:, :, None] + b[None]).max(1), LOW)


def _per_document(matrices: pd.DataFrame) -> pd.DataFrame:
    """True scores of every chunk's entry states, from the products of the matrices before it."""
    matrices = matrices.sort_values("chunk")
    states = int(len(matrices["matrix"].iloc[0]) ** 0.5)
    each = [np.asarray(m, np.int64).reshape(states, states) for m in matrices["matrix"]]
    before = itertools.accumulate([np.where(np.eye(states, dtype=bool), 0, LOW).astype(np.int64), *each[:-1]], combine)
    return matrices[["doc", "chunk"]].assign(entry=[m[0] for m in before])


def _from_the_end(maps: pd.DataFrame) -> pd.DataFrame:
    """Exit states: the last chunk ends with the text, the others where the next begins."""
    maps = maps.sort_values("chunk")
    exits, state = [], 0
    for entries in reversed(list(maps["entries"])):
        exits.append(state)
        state = int(entries[state])
    return maps[["doc", "chunk"]].assign(exit=exits[::-1])


def _lexicon_of(shared):
    return Lexicon(shared.value)


def _encode_giants(giants: DataFrame, shared, chunk: int, longest: int) -> DataFrame:
    """``doc`` and ``ids`` of giant texts by chunks."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = " " + text
                for at in range(0, len(text), chunk * 16):
                    places = range(at, min(at + chunk * 16, len(text)), chunk)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc] * len(places)), pa.array([p // chunk for p in places], pa.int64()),
                         pa.array([text[max(p - 1, 0) : p + chunk + longest - 1] for p in places])],
                        names=["doc", "chunk", "text"],
                    )

    def each(work, name, kind):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = _lexicon_of(shared)
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    out.append(work(Chunk(lexicon, row["text"], row["chunk"] > 0, chunk), row))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["doc", "chunk", name])

        return run

    longs = pa.list_(pa.int64())
    chunks = settle(giants.mapInArrow(split, "doc string, chunk long, text string"), "chunks")
    spread = chunks.repartition("doc", "chunk")
    matrices = spread.mapInArrow(each(lambda c, _: c.matrix().ravel(), "matrix", longs), "doc string, chunk long, matrix array<long>")
    entry = settle(matrices.groupBy("doc").applyInPandas(_per_document, "doc string, chunk long, entry array<long>"), "entries")
    known = chunks.join(entry, ["doc", "chunk"])
    maps = known.mapInArrow(
        each(lambda c, row: c.entries(np.array(row["entry"], np.int64)), "entries", longs), "doc string, chunk long, entries array<long>"
    )
    exits = settle(maps.groupBy("doc").applyInPandas(_from_the_end, "doc string, chunk long, exit long"), "exits")
    parts = known.join(exits, ["doc", "chunk"]).mapInArrow(
        each(lambda c, row: c.ids(np.array(row["entry"], np.int64), row["exit"]), "ids", pa.list_(pa.int32())),
        "doc string, chunk long, ids array<int>",
    )
    in_order = F.sort_array(F.collect_list(F.struct("chunk", "ids")))
    return parts.groupBy("doc").agg(F.flatten(F.transform(in_order, lambda p: p["ids"])).alias("ids"))


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", chunk_chars: int = 1 << 16) -> DataFrame:
    """Every row as ``row`` with ``ids``. Texts over ``chunk_chars`` characters are encoded chunk by chunk."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary, about a megabyte

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = _lexicon_of(shared)
        for batch in batches:
            texts = batch.to_pylist()
            out: list = [None if t is None else np.empty(0, np.int32) for t in texts]
            todo = [i for i, t in enumerate(texts) if t]
            while todo:
                size, take = 0, 0
                while take < len(todo) and (take == 0 or size < 1 << 18):
                    size += len(texts[todo[take]])
                    take += 1
                for i, ids in zip(todo[:take], encode_texts(lexicon, [texts[i] for i in todo[:take]])):
                    out[i] = ids
                todo = todo[take:]
            sizes = [0 if o is None else len(o) for o in out]
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            values = np.concatenate([o for o in out if o is not None] or [np.empty(0, np.int32)])
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=pa.array([o is None for o in out]))

    cut = F.arrow_udf("array<int>")(run)
    rows = docs.select(F.struct("*").alias("row"))
    text = F.col("row")[text_col]
    giant = F.coalesce(F.char_length(text) >= chunk_chars, F.lit(False))
    plain = rows.where(~giant).select("row", cut(text).alias("ids"))
    # Equal giant texts are encoded once, under their digest.
    giants = rows.where(giant).select("row", F.sha2(text, 256).alias("_doc"))
    distinct = giants.groupBy("_doc").agg(F.first(F.col("row")[text_col]).alias("text"))
    done = _encode_giants(distinct.select(F.col("_doc").alias("doc"), "text"), shared, chunk_chars, max(map(len, vocabulary.pieces)))
    large = giants.join(done, same(F.col("_doc"), F.col("doc"))).select("row", "ids")
    return plain.unionByName(large)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``: pieces joined, marks as spaces, byte pieces as bytes, without the space put before."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = shared.value
        data: dict[int, bytes] = {i: p.replace(chr(MARK), " ").encode() for i, p in zip(v.ids, v.pieces)}
        data |= {i: bytes([b]) for b, i in enumerate(v.byte_ids)}
        for ids in batches:
            out = [None if x is None else b"".join(map(data.__getitem__, x.tolist()))[1:].decode("utf-8", "replace") for x in ids]
            yield pd.Series(out, dtype=object)

    return rows.withColumn("decoded", text(ids_col))


@query()
def op7_sentencepiece(spark, sf_dir):
    vocabulary = Vocabulary.load()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = decode(encode(docs, vocabulary), vocabulary)
    return done.select(
        "row.doc_id",
        F.char_length("row.text").cast("long").alias("n_chars"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        same(F.col("row.text"), F.col("decoded")).alias("round_trip"),
    )
