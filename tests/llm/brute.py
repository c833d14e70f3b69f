"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

SPACE = " \t\n\x0b\f\r"
UPPER = {c: c + 32 for c in range(65, 91)}


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def line_dedup(docs, min_chars=20, min_docs=3):
    """(id, lines, dropped, digest) per document."""
    lines = [(d, (t or "").split("\n")) for d, t in docs]
    key = lambda line: line.strip(SPACE).translate(UPPER)
    smaller = lambda d: (d is not None, d or 0)
    held = collections.defaultdict(set)
    for d, ls in lines:
        for line in ls:
            if len(key(line)) >= min_chars:
                held[key(line)].add(d)
    keeper = {k: max(v, key=smaller) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for d, ls in lines:
        kept = [x for x in ls if key(x) not in keeper or keeper[key(x)] == d]
        out.append((d, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return out


def exact_dedup(docs):
    """(id, keep_id, size, digest) per document."""
    norm = [(d, re.sub(f"[{SPACE}]+", " ", t or "")) for d, t in docs]
    groups = collections.defaultdict(list)
    for d, t in norm:
        groups[t].append(d)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return [(d, least(groups[t]), len(groups[t]), sha(t)) for d, t in norm]


def repeats(docs, length=200):
    """(id, bytes, removed, spans, digest) per document."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = collections.Counter(x[i : i + length] for _, x in raw for i in range(len(x) - length + 1))
    out = []
    for d, x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(x), sum(gone), spans, sha(bytes(b for b, g in zip(x, gone) if not g))))
    return out


class Union:
    def __init__(self, n):
        self.of = list(range(n))

    def root(self, i):
        while self.of[i] != i:
            i = self.of[i]
        return i

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.of[max(a, b)] = min(a, b)


def components(ids, linked):
    """The smallest id of each row's component, and the component; rows are linked by a function of their places."""
    union = Union(len(ids))
    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                union.join(i, j)
    members = collections.defaultdict(list)
    for i in range(len(ids)):
        members[union.root(i)].append(ids[i])
    least = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return [(least[union.root(i)], union.root(i)) for i in range(len(ids))]


def shingles(text, words=5):
    found = re.findall(f"[^{SPACE}]+", (text or "").translate(UPPER))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def near_dedup(docs, percent=85):
    """(id, shingles, smallest id of the component, component) per document."""
    sets = [shingles(t) for _, t in docs]

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return both > 0 and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)

    least = components([d for d, _ in docs], linked)
    return [(d, len(s), *c) for (d, _), s, c in zip(docs, sets, least)]


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def pii(text):
    """Strict spans by start, then kind."""
    found = []
    for number, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            if _valid(kind, m.group()):
                found.append((m.start(), number, f"{kind}:{m.start()}:{m.end()}"))
    return [name for _, _, name in sorted(found)]


def rebuilt(turns, every=5, most=9):
    """conv → turns (role, text) that follow the starts shared by blocks of ids; ``turns`` are (conv, turn, role, text)."""
    import zlib

    of = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            of[conv].append(((turn is not None, turn or 0, tie), (role, text)))
    given = {c: [t for _, t in sorted(ts)] for c, ts in of.items()}
    out = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - int(abs(c) % every * (1 if c > 0 else -1))
        out[c] = given.get(base, [])[:h] + own[h:]
    return out


def trie(convs):
    """Rows (smallest member, depth, parent's, members, children, leaves, saved, digest of the ends) of conv → turns."""
    nodes = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids, sums = collections.Counter(p[:-1] for p in nodes if p), collections.defaultdict(lambda: [0, 0])
    for path, members in nodes.items():
        saved = (len(members) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            sums[path[:d]][0] += kids[path] == 0
            sums[path[:d]][1] += saved
    return [
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], *sums[p], sha(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))))
        for p, m in nodes.items()
    ]


def lossy_vocabulary(docs, least=7):
    """word → occurrences, of (id, text)."""
    import zlib

    counts = collections.Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += len(run) >= least
    return {w: n for w, n in counts.items() if n >= 2}


def spelling(counts, ratio=10):
    """(word, form, root, n, near words, form's n) of word → occurrences."""

    def near(x, y):
        if abs(len(x) - len(y)) > 1 or x == y:
            return False
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y)) == 1
        short, long = sorted((x, y), key=len)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    form, many = {}, {}
    for w, n in counts.items():
        found = [v for v in counts if near(w, v)]
        many[w] = len(found)
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return [(w, form[w], root(w), n, many[w], counts.get(form[w])) for w, n in counts.items()]


def top_scores(vectors, k=20, every=20):
    """(query, rank, id, score) of (id, vector)."""
    import math

    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, x) in enumerate(fine):
        if q is None or q % every:
            continue
        scores = [(-sum(a * b for a, b in zip(x, y)), i is None, i or 0, i) for j, (i, y) in enumerate(fine) if j != at and len(x) == len(y)]
        out += [(q, r, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return out
