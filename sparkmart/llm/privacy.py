"""Personal data by candidates and boosted trees.

High-recall patterns propose spans of four kinds, which may overlap. Those of the strict patterns, with valid
values, are personal data in any case. The others are scored by gradient-boosted trees on features of their
format and of the characters around them. The trees are trained on candidates of all
documents: their strict matches, the same values written anew where they stood in forms that the strict patterns
miss (veiled, without mark, parted otherwise), and look-alikes made of them (failing checks, numbers too high,
prices, product codes), which count as negative like the text's own candidates that nothing strict touches. Half of the
documents calibrates, per kind, the lowest score whose selections are right often enough, and candidates at or above it
are added, unless they overlap a strict match of any kind. Candidates of equal features are one row with their number
as weight, so the trees see all candidates but take time by the different ones. All else is expressions over one row: documents are read
and scored without a shuffle.

Defined cases: a null text is empty; without documents, or without positive and negative candidates to learn
from, nothing is added; equal rows give equal results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmart.llm.common import let, query, read, running_sum
from sparkmart.session import settle

KINDS = ("email", "ip", "card", "phone")

# The strict patterns. Written so that a failing run of characters is not tried again from each of its places:
# a match begins where its run does, or where the match before ended, and runs are never given back.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The high-recall patterns: also veiled, unusually parted or unmarked forms.
LOOSE = {
    "email": r"(?:\G|(?<![\p{L}0-9._%+-]))[\p{L}0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[\p{L}0-9-]{1,63}+"
    r"(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[\p{L}0-9-]{2,24}+){1,4}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\.|\[\.\]|\(dot\)|\[dot\])\x20?[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])(?:[0-9]{12,19}+|[0-9](?:[\x20./_-]?[0-9]){11,18}+)(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00)?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![0-9])",
}
CONTEXT = {
    "email": "mail|contact|write|@",
    "ip": r"\bip\b|host|server|addr|login|from",
    "card": "card|visa|master|credit|pay|konto|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobil|whatsapp|number",
}
FEATURES = (
    "kind", "digits", "letters", "spaces", "dashes", "dots", "parens", "groups", "longest",
    "luhn", "octets", "before_letter", "before_digit", "before_mark", "after_letter", "after_digit", "after_mark", "word",
)


@dataclass(frozen=True)
class Settings:
    """What trees are learned from, and ``precision``, which is asked of added spans.

    All strict values and other candidates of all documents are learned from, unless ``sample_values`` is given: then about
    so many of each, drawn by a hash. ``bins`` exceeds the values that a feature takes, so that splits are tried at all of them.
    """

    sample_values: int | None = None
    bins: int = 512
    trees: int = 12
    depth: int = 4
    precision: float = 0.97
    context: int = 32
    seed: int = 3


def apart(spans: Column, others: Column, block: int = 256) -> Column:
    """The spans that overlap none of the others, which are looked through by blocks in order of their start."""

    def free(rows):
        numbers = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / block).cast("int")))
        items = lambda k: F.slice(rows, k * block + 1, block)
        blocks = F.transform(
            F.coalesce(numbers, F.array().cast("array<int>")),
            lambda k: let(items(k), lambda r: F.struct(
                F.get(r, 0)["start"].alias("start"), F.array_max(F.transform(r, lambda x: x["end"])).alias("end"), r.alias("rows")
            )),
        )
        meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
        return let(blocks, lambda bs: F.filter(
            spans, lambda a: ~F.exists(bs, lambda b: F.when(meets(a, b), F.exists(b["rows"], lambda x: meets(a, x))).otherwise(False))
        ))

    return let(F.array_sort(F.transform(others, lambda o: F.struct(o["start"], o["end"]))), free)


def respelt(span: Column) -> Column:
    """The value of a strict span in other forms: an array of ``text`` and ``label``."""
    found, digits = span["found"], _digits(span["found"])
    sub = lambda pattern, by, text=found: F.regexp_replace(text, pattern, by)
    fours = lambda by, text=digits: sub("([0-9]{4})(?=[0-9])", f"$1{by}", text)
    wrong = F.concat(F.left(digits, F.length(digits) - 1), F.pmod(F.right(digits, F.lit(1)).try_cast("int") + 1, F.lit(10)).cast("string"))
    unmarked, price = F.substr(found, F.lit(2)), F.lpad(F.pmod(F.xxhash64(found), F.lit(10_000_000)).cast("string"), 7, "1")
    forms = {
        "email": (
            [sub("@", by_at, sub(r"\.(?=[^@]*$)", by_dot)) for by_at, by_dot in ((" (at) ", "."), ("[at]", "[dot]"), ("(at)", " (dot) "), (" @ ", "."))],
            [sub("^([0-9]{3})([0-9]{2})", r"$1 @ $2.", price), sub("^([0-9])([0-9]{3})", r"$1 @ $2.", price)],
        ),
        "ip": (
            [sub(r"\.", by) for by in ("[.]", " (dot) ", "[dot]", " . ")],
            [F.concat(F.lit("7"), F.lpad(sub(r"\..*", ""), 2, "0"), sub(r"^[0-9]+", "", sub(r"\.", by))) for by in ("[.]", " . ")],
        ),
        "card": ([fours("."), fours("/"), fours("_")], [fours(".", wrong), fours("/", wrong), fours(" ", wrong), wrong]),
        "phone": (
            [unmarked, F.concat(F.lit("00"), unmarked), sub(r"[\x20-]+", ".", unmarked)],
            [F.concat(F.lit("Q"), unmarked), F.concat(unmarked, F.lit("B")), F.concat(F.lit("#"), unmarked)],
        ),
    }
    rows = {
        k: F.array(*(F.struct(text.alias("text"), F.lit(float(label)).alias("label")) for label, texts in ((1, good), (0, bad)) for text in texts))
        for k, (good, bad) in forms.items()
    }
    none = F.array().cast("array<struct<text:string,label:double>>")
    return reduce(lambda rest, k: F.when(span["kind"] == k, rows[k]).otherwise(rest), KINDS, none)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a row of digits is right."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)))
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda acc, d: acc + d) % 10 == 0


def octets(text: Column) -> Column:
    """Whether all numbers parted by dots are at most 255."""
    parts = F.transform(F.split(text, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return ~F.exists(parts, lambda p: (F.length(p) > 3) | (F.coalesce(p.try_cast("int"), F.lit(0)) > 255))


def _valid(kind: str, found: Column) -> Column:
    count = F.length(_digits(found))
    if kind == "ip":
        return octets(found)
    if kind == "card":
        return count.between(12, 19) & luhn(_digits(found))
    return count.between(9, 15) if kind == "phone" else F.lit(True)


def matches(text: Column, kind: str, pattern: str, context: int) -> Column:
    """All matches with their places in code points, and the characters before and after."""

    def spans(cut):
        found, gaps = cut["found"], cut["gaps"]
        lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: (F.char_length(g) + F.char_length(m)).cast("long"))
        places = let(lengths, lambda values: running_sum(values))
        parts = F.arrays_zip(
            found.alias("m"), places.alias("at"), F.slice(gaps, 1, F.size(found)).alias("g"), F.slice(gaps, 2, F.size(found)).alias("a")
        )

        def span(p):
            start = p["at"] + F.char_length(p["g"])
            return F.struct(
                start.alias("start"), (start + F.char_length(p["m"])).alias("end"), F.lit(kind).alias("kind"),
                p["m"].alias("found"), F.right(p["g"], F.lit(context)).alias("before"), F.left(p["a"], F.lit(1)).alias("after"),
            )

        return F.transform(parts, span)

    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern).alias("gaps"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string,found:string,before:string,after:string>>")
    return F.when(text.rlike(pattern), let(cut, spans)).otherwise(none)


def strict_spans(text: Column, context: int) -> Column:
    """The valid matches of the strict patterns, kind by kind."""
    valid = lambda kind: lambda span: _valid(kind, span["found"])
    return F.concat(*(F.filter(matches(text, k, STRICT[k], context), valid(k)) for k in KINDS))


def loose_spans(text: Column, context: int) -> Column:
    return F.concat(*(matches(text, k, LOOSE[k], context) for k in KINDS))


def features(span: Column) -> dict[str, Column]:
    """Numbers that describe a span's format and surroundings.

    Signs that only tell whether a strict pattern matched (the plus of a phone number, the at sign) are no
    features: the trees are to know unmarked and veiled forms by everything else.
    """
    found, digits = span["found"], _digits(span["found"])
    count = lambda pattern: F.regexp_count(found, F.lit(pattern))
    last = F.right(span["before"], F.lit(1))
    of_kind = lambda values, default: reduce(lambda rest, k: F.when(span["kind"] == k, values[k]).otherwise(rest), KINDS, default)
    groups = F.regexp_extract_all(found, F.lit("[0-9]+"), F.lit(0))
    values = {
        "kind": of_kind({k: F.lit(i) for i, k in enumerate(KINDS)}, F.lit(-1)),
        "digits": F.length(digits),
        "letters": count(r"\p{L}"),
        "spaces": count(r"\x20"),
        "dashes": count("-"),
        "dots": count(r"\."),
        "parens": count(r"[()\[\]]"),
        "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
        "luhn": F.when(F.length(digits) >= 12, luhn(digits)).otherwise(False),
        "octets": F.when(span["kind"] == "ip", octets(F.array_join(groups, "."))).otherwise(False),
        "before_letter": last.rlike(r"\p{L}"),
        "before_digit": last.rlike("[0-9]"),
        "before_mark": last.rlike(r"[^\p{L}0-9\x20\x09-\x0D]"),
        "after_letter": span["after"].rlike(r"\p{L}"),
        "after_digit": span["after"].rlike("[0-9]"),
        "after_mark": span["after"].rlike(r"[^\p{L}0-9\x20\x09-\x0D]"),
        "word": of_kind({k: F.lower(span["before"]).rlike(CONTEXT[k]) for k in KINDS}, F.lit(False)),
    }
    return {name: F.coalesce(values[name].cast("double"), F.lit(0.0)) for name in FEATURES}


def _struct(values: dict[str, Column]) -> Column:
    return F.struct(*(value.alias(name) for name, value in values.items()))


def name_of(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], span["start"].cast("string"), span["end"].cast("string"))


@dataclass(frozen=True)
class Trees:
    """Boosted trees as nested tuples (feature, threshold, left, right) or values, and thresholds per kind."""

    trees: tuple
    weights: tuple[float, ...]
    thresholds: dict[str, float]

    def score(self, x: Column) -> Column:
        """The probability that a span with these features is personal data."""

        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            return F.when(x[FEATURES[node[0]]] <= node[1], walk(node[2])).otherwise(walk(node[3]))

        margin = sum((walk(t) * w for t, w in zip(self.trees, self.weights)), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    def select(self, spans: Column) -> Column:
        """The spans whose score reaches the threshold of their kind."""
        described = F.transform(spans, lambda s: F.struct(s.alias("span"), _struct(features(s)).alias("x")))
        least = lambda kind: reduce(
            lambda rest, kv: F.when(kind == kv[0], F.lit(kv[1])).otherwise(rest), self.thresholds.items(), F.lit(2.0)
        )
        chosen = F.filter(described, lambda d: self.score(d["x"]) >= least(d["span"]["kind"]))
        return F.transform(chosen, lambda d: d["span"])


def _tuple(node):
    """A trained tree's node as a nested tuple."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _tuple(node.leftChild()), _tuple(node.rightChild())


def training_rows(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """Candidates of the documents: features, ``label``, ``held`` for calibration."""
    draw = F.xxhash64(F.lit(s.seed), id_col, text_col)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), draw.alias("draw"))
    strict = strict_spans(F.col("text"), s.context)
    spans = texts.select("draw", "text", loose_spans(F.col("text"), s.context).alias("loose"), strict.alias("strict")).drop("text")
    # Written first, the spans are found once per document and not again for each use.
    spans = settle(spans, "spans")
    many = {} if s.sample_values is None else spans.agg(*(F.sum(F.size(c)).alias(c) for c in ("strict", "loose"))).first().asDict()
    for name in ("strict", "loose"):
        if (many.get(name) or 0) > (s.sample_values or 0):
            share = F.lit(s.sample_values / many[name] * 2.0**64 - 2.0**63)
            drawn_span = lambda x: F.xxhash64(F.lit(s.seed), F.col("draw"), x["kind"], x["start"]) < share  # noqa: B023, E731
            spans = spans.withColumn(f"drawn_{name}", F.filter(name, drawn_span))
        else:
            spans = spans.withColumn(f"drawn_{name}", F.col(name))
    own = spans.select("draw", F.explode(F.concat(
        F.transform("drawn_strict", lambda x: F.struct(x.alias("span"), F.lit(1.0).alias("label"))),
        F.transform(apart(F.col("drawn_loose"), F.col("strict")), lambda x: F.struct(x.alias("span"), F.lit(0.0).alias("label"))),
    )).alias("c"))
    # Each form of a value is put where the value stood and its candidates are found there.
    forms = spans.select("draw", F.explode("drawn_strict").alias("of")).select("draw", "of", F.explode(respelt(F.col("of"))).alias("form"))
    forms = forms.select(
        "draw", "form", F.col("of.kind").alias("of"), F.concat("of.before", "form.text", "of.after").alias("text"),
        F.char_length("of.before").cast("long").alias("start"),
    )
    forms = forms.withColumn("end", F.col("start") + F.char_length("form.text"))
    touched = F.filter(loose_spans(F.col("text"), s.context), lambda x: (x["start"] < F.col("end")) & (F.col("start") < x["end"]))
    whole = lambda x: (x["kind"] == F.col("of")) & (x["start"] == F.col("start")) & (x["end"] == F.col("end"))
    forms = forms.select("draw", F.explode(
        F.transform(touched, lambda x: F.struct(x.alias("span"), F.when(whole(x), F.col("form.label")).otherwise(0.0).alias("label")))
    ).alias("c"))
    rows = settle(own.unionByName(forms), "labelled").select("draw", "c.span", "c.label")
    held = F.xxhash64("draw").bitwiseAND(1) == 0
    return rows.select(F.col("span.kind").alias("kind_name"), held.alias("held"), "label", _struct(features(F.col("span"))).alias("x"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> Trees | None:
    """Trees for the documents' candidates; None when there is nothing to tell apart."""
    s = settings
    counted = training_rows(docs, id_col, text_col, s).groupBy("kind_name", "held", "label", "x").agg(F.count("*").cast("double").alias("weight"))
    rows = settle(counted, "candidates")
    seen = {(r["held"], r["label"]) for r in rows.select("held", "label").distinct().collect()}
    if not {(False, 0.0), (False, 1.0)} <= seen:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    data = vectors.transform(rows.select("kind_name", "held", "label", "weight", "x.*"))
    learner = GBTClassifier(
        maxIter=s.trees, maxDepth=s.depth, maxBins=s.bins, stepSize=0.3, seed=s.seed, checkpointInterval=-1, weightCol="weight"
    )
    model = learner.fit(data.where(~F.col("held")))
    scored = model.transform(data.where("held")).select("kind_name", "label", "weight", vector_to_array("probability")[1].alias("score"))
    grid = [0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.925, 0.95, 0.975]
    per_kind = scored.groupBy("kind_name").agg(
        *(F.sum(F.when(F.col("score") >= g, F.col("label") * F.col("weight"))).alias(f"right_{i}") for i, g in enumerate(grid)),
        *(F.sum(F.when(F.col("score") >= g, F.col("weight"))).alias(f"all_{i}") for i, g in enumerate(grid)),
    )
    thresholds = {}
    for r in per_kind.collect():  # at most one row per kind
        good = [g for i, g in enumerate(grid) if r[f"all_{i}"] and (r[f"right_{i}"] or 0) >= s.precision * r[f"all_{i}"]]
        if good:
            thresholds[r["kind_name"]] = good[0]
    trees = tuple(_tuple(t._java_obj.rootNode()) for t in model.trees)
    return Trees(trees, tuple(model.treeWeights), thresholds)


def personal_data(docs: DataFrame, trees: Trees | None, text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Every row as ``row`` with ``base`` and ``added`` spans, each of ``start``, ``end``, ``kind`` and its texts."""
    s = settings
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    rows = docs.select(F.struct("*").alias("row")).withColumn("base", strict_spans(text, s.context))
    if trees is None:
        return rows.withColumn("added", F.slice("base", 1, 0))
    rows = rows.withColumn("_chosen", trees.select(loose_spans(text, s.context)))
    added = F.when(F.size("_chosen") == 0, F.slice("base", 1, 0)).otherwise(apart(F.col("_chosen"), F.col("base")))
    return rows.withColumn("added", added).drop("_chosen")


def joined_names(spans: Column) -> Column:
    """Spans as ``kind:start:end`` in order of start, then kind."""
    number = lambda x: reduce(lambda rest, k: F.when(x["kind"] == k, KINDS.index(k)).otherwise(rest), KINDS, F.lit(-1))
    keyed = F.transform(spans, lambda x: F.struct(x["start"], number(x), x["end"], name_of(x).alias("name")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["name"]), ",")


@query()
def op8_pii(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data(docs, train(docs))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "row.doc_id",
        *(count(k) for k in KINDS),
        F.sha2(joined_names(F.col("base")), 256).alias("base_sha256"),
        joined_names(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
