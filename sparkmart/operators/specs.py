"""All specs of a registry at once: verdicts on their join graphs and names, and decisions written into them.

Specs stay rows. Their nested arrays are read and rewritten by column expressions, so nothing passes through the driver, and no row
meets another but for the join with the decisions, which come grouped by spec.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmart.functions.types import row_type

_TEXT, _FLAG, _LONG = T.StringType(), T.BooleanType(), T.LongType()
_TEXTS = T.MapType(_TEXT, _TEXT)

# The whole of a spec as it is written, both forms of join rules included.
_MAPPING = row_type(
    type_map=_TEXT,
    mapping=_TEXTS,
    alias_new_column_transform=_TEXT,
    type_field=_TEXT,
    mapping_json=T.ArrayType(row_type(mapping=_TEXTS, type_field=_TEXT)),
)
_COLUMN = row_type(
    name=_TEXT, alias=_TEXT, is_update_key=_FLAG, type=_TEXT, data_type=_TEXT, udt_schema=_TEXT, udt_name=_TEXT,
    char_max_len=_LONG, num_precision=_LONG, num_scale=_LONG, is_deleted=_FLAG, is_nullable=_FLAG, is_primary_key=_FLAG,
    view_key=_TEXT, is_fk=_FLAG, default=_TEXT, is_unq=_FLAG,
    transform=row_type(type=_TEXT, mode=_TEXT, output_column=_TEXT, mapping=_MAPPING),
    reference=_TEXTS,
)
_END = row_type(source=_TEXT, schema=_TEXT, table=_TEXT, column=_TEXT)
_RULE = row_type(
    left=_END, right=_END, main_table=_TEXT, source=_TEXT, schema=_TEXT, table=_TEXT, column_first=_TEXT, column_second=_TEXT
)
_TABLE = row_type(name=_TEXT, columns=T.ArrayType(_COLUMN))
_SCHEMA = row_type(name=_TEXT, tables=T.ArrayType(_TABLE))
SPEC = row_type(
    view_name=_TEXT,
    sources=T.ArrayType(row_type(name=_TEXT, schemas=T.ArrayType(_SCHEMA))),
    joins=T.ArrayType(row_type(inner=_RULE)),
)

DECISIONS = row_type(view_id=_LONG, db=_TEXT, schema=_TEXT, table=_TEXT, decision=_TEXT, old=_TEXT, new=_TEXT)

OK, NO_TABLE, NO_TREE, NO_RULE = "ok", "no table", "not one tree", "several tables without a rule"
UNKNOWN_TABLE, EQUAL_NAMES = "unknown table in a rule", "equal column names in a table"
RENAME, DELETE, DROP = "rename", "delete", "drop"


def _each(array: Column, make) -> Column:
    """``make`` of every element, none of a missing array."""
    return F.coalesce(F.transform(array, make), F.array())


def _tables(v: Column) -> Column:
    """The selected tables in order, with their place and columns."""
    place = lambda s, c, t: F.struct(
        s["name"].alias("source"), c["name"].alias("schema"), t["name"].alias("table"), t["columns"].alias("columns")
    )
    per_source = F.transform(
        v["sources"], lambda s: F.flatten(F.transform(F.coalesce(s["schemas"], F.array()), lambda c: _each(c["tables"], lambda t: place(s, c, t))))
    )
    return F.coalesce(F.flatten(per_source), F.array())


def _key(x: Column) -> Column:
    return F.struct(*(x[c].alias(c) for c in ("source", "schema", "table")))


def _ends(rule: Column, tables: Column) -> Column:
    """The left and right table of a rule; the older form names its main table, by default the first one."""
    named = F.filter(tables, lambda t: t["table"] == rule["main_table"])
    main = F.get(F.when(F.coalesce(rule["main_table"], F.lit("")) != "", named).otherwise(tables), F.lit(0))
    new = F.array(_key(rule["left"]), _key(rule["right"]))
    return F.when(rule["left"].isNotNull(), new).otherwise(F.array(_key(main), _key(rule)))


def _parts(rules: Column, joined: Column) -> Column:
    """How many parts the rules leave their tables in: every rule gives the right table's part the number of the left one's."""
    at = lambda table: (F.array_position(joined, table) - 1).cast("int")
    ends = F.transform(rules, lambda r: F.struct(at(F.get(r, 0)).alias("left"), at(F.get(r, 1)).alias("right")))

    def step(parts: Column, r: Column) -> Column:
        return F.transform(parts, lambda p: F.when(p == F.get(parts, r["right"]), F.get(parts, r["left"])).otherwise(p))

    return F.size(F.array_distinct(F.aggregate(ends, F.transform(joined, lambda _, i: i), step)))


def verdicts(registry: DataFrame, strict: bool = False) -> DataFrame:
    """``(id, name, verdict, n_tables, n_joined, left_out)`` of every spec, what ``plan_joins`` says of it.

    Rules form one tree if they connect all their tables and are one less than these. ``left_out`` are tables that no
    rule joins; ``strict`` refuses several tables without any rule. Names count as in the mart, by alias.
    """
    specs = registry.select("id", F.from_json("schema_view", SPEC).alias("v"))
    specs = specs.select("id", F.lower(F.coalesce("v.view_name", F.lit(""))).alias("name"), _tables(F.col("v")).alias("tables"), "v.joins")
    rules = F.filter(F.coalesce("joins", F.array()), lambda j: j["inner"].isNotNull())
    specs = specs.withColumn("rules", F.transform(rules, lambda j: _ends(j["inner"], F.col("tables"))))
    specs = specs.withColumn("keys", F.transform("tables", _key)).withColumn("joined", F.array_distinct(F.flatten("rules")))
    unknown = F.exists("joined", lambda k: ~F.array_contains(F.col("keys"), k) | k["table"].isNull())
    tree = (F.size("rules") == F.size("joined") - 1) & (_parts(F.col("rules"), F.col("joined")) == 1)
    targets = lambda t: _each(t["columns"], lambda c: F.coalesce(F.nullif(c["alias"], F.lit("")), c["name"]))
    again = F.exists("tables", lambda t: F.size(F.array_distinct(targets(t))) < F.size(targets(t)))
    none = F.size("rules") == 0
    verdict = (
        F.when(F.size("tables") == 0, NO_TABLE)
        .when(unknown, UNKNOWN_TABLE)
        .when(none & F.lit(strict) & (F.size("tables") > 1), NO_RULE)
        .when(~none & ~tree, NO_TREE)
        .when(again, EQUAL_NAMES)
        .otherwise(OK)
    )
    # Without rules the first table alone is the mart.
    joined = F.when(none, F.slice("keys", 1, 1)).otherwise(F.col("joined"))
    out = F.array_except(F.col("keys"), joined)
    return specs.select(
        "id",
        "name",
        verdict.alias("verdict"),
        F.size("tables").alias("n_tables"),
        F.size(joined).alias("n_joined"),
        F.transform(out, lambda k: F.concat_ws(".", k["source"], k["schema"], k["table"])).alias("left_out"),
    )


def _renamed(columns: Column, decisions: Column) -> Column:
    """Columns after renames, one after the other: each points the first column of its old name at the new one."""

    def one(cols: Column, d: Column) -> Column:
        place = F.array_position(F.transform(cols, lambda c: F.lower(c["name"])), F.lower(d["old"])) - 1
        return F.transform(cols, lambda c, i: F.when(i == place, c.withField("name", d["new"])).otherwise(c))

    return F.aggregate(F.filter(decisions, lambda d: d["decision"] == RENAME), columns, one)


def _kept(columns: Column, decisions: Column) -> Column:
    """Columns without those deleted or dropped, whatever their case."""
    gone = F.transform(F.filter(decisions, lambda d: d["decision"].isin(DELETE, DROP)), lambda d: F.lower(d["old"]))
    return F.filter(columns, lambda c: ~F.array_contains(gone, F.lower(c["name"])))


def resolved(registry: DataFrame, decisions: DataFrame) -> DataFrame:
    """``(id, schema_view, problem)``: every spec with its decisions written into it.

    ``decisions`` has ``view_id``, ``db``, ``schema``, ``table``, ``decision``, ``old``, ``new`` and ``seq``, their order within
    a spec. Renames come first, then deleted and dropped columns leave the spec; a rename finds its table whatever the case, the others by its exact
    name. A spec with a rename of a table or column it lacks stays as it is and has its first such column as ``problem``; so
    does one whose text is no spec.
    """
    wanted = F.struct("seq", "db", "schema", "table", "decision", "old", "new")
    grouped = decisions.groupBy(F.col("view_id").alias("_view")).agg(F.sort_array(F.collect_list(wanted)).alias("d"))
    rows = registry.join(grouped, F.col("id") == F.col("_view"), "left")
    rows = rows.select("id", "schema_view", F.from_json("schema_view", SPEC).alias("v"), F.coalesce("d", F.array().cast(grouped.schema["d"].dataType)).alias("d"))
    lowered = lambda x, y: F.lower(x) == F.lower(y)

    def in_table(s: Column, c: Column, t: Column) -> Column:
        loose = F.filter("d", lambda d: lowered(d["db"], s["name"]) & lowered(d["schema"], c["name"]) & lowered(d["table"], t["name"]))
        exact = F.filter("d", lambda d: (d["db"] == s["name"]) & (d["schema"] == c["name"]) & (d["table"] == t["name"]))
        return t.withField("columns", _kept(_renamed(t["columns"], loose), exact))

    per_schema = lambda s: lambda c: c.withField("tables", F.transform(c["tables"], lambda t: in_table(s, c, t)))
    sources = F.transform("v.sources", lambda s: s.withField("schemas", F.transform(s["schemas"], per_schema(s))))
    written = F.to_json(F.col("v").withField("sources", sources))
    tables = _tables(F.col("v"))

    def missing(d: Column) -> Column:
        """A rename whose old name neither the spec nor an earlier rename of the table brings."""
        here = F.filter(tables, lambda t: lowered(t["source"], d["db"]) & lowered(t["schema"], d["schema"]) & lowered(t["table"], d["table"]))
        names = F.flatten(F.transform(here, lambda t: _each(t["columns"], lambda c: F.lower(c["name"]))))
        same = lambda e: lowered(e["db"], d["db"]) & lowered(e["schema"], d["schema"]) & lowered(e["table"], d["table"])
        earlier = lambda e: (e["decision"] == RENAME) & (e["seq"] < d["seq"]) & same(e)
        made = F.transform(F.filter("d", earlier), lambda e: F.struct(F.lower(e["old"]).alias("old"), F.lower(e["new"]).alias("new")))
        now = F.aggregate(made, names, lambda n, e: F.transform(n, lambda x, i: F.when(i == F.array_position(n, e["old"]) - 1, e["new"]).otherwise(x)))
        return (d["decision"] == RENAME) & ~F.array_contains(now, F.lower(d["old"]))

    problem = F.when(F.col("v.sources").isNull() & (F.size("d") > 0), F.lit("not a spec")).otherwise(
        F.get(F.transform(F.filter("d", missing), lambda d: d["old"]), F.lit(0))
    )
    rows = rows.withColumn("problem", problem)
    untouched = F.col("problem").isNotNull() | (F.size("d") == 0)
    return rows.select("id", F.when(untouched, F.col("schema_view")).otherwise(written).alias("schema_view"), "problem")
