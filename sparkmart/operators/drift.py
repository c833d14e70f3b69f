"""Schema drift: compare source, spec and mart columns, and score likely renames.

Catalogs are DataFrames: source columns ``(db, schema, table, column, type)``, spec columns
``(view_id, db, schema, table, column, target, type)`` and mart columns ``(view_id, column)``. Names compare
in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmart.functions.similarity import jaro_winkler, normal_name, normal_type
from sparkmart.functions.types import MART_TYPES, row_type
from sparkmart.session import settle

# Fixed values of the rename score.
MIN_SCORE = 0.45
TYPE_BONUS = 0.1

SCHEMA_ONLY = "schema_only"
MISSING_IN_MART = "missing_in_dwh"
MART_ONLY = "dwh_only"
RENAME = "rename_candidate"

GROUP = ["view_id", "db", "schema", "table"]
_OPEN, _RESOLVED = "open", "resolved"

_TEXT, _LONG, _TIME = T.StringType(), T.LongType(), T.TimestampType()
GROUPS = row_type(
    id=_LONG,
    schema_id=_LONG,
    database_name=_TEXT,
    schema_name=_TEXT,
    table_name=_TEXT,
    status=_TEXT,
    created_at=_TIME,
    resolved_at=_TIME,
)
ITEMS = row_type(
    id=_LONG,
    group_id=_LONG,
    old_column_name=_TEXT,
    new_column_name=_TEXT,
    score=T.DoubleType(),
    mismatch_type=_TEXT,
)


def common_type(c: Column) -> Column:
    """A source type name as the mart names it, so that ``int4`` and ``integer`` are equal."""
    names = F.create_map(*[F.lit(x) for kv in MART_TYPES.items() for x in kv])
    plain = normal_type(c)
    named = lambda base: F.coalesce(F.try_element_at(names, base), F.lit("text"))
    base, suffix = F.regexp_replace(plain, r"\(.*\)", ""), F.regexp_extract(plain, r"\(.*\)", 0)
    # Most types have no parentheses to look for.
    return F.when(c.isNotNull(), F.when(plain.contains("("), F.concat(named(base), suffix)).otherwise(named(plain)))


def _type_code(c: Column) -> Column:
    """A type as a number, NULL when unknown. Types are only compared, and numbers aggregate by hash."""
    return F.when(c.isNotNull(), F.xxhash64(common_type(c)))


def column_presence(
    source: DataFrame, spec: DataFrame, mart: DataFrame, alias_aware: bool = True
) -> DataFrame:
    """One row per (view, table, column name) telling where the name occurs, with a code for its type.

    The catalogs are tagged, unioned and grouped once, which needs one shuffle where pairwise
    differences would need one each. With ``alias_aware`` a spec column is known by its source name to the
    source and by its target to the mart; without it the target is used for both.
    """
    scope = spec.select(*GROUP).distinct()
    in_mart = mart.select("view_id", F.lower("column").alias("target"), F.lit(True).alias("in_mart")).distinct()
    from_source = source.join(scope, GROUP[1:]).select(
        *GROUP,
        F.lower("column").alias("name"),
        _type_code(F.col("type")).alias("source_type"),
        F.lit(True).alias("in_source"),
    )
    # A spec column speaks for its own name and for its target's name, in one row if they are equal.
    unknown = F.lit(None).cast("bigint")
    name = F.lower("column" if alias_aware else "target")
    same = name.eqNullSafe(F.col("target"))
    as_column = F.struct(
        name.alias("name"),
        _type_code(F.col("type")).alias("spec_type"),
        F.lit(True).alias("in_spec"),
        F.coalesce("in_mart", F.lit(False)).alias("in_mart"),
        same.alias("is_target"),
    )
    as_target = F.struct(
        F.col("target").alias("name"),
        unknown.alias("spec_type"),
        F.lit(False).alias("in_spec"),
        F.lit(False).alias("in_mart"),
        F.lit(True).alias("is_target"),
    )
    from_spec = (
        spec.withColumn("target", F.lower("target"))
        .join(in_mart, ["view_id", "target"], "left")
        .select(*GROUP, F.inline(F.when(same, F.array(as_column)).otherwise(F.array(as_column, as_target))))
    )
    both = from_source.unionByName(from_spec, allowMissingColumns=True)
    flags = ["in_source", "in_spec", "in_mart", "is_target"]
    return both.groupBy(*GROUP, "name").agg(
        *(F.coalesce(F.max(f), F.lit(False)).alias(f) for f in flags),
        F.max("source_type").alias("source_type"),
        # A spec column without a type takes the one of its source column.
        F.coalesce(F.max("spec_type"), F.max("source_type")).alias("type"),
    )


def rename_candidates(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Score every old name against every new name of the same group.

    ``old`` and ``new`` are ``(*keys, name, type)``. Pairs need equal types, or one unknown type; equal
    types add a bonus, so a score may exceed 1. All pairs at or above the threshold are kept. A group
    is one table, whose width the source limits (about 1600 columns), so its pairs are bounded too.
    """

    def typed(side: DataFrame) -> Column:
        kind = F.col("type")
        return F.nullif(normal_type(kind), F.lit("")) if dict(side.dtypes)["type"] == "string" else kind

    a = old.select(*keys, F.col("name").alias("old"), typed(old).alias("old_type"))
    b = new.select(*keys, F.col("name").alias("new"), typed(new).alias("new_type"))
    known_a, known_b = F.col("old_type").isNotNull(), F.col("new_type").isNotNull()
    equal = known_a & known_b & (F.col("old_type") == F.col("new_type"))
    pairs = a.join(b, keys).where(equal | (known_a != known_b))
    score = jaro_winkler(normal_name(F.col("old")), normal_name(F.col("new")))
    bonus = F.when(equal, F.lit(TYPE_BONUS)).otherwise(F.lit(0.0))
    scored = pairs.withColumn("score", score + bonus).where(F.col("score") >= MIN_SCORE)
    return scored.select(*keys, "old", "new", "score")


def drift_report(
    source: DataFrame,
    spec: DataFrame,
    mart: DataFrame,
    extra: DataFrame | None = None,
    alias_aware: bool = True,
    source_types: bool = True,
    renames: bool = True,
    scratch: str | None = None,
) -> DataFrame:
    """All findings as ``(view_id, db, schema, table, type, old, new, score)``.

    ``extra`` lists further mart columns a spec creates, which are therefore not mart-only. With
    ``source_types=False`` only spec types take part in the rename score.
    """
    seen = column_presence(source, spec, mart, alias_aware)
    # Names that all catalogs have, and targets that no catalog has as a name, are no finding.
    seen = settle(seen.where("if(in_spec, not (in_source and in_mart), in_source and not is_target)"), "columns", scratch)
    none, no_score = F.lit(None).cast("string"), F.lit(None).cast("double")
    kind = F.when(F.col("in_spec") & ~F.col("in_source"), SCHEMA_ONLY).when(
        F.col("in_spec") & F.col("in_source") & ~F.col("in_mart"), MISSING_IN_MART
    )
    basic = (
        seen.withColumn("type", kind)
        .where(F.col("type").isNotNull())
        .select(
            *GROUP,
            "type",
            F.when(F.col("type") == SCHEMA_ONLY, F.col("name")).alias("old"),
            F.when(F.col("type") == MISSING_IN_MART, F.col("name")).alias("new"),
            no_score.alias("score"),
        )
    )

    # Mart columns that no target explains, found by one grouping instead of a difference.
    targets = spec.select("view_id", F.lower("target").alias("column"), F.lit(False).alias("stray"))
    if extra is not None:
        targets = targets.union(extra.select("view_id", F.lower("target"), F.lit(False)))
    present = mart.select("view_id", F.lower("column").alias("column"), F.lit(True).alias("stray"))
    stray = present.union(targets).groupBy("view_id", "column").agg(F.min("stray").alias("stray")).where("stray")
    scope = spec.select(*GROUP).distinct()
    mart_only = stray.join(scope, "view_id").select(
        *GROUP, F.lit(MART_ONLY).alias("type"), F.col("column").alias("old"), none.alias("new"), no_score.alias("score")
    )
    report = basic.unionByName(mart_only)
    if not renames:
        return report

    # Without source types every spec column counts as typed, text by default.
    old_type = F.col("type") if source_types else F.coalesce("type", _type_code(F.lit("text")))
    old = seen.where("in_spec and in_mart and not in_source").select(*GROUP, "name", old_type.alias("type"))
    new_type = F.col("source_type") if source_types else F.lit(None).cast("bigint")
    new = seen.where("in_source and not in_spec and not is_target").select(*GROUP, "name", new_type.alias("type"))
    likely = rename_candidates(old, new, GROUP)
    return report.unionByName(likely.withColumn("type", F.lit(RENAME)))


def observed_report(
    seen: DataFrame, spec: DataFrame, mart: DataFrame, extra: DataFrame | None = None, scratch: str | None = None
) -> DataFrame:
    """The findings that columns seen in events can show.

    Row images are partial, so a column that was not seen may well exist: spec columns count as part of the source,
    and nothing is taken for gone or renamed. Only a catalog of the source can tell that.
    """
    known = spec.select("db", "schema", "table", "column", "type")
    source = seen.select("db", "schema", "table", "column", F.lit(None).cast("string").alias("type")).union(known)
    return drift_report(source, spec, mart, extra, renames=False, scratch=scratch)


def content_id(*columns) -> Column:
    """A positive id derived from content, so that replaying a batch gives the same id."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def upsert_groups(
    report: DataFrame, groups: DataFrame, items: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Record findings: open a group where none is open, else replace the open group's items.

    Returns the new ``(groups, items)``. Groups without findings stay as they are. The id of a new group follows
    from its table and the number of groups it had before, so recording a report again gives the same ids.
    """
    found = report.select(
        F.col("view_id").alias("schema_id"),
        F.col("db").alias("database_name"),
        F.col("schema").alias("schema_name"),
        F.col("table").alias("table_name"),
        "type",
        "old",
        "new",
        "score",
    )
    key = ["schema_id", "database_name", "schema_name", "table_name"]
    # A table's groups are counted and its open ones kept in one grouping, so the findings meet them in one join.
    opened = F.collect_list(F.when(F.col("status") == _OPEN, F.struct("id")))
    known = groups.groupBy(*key).agg(F.count("*").alias("before"), opened.alias("opened"))
    checked = found.select(*key).distinct().join(known, key, "left")
    checked = checked.select(*key, "before", F.explode_outer("opened").alias("one")).withColumn("open_id", F.col("one.id"))
    fresh_id = content_id(*key, F.coalesce("before", F.lit(0)))
    current = checked.select(
        *key, F.coalesce("open_id", fresh_id).alias("id"), F.col("open_id").isNull().alias("fresh")
    )
    created = current.where("fresh").select(
        "id",
        *key,
        F.lit(_OPEN).alias("status"),
        now.cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )
    with_group = found.join(current.select(*key, F.col("id").alias("group_id")), key)
    new_items = with_group.select(
        content_id("group_id", "type", "old", "new").alias("id"),
        "group_id",
        F.col("old").alias("old_column_name"),
        F.col("new").alias("new_column_name"),
        "score",
        F.col("type").alias("mismatch_type"),
    )
    kept = items.join(current.select(F.col("id").alias("group_id")), "group_id", "left_anti")
    return groups.unionByName(created), kept.select(*items.columns).unionByName(new_items)


def resolve_group(groups: DataFrame, group_id: int, now: Column) -> DataFrame:
    """Close a group."""
    hit = F.col("id") == F.lit(group_id)
    return groups.withColumn("status", F.when(hit, F.lit(_RESOLVED)).otherwise(F.col("status"))).withColumn(
        "resolved_at", F.when(hit, now.cast("timestamp")).otherwise(F.col("resolved_at"))
    )


def groups_with_items(groups: DataFrame, items: DataFrame) -> DataFrame:
    """Groups with their items as a sorted array; a group's items are columns of one table."""
    nested = items.groupBy(F.col("group_id").alias("id")).agg(
        F.array_sort(
            F.collect_list(F.struct("mismatch_type", "old_column_name", "new_column_name", "score"))
        ).alias("items")
    )
    return groups.join(nested, "id", "left")
