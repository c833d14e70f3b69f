"""Schema-drift queries over column catalogs derived from the order lines.

Every order is one mart over a table of its own. Each of its lines names a column (part name and size) and
says by its flags whether the source, the spec and the mart have it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmart.operators import drift, specs
from sparkmart.operators.evolve import SUGGESTIONS, Resolution, new_suggestions, plan_resolution, project_change
from sparkmart.operators.paging import match_all, ordered_page
from sparkmart.operators.registry import REGISTRY, spec_columns
from sparkmart.operators.routing import data_events, observed_columns
from sparkmart.plans.mart import mart_frame
from sparkmart.queries.base import catalog, query, read, table_key
from sparkmart.queries.marts import CUSTOMER_ORDERS
from sparkmart.session import local_frame, settle

_LINES_SQL = """
WITH lines AS (
  SELECT l_orderkey AS view_id, 'orders_' || l_orderkey AS tab, replace(p_name, ' ', '_') || '_' || p_size AS col,
         l_returnflag AS flag, l_linestatus AS status,
         CASE WHEN p_size < 20 THEN 'integer' WHEN p_size < 40 THEN 'text' END AS typ
  FROM lineitem JOIN part ON l_partkey = p_partkey),
src AS (SELECT view_id, tab, col, max(typ) AS typ FROM lines WHERE flag IN ('A', 'N') GROUP BY ALL),
spec AS (SELECT view_id, tab, col, max(typ) AS typ FROM lines WHERE flag IN ('N', 'R') GROUP BY ALL),
dwh AS (SELECT DISTINCT view_id, col FROM lines WHERE status = 'O'),
seen AS (
  SELECT coalesce(src.view_id, spec.view_id) AS view_id, coalesce(src.tab, spec.tab) AS tab,
         coalesce(src.col, spec.col) AS col, src.col IS NOT NULL AS in_src, spec.col IS NOT NULL AS in_spec,
         src.typ AS src_typ, coalesce(spec.typ, src.typ) AS typ,
         spec.col IS NOT NULL AND dwh.col IS NOT NULL AS in_dwh
  FROM src FULL JOIN spec ON src.view_id = spec.view_id AND src.col = spec.col
  LEFT JOIN dwh ON dwh.view_id = spec.view_id AND dwh.col = spec.col),
pairs AS (
  SELECT o.view_id, o.tab, o.col AS old, n.col AS new, coalesce(o.typ = n.src_typ, false) AS equal_types,
         replace(o.col, '_', ' ') AS a, replace(n.col, '_', ' ') AS b
  FROM seen o JOIN seen n ON o.view_id = n.view_id
  WHERE o.in_spec AND o.in_dwh AND NOT o.in_src AND n.in_src AND NOT n.in_spec
    AND ((o.typ IS NULL) <> (n.src_typ IS NULL) OR o.typ = n.src_typ)),
scored AS (
  SELECT *, jaro_similarity(a, b) AS j,
         CASE WHEN left(a, 4) = left(b, 4) THEN 4 WHEN left(a, 3) = left(b, 3) THEN 3
              WHEN left(a, 2) = left(b, 2) THEN 2 WHEN left(a, 1) = left(b, 1) THEN 1 ELSE 0 END AS prefix
  FROM pairs),
renames AS (
  SELECT view_id, tab, old, new, j + 0.1 * prefix * (1 - j) + CASE WHEN equal_types THEN 0.1 ELSE 0 END AS score
  FROM scored WHERE j + 0.1 * prefix * (1 - j) + CASE WHEN equal_types THEN 0.1 ELSE 0 END >= 0.45),
report AS (
  SELECT view_id, tab, 'schema_only' AS type, col AS old, NULL AS new, NULL::DOUBLE AS score
  FROM seen WHERE in_spec AND NOT in_src
  UNION ALL SELECT view_id, tab, 'missing_in_dwh', NULL, col, NULL FROM seen WHERE in_spec AND in_src AND NOT in_dwh
  UNION ALL SELECT view_id, tab, 'dwh_only', dwh.col, NULL, NULL FROM dwh
            JOIN (SELECT DISTINCT view_id, tab FROM spec) USING (view_id)
            WHERE (view_id, dwh.col) NOT IN (SELECT (view_id, col) FROM spec)
  UNION ALL SELECT view_id, tab, 'rename_candidate', old, new, round(score, 9) FROM renames)
"""


def line_catalogs(spark, sf_dir):
    """Source, spec and mart column catalogs."""
    # Types in the order of their names; numbers aggregate by hash.
    kind = F.when(F.col("p_size") < 20, 0).when(F.col("p_size") < 40, 1)
    type_name = lambda c: F.when(F.col(c) == 0, "int4").when(F.col(c) == 1, "text").alias(c)
    lines = (
        read(spark, sf_dir, "lineitem")
        .join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("view_id"),
            F.concat(F.translate("p_name", " ", "_"), F.lit("_"), "p_size").alias("column"),
            kind.alias("type"),
            "l_returnflag",
            "l_linestatus",
        )
    )
    # One pass over the lines: every name of a mart with the highest type and the catalogs that have it.
    names = ["view_id", "db", "schema", "table", "column"]
    kinds = {"source": F.col("l_returnflag").isin("A", "N"), "spec": F.col("l_returnflag").isin("N", "R")}
    seen = lines.groupBy("view_id", "column").agg(
        *(F.max(F.when(c, F.col("type"))).alias(f"{k}_type") for k, c in kinds.items()),
        *(F.bool_or(c).alias(f"in_{k}") for k, c in kinds.items()),
        F.bool_or(F.col("l_linestatus") == "O").alias("in_mart"),
    )
    # The mart's number names its table, so the table need not be shuffled or written.
    table = [F.lit("shop").alias("db"), F.lit("public").alias("schema"), F.concat(F.lit("orders_"), "view_id").alias("table")]
    flags = [f"in_{k}" for k in (*kinds, "mart")]
    seen = settle(seen, "lines").select("view_id", *table, "column", *(type_name(f"{k}_type") for k in kinds), *flags)
    source = seen.where("in_source").select("db", "schema", "table", "column", F.col("source_type").alias("type"))
    spec = seen.where("in_spec").select(*names, F.col("spec_type").alias("type"), F.col("column").alias("target"))
    return source, spec, seen.where("in_mart").select("view_id", "column")


@query(_LINES_SQL + """
SELECT view_id, 'shop' AS db, 'public' AS "schema", tab AS "table", type, old, new, score FROM report
""")
def drift_report(spark, sf_dir):
    report = drift.drift_report(*line_catalogs(spark, sf_dir))
    return report.withColumn("score", F.round("score", 9))


@query("""
WITH lines AS MATERIALIZED (
  SELECT l_orderkey AS view_id, replace(p_name, ' ', '_') || '_' || p_size AS col,
         bool_or(l_returnflag IN ('A', 'N')) AS in_src, bool_or(l_returnflag IN ('N', 'R')) AS in_spec, bool_or(l_linestatus = 'O') AS in_dwh,
         max(CASE WHEN p_size < 20 THEN 'integer' WHEN p_size < 40 THEN 'text' END) AS typ
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
pairs AS (
  SELECT o.view_id, o.col AS old, n.col AS new, CASE WHEN o.typ = n.typ THEN 0.1 ELSE 0 END AS bonus,
         replace(o.col, '_', ' ') AS a, replace(n.col, '_', ' ') AS b
  FROM lines AS o JOIN lines AS n ON o.view_id = n.view_id
  WHERE o.in_spec AND o.in_dwh AND NOT o.in_src AND n.in_src AND NOT n.in_spec
    AND ((o.typ IS NULL) <> (n.typ IS NULL) OR o.typ = n.typ)),
scored AS (
  SELECT *, jaro_similarity(a, b) AS j,
         CASE WHEN left(a, 4) = left(b, 4) THEN 4 WHEN left(a, 3) = left(b, 3) THEN 3
              WHEN left(a, 2) = left(b, 2) THEN 2 WHEN left(a, 1) = left(b, 1) THEN 1 ELSE 0 END AS prefix
  FROM pairs)
SELECT view_id, 'orders_' || view_id AS "table", old, new, round(j + 0.1 * prefix * (1 - j) + bonus, 9) AS score
FROM scored WHERE j + 0.1 * prefix * (1 - j) + bonus >= 0.45
""")
def rename_candidates(spark, sf_dir):
    report = drift.drift_report(*line_catalogs(spark, sf_dir))
    likely = report.where(F.col("type") == drift.RENAME)
    return likely.select("view_id", "table", "old", "new", F.round("score", 9).alias("score"))


@query(_LINES_SQL + """
, pending AS (SELECT DISTINCT o_orderkey AS view_id FROM orders WHERE o_orderstatus = 'P')
SELECT view_id, old AS old_column_name, new AS new_column_name FROM renames
WHERE view_id NOT IN (SELECT view_id FROM pending) ORDER BY view_id, old, new LIMIT 50 OFFSET 10
""")
def suggestions_page(spark, sf_dir):
    report = settle(drift.drift_report(*line_catalogs(spark, sf_dir)), "report")
    orders = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    known = new_suggestions(report, local_frame(spark, [], SUGGESTIONS))
    pending = known.join(orders, F.col("view_id") == F.col("o_orderkey"), "left_semi")
    fresh = new_suggestions(report, pending)
    return ordered_page(
        fresh.select("view_id", "old_column_name", "new_column_name"),
        ["view_id", "old_column_name", "new_column_name"],
        offset=10,
        descending=False,
    )


def _open_groups(spark, sf_dir):
    """The groups that exist before the check, one per order: open or resolved, each with a stale item."""
    orders = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved")
    groups = orders.select(
        (-F.col("o_orderkey") - 1).alias("id"),
        F.col("o_orderkey").alias("schema_id"),
        F.lit("shop").alias("database_name"),
        F.lit("public").alias("schema_name"),
        F.concat(F.lit("orders_"), "o_orderkey").alias("table_name"),
        status.alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )
    items = groups.select(
        F.col("id"),
        F.col("id").alias("group_id"),
        F.lit("stale").alias("old_column_name"),
        F.lit(None).cast("string").alias("new_column_name"),
        F.lit(None).cast("double").alias("score"),
        F.lit(drift.SCHEMA_ONLY).alias("mismatch_type"),
    )
    return groups, items


_GROUPS_SQL = _LINES_SQL + """,
before AS (SELECT o_orderkey AS schema_id, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'resolved' END AS status
           FROM orders),
found AS (SELECT view_id AS schema_id, type AS mismatch_type, old AS old_column_name, new AS new_column_name, score
          FROM report),
stale AS (SELECT 'schema_only' AS mismatch_type, 'stale' AS old_column_name, CAST(NULL AS VARCHAR) AS new_column_name,
                 CAST(NULL AS DOUBLE) AS score),
after AS (
  SELECT schema_id, 'open' AS status, true AS old_group, found.* EXCLUDE (schema_id)
  FROM before JOIN found USING (schema_id) WHERE status = 'open'
  UNION ALL SELECT schema_id, 'open', false, found.* EXCLUDE (schema_id) FROM before JOIN found USING (schema_id)
            WHERE status = 'resolved'
  UNION ALL SELECT before.schema_id, status, true, stale.* FROM before CROSS JOIN stale
            WHERE status = 'resolved' OR before.schema_id NOT IN (SELECT schema_id FROM found))
"""


@query(_GROUPS_SQL + "SELECT * FROM after")
def mismatch_groups(spark, sf_dir):
    """Every group with each of its items."""
    report = settle(drift.drift_report(*line_catalogs(spark, sf_dir)), "report")
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    groups, items = drift.upsert_groups(report, *_open_groups(spark, sf_dir), now)
    old = (F.col("id") < 0).alias("old_group")
    shown = groups.select("schema_id", "status", old, F.col("id").alias("group_id"))
    what = ["mismatch_type", "old_column_name", "new_column_name"]
    return shown.join(items.drop("id"), "group_id").select(
        "schema_id", "status", "old_group", *what, F.round("score", 9).alias("score")
    )


@query(_GROUPS_SQL + """
SELECT schema_id, status, old_group, count(*) AS n_items, count(*) FILTER (mismatch_type = 'rename_candidate') AS n_renames,
       count(*) FILTER (mismatch_type = 'schema_only') AS n_schema_only, min(old_column_name) AS first_old
FROM after GROUP BY ALL
""")
def mismatch_groups_with_items(spark, sf_dir):
    """Every group as one row with its items nested."""
    report = settle(drift.drift_report(*line_catalogs(spark, sf_dir)), "report")
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    nested = drift.groups_with_items(*drift.upsert_groups(report, *_open_groups(spark, sf_dir), now)).where("items IS NOT NULL")
    of = lambda kind: F.size(F.filter("items", lambda x: x["mismatch_type"] == kind))
    return nested.select(
        "schema_id",
        "status",
        (F.col("id") < 0).alias("old_group"),
        F.size("items").alias("n_items"),
        of(drift.RENAME).alias("n_renames"),
        of(drift.SCHEMA_ONLY).alias("n_schema_only"),
        F.array_min(F.transform("items", lambda x: x["old_column_name"])).alias("first_old"),
    )


@query("""
SELECT o_orderkey AS schema_id, CASE WHEN o_orderkey = 7 THEN 'resolved'
       WHEN o_orderstatus = 'O' THEN 'open' ELSE 'resolved' END AS status
FROM orders
""")
def mismatch_resolved(spark, sf_dir):
    groups, _ = _open_groups(spark, sf_dir)
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    return drift.resolve_group(groups, -8, now).select("schema_id", "status")


@query("""
SELECT o_orderkey AS schema_id, 'orders_' || o_orderkey AS table_name FROM orders
WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, -o_orderkey - 1 DESC
LIMIT 10 OFFSET 5
""")
def mismatch_list(spark, sf_dir):
    groups, _ = _open_groups(spark, sf_dir)
    wanted = match_all(groups, {"status": "open", "database_name": "shop", "schema_name": "public", "schema_id": None})
    return ordered_page(wanted, ["created_at", "id"], 10, 5).select("schema_id", "table_name")


@query("""
SELECT c_custkey AS customer_id, c_name AS full_name, c_mktsegment AS segment, o_orderkey, o_totalprice,
       o_orderdate, n_name AS nation
FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
""")
def mart_resolution(spark, sf_dir):
    customer = Resolution(renames=(("c_name", "full_name"),), ignores=("c_mktsegment",))
    orders = Resolution(drops=("o_orderstatus", "O_ORDERSTATUS"), deletes=("o_totalprice",))
    built = mart_frame(CUSTOMER_ORDERS, catalog(spark, sf_dir))
    first = plan_resolution(CUSTOMER_ORDERS, table_key("customer"), customer)
    second = plan_resolution(first.spec, table_key("orders"), orders)
    return project_change(project_change(built, first), second)


@query("""
WITH kinds AS (SELECT unnest(['click', 'view', 'signup', 'purchase']) AS kind, unnest([0, 1, 2, 3]) AS number),
seen AS (SELECT DISTINCT user_id AS view_id FROM events WHERE event_type <> 'error')
SELECT view_id, 'users_' || view_id AS "table", 'missing_in_dwh' AS type, CAST(NULL AS VARCHAR) AS old,
       kind || '_value' AS new
FROM seen JOIN kinds ON number = view_id % 4
""")
def cdc_observed_drift(spark, sf_dir):
    """Events show a few columns of a table each; only what a mart lacks is a finding, nothing counts as gone."""
    from sparkmart.queries.changes import activity_events

    events = data_events(activity_events(spark, sf_dir))
    events = events.withColumn("table", F.concat(F.lit("users_"), F.col("after")["user_id"]))
    seen = settle(observed_columns(events), "observed")
    kinds = ["click", "view", "signup", "purchase"]
    place = [F.substring("table", 7, 20).cast("bigint").alias("view_id"), "db", "schema", "table"]
    views = seen.select(*place).distinct()
    names = F.array(F.lit("user_id"), *(F.lit(f"{k}_value") for k in kinds))
    spec = views.select("*", F.explode(names).alias("column")).withColumns({"target": F.col("column"), "type": F.lit("text")})
    lacks = F.element_at(F.array(*(F.lit(f"{k}_value") for k in kinds)), (F.col("view_id") % 4 + 1).cast("int"))
    mart = spec.where(F.col("column") != lacks).select("view_id", "column")
    return drift.observed_report(seen, spec, mart).select("view_id", "table", "type", "old", "new")


_RESOLVED_SPECS_SQL = """
SELECT n_nationkey AS view_id, CASE WHEN c = 'bal' AND n_nationkey % 3 = 0 THEN 'balance' ELSE c END AS "column"
FROM nation, (SELECT unnest(['id', 'bal', 'note']) AS c)
WHERE NOT (c = 'note' AND n_nationkey % 3 = 1) AND NOT (c = 'bal' AND n_nationkey % 3 = 2)
"""


@query(_RESOLVED_SPECS_SQL)
def resolved_specs(spark, sf_dir):
    """The specs after renames, deletions and drops, one mart per nation."""
    from sparkmart.queries.base import mart, table

    decisions = [
        Resolution(renames=(("bal", "balance"),)),
        Resolution(deletes=("NOTE",)),
        Resolution(drops=("bal", "BAL"), ignores=("id",)),
    ]
    rows = []
    for r in read(spark, sf_dir, "nation").select("n_nationkey").toLocalIterator():
        key = table_key(f"stock_{r[0]}")
        spec = mart(f"stock_{r[0]}", table(key.table, "id", "bal", "note"))
        rows.append((r[0], plan_resolution(spec, key, decisions[r[0] % 3]).spec.to_json()))
    registry = local_frame(spark, rows, REGISTRY)
    return spec_columns(registry).select("view_id", "column")


# -- all specs at once --------------------------------------------------------------------------


def order_registry(spark, sf_dir):
    """One spec per order: its lines are join rules between a part table and a supplier table.

    Tables of an order's seventh line are not selected, so a rule may name one that is unknown; two lines of one part table give it two columns,
    of one name perhaps.
    """
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").alias("line"),
        F.concat(F.lit("p"), F.col("l_partkey") % 4).alias("p"),
        F.concat(F.lit("s"), F.col("l_suppkey") % 3).alias("s"),
        F.concat(F.lit("c"), F.col("l_quantity").cast("int") % 50).alias("c"),
    )
    end = lambda name: F.struct(F.lit("shop").alias("source"), F.lit("public").alias("schema"), name.alias("table"), F.lit("id").alias("column"))
    rule = lambda p, s: F.struct(F.struct(end(p).alias("left"), end(s).alias("right")).alias("inner"))
    # One grouping of the lines; an order's tables are told from its few lines where they are.
    orders = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("line", "p", "s", "c"))).alias("lines"))
    orders = orders.withColumn("chosen", F.filter("lines", lambda x: x["line"] < 7))
    names = F.sort_array(F.array_distinct(F.concat(F.transform("chosen", lambda x: x["p"]), F.transform("chosen", lambda x: x["s"]))))
    columns = lambda name: F.transform(F.filter("chosen", lambda x: x["p"].eqNullSafe(name)), lambda x: F.struct(x["c"].alias("name")))
    tables = F.transform("names", lambda name: F.struct(name.alias("name"), columns(name).alias("columns")))
    # An order without a number has no tables, nor has one without chosen lines.
    some = F.col("l_orderkey").isNotNull() & (F.size("names") > 0)
    orders = orders.withColumn("names", names).select(
        "l_orderkey", F.transform("lines", lambda x: rule(x["p"], x["s"])).alias("joins"), F.when(some, tables).alias("tables")
    )
    sources = F.array(F.struct(F.lit("shop").alias("name"), F.array(F.struct(F.lit("public").alias("name"), "tables")).alias("schemas")))
    spec = F.to_json(F.struct(F.concat(F.lit("Order_"), "l_orderkey").alias("view_name"), sources.alias("sources"), "joins"))
    return orders.select(F.col("l_orderkey").alias("id"), spec.alias("schema_view"))


@query("""
WITH RECURSIVE l AS (
  SELECT l_orderkey AS id, l_linenumber AS line, 'p' || l_partkey % 4 AS p, 's' || l_suppkey % 3 AS s, CAST(l_quantity AS INTEGER) % 50 AS c
  FROM lineitem),
known AS (SELECT DISTINCT id, unnest([p, s]) AS t FROM l WHERE line < 7),
used AS (SELECT DISTINCT id, unnest([p, s]) AS t FROM l),
reach AS (
  SELECT id, min(p) AS t FROM l GROUP BY id
  UNION SELECT reach.id, CASE WHEN reach.t = l.p THEN l.s ELSE l.p END FROM reach JOIN l ON reach.id = l.id AND (reach.t = l.p OR reach.t = l.s)),
n AS (SELECT id, count(*) AS rules FROM l GROUP BY id),
facts AS (
  SELECT n.id, rules, (SELECT count(*) FROM known WHERE known.id = n.id) AS n_tables, (SELECT count(*) FROM used WHERE used.id = n.id) AS n_joined,
         (SELECT count(*) FROM reach WHERE reach.id = n.id) AS reached
  FROM n),
again AS (SELECT DISTINCT id FROM l WHERE line < 7 GROUP BY id, p, c HAVING count(*) > 1)
SELECT id, 'order_' || id AS name,
       CASE WHEN n_tables = 0 THEN 'no table' WHEN n_joined > n_tables THEN 'unknown table in a rule' WHEN rules <> n_joined - 1 OR reached <> n_joined THEN 'not one tree'
            WHEN id IN (SELECT id FROM again) THEN 'equal column names in a table' ELSE 'ok' END AS verdict,
       n_tables, n_joined
FROM facts
""")
def spec_verdicts(spark, sf_dir):
    return specs.verdicts(order_registry(spark, sf_dir)).drop("left_out")


@query("""
WITH c AS (
  SELECT c_custkey AS view_id, c_custkey % 7 = 0 AS failing, c_mktsegment AS seg FROM customer),
cols AS (SELECT view_id, failing, seg, unnest(['id', 'balance', 'note', 'city']) AS col FROM c)
SELECT view_id, CASE WHEN NOT failing AND seg = 'BUILDING' AND col = 'balance' THEN 'amount'
                     WHEN NOT failing AND seg = 'MACHINERY' AND col = 'city' THEN 'town' ELSE col END AS "column",
       CASE WHEN failing THEN 'gone' END AS problem
FROM cols
WHERE failing OR NOT (col = 'note' AND seg IN ('AUTOMOBILE', 'MACHINERY') OR col = 'city' AND seg = 'AUTOMOBILE')
""")
def customer_specs_resolved(spark, sf_dir):
    """One spec per customer; decisions follow from the segment: accepted renames, deletions, drops, and one that fails."""
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    columns = F.array(*(F.struct(F.lit(c).alias("name")) for c in ("id", "balance", "note", "city")))
    tables = F.array(F.struct(F.concat(F.lit("stock_"), "id").alias("name"), columns.alias("columns")))
    sources = F.array(F.struct(F.lit("shop").alias("name"), F.array(F.struct(F.lit("public").alias("name"), tables.alias("tables"))).alias("schemas")))
    registry = customers.select("id", F.to_json(F.struct(F.concat(F.lit("stock_"), "id").alias("view_name"), sources.alias("sources"))).alias("schema_view"))
    one = lambda seq, kind, old, new=None: F.struct(
        F.lit(seq).alias("seq"), F.lit(kind).alias("decision"), F.lit(old).alias("old"), F.lit(new).cast("string").alias("new")
    )
    segment = F.col("c_mktsegment")
    chosen = (
        F.when(segment == "BUILDING", F.array(one(1, specs.RENAME, "BALANCE", "sum"), one(2, specs.RENAME, "sum", "amount")))
        .when(segment == "MACHINERY", F.array(one(1, specs.RENAME, "city", "town"), one(2, specs.DELETE, "NOTE")))
        .when(segment == "AUTOMOBILE", F.array(one(1, specs.DROP, "city"), one(2, specs.DELETE, "note"), one(3, specs.DELETE, "nothing")))
    )
    chosen = F.when(F.col("id") % 7 == 0, F.array(one(1, specs.DELETE, "note"), one(2, specs.RENAME, "gone", "back"))).otherwise(chosen)
    place = [F.lit("shop").alias("db"), F.lit("public").alias("schema"), F.concat(F.lit("stock_"), "id").alias("table")]
    decisions = customers.select(F.col("id").alias("view_id"), *place, F.inline(chosen))
    done = specs.resolved(registry, decisions)
    return spec_columns(done).select("view_id", "column").join(done.select(F.col("id").alias("view_id"), "problem"), "view_id")
