"""Queries over listings: paging, filters, de-duplication, the registry, discovery and the run log."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from sparkmart.operators import dedup, paging, registry, runlog
from sparkmart.operators.drift import common_type
from sparkmart.queries.base import query, read
from sparkmart.session import scratch_path
from sparkmart.sources import discovery, extract
from sparkmart.sources.change_log import drop_staging_topics

_START, _END = datetime.datetime(1996, 1, 1), datetime.datetime(1998, 12, 31)


@query("""
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 10
""")
def page_orders(spark, sf_dir):
    found = paging.match_all(
        read(spark, sf_dir, "orders"), {"o_orderstatus": "P", "o_orderpriority": "1-URGENT", "o_custkey": None}
    )
    return paging.ordered_page(found, ["o_orderdate", "o_orderkey"], "many", 10).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20")
def page_ascending(spark, sf_dir):
    page = paging.ordered_page(read(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], 20, -1, descending=False)
    return page.select("o_orderkey", "o_orderdate")


@query("""
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1998-12-31'
ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 50
""")
def range_filter_page(spark, sf_dir):
    found = paging.in_range(read(spark, sf_dir, "orders"), "o_orderdate", _START, _END)
    return paging.paginate(found, ["o_orderdate", "o_orderkey"], 3, 25).select("o_orderkey", "o_orderdate")


@query("""
SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1996-01-01', 100)
ORDER BY o_orderdate, o_orderkey LIMIT 25
""")
def page_after_key(spark, sf_dir):
    last = (_START, 100)
    page = paging.page_after(read(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], last, 25)
    return page.select("o_orderkey", "o_orderdate")


@query("""
SELECT doc_id, lang, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1
""")
def dedup_keep_first(spark, sf_dir):
    # The hash stands for the text, so that whole documents do not have to be shuffled.
    documents = read(spark, sf_dir, "documents")
    return dedup.keep_first(documents, F.sha2("text", 256), "doc_id").select("doc_id", "lang", "n_chars")


@query("""
SELECT doc_id, lang, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn > 1
""")
def dedup_repeats(spark, sf_dir):
    documents = read(spark, sf_dir, "documents")
    return dedup.repeats(documents, F.sha2("text", 256), "doc_id").select("doc_id", "lang", "n_chars")


@query("""
SELECT arg_min(n, p_partkey) AS name, min(p_partkey) AS p_partkey FROM (
  SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN upper(p_name) ELSE p_name END || p_brand AS n FROM part)
GROUP BY lower(n)
""")
def unique_ignore_case(spark, sf_dir):
    spelt = F.when(F.col("p_type") == "PROMO", F.upper("p_name")).otherwise(F.col("p_name"))
    names = read(spark, sf_dir, "part").select(F.concat(spelt, "p_brand").alias("name"), "p_partkey")
    return dedup.unique_ignore_case(names, "name", "p_partkey")


@query("""
SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending
FROM customer
""")
def pending_exists(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select("c_custkey")
    orders = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return dedup.with_match_flag(customers, orders, ["c_custkey"], "pending")


# -- registry -----------------------------------------------------------------------------------


def supplier_registry(spark, sf_dir):
    """One mart spec per supplier: its own stock table, and the order table of its nation.

    Suppliers in credit also use the customer table of a second source.
    """

    def named(name, **more):
        name = F.lit(name) if isinstance(name, str) else name
        return F.struct(name.alias("name"), *(c.alias(n) for n, c in more.items()))

    columns = F.array(named("id"), named("amount"))
    stock = named(F.concat(F.lit("stock_"), "s_suppkey"), columns=columns)
    orders = named("orders", columns=columns)
    first = named(F.col("n_name"), schemas=F.array(named("public", tables=F.array(stock, orders))))
    second = named("crm", schemas=F.array(named("sales", tables=F.array(named("customer", columns=columns)))))
    sources = F.when(F.col("s_acctbal") > 0, F.array(first, second)).otherwise(F.array(first))
    spec = F.to_json(F.struct(F.col("s_name").alias("view_name"), sources.alias("sources")))
    suppliers = read(spark, sf_dir, "supplier").join(
        read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return suppliers.select(F.col("s_suppkey").alias("id"), spec.alias("schema_view"))


@query("""
SELECT 'dbserver_' || n_name || '.public.stock_' || s_suppkey AS topic
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION SELECT 'dbserver_' || n_name || '.public.orders' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION SELECT 'dbserver_crm.sales.customer' FROM supplier WHERE s_acctbal > 0
""")
def distinct_topics(spark, sf_dir):
    return registry.topics(supplier_registry(spark, sf_dir))


@query("""
SELECT s_suppkey AS id, lower(s_name) AS name, CASE WHEN s_acctbal > 0 THEN 2 ELSE 1 END AS source_count,
       CASE WHEN s_acctbal > 0 THEN 3 ELSE 2 END AS table_count
FROM supplier
""")
def registry_summary(spark, sf_dir):
    return registry.summary(supplier_registry(spark, sf_dir))


@query("""
SELECT s_suppkey AS id, lower(s_name) || CASE WHEN s_suppkey % 3 = 0 THEN '_v2' ELSE '' END AS name
FROM supplier WHERE s_nationkey IN (3, 5)
""")
def registry_log(spark, sf_dir):
    """Specs of which a third was changed once, read from the log for the order tables of two nations."""
    specs = supplier_registry(spark, sf_dir)
    again = specs.where("id % 3 = 0").withColumn("schema_view", F.regexp_replace("schema_view", '("view_name":"[^"]*)', "$1_v2"))
    log = specs.withColumn("version", F.lit(1).cast("long")).union(again.withColumn("version", F.col("id") + 1))
    nations = read(spark, sf_dir, "nation").where("n_nationkey IN (3, 5)")
    tables = nations.select(F.col("n_name").alias("db"), F.lit("public").alias("schema"), F.lit("orders").alias("table"))
    used = registry.using(registry.newest(log), tables)
    return registry.summary(used).select("id", "name")


@query("SELECT s_suppkey AS id, lower(s_name) AS name FROM supplier WHERE s_nationkey = 3")
def views_using_table(spark, sf_dir):
    return registry.views_using(supplier_registry(spark, sf_dir), "NATION_3", "public", "orders")


@query("""
SELECT 'dbserver_' || n_name || '.public.stock_' || s_suppkey AS topic
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION SELECT 'dbserver_' || n_name || '.public.orders' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION SELECT 'dbserver_crm.sales.customer' FROM supplier WHERE s_acctbal > 0
""")
def topics_without_staging(spark, sf_dir):
    topics = registry.topics(supplier_registry(spark, sf_dir))
    staging = topics.select(F.concat(F.lit("dbserver_dwh.public."), F.lit("temp_"), "topic").alias("topic"))
    return drop_staging_topics(topics.union(staging))


# -- discovery ----------------------------------------------------------------------------------

_CATALOG_SQL = """
WITH cat AS (
  SELECT DISTINCT p_brand AS source, CASE p_type WHEN 'PROMO' THEN 'pg_promo' ELSE lower(p_type) END AS sch,
         p_name AS tab, 'c' || p_size AS col, p_size AS ord,
         CASE WHEN p_size < 20 THEN 'integer' WHEN p_size < 40 THEN 'ARRAY' ELSE 'USER-DEFINED' END AS data_type
  FROM part)
"""


def part_catalog(spark, sf_dir):
    """A column catalog spelt by the part table: brand, type, name and size."""
    schema = F.when(F.col("p_type") == "PROMO", "pg_promo").otherwise(F.lower("p_type"))
    kind = F.when(F.col("p_size") < 20, "integer").when(F.col("p_size") < 40, "ARRAY").otherwise("USER-DEFINED")
    udt = F.when(F.col("p_size") < 20, "int4").when(F.col("p_size") < 40, "_int4").otherwise("mood")
    return (
        read(spark, sf_dir, "part")
        .select(
            F.col("p_brand").alias("source"),
            schema.alias("schema"),
            F.col("p_name").alias("table"),
            F.concat(F.lit("c"), "p_size").alias("column"),
            F.col("p_size").alias("ordinal"),
            kind.alias("data_type"),
            F.when(F.col("p_size") >= 40, "public").otherwise("").alias("udt_schema"),
            udt.alias("udt_name"),
        )
        .distinct()
    )


@query(_CATALOG_SQL + """
SELECT source, sch AS "schema", tab AS "table", col AS "column",
       CASE WHEN ord < 20 THEN 'integer' WHEN ord < 40 THEN 'varchar(' || ord || ')' ELSE 'text' END AS resolved
FROM cat
""")
def resolved_types(spark, sf_dir):
    spelt = (
        F.when(F.col("ordinal") < 10, " INT4 ")
        .when(F.col("ordinal") < 20, "int")
        .when(F.col("ordinal") < 40, F.concat(F.lit("character varying("), "ordinal", F.lit(")")))
        .otherwise("mood")
    )
    columns = part_catalog(spark, sf_dir)
    return columns.select("source", "schema", "table", "column", common_type(spelt).alias("resolved"))


@query(_CATALOG_SQL + "SELECT DISTINCT source, sch AS \"schema\" FROM cat WHERE sch NOT LIKE 'pg\\_%' ESCAPE '\\'")
def list_schemas(spark, sf_dir):
    return discovery.list_schemas(part_catalog(spark, sf_dir))


@query(_CATALOG_SQL + """
SELECT DISTINCT source, sch AS "schema", tab AS "table" FROM cat WHERE sch = 'large'
ORDER BY tab, sch, source LIMIT 20 OFFSET 20
""")
def list_tables(spark, sf_dir):
    return discovery.list_tables(part_catalog(spark, sf_dir), "large", page=2)


@query(_CATALOG_SQL + """
SELECT source, sch AS "schema", tab AS "table", col AS "column",
       CASE data_type WHEN 'ARRAY' THEN '_int4' WHEN 'USER-DEFINED' THEN 'public.mood' ELSE data_type END AS shown,
       ord < 10 AS is_pk, ord BETWEEN 5 AND 20 AS is_fk, ord > 40 AS is_unique
FROM cat
""")
def column_facts(spark, sf_dir):
    columns = part_catalog(spark, sf_dir)
    names = F.array_compact(
        F.array(
            F.when(F.col("ordinal") < 10, "pk"),
            F.when(F.col("ordinal").between(5, 20), "fk"),
            F.when(F.col("ordinal") > 40, "uq"),
        )
    )
    table = ["source", "schema", "table"]
    usage = columns.select(*table, "column", F.explode(names).alias("constraint_name"))
    kinds = F.create_map(*[F.lit(x) for x in ("pk", "PRIMARY KEY", "fk", "FOREIGN KEY", "uq", "UNIQUE")])
    constraints = usage.select(*table, "constraint_name", kinds[F.col("constraint_name")].alias("constraint_type"))
    facts = discovery.column_facts(columns, usage, constraints.distinct())
    return facts.select(*table, "column", discovery.shown_type(facts).alias("shown"), "is_pk", "is_fk", "is_unique")


@query(_CATALOG_SQL + """
, t AS (SELECT source, sch, tab, string_agg(col, ',' ORDER BY ord) AS cols,
               row_number() OVER (PARTITION BY source, sch ORDER BY tab) AS rn
        FROM cat GROUP BY source, sch, tab)
SELECT source, sch AS "schema", string_agg(tab || ':' || cols, ';' ORDER BY tab) AS tree
FROM t WHERE rn > 5 AND rn <= 10 GROUP BY source, sch
""")
def source_tree(spark, sf_dir):
    tree = discovery.source_tree(part_catalog(spark, sf_dir), ("column",), page=2, size=5)
    as_text = F.transform(
        "tables",
        lambda t: F.concat(t["name"], F.lit(":"), F.array_join(F.transform(t["columns"], lambda c: c["column"]), ",")),
    )
    return tree.select("source", "schema", F.array_join(as_text, ";").alias("tree"))


_INFORMATION_SQL = """
WITH cols AS (
  SELECT DISTINCT p_brand AS db, CASE p_type WHEN 'PROMO' THEN 'pg_promo' ELSE lower(p_type) END AS sch,
         p_name AS tab, 'c' || p_size AS col, p_size AS ord
  FROM part),
schs AS (SELECT db, sch FROM cols UNION SELECT DISTINCT p_brand, 'unused_' || p_size % 3 FROM part)
"""


def part_information(spark, sf_dir):
    """An information schema spelt by the part table; every database has schemas without tables."""
    part = read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("table_catalog"),
        F.when(F.col("p_type") == "PROMO", "pg_promo").otherwise(F.lower("p_type")).alias("table_schema"),
        F.col("p_name").alias("table_name"),
        F.concat(F.lit("c"), "p_size").alias("column_name"),
        F.col("p_size").alias("ordinal_position"),
    ).distinct()
    number = F.col("ordinal_position")
    text, none = F.lit("").alias, F.lit(None).cast("int").alias
    columns = part.select(
        "*", F.lit("integer").alias("data_type"), text("udt_schema"), F.lit("int4").alias("udt_name"),
        F.when(number % 2 == 0, "YES").otherwise("NO").alias("is_nullable"),
        none("character_maximum_length"), none("numeric_precision"), none("numeric_scale"),
        F.when(number > 25, number.cast("string")).alias("column_default"),
    )
    kinds = F.array_compact(F.array(
        F.when(number < 10, F.lit("PRIMARY KEY")), F.when(number.between(5, 20), F.lit("FOREIGN KEY")),
        F.when(number > 40, F.lit("UNIQUE")),
    ))
    key = ["table_catalog", "table_schema", "table_name"]
    usage = part.select(*key, "column_name", F.explode(kinds).alias("constraint_type")).withColumn(
        "constraint_name", F.concat_ws("_", "table_name", "constraint_type")
    )
    constraints = usage.select(*key, "constraint_name", "constraint_type").distinct()
    unused = read(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("unused_"), F.col("p_size") % 3))
    schemata = part.select("table_catalog", "table_schema").union(unused).toDF("catalog_name", "schema_name").distinct()
    described = part.where(number % 5 == 0).select(*key, "column_name", F.concat(F.lit("about "), "column_name").alias("description"))
    return discovery.InformationSchema(columns, usage, constraints, schemata, described)


@query(_INFORMATION_SQL + "SELECT db AS source, sch AS \"schema\" FROM schs WHERE sch NOT LIKE 'pg\\_%' ESCAPE '\\'")
def list_schemas_without_tables(spark, sf_dir):
    return discovery.list_schemas(part_information(spark, sf_dir).schemas())


@query(_INFORMATION_SQL + """
SELECT db AS source, sch AS "schema", tab AS "table", col AS "column", ord % 2 = 0 AS is_nullable, ord < 10 AS is_pk,
       ord BETWEEN 5 AND 20 AS is_fk, ord > 40 AS is_unique, CASE WHEN ord > 25 THEN CAST(ord AS VARCHAR) END AS column_default,
       CASE WHEN ord % 5 = 0 THEN 'about ' || col END AS description
FROM cols
""")
def information_schema_facts(spark, sf_dir):
    return part_information(spark, sf_dir).facts().select(
        "source", "schema", "table", "column", "is_nullable", "is_pk", "is_fk", "is_unique", "column_default", "description"
    )


@query(_INFORMATION_SQL + """
, t AS (SELECT db, sch, tab, string_agg(col || '/' || CASE WHEN ord < 10 THEN 'pk' ELSE '' END || '/'
                 || CASE WHEN ord % 5 = 0 THEN 'about ' || col ELSE '' END, ',' ORDER BY ord) AS cols,
               row_number() OVER (PARTITION BY db, sch ORDER BY tab) AS rn
        FROM cols GROUP BY db, sch, tab),
s AS (SELECT db, sch, coalesce(string_agg(tab || ':' || cols, ';' ORDER BY tab), '') AS tabs
      FROM (SELECT *, row_number() OVER (PARTITION BY db ORDER BY sch) AS place
            FROM schs WHERE sch NOT LIKE 'pg\\_%' ESCAPE '\\') LEFT JOIN (SELECT * FROM t WHERE rn <= 4) USING (db, sch)
      WHERE place BETWEEN 4 AND 6 GROUP BY db, sch)
SELECT db AS source, db AS "database", string_agg(sch || '=' || tabs, '|' ORDER BY sch) AS assembly FROM s GROUP BY db
""")
def source_assembly(spark, sf_dir):
    info = part_information(spark, sf_dir)
    nested = discovery.source_assembly(info.facts(), info.schemas(), size=4, schema_page=2, schema_size=3)
    about = lambda c: F.concat_ws(
        "/", c["column"], F.when(c["is_pk"], "pk").otherwise(""), F.coalesce(c["description"], F.lit(""))
    )
    in_table = lambda t: F.concat(t["name"], F.lit(":"), F.array_join(F.transform(t["columns"], about), ","))
    in_schema = lambda s: F.concat(s["name"], F.lit("="), F.array_join(F.transform(s["tables"], in_table), ";"))
    return nested.select("source", "database", F.array_join(F.transform("schemas", in_schema), "|").alias("assembly"))


# -- extraction ---------------------------------------------------------------------------------

# The cube of the order number: most keys lie in the lowest of equal ranges.
_PARTS = 16


def _skewed_lines(spark, sf_dir):
    key = F.pow(F.col("l_orderkey").cast("double"), F.lit(3)).cast("decimal(38,0)").alias("key")
    return read(spark, sf_dir, "lineitem").select(key, "l_returnflag", "l_linenumber", "l_quantity")


@query("""
SELECT l_returnflag, l_linenumber, count(*) AS n_rows, sum(l_quantity) AS quantity
FROM lineitem GROUP BY l_returnflag, l_linenumber
""")
def extracted_in_parts(spark, sf_dir):
    lines = _skewed_lines(spark, sf_dir)
    copy = extract.Extraction(
        spark,
        scratch_path(spark, "extracted"),
        lambda conditions: extract.frame_part(lines, conditions),
        lambda: extract.range_conditions("`key`", extract.equi_depth_bounds(lines, "key", _PARTS)),
        wave=6,
    ).run()
    return copy.groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n_rows"), F.sum("l_quantity").alias("quantity"))


@query(f"SELECT {_PARTS} AS parts, count(*) AS n_rows, true AS within_twice FROM lineitem")
def equi_depth_parts(spark, sf_dir):
    lines = _skewed_lines(spark, sf_dir)
    conditions = extract.range_conditions("`key`", extract.equi_depth_bounds(lines, "key", _PARTS))
    # A row that met no condition or several would show in the number of rows.
    sizes = lines.select(F.inline(F.array(*(
        F.struct(F.lit(i).alias("part"), F.coalesce(F.expr(c), F.lit(False)).alias("inside")) for i, c in enumerate(conditions)
    )))).where("inside").groupBy("part").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("parts"), F.sum("n").alias("n_rows"), (F.max("n") <= 2 * F.min("n")).alias("within_twice")
    )


# -- run log ------------------------------------------------------------------------------------

_TASKS_SQL = """
SELECT CAST(user_id AS VARCHAR) AS task_id, min(ts) AS create_at,
       arg_max(CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'error' THEN 'Execution error'
               ELSE 'In progress' END, event_id) AS status,
       arg_max(props, event_id) AS comment
FROM events GROUP BY user_id
"""


def event_log(spark, sf_dir):
    status = (
        F.when(F.col("event_type") == "purchase", runlog.COMPLETED)
        .when(F.col("event_type") == "error", runlog.FAILED)
        .otherwise(runlog.IN_PROGRESS)
    )
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("task_id"),
        F.col("ts").alias("at"),
        status.alias("status"),
        F.col("props").alias("comment"),
        "event_id",
    )


@query(_TASKS_SQL)
def runlog_current(spark, sf_dir):
    return runlog.current_tasks(event_log(spark, sf_dir), "event_id")


@query(f"""
SELECT * FROM ({_TASKS_SQL}) WHERE create_at >= TIMESTAMP '2024-01-01 02:00:00'
ORDER BY create_at DESC, task_id DESC LIMIT 10 OFFSET 10
""")
def runlog_page(spark, sf_dir):
    start = datetime.datetime(2024, 1, 1, 2)
    return runlog.list_tasks(event_log(spark, sf_dir), start=start, page=2, order="event_id")
