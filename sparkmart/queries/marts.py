"""Queries that build marts from specs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmart.functions.transform import align, stage
from sparkmart.operators.registry import Registry
from sparkmart.plans.build import build_mart
from sparkmart.plans.mart import current_view, mart_frame
from sparkmart.plans.spec import JsonField, MartSpec, Transform
from sparkmart.queries.base import CRM, SHOP, catalog, column, mart, on, query, read, table
from sparkmart.session import scratch_path
from sparkmart.sources.catalog import count_spec_tables
from sparkmart.store import TableStore

CUSTOMER_ORDERS = mart(
    "customer_orders",
    table("customer", column("c_custkey", "customer_id"), "c_name", column("c_mktsegment", "segment")),
    table("orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"),
    table("nation", column("n_name", "nation")),
    joins=(on("customer.c_custkey", "orders.o_custkey"), on("customer.c_nationkey", "nation.n_nationkey")),
)

FIVE_TABLES = mart(
    "five_tables",
    table("lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"),
    table("orders", "o_orderdate", "o_orderpriority"),
    table("customer", "c_name", "c_mktsegment"),
    table("nation", "n_name"),
    table("region", "r_name"),
    joins=(
        on("nation.n_regionkey", "region.r_regionkey"),
        on("customer.c_nationkey", "nation.n_nationkey"),
        on("orders.o_custkey", "customer.c_custkey"),
        on("lineitem.l_orderkey", "orders.o_orderkey"),
    ),
)

_CUSTOMER_ORDERS_SQL = """
SELECT c_custkey AS customer_id, c_name, c_mktsegment AS segment, o_orderkey, o_orderstatus, o_totalprice,
       o_orderdate, n_name AS nation
FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
"""


@query(_CUSTOMER_ORDERS_SQL)
def mart_customer_orders(spark, sf_dir):
    return mart_frame(CUSTOMER_ORDERS, catalog(spark, sf_dir))


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate, o_orderdate, o_orderpriority,
       c_name, c_mktsegment, n_name, r_name
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def mart_five_tables(spark, sf_dir):
    return mart_frame(FIVE_TABLES, catalog(spark, sf_dir))


@query("""
SELECT c_custkey, c_name, o_orderkey, o_totalprice
FROM customer JOIN orders ON c_custkey = o_custkey
""")
def mart_cross_source(spark, sf_dir):
    spec = mart(
        "cross_source",
        table("customer", "c_custkey", "c_name", source=CRM),
        table("orders", "o_orderkey", "o_totalprice"),
        joins=(on("customer.c_custkey", "orders.o_custkey", CRM, SHOP),),
    )
    return mart_frame(spec, catalog(spark, sf_dir))


@query("""
SELECT c_custkey, c_mktsegment, o_orderkey, o_orderpriority
FROM customer JOIN orders ON c_custkey = o_custkey
""")
def mart_legacy_join(spark, sf_dir):
    spec = MartSpec.from_json(
        {
            "view_name": "Legacy_Join",
            "joins": [
                {
                    "inner": {
                        "main_table": "customer",
                        "source": SHOP,
                        "schema": "public",
                        "table": "orders",
                        "column_first": "c_custkey",
                        "column_second": "o_custkey",
                    }
                }
            ],
            "sources": [
                {
                    "name": SHOP,
                    "schemas": [
                        {
                            "name": "public",
                            "tables": [
                                {"name": "customer", "columns": [{"name": "c_custkey"}, {"name": "c_mktsegment"}]},
                                {"name": "orders", "columns": [{"name": "o_orderkey"}, {"name": "o_orderpriority"}]},
                            ],
                        }
                    ],
                }
            ],
        }
    )
    return mart_frame(spec, catalog(spark, sf_dir))


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice, c_name, s_name
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
""")
def mart_composite_join(spark, sf_dir):
    spec = mart(
        "local_suppliers",
        table("lineitem", "l_orderkey", "l_linenumber", "l_extendedprice"),
        table("orders"),
        table("customer", "c_name"),
        table("supplier", "s_name"),
        joins=(
            on("lineitem.l_orderkey", "orders.o_orderkey"),
            on("orders.o_custkey", "customer.c_custkey"),
            on("lineitem.l_suppkey", "supplier.s_suppkey"),
            on("customer.c_nationkey", "supplier.s_nationkey"),
        ),
    )
    return mart_frame(spec, catalog(spark, sf_dir), composite=True)


@query("SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def mart_prune_unjoined(spark, sf_dir):
    spec = mart(
        "prune_unjoined",
        table("orders", "o_orderkey", "o_totalprice"),
        table("customer", "c_name"),
        table("part", "p_partkey", "p_name"),
        joins=(on("orders.o_custkey", "customer.c_custkey"),),
    )
    return mart_frame(spec, catalog(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, l_tax FROM lineitem")
def mart_first_table_only(spark, sf_dir):
    spec = mart("first_only", table("lineitem", "l_orderkey", "l_linenumber", "l_tax"), table("part", "p_name"))
    return mart_frame(spec, catalog(spark, sf_dir))


@query("""
SELECT o_orderkey, o_orderstatus,
       CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS status_label
FROM orders
""")
def value_map_status(spark, sf_dir):
    labels = Transform("FieldTransform", values={"F": "finished", "O": "open"}, output="status_label")
    spec = mart("status", table("orders", "o_orderkey", column("o_orderstatus", transform=labels)))
    return mart_frame(spec, catalog(spark, sf_dir))


@query("""
SELECT c_custkey, c_nationkey,
       CASE CAST(c_nationkey AS VARCHAR) WHEN '0' THEN 'zero' WHEN '1' THEN 'one' WHEN '24' THEN 'last' END
           AS c_nationkey_transformed
FROM customer
""")
def value_map_numeric_key(spark, sf_dir):
    labels = Transform("FieldTransform", values={"0": "zero", "1": "one", "24": "last"})
    spec = mart("nations", table("customer", "c_custkey", column("c_nationkey", transform=labels)))
    return mart_frame(spec, catalog(spark, sf_dir))


@query("""
SELECT event_id, props, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       json_extract_string(props, '$.missing') AS missing
FROM events
""")
def json_flatten_props(spark, sf_dir):
    flatten = Transform("JSON", fields=(JsonField("k", "k", "int"), JsonField("missing", "missing", "text")))
    spec = mart("props", table("events", "event_id", column("props", transform=flatten)))
    return mart_frame(spec, catalog(spark, sf_dir))


@query("""
SELECT event_id, event_type AS kind, '' AS n, '' AS missing FROM events
""")
def json_flatten_compact(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(
        "event_id", F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("n"))).alias("doc")
    )
    flatten = Transform("JSON", fields=tuple(JsonField(n, n, "text") for n in ("kind", "n", "missing")))
    spec = mart("compact", table("events", "event_id", column("doc", transform=flatten), source="derived"))
    return mart_frame(spec, catalog(spark, sf_dir, events=events), profile="compact").drop("doc")


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS amount FROM events
""")
def bad_cast_to_null(spark, sf_dir):
    amount = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("user_id").cast("string"))
    events = read(spark, sf_dir, "events").select("event_id", amount.alias("amount"))
    spec = mart("amounts", table("events", "event_id", column("amount", type="bigint"), source="derived"))
    return mart_frame(spec, catalog(spark, sf_dir, events=events), on_bad_cast="null")


@query("""
SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS total, CAST(o_orderdate AS DATE) AS day,
       substr(o_orderpriority, 1, 3) AS prio
FROM orders
""")
def typed_columns(spark, sf_dir):
    spec = mart(
        "typed",
        table(
            "orders",
            column("o_orderkey", type="int8"),
            column("o_totalprice", "total", type="numeric", num_precision=18, num_scale=2),
            column("o_orderdate", "day", type="date"),
            column("o_orderpriority", "prio", type="varchar(3)"),
        ),
    )
    return mart_frame(spec, catalog(spark, sf_dir))


@query("SELECT c_custkey, c_name, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer")
def deleted_column_null(spark, sf_dir):
    spec = mart(
        "deleted", table("customer", "c_custkey", "c_name", column("c_acctbal", type="float8", is_deleted=True))
    )
    return mart_frame(spec, catalog(spark, sf_dir))


@query("SELECT c_acctbal, c_name AS full_name FROM customer")
def load_alignment(spark, sf_dir):
    wanted = table("customer", column("c_name", "full_name"), "c_acctbal", column("c_absent"))
    loaded = stage(read(spark, sf_dir, "customer"), table("customer", column("c_name", "full_name"), "c_acctbal"))
    return align(loaded, wanted)


@query("""
SELECT 'shop' AS source, 'public' AS "schema", 'lineitem' AS "table", count(*) AS rows FROM lineitem
UNION ALL SELECT 'shop', 'public', 'orders', count(*) FROM orders
UNION ALL SELECT 'shop', 'public', 'customer', count(*) FROM customer
UNION ALL SELECT 'shop', 'public', 'nation', count(*) FROM nation
UNION ALL SELECT 'shop', 'public', 'region', count(*) FROM region
""")
def table_counts(spark, sf_dir):
    return count_spec_tables(catalog(spark, sf_dir), FIVE_TABLES)


@query(_CUSTOMER_ORDERS_SQL)
def mart_published(spark, sf_dir):
    store = TableStore(spark, scratch_path(spark, "marts"))
    build_mart(store, CUSTOMER_ORDERS, catalog(spark, sf_dir), buckets=4)
    return store.read("customer_orders")


@query(_CUSTOMER_ORDERS_SQL.replace("c_name,", "c_name AS full_name,").replace("o_orderstatus, ", ""))
def mart_renamed_and_dropped(spark, sf_dir):
    store = TableStore(spark, scratch_path(spark, "marts"))
    build_mart(store, CUSTOMER_ORDERS, catalog(spark, sf_dir))
    store.alter("customer_orders", {"c_name": "full_name"}, ["o_orderstatus", "never_there"])
    return store.read("customer_orders")


@query(_CUSTOMER_ORDERS_SQL)
def mart_from_registry(spark, sf_dir):
    store = TableStore(spark, scratch_path(spark, "marts"))
    registry = Registry(store)
    return mart_frame(registry.get(registry.add(CUSTOMER_ORDERS)), catalog(spark, sf_dir))


@query("""
SELECT user_id, ts, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
) WHERE rn = 1
""")
def versioned_current_view(spark, sf_dir):
    versions = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return current_view(versions, ["user_id"], ("ts", "event_id"))
