"""Queries over change logs derived from the event and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmart.operators.changes import conflict_columns, fold, partial_rows, value_columns
from sparkmart.operators.evolve import Evolution
from sparkmart.operators.registry import Registry, routes
from sparkmart.operators.routing import data_events, known_op, observed_columns, route, write_gate
from sparkmart.operators.upsert import apply_events
from sparkmart.plans.build import build_mart
from sparkmart.plans.mart import current_view, mart_frame
from sparkmart.plans.spec import JsonField, Transform
from sparkmart.queries.base import PUBLIC, SHOP, catalog, column, mart, on, query, read, table, table_key
from sparkmart.queries.listings import supplier_registry
from sparkmart.session import scratch_path
from sparkmart.sources import change_log
from sparkmart.store import TableStore
from sparkmart.streaming.appended import appended_mart
from sparkmart.streaming.cdc import ChangeApplier, apply_stream


def _key(name: str = "user_id", **facts):
    return column(name, type="bigint", is_update_key=True, **facts)


def _is(*kinds: str):
    return F.col("event_type").isin(*kinds)


def _after(*pairs):
    """A row image from (condition, column, value) triples; a column is present where its condition holds."""
    nothing = F.create_map().cast("map<string,string>")
    entries = [
        F.when(cond, F.create_map(F.lit(name), value.cast("string"))).otherwise(nothing)
        for cond, name, value in pairs
    ]
    return F.map_concat(*entries)


def envelopes(events, after, tab: str, db: str = SHOP, op="u", seq: str = "event_id"):
    """Change records ``(value, seq)`` in the wire format."""
    text = change_log.envelope(after, db, PUBLIC, tab, op, F.col(seq))
    return events.select(text.alias("value"), F.col(seq).alias("seq"))


# -- decoding and routing -----------------------------------------------------------------------


def raw_user_log(spark, sf_dir):
    """Event rows as records; those of type 'error' are cut off in the middle."""
    events = read(spark, sf_dir, "events")
    after = F.create_map(F.lit("user_id"), F.col("user_id"))
    op = F.when(_is("view"), "r").when(_is("click"), "c").when(_is("signup"), "d").otherwise("u")
    log = envelopes(events, after, "users", op=op)
    broken = F.col("value").contains('"op":"u"') & (F.col("seq") >= 0)
    cut = F.when(broken, F.expr("substr(value, 1, length(value) - 10)")).otherwise(F.col("value"))
    errors = events.where(_is("error")).select(F.col("event_id").alias("seq"), F.lit(True).alias("bad"))
    marked = log.join(errors, "seq", "left")
    return marked.select(F.when(F.col("bad"), cut).otherwise(F.col("value")).alias("value"), "seq")


@query("""
SELECT event_id AS seq, 'shop' AS db, 'users' AS "table", CAST(user_id AS VARCHAR) AS user_id,
       CASE event_type WHEN 'view' THEN 'r' WHEN 'click' THEN 'c' WHEN 'signup' THEN 'd' ELSE 'u' END AS op
FROM events WHERE event_type <> 'error'
""")
def cdc_decode(spark, sf_dir):
    events = change_log.decode(raw_user_log(spark, sf_dir))
    user = F.col("after")["user_id"].alias("user_id")
    return events.select("seq", "db", "table", user, known_op(F.col("op")).alias("op"))


@query("""
WITH e AS (
  SELECT '{"before":null,"after":{"user_id":' || user_id || '},"source":{"db":"shop","schema":"public","table":"users",'
         || '"lsn":' || event_id || '},"op":"u"}' AS record
  FROM events WHERE event_type = 'error')
SELECT left(record, length(record) - 10) AS value, 'not an envelope' AS reason FROM e
""")
def cdc_bad_records(spark, sf_dir):
    return change_log.bad_records(raw_user_log(spark, sf_dir))


def stock_events(spark, sf_dir):
    """Line items as changes of their supplier's stock table."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("db"))
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    op = F.when(F.col("l_returnflag") == "A", "u").when(F.col("l_returnflag") == "N", "c").otherwise("d")
    return (
        read(spark, sf_dir, "lineitem")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            "db",
            F.lit(PUBLIC).alias("schema"),
            F.concat(F.lit("stock_"), "l_suppkey").alias("table"),
            op.alias("op"),
            F.create_map(F.lit("id"), F.col("l_orderkey").cast("string")).alias("after"),
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
        )
    )


@query("""
SELECT s_suppkey AS view_id, lower(s_name) AS view, l_orderkey, l_linenumber, l_partkey
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag IN ('A', 'N')
""")
def cdc_route(spark, sf_dir):
    routed = route(data_events(stock_events(spark, sf_dir)), routes(supplier_registry(spark, sf_dir)))
    return routed.select("view_id", "view", "l_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT s_suppkey AS view_id, l_orderkey, l_linenumber, l_partkey
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag IN ('A', 'N') AND s_acctbal >= 1000
""")
def cdc_write_gate(spark, sf_dir):
    specs = routes(supplier_registry(spark, sf_dir))
    poor = read(spark, sf_dir, "supplier").where("s_acctbal < 1000").select(F.col("s_suppkey").alias("view_id"))
    pending = specs.join(poor, "view_id", "left_semi")
    routed = write_gate(route(data_events(stock_events(spark, sf_dir)), specs), pending)
    return routed.select("view_id", "l_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT DISTINCT 'shop' AS db, 'public' AS "schema", 'users' AS "table", unnest(['user_id', event_type || '_value'])
       AS "column"
FROM events WHERE event_type <> 'error'
""")
def cdc_observed_columns(spark, sf_dir):
    return observed_columns(data_events(activity_events(spark, sf_dir)))


# -- folding ------------------------------------------------------------------------------------

_KINDS = ("click", "view", "signup", "purchase")

ACTIVITY = mart(
    "user_activity", table("users", _key(), *(column(f"{k}_value", type="float8") for k in _KINDS))
)


def activity_events(spark, sf_dir):
    """One value column per event type; small purchases are explicit NULLs, errors are deletes."""
    events = read(spark, sf_dir, "events")
    value = F.when(~_is("purchase") | (F.col("value") >= 10), F.col("value"))
    after = F.create_map(
        F.lit("user_id"), F.col("user_id").cast("string"), F.concat("event_type", F.lit("_value")), value.cast("string")
    )
    return change_log.decode(envelopes(events, after, "users", op=F.when(_is("error"), "d").otherwise("u")))


@query("""
SELECT user_id, arg_max_null(value, event_id) FILTER (event_type = 'click') AS click_value,
       arg_max_null(value, event_id) FILTER (event_type = 'view') AS view_value,
       arg_max_null(value, event_id) FILTER (event_type = 'signup') AS signup_value,
       arg_max_null(CASE WHEN value >= 10 THEN value END, event_id) FILTER (event_type = 'purchase') AS purchase_value
FROM events WHERE event_type <> 'error' GROUP BY user_id
""")
def cdc_fold_last_present(spark, sf_dir):
    key = table_key("users")
    rows = partial_rows(activity_events(spark, sf_dir), ACTIVITY, key)
    folded = fold(rows, conflict_columns(ACTIVITY.table(key)))
    return folded.select(*value_columns(folded))


# -- applying -----------------------------------------------------------------------------------

CUSTOMERS = mart(
    "customers", table("customer", _key("c_custkey"), "c_name", column("c_acctbal", type="float8"), "c_mktsegment")
)


def _customer_images(spark, sf_dir, null_key: str | None = None):
    """Events and the row images they stand for: views concern customers that are not in the mart."""
    events = read(spark, sf_dir, "events")
    key = F.when(_is("view"), -F.col("user_id") - 1).otherwise(F.col("user_id"))
    if null_key:
        key = F.when(~_is(null_key), key)
    name = F.concat(F.when(_is("purchase"), "buyer").otherwise("v"), F.col("event_id"))
    balance_kinds = ("click", "purchase", null_key) if null_key else ("click", "purchase")
    after = _after(
        (F.lit(True), "c_custkey", key),
        (_is("purchase", "view"), "c_name", name),
        (_is(*balance_kinds), "c_acctbal", F.when(~_is("purchase"), F.col("value"))),
        (_is("signup"), "c_mktsegment", F.col("event_type")),
    )
    return events, after


def customer_log(spark, sf_dir, null_key: str | None = None):
    """Changes of customers told by events."""
    return envelopes(*_customer_images(spark, sf_dir, null_key), "customer")


def partitioned_log(spark, sf_dir):
    """The same as records of three topic partitions, whose offsets repeat; errors have no key, views no position."""
    events, after = _customer_images(spark, sf_dir, null_key="error")
    placed = ~_is("view")
    value = change_log.envelope(after, SHOP, PUBLIC, "customer", "u", F.when(placed, F.col("event_id")))
    return events.select(
        value.alias("value"),
        F.lit("dbserver_shop.public.customer").alias("topic"),
        (F.col("event_id") % 3).cast("int").alias("partition"),
        F.when(placed, F.floor(F.col("event_id") / 3)).alias("offset"),
    )


_FOLDED_SQL = """
WITH ch AS (SELECT *, CASE WHEN event_type = 'view' THEN -user_id - 1 ELSE user_id END AS k FROM events),
f AS (
  SELECT k, bool_or(event_type IN ('purchase', 'view')) AS has_n, bool_or(event_type IN ('click', 'purchase')) AS has_b,
         bool_or(event_type = 'signup') AS has_s,
         arg_max_null(CASE event_type WHEN 'purchase' THEN 'buyer' ELSE 'v' END || event_id, event_id)
             FILTER (event_type IN ('purchase', 'view')) AS n,
         arg_max_null(CASE event_type WHEN 'click' THEN value END, event_id)
             FILTER (event_type IN ('click', 'purchase')) AS b,
         arg_max_null(event_type, event_id) FILTER (event_type = 'signup') AS s
  FROM ch {where} GROUP BY k)
"""
_APPLIED_SQL = """
SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN has_n THEN n ELSE c_name END AS c_name,
       CASE WHEN has_b THEN b ELSE c_acctbal END AS c_acctbal,
       CASE WHEN has_s THEN s ELSE c_mktsegment END AS c_mktsegment
FROM customer FULL JOIN f ON c_custkey = k
"""


@query(_FOLDED_SQL.format(where="") + _APPLIED_SQL)
def cdc_apply_to_mart(spark, sf_dir):
    base = mart_frame(CUSTOMERS, catalog(spark, sf_dir))
    return apply_events(base, change_log.decode(customer_log(spark, sf_dir)), CUSTOMERS)


@query(
    _FOLDED_SQL.format(where="WHERE event_type <> 'error'")
    + _APPLIED_SQL
    + "UNION ALL SELECT NULL, NULL, value, NULL FROM events WHERE event_type = 'error'"
)
def cdc_null_keys(spark, sf_dir):
    base = mart_frame(CUSTOMERS, catalog(spark, sf_dir))
    return apply_events(base, change_log.decode(customer_log(spark, sf_dir, null_key="error")), CUSTOMERS)


_NULL_KEYS_SQL = "UNION ALL SELECT NULL, NULL, value, NULL FROM events WHERE event_type = 'error'"


@query(_FOLDED_SQL.format(where="WHERE event_type NOT IN ('error', 'view')") + _APPLIED_SQL + _NULL_KEYS_SQL)
def cdc_partitioned_log(spark, sf_dir):
    base = mart_frame(CUSTOMERS, catalog(spark, sf_dir))
    return apply_events(base, change_log.decode(partitioned_log(spark, sf_dir)), CUSTOMERS)


@query("""
SELECT 'no position' AS reason, -user_id - 1 AS c_custkey, 'v' || event_id AS c_name FROM events
WHERE event_type = 'view'
""")
def cdc_unplaced_records(spark, sf_dir):
    bad = change_log.bad_records(partitioned_log(spark, sf_dir))
    field = lambda name: F.get_json_object("value", f"$.after.{name}").alias(name)
    return bad.select("reason", field("c_custkey").cast("bigint").alias("c_custkey"), field("c_name"))


@query(
    _FOLDED_SQL.format(where="")
    + """
SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN has_n THEN n ELSE c_name END AS c_name,
       CASE WHEN has_b THEN b ELSE c_acctbal END AS c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment
FROM customer FULL JOIN f ON c_custkey = k
"""
)
def cdc_deleted_column(spark, sf_dir):
    """Sign-ups carry a value for a column that was deleted; it stays NULL."""
    spec = mart(
        "customers_without_segment",
        table(
            "customer",
            _key("c_custkey"),
            "c_name",
            column("c_acctbal", type="float8"),
            column("c_mktsegment", type="text", is_deleted=True),
        ),
    )
    base = mart_frame(spec, catalog(spark, sf_dir))
    return apply_events(base, change_log.decode(customer_log(spark, sf_dir)), spec)


@query("""
SELECT -1 - c_custkey AS c_custkey, c_name, CAST(NULL AS DOUBLE) AS c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment
FROM customer WHERE c_nationkey < 20
""")
def cdc_no_mart_column(spark, sf_dir):
    """Events that write no column of the mart are skipped, here those of customers of some nations."""
    customers = read(spark, sf_dir, "customer")
    ours = F.col("c_nationkey") < 20
    after = _after(
        (ours, "c_custkey", -F.col("c_custkey") - 1), (ours, "c_name", F.col("c_name")), (~ours, "c_nationkey", F.col("c_nationkey"))
    )
    log = envelopes(customers, after, "customer", seq="c_custkey")
    empty = mart_frame(CUSTOMERS, catalog(spark, sf_dir)).where(F.lit(False))
    return apply_events(empty, change_log.decode(log), CUSTOMERS)


ORDER_CUSTOMERS = mart(
    "order_customers",
    table("orders", _key("o_orderkey"), "o_totalprice"),
    table("customer", _key("c_custkey", alias="customer_id"), "c_name", column("c_acctbal", type="float8")),
    joins=(on("orders.o_custkey", "customer.c_custkey"),),
)


@query("""
WITH m AS (SELECT o_orderkey, o_totalprice, c_custkey AS customer_id, c_name, c_acctbal
           FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT user_id, arg_max_null(value, event_id) AS b FROM events GROUP BY user_id)
SELECT o_orderkey, o_totalprice, customer_id, c_name, CASE WHEN user_id IS NULL THEN c_acctbal ELSE b END AS c_acctbal
FROM m LEFT JOIN f ON customer_id = user_id
UNION ALL SELECT NULL, NULL, user_id, NULL, b FROM f WHERE user_id NOT IN (SELECT customer_id FROM m)
""")
def cdc_fanout_update_many(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    after = _after((F.lit(True), "c_custkey", F.col("user_id")), (F.lit(True), "c_acctbal", F.col("value")))
    changes = change_log.decode(envelopes(events, after, "customer"))
    base = mart_frame(ORDER_CUSTOMERS, catalog(spark, sf_dir))
    return apply_events(base, changes, ORDER_CUSTOMERS, [table_key("customer")])


@query("""
WITH f AS (
  SELECT user_id, arg_max_null(CASE WHEN event_type <> 'error' THEN event_type END, event_id) AS s,
         arg_max(CASE event_type WHEN 'click' THEN 'active' WHEN 'purchase' THEN 'buyer' WHEN 'error' THEN 'unknown' END,
                 event_id) FILTER (event_type IN ('click', 'purchase', 'error')) AS label
  FROM events GROUP BY user_id)
SELECT c_custkey, CASE WHEN user_id IS NULL THEN c_mktsegment ELSE s END AS c_mktsegment,
       coalesce(label, CASE WHEN c_mktsegment = 'BUILDING' THEN 'construction' END) AS segment_label
FROM customer LEFT JOIN f ON c_custkey = user_id
UNION ALL SELECT user_id, s, label FROM f WHERE user_id NOT IN (SELECT c_custkey FROM customer)
""")
def cdc_value_map_keep_old(spark, sf_dir):
    values = {"BUILDING": "construction", "click": "active", "purchase": "buyer", "<nil>": "unknown"}
    labels = Transform("FieldTransform", values=values, output="segment_label")
    spec = mart("labels", table("customer", _key("c_custkey"), column("c_mktsegment", type="text", transform=labels)))
    after = _after(
        (F.lit(True), "c_custkey", F.col("user_id")),
        (F.lit(True), "c_mktsegment", F.when(~_is("error"), F.col("event_type"))),
    )
    changes = change_log.decode(envelopes(read(spark, sf_dir, "events"), after, "customer"))
    return apply_events(mart_frame(spec, catalog(spark, sf_dir)), changes, spec)


@query("""
WITH e AS (
  SELECT *, CASE event_type WHEN 'click' THEN props WHEN 'view' THEN '{}' WHEN 'error' THEN '[1]'
                 WHEN 'purchase' THEN '{"k": null}' END AS doc FROM events),
f AS (
  SELECT user_id, arg_max_null(doc, event_id) AS doc, bool_or(event_type IN ('click', 'purchase')) AS has_k,
         arg_max_null(CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END, event_id)
             FILTER (event_type IN ('click', 'purchase')) AS k
  FROM e GROUP BY user_id),
c AS (SELECT c_custkey, '{"k": ' || c_nationkey || '}' AS doc, c_nationkey AS k FROM customer)
SELECT coalesce(c_custkey, user_id) AS c_custkey, CASE WHEN user_id IS NULL THEN c.doc ELSE f.doc END AS doc,
       CASE WHEN has_k THEN f.k ELSE c.k END AS k
FROM c FULL JOIN f ON c_custkey = user_id
""")
def cdc_json_flatten(spark, sf_dir):
    doc = F.concat(F.lit('{"k": '), "c_nationkey", F.lit("}"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", doc.alias("doc"))
    flatten = Transform("JSON", fields=(JsonField("k", "k", "int"),))
    doc_column = column("doc", type="text", transform=flatten)
    spec = mart("docs", table("customer", _key("c_custkey"), doc_column, source="derived"))
    payload = (
        F.when(_is("click"), F.col("props"))
        .when(_is("view"), "{}")
        .when(_is("error"), "[1]")
        .when(_is("purchase"), '{"k": null}')
    )
    after = _after((F.lit(True), "c_custkey", F.col("user_id")), (F.lit(True), "doc", payload))
    changes = change_log.decode(envelopes(read(spark, sf_dir, "events"), after, "customer", db="derived"))
    return apply_events(mart_frame(spec, catalog(spark, sf_dir, customer=customers)), changes, spec)


@query("""
WITH f AS (
  SELECT CASE WHEN event_type = 'view' THEN -user_id - 1 ELSE user_id END AS k, arg_max(event_type, event_id) AS level
  FROM events GROUP BY 1)
SELECT coalesce(c_custkey, k) AS c_custkey, c_name, coalesce(c_custkey, k) AS member_id,
       coalesce(f.level, c_mktsegment) AS level
FROM customer FULL JOIN f ON c_custkey = k
""")
def cdc_view_key(spark, sf_dir):
    profiles = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("member_id"), F.col("c_mktsegment").alias("level")
    )
    spec = mart(
        "members",
        table("customer", _key("c_custkey", view_key="member_id"), "c_name"),
        table("profile", _key("member_id", view_key="c_custkey"), "level", source="derived"),
        joins=(on("customer.c_custkey", "profile.member_id", right_source="derived"),),
    )
    member = F.when(_is("view"), -F.col("user_id") - 1).otherwise(F.col("user_id"))
    after = _after((F.lit(True), "member_id", member), (F.lit(True), "level", F.col("event_type")))
    changes = change_log.decode(envelopes(read(spark, sf_dir, "events"), after, "profile", db="derived"))
    base = mart_frame(spec, catalog(spark, sf_dir, profile=profiles))
    return apply_events(base, changes, spec, [table_key("profile", "derived")])


@query("""
WITH a AS (
  SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN o_totalprice ELSE 1.5 END AS o_totalprice, c_custkey,
         c_acctbal
  FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT -o_orderkey - 1, o_custkey, 1.5, o_custkey, NULL FROM orders WHERE o_orderstatus = 'F'),
f AS (SELECT user_id, arg_max_null(value, event_id) AS b FROM events GROUP BY user_id)
SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, CASE WHEN user_id IS NULL THEN c_acctbal ELSE b END AS c_acctbal
FROM a LEFT JOIN f ON c_custkey = user_id AND o_custkey = user_id
UNION ALL SELECT NULL, user_id, NULL, user_id, b FROM f WHERE user_id NOT IN (SELECT c_custkey FROM a)
""")
def cdc_two_tables(spark, sf_dir):
    spec = mart(
        "orders_with_customers",
        table(
            "orders",
            _key("o_orderkey"),
            _key("o_custkey", view_key="c_custkey"),
            column("o_totalprice", type="float8"),
        ),
        table("customer", _key("c_custkey", view_key="o_custkey"), column("c_acctbal", type="float8")),
        joins=(on("orders.o_custkey", "customer.c_custkey"),),
    )
    orders = read(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderstatus") == "F", -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey"))
    always = F.lit(True)
    order_changes = _after(
        (always, "o_orderkey", key), (always, "o_custkey", F.col("o_custkey")), (always, "o_totalprice", F.lit(1.5))
    )
    events = read(spark, sf_dir, "events")
    customer_changes = _after((always, "c_custkey", F.col("user_id")), (always, "c_acctbal", F.col("value")))
    log = envelopes(orders, order_changes, "orders", seq="o_orderkey").union(
        envelopes(events, customer_changes, "customer")
    )
    return apply_events(mart_frame(spec, catalog(spark, sf_dir)), change_log.decode(log), spec)


# -- streaming ----------------------------------------------------------------------------------


def _stream_into(spark, sf_dir, spec, log, **build):
    """Build a mart, stream the change log from files into it and return the store."""
    root = scratch_path(spark, "stream")
    store = TableStore(spark, f"{root}/store")
    registry = Registry(store)
    registry.add(spec)
    build_mart(store, spec, catalog(spark, sf_dir), **build)
    log.select("value").write.text(f"{root}/log")
    applier = ChangeApplier(store, registry, Evolution(store, registry))
    apply_stream(spark, change_log.read_files(spark, f"{root}/log"), applier, f"{root}/checkpoint")
    return store


@query(_FOLDED_SQL.format(where="") + _APPLIED_SQL)
def cdc_stream_mart(spark, sf_dir):
    log = customer_log(spark, sf_dir)
    return _stream_into(spark, sf_dir, CUSTOMERS, log, buckets=4).read(CUSTOMERS.name)


@query("""
WITH last AS (
  SELECT CASE WHEN event_type = 'view' THEN -user_id - 1 ELSE user_id END AS k, arg_max(event_id, event_id) AS id
  FROM events GROUP BY 1)
SELECT coalesce(k, c_custkey) AS c_custkey,
       CASE WHEN k IS NULL THEN c_name WHEN event_type = 'purchase' THEN 'buyer' || id
            WHEN event_type = 'view' THEN 'v' || id END AS c_name,
       CASE WHEN k IS NULL THEN c_acctbal WHEN event_type = 'click' THEN value END AS c_acctbal,
       CASE WHEN k IS NULL THEN c_mktsegment WHEN event_type = 'signup' THEN event_type END AS c_mktsegment
FROM customer FULL JOIN (SELECT k, id, event_type, value FROM last JOIN events ON id = event_id) ON c_custkey = k
""")
def cdc_stream_versioned(spark, sf_dir):
    store = _stream_into(spark, sf_dir, CUSTOMERS, customer_log(spark, sf_dir), versioned=True)
    return current_view(store.read(CUSTOMERS.name), ["c_custkey"]).drop("updated_at", "_seq")


# -- several batches ----------------------------------------------------------------------------


def _appended(spark, sf_dir, spec, log, batches, **build):
    """A mart with the records of the log appended in batches, told by conditions; the first two are folded together."""
    kept = appended_mart(spark, spec.name, spec)
    kept.build(catalog(spark, sf_dir, **build))
    for k, batch in enumerate(batches):
        kept(log.where(batch).select("value"), k)
        if k == 1:
            kept.compact(2)
    return kept


# Every batch has records that come before some of the batch before it.
_THIRDS = ["seq % 3 = 2", "seq % 3 = 0", "seq % 3 = 1"]


@query(_FOLDED_SQL.format(where="") + _APPLIED_SQL)
def cdc_merge_on_read(spark, sf_dir):
    return _appended(spark, sf_dir, CUSTOMERS, customer_log(spark, sf_dir), _THIRDS).read()


@query(_FOLDED_SQL.format(where="WHERE event_type <> 'error'") + _APPLIED_SQL + _NULL_KEYS_SQL)
def cdc_merge_on_read_null_keys(spark, sf_dir):
    return _appended(spark, sf_dir, CUSTOMERS, customer_log(spark, sf_dir, null_key="error"), _THIRDS).read()


@query("""
WITH m AS (SELECT o_orderkey, o_totalprice, c_custkey AS customer_id, c_name, c_acctbal
           FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT user_id, arg_max_null(value, event_id) AS b FROM events GROUP BY user_id)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.5 ELSE m.o_totalprice END AS o_totalprice, customer_id, c_name,
       CASE WHEN user_id IS NULL THEN c_acctbal ELSE b END AS c_acctbal
FROM m JOIN orders USING (o_orderkey) LEFT JOIN f ON customer_id = user_id
UNION ALL SELECT NULL, NULL, user_id, NULL, b FROM f WHERE user_id NOT IN (SELECT customer_id FROM m)
""")
def cdc_merge_on_read_two_tables(spark, sf_dir):
    """Changes of orders, of one row each, and of customers, of all their orders, mixed over three batches."""
    events, orders = read(spark, sf_dir, "events"), read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    always = F.lit(True)
    balance = _after((always, "c_custkey", F.col("user_id")), (always, "c_acctbal", F.col("value")))
    price = _after((always, "o_orderkey", F.col("o_orderkey")), (always, "o_totalprice", F.lit(1.5)))
    log = envelopes(events, balance, "customer").union(envelopes(orders, price, "orders", seq="o_orderkey"))
    return _appended(spark, sf_dir, ORDER_CUSTOMERS, log, _THIRDS).read()


@query(
    _FOLDED_SQL.format(where="")
    + f", applied AS ({_APPLIED_SQL}) SELECT split, applied.* FROM applied, (VALUES ('halves'), ('thirds')) AS s(split)"
)
def cdc_batch_borders(spark, sf_dir):
    """One log cut into batches in two ways, late records in both; the marts are equal."""
    log = customer_log(spark, sf_dir).persist()
    ways = {"halves": ["seq % 2 = 1", "seq % 2 = 0"], "thirds": _THIRDS}
    marts = []
    for way, batches in ways.items():
        store = TableStore(spark, scratch_path(spark, f"borders-{way}"))
        registry = Registry(store)
        registry.add(CUSTOMERS)
        build_mart(store, CUSTOMERS, catalog(spark, sf_dir), buckets=4)
        applier = ChangeApplier(store, registry)
        for k, batch in enumerate(batches):
            applier(log.where(batch).select("value"), k)
        marts.append(store.read(CUSTOMERS.name).withColumn("split", F.lit(way)))
    log.unpersist()
    return marts[0].unionByName(marts[1])


@query(_FOLDED_SQL.format(where="") + _APPLIED_SQL)
def cdc_stream_appended(spark, sf_dir):
    """The log streamed from files in several batches into an appended mart."""
    kept = appended_mart(spark, CUSTOMERS.name, CUSTOMERS)
    kept.build(catalog(spark, sf_dir))
    customer_log(spark, sf_dir).select("value").repartition(2).write.text(f"{kept.root}/log")
    apply_stream(spark, change_log.read_files(spark, f"{kept.root}/log", per_trigger=1), kept, f"{kept.root}/checkpoint")
    return kept.read()
