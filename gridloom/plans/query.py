"""Filter, sort, page, lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.names import is_identifier
from gridloom.operators import query as Q
from gridloom.operators.catalog import by_recent_touch, by_recent_update
from gridloom.operators.keys import with_positions
from gridloom.operators.paging import (
    order_columns,
    page,
    page_after,
    sort_model,
    total_order,
)
from gridloom.plans.registry import plan, table

_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@plan("filter_text", "SELECT * FROM customer WHERE c_mktsegment ILIKE '%mach%y%'")
def _(spark, sf):
    customer = table(spark, sf, "customer")
    return customer.where(Q.text_filter(F.col("c_mktsegment"), "mach%y"))


@plan(
    "filter_text_literal",
    "SELECT page_id, url FROM pages WHERE contains(lower(url), '?page=')",
)
def _(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return pages.where(Q.text_filter(F.col("url"), "?PAGE=", literal=True))


@plan(
    "filter_text_number_column",
    "SELECT o_orderkey, o_totalprice FROM orders "
    "WHERE CAST(o_orderkey AS VARCHAR) ILIKE '%42%'",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.where(Q.text_filter(F.col("o_orderkey"), "42"))


@plan("filter_number", "SELECT * FROM orders WHERE o_totalprice > 250000")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.where(Q.number_filter(F.col("o_totalprice"), "greaterThan", 250000.0))


LINE_FILTER = {
    "l_returnflag": {"filterType": "text", "type": "contains", "filter": "a"},
    "l_quantity": {"filterType": "number", "type": "greaterThan", "filter": 25.0},
    "l_discount": {"filterType": "number", "type": "lessThan", "filter": 0.05},
    "l_linestatus": {"filterType": "text", "type": "contains", "filter": ""},
    "l_shipdate": {"filterType": "date", "type": "equals", "filter": "1998-01-01"},
}


@plan(
    "filter_model",
    "SELECT * FROM lineitem "
    "WHERE l_returnflag ILIKE '%a%' AND l_quantity > 25 AND l_discount < 0.05",
)
def _(spark, sf):
    return Q.filter_model(table(spark, sf, "lineitem"), LINE_FILTER)


@plan("lookup_by_id", "SELECT * FROM orders WHERE o_orderkey = 742")
def _(spark, sf):
    return Q.lookup(table(spark, sf, "orders"), 742, "o_orderkey")


@plan(
    "lookup_first",
    "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1",
)
def _(spark, sf):
    customer = table(spark, sf, "customer")
    return Q.lookup_first(customer, "c_mktsegment", "BUILDING", "c_custkey")


@plan("exists_check", "SELECT count(*) > 0 AS found FROM customer WHERE c_name = 'Customer#000000042'")
def _(spark, sf):
    return Q.exists(table(spark, sf, "customer"), F.col("c_name") == "Customer#000000042")


@plan(
    "label_projection",
    """SELECT c_custkey AS "ID", c_name AS "CUSTOMER NAME", c_nationkey AS "NATION",
              c_acctbal AS "BALANCE", c_mktsegment AS "C_MKTSEGMENT",
              c_name AS "CREATED BY", c_mktsegment AS "UPDATED BY"
       FROM customer""",
)
def _(spark, sf):
    rows = table(spark, sf, "customer").withColumns(
        {"add_usr": F.col("c_name"), "upd_usr": F.col("c_mktsegment")}
    )
    labels = {"c_name": "Customer Name", "c_nationkey": "Nation", "c_acctbal": "Balance"}
    return Q.label_projection(rows.withColumnRenamed("c_custkey", "id"), labels)


@plan(
    "column_search",
    "SELECT p_partkey, p_name, p_type FROM part "
    "WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')",
)
def _(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return Q.column_search(part, "RING", ["p_name", "p_type"])


@plan(
    "identifier_check",
    """SELECT p_partkey,
              regexp_full_match(p_brand, '[a-zA-Z_][a-zA-Z0-9_]*') AS brand_ok,
              regexp_full_match(p_type, '[a-zA-Z_][a-zA-Z0-9_]*') AS type_ok,
              regexp_full_match(p_type || CASE WHEN p_partkey % 2 = 0 THEN chr(10) ELSE '' END,
                  '[a-zA-Z_][a-zA-Z0-9_]*') AS line_ok
       FROM part""",
)
def _(spark, sf):
    broken = F.when(F.col("p_partkey") % 2 == 0, "\n").otherwise("")
    return table(spark, sf, "part").select(
        "p_partkey",
        is_identifier(F.col("p_brand")).alias("brand_ok"),
        is_identifier(F.col("p_type")).alias("type_ok"),
        is_identifier(F.concat("p_type", broken)).alias("line_ok"),
    )


@plan("table_scan", "SELECT * FROM supplier")
def _(spark, sf):
    return table(spark, sf, "supplier")


@plan("row_count", "SELECT count(*) AS row_count FROM lineitem")
def _(spark, sf):
    return Q.row_count(table(spark, sf, "lineitem"))


@plan("table_stats", "SELECT count(*) AS row_count, CAST(6 AS BIGINT) AS column_count FROM orders")
def _(spark, sf):
    return Q.table_stats(table(spark, sf, "orders"))


_UNRANKED = "CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END"


def _orders_with_gaps(spark, sf):
    orders = table(spark, sf, "orders")
    known = F.col("o_orderpriority") != "4-NOT SPECIFIED"
    return orders.withColumn("o_orderpriority", F.when(known, F.col("o_orderpriority")))


_ORDER_SORT = [("o_orderpriority", "desc"), ("o_orderstatus", "asc")]


@plan(
    "sort_model",
    f"""SELECT * REPLACE ({_UNRANKED} AS o_orderpriority) FROM orders
        ORDER BY o_orderpriority DESC NULLS LAST, o_orderstatus, o_orderkey""",
)
def _(spark, sf):
    return sort_model(_orders_with_gaps(spark, sf), _ORDER_SORT, ["o_orderkey"])


@plan(
    "sort_positions",
    f"""SELECT o_orderkey, row_number() OVER (
            ORDER BY {_UNRANKED} DESC NULLS LAST, o_orderstatus, o_orderkey) - 1 AS position
        FROM orders""",
)
def _(spark, sf):
    order = order_columns(total_order(_ORDER_SORT, ["o_orderkey"]))
    rows = _orders_with_gaps(spark, sf).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return with_positions(rows, order, "position").select("o_orderkey", "position")


_LINE_ORDER = (
    "l_shipdate DESC NULLS LAST, l_extendedprice NULLS LAST, "
    "l_orderkey, l_linenumber, l_partkey, l_suppkey"
)
_LINE_SORT = [("l_shipdate", "desc"), ("l_extendedprice", "asc")]


@plan(
    "page",
    f"""SELECT * FROM (
            SELECT *, row_number() OVER (ORDER BY {_LINE_ORDER}) - 1 AS _position FROM lineitem)
        WHERE _position >= 1000 AND _position < 1100""",
)
def _(spark, sf):
    return page(table(spark, sf, "lineitem"), _LINE_SORT, _LINE_KEY, 1000, 1100)


@plan(
    "page_deep",
    f"""SELECT * FROM (
            SELECT *, row_number() OVER (ORDER BY {_LINE_ORDER}) - 1 AS _position FROM lineitem)
        WHERE _position >= (SELECT count(*) // 2 FROM lineitem)
          AND _position < (SELECT count(*) // 2 FROM lineitem) + 100""",
)
def _(spark, sf):
    lineitem = table(spark, sf, "lineitem")
    middle = lineitem.count() // 2
    return page(
        lineitem, _LINE_SORT, _LINE_KEY, middle, middle + 100, top_k_rows=5_000, sample_rows=2_000
    )


_ORDERS_BY_PRICE = """
    SELECT * FROM (
        SELECT *, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) - 1
            AS _position FROM orders)"""


@plan("page_wide", f"{_ORDERS_BY_PRICE} WHERE _position >= 500 AND _position < 9000")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return page(orders, [("o_totalprice", "desc")], ["o_orderkey"], 500, 9000, top_k_rows=1_000)


@plan("page_all", _ORDERS_BY_PRICE)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return page(orders, [("o_totalprice", "desc")], ["o_orderkey"], 0, 1 << 40, top_k_rows=1_000)


@plan(
    "page_after",
    """SELECT o_orderkey, o_totalprice, o_orderdate FROM orders
       WHERE o_totalprice < 250000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    last = (250000.0, (1 << 62))
    return page_after(orders, [("o_totalprice", "desc")], ["o_orderkey"], last, 100)


@plan(
    "page_total",
    "SELECT count(*) + 3 AS total FROM orders "
    "WHERE o_orderpriority ILIKE '%high%' AND o_totalprice > 100000",
)
def _(spark, sf):
    model = {
        "o_orderpriority": {"filterType": "text", "filter": "high"},
        "o_totalprice": {"filterType": "number", "type": "greaterThan", "filter": 100000.0},
    }
    return Q.page_total(table(spark, sf, "orders"), model, pending=3)


def _order_catalog(spark, sf):
    """Orders seen as catalog entries: only finished ones were ever updated."""
    closed = F.col("o_orderstatus") == "F"
    updated = F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("add_ts"),
        F.when(closed, updated).alias("upd_ts"),
    )


_CATALOG_SQL = """
    SELECT o_orderkey AS id, o_orderdate AS add_ts,
           CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAY END AS upd_ts
    FROM orders"""


@plan(
    "catalog_recent",
    f"SELECT * FROM ({_CATALOG_SQL}) ORDER BY upd_ts DESC NULLS LAST, add_ts DESC, id",
)
def _(spark, sf):
    return by_recent_update(_order_catalog(spark, sf))


@plan(
    "catalog_recent_coalesce",
    f"SELECT * FROM ({_CATALOG_SQL}) ORDER BY coalesce(upd_ts, add_ts) DESC, add_ts DESC, id",
)
def _(spark, sf):
    return by_recent_touch(_order_catalog(spark, sf))
