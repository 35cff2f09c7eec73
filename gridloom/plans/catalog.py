"""Catalog joins, schema changes, versions and quality checks."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from gridloom.operators import catalog as K
from gridloom.operators import evolve as E
from gridloom.operators import quality as L
from gridloom.operators import versions as V
from gridloom.operators.keys import assign_ids
from gridloom.plans.registry import NOW, USER, plan, table

_STAMP = f"TIMESTAMP '{NOW}'"

# --- catalog -----------------------------------------------------------------------


@plan(
    "tables_with_columns",
    """SELECT c_custkey AS id, c_name AS tbl_label, o_orderkey AS column_id,
              o_custkey AS tbl_id, o_orderstatus AS col_label
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'P'""",
)
def _(spark, sf):
    tables = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("tbl_label")
    )
    columns = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("tbl_id"),
        F.col("o_orderstatus").alias("col_label"),
    )
    return K.tables_with_columns(tables, columns.where(F.col("col_label") != "P"))


@plan(
    "columns_with_types",
    """SELECT c_custkey AS id, 'col_' || c_nationkey AS col_link, n_name AS type
       FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 0""",
)
def _(spark, sf):
    columns = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("col_"), F.col("c_nationkey").cast("string")).alias("col_link"),
    )
    types = table(spark, sf, "nation").where(F.col("n_regionkey") != 0).select(
        F.concat(F.lit("col_"), F.col("n_nationkey").cast("string")).alias("col_link"),
        F.col("n_name").alias("type"),
    )
    return K.columns_with_types(columns, types)


@plan(
    "find_across_schemas",
    """SELECT 'public' AS schema_name, s_suppkey AS id, s_name AS tbl_label FROM supplier
       UNION ALL
       SELECT 'published', c_custkey, c_name FROM customer
       WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""",
)
def _(spark, sf):
    published = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("tbl_label")
    )
    public = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("tbl_label")
    )
    schemas = {"published": published, "public": public}
    return K.find_across_schemas({s: schemas[s] for s in K.schema_order(["published", "public"])})


def _cascade(spark, sf):
    orders, lineitem = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    gone = orders.where(F.col("o_orderstatus") == "F").select("o_orderkey")
    return K.cascade_delete(orders, lineitem, gone, "o_orderkey", "l_orderkey")


@plan("cascade_delete_parents", "SELECT * FROM orders WHERE o_orderstatus <> 'F'")
def _(spark, sf):
    return _cascade(spark, sf)[0]


@plan(
    "cascade_delete",
    """SELECT * FROM lineitem
       WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def _(spark, sf):
    return _cascade(spark, sf)[1]


# --- schema changes ----------------------------------------------------------------


@plan("add_column", "SELECT *, CAST(NULL AS BIGINT) AS score FROM customer")
def _(spark, sf):
    return E.add_column(table(spark, sf, "customer"), "score", "long")


@plan("drop_column", "SELECT * EXCLUDE (c_acctbal) FROM customer")
def _(spark, sf):
    return E.drop_column(table(spark, sf, "customer"), "c_acctbal")


@plan(
    "rename_columns",
    "SELECT s_suppkey AS id, s_name AS label, s_nationkey, s_acctbal FROM supplier",
)
def _(spark, sf):
    return E.rename_columns(table(spark, sf, "supplier"), {"s_suppkey": "id", "s_name": "label"})


@plan(
    "change_column_type",
    """SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
              o_orderstatus, CAST(round_even(o_totalprice, 0) AS BIGINT) AS o_totalprice,
              CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority
       FROM orders""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders")
    changes = {
        "o_orderkey": "INTEGER",
        "o_custkey": "VARCHAR(20)",
        "o_totalprice": "BIGINT",
        "o_orderdate": "DATE",
    }
    for name, new_type in changes.items():
        rows = E.change_column_type(rows, name, new_type)
    return rows


@plan(
    "conversion_failures",
    "SELECT p_partkey, p_name FROM part WHERE length(p_name) > 10",
)
def _(spark, sf):
    return E.conversion_failures(table(spark, sf, "part"), "p_name", "varchar(10)", ["p_partkey"])


@plan(
    "backfill_default",
    """SELECT d.doc_id, d.source, coalesce(l.quality, 1) AS quality, coalesce(l.toxic, 0) AS toxic
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def _(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "source")
    joined = documents.join(table(spark, sf, "labels"), "doc_id", "left")
    return E.backfill_default(joined, {"quality": 1, "toxic": 0})


# --- the customer table as a catalog of tables -------------------------------------

_TABLES_SQL = """
    SELECT c_custkey AS id, c_name AS tbl_label, 'tbl_' || c_custkey AS tbl_link,
           1 AS version_no, c_mktsegment AS add_usr,
           CAST(NULL AS VARCHAR) AS upd_usr, CAST(NULL AS TIMESTAMP) AS upd_ts
    FROM customer"""


def _tables(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("tbl_label"),
        F.concat(F.lit("tbl_"), F.col("c_custkey").cast("string")).alias("tbl_link"),
        F.lit(1).alias("version_no"),
        F.col("c_mktsegment").alias("add_usr"),
        F.lit(None).cast("string").alias("upd_usr"),
        F.lit(None).cast("timestamp_ntz").alias("upd_ts"),
    )


@plan(
    "rename_label",
    f"""SELECT id, CASE WHEN add_usr = 'BUILDING' THEN tbl_label || ' (old)' ELSE tbl_label END
                   AS tbl_label, tbl_link, version_no, add_usr,
               CASE WHEN add_usr = 'BUILDING' THEN '{USER}' END AS upd_usr,
               CASE WHEN add_usr = 'BUILDING' THEN {_STAMP} END AS upd_ts
        FROM ({_TABLES_SQL})""",
)
def _(spark, sf):
    chosen = F.col("add_usr") == "BUILDING"
    label = F.concat("tbl_label", F.lit(" (old)"))
    return E.rename_label(_tables(spark, sf), chosen, label, USER, NOW)


@plan(
    "version_swap",
    f"""SELECT id, tbl_label, coalesce('new_' || s_suppkey, tbl_link) AS tbl_link,
               CASE WHEN s_suppkey IS NULL THEN 1 ELSE 2 END AS version_no, add_usr,
               CASE WHEN s_suppkey IS NOT NULL THEN '{USER}' END AS upd_usr,
               CASE WHEN s_suppkey IS NOT NULL THEN {_STAMP} END AS upd_ts
        FROM ({_TABLES_SQL}) LEFT JOIN supplier ON s_suppkey = id""",
)
def _(spark, sf):
    links = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit("new_"), F.col("s_suppkey").cast("string")).alias("new_link"),
    )
    return V.swap_links(_tables(spark, sf), links, USER, NOW)


@plan(
    "metadata_backup",
    f"SELECT *, {_STAMP} AS backup_ts FROM ({_TABLES_SQL}) WHERE add_usr = 'MACHINERY'",
)
def _(spark, sf):
    return V.backup_rows(_tables(spark, sf), F.col("add_usr") == "MACHINERY", NOW)


# Orders are the columns of both schemas, under other labels; the catalog ids of a table
# differ between the two, and customers of two segments are the tables copied.
@plan(
    "sync_columns",
    """WITH ids AS (SELECT c_custkey AS source_id, c_custkey + 5 AS target_id FROM customer
                    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
       kept AS (SELECT o_orderkey AS id, o_custkey AS tbl_id, 'old' AS tbl_link,
                       o_orderpriority AS col_label
                FROM orders WHERE o_custkey NOT IN (SELECT target_id FROM ids))
       SELECT * FROM kept
       UNION ALL
       SELECT (SELECT max(id) FROM kept) + row_number() OVER (ORDER BY target_id, o_orderkey),
              target_id, 'link_' || target_id, o_orderpriority || o_orderkey
       FROM orders JOIN ids ON o_custkey = source_id""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    ids = table(spark, sf, "customer").where(
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    )
    target_id = F.col("c_custkey") + 5
    ids = ids.select(
        F.col("c_custkey").alias("source_id"),
        target_id.alias("target_id"),
        F.concat(F.lit("link_"), target_id.cast("string")).alias("new_link"),
    )
    target = orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("tbl_id"),
        F.lit("old").alias("tbl_link"),
        F.col("o_orderpriority").alias("col_label"),
    )
    source = orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("tbl_id"),
        F.lit("old").alias("tbl_link"),
        F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("col_label"),
    )
    synced = V.sync_columns(target, source, ids)
    kept, fresh = synced.where(F.col("id").isNotNull()), synced.where(F.col("id").isNull())
    order = [F.col("tbl_id"), _order_key(F.col("col_label"))]
    return kept.unionByName(assign_ids(fresh, kept, order, "id"))


def _order_key(label):
    """The order number at the end of a column label."""
    return F.regexp_extract(label, r"[A-Z]([0-9]+)$", 1).cast("bigint")


_BACKUPS_SQL = """
    SELECT o_custkey AS id, 'label ' || o_orderkey AS tbl_label, 'tbl_' || o_orderkey AS tbl_link,
           7 AS version_no, o_orderpriority AS add_usr, o_orderstatus AS upd_usr,
           o_orderdate AS upd_ts,
           o_orderdate + to_microseconds(o_orderkey) AS backup_ts
    FROM orders"""


def _backups(spark, sf):
    orders = table(spark, sf, "orders")
    tick = F.expr("make_dt_interval(0, 0, 0, CAST(o_orderkey AS DECIMAL(18,6)) / 1000000)")
    key = F.col("o_orderkey").cast("string")
    return orders.select(
        F.col("o_custkey").alias("id"),
        F.concat(F.lit("label "), key).alias("tbl_label"),
        F.concat(F.lit("tbl_"), key).alias("tbl_link"),
        F.lit(7).alias("version_no"),
        F.col("o_orderpriority").alias("add_usr"),
        F.col("o_orderstatus").alias("upd_usr"),
        F.col("o_orderdate").alias("upd_ts"),
        (F.col("o_orderdate") + tick).alias("backup_ts"),
    )


@plan(
    "rollback_version",
    f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY backup_ts DESC) AS rn
                   FROM ({_BACKUPS_SQL}))
        SELECT t.id, coalesce(b.tbl_label, t.tbl_label) AS tbl_label,
               coalesce(b.tbl_link, t.tbl_link) AS tbl_link,
               coalesce(b.version_no, t.version_no) AS version_no,
               coalesce(b.add_usr, t.add_usr) AS add_usr,
               coalesce(b.upd_usr, t.upd_usr) AS upd_usr, coalesce(b.upd_ts, t.upd_ts) AS upd_ts
        FROM ({_TABLES_SQL}) t LEFT JOIN b ON b.id = t.id AND b.rn = 1""",
)
def _(spark, sf):
    return V.rollback_tables(_tables(spark, sf), _backups(spark, sf))


# NULL keys and NULL times take part: a key of their own, and older than any other time.
_DIRTY_ORDERS_SQL = """
    SELECT * REPLACE (
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate) FROM orders"""


@plan(
    "retain_last_versions",
    f"""SELECT * EXCLUDE (rk) FROM (
           SELECT *, rank() OVER (
               PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST) AS rk
           FROM ({_DIRTY_ORDERS_SQL})) WHERE rk <= 5""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").withColumns(
        {
            "o_custkey": F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")),
            "o_orderdate": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")),
        }
    )
    return V.retain_last_versions(orders, ["o_custkey"], "o_orderdate")


@plan(
    "retain_last_snapshots",
    """SELECT * EXCLUDE (rk) FROM (
           SELECT *, dense_rank() OVER (
               PARTITION BY l_suppkey ORDER BY l_shipdate DESC NULLS LAST) AS rk
           FROM (SELECT * REPLACE (
               CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey,
               CASE WHEN l_suppkey % 3 = 0 AND l_linenumber > 1 THEN NULL ELSE l_shipdate END
                   AS l_shipdate) FROM lineitem)) WHERE rk <= 5""",
)
def _(spark, sf):
    hidden = (F.col("l_suppkey") % 3 == 0) & (F.col("l_linenumber") > 1)
    lineitem = table(spark, sf, "lineitem").withColumns(
        {
            "l_suppkey": F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey")),
            "l_shipdate": F.when(~hidden, F.col("l_shipdate")),
        }
    )
    return V.retain_last_snapshots(lineitem, ["l_suppkey"], "l_shipdate")


# --- data copies -------------------------------------------------------------------


@plan(
    "bulk_copy",
    """SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal,
              CAST(NULL AS VARCHAR) AS s_phone FROM supplier""",
)
def _(spark, sf):
    target = "s_suppkey bigint, s_name string, s_nationkey bigint, s_acctbal double, s_phone string"
    schema = spark.createDataFrame([], target).schema
    return V.bulk_copy(table(spark, sf, "supplier"), schema)


@plan("migrate_new", "SELECT * FROM customer")
def _(spark, sf):
    customer = table(spark, sf, "customer")
    return V.bulk_copy(customer, E.clone_structure(customer).schema)


def _source_and_target(spark, sf):
    """A source table with one more column and one other type than its older target."""
    lineitem = table(spark, sf, "lineitem")
    supplier = table(spark, sf, "supplier")
    target = supplier.withColumnRenamed("s_suppkey", "id")
    source = (
        lineitem.groupBy(F.col("l_partkey").alias("id"))
        .agg(
            F.min("l_returnflag").alias("s_name"),
            F.min("l_linenumber").cast("bigint").alias("s_nationkey"),
            F.max("l_extendedprice").alias("s_acctbal"),
            F.count(F.lit(1)).alias("returned"),
        )
    )
    return source, target


@plan(
    "migrate_shadow",
    """SELECT s_suppkey AS id, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal,
              CAST(NULL AS BIGINT) AS returned FROM supplier""",
)
def _(spark, sf):
    return V.migrate_shadow(*_source_and_target(spark, sf))


@plan(
    "migrate_shadow_merge",
    """WITH source AS (
           SELECT l_partkey AS id, min(l_returnflag) AS s_name,
                  CAST(min(l_linenumber) AS BIGINT) AS s_nationkey,
                  max(l_extendedprice) AS s_acctbal, count(*) AS returned
           FROM lineitem GROUP BY l_partkey)
       SELECT * FROM source
       UNION ALL
       SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier
       WHERE s_suppkey NOT IN (SELECT id FROM source)""",
)
def _(spark, sf):
    return V.migrate_shadow(*_source_and_target(spark, sf), merge_source=True)


# --- quality -----------------------------------------------------------------------


@plan(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS cnt FROM lineitem
       GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def _(spark, sf):
    return L.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@plan("distinct_ids", "SELECT DISTINCT l_orderkey FROM lineitem")
def _(spark, sf):
    return L.distinct_ids(table(spark, sf, "lineitem"), "l_orderkey")


# A flawed copy of orders: pending urgent ones are lost, finished urgent ones doubled.
_COPY_SQL = """
    SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')
    UNION ALL
    SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"""


def _copy(spark, sf):
    orders = table(spark, sf, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    status = F.col("o_orderstatus")
    kept = orders.where(~((status == "P") & urgent)).select("o_orderkey")
    return kept.unionByName(orders.where((status == "F") & urgent).select("o_orderkey"))


@plan(
    "missing_ids",
    f"SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN ({_COPY_SQL})",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return L.missing_ids(orders, _copy(spark, sf), "o_orderkey")


@plan(
    "integrity_report",
    f"""WITH tracked AS (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('P', 'O')),
        copy AS ({_COPY_SQL}),
        n AS (SELECT (SELECT count(*) FROM tracked) + 1000 AS expected_count,
                     (SELECT count(*) FROM copy) AS actual_count,
                     (SELECT count(*) FROM tracked) AS tracked_inserts,
                     (SELECT count(*) FROM tracked
                      WHERE o_orderkey NOT IN (SELECT * FROM copy)) AS missing_count,
                     (SELECT count(*) FROM (SELECT o_orderkey FROM copy GROUP BY 1
                      HAVING count(*) > 1)) AS duplicate_ids)
        SELECT *, missing_count > 0 AS data_loss, expected_count <> actual_count AS count_mismatch,
               missing_count = 0 AND expected_count = actual_count AS valid FROM n""",
)
def _(spark, sf):
    tracked = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("P", "O"))
    return L.integrity_report(1000, tracked, _copy(spark, sf), "o_orderkey")


@plan(
    "insert_stats",
    """SELECT count(*) AS total_inserts,
              count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-10 00:00:00') AS inserts_before,
              count(*) FILTER (WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00'
                  AND TIMESTAMP '2024-01-20 12:00:00') AS inserts_during,
              count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20 12:00:00') AS inserts_after
       FROM events""",
)
def _(spark, sf):
    start, end = datetime.datetime(2024, 1, 10), datetime.datetime(2024, 1, 20, 12)
    return L.insert_stats(table(spark, sf, "events"), "ts", start, end)


@plan(
    "domain_violations",
    """SELECT o_orderkey, 'status' AS rule FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
       UNION ALL
       SELECT o_orderkey, 'priority' FROM orders
       WHERE NOT regexp_full_match(o_orderpriority, '[a-zA-Z0-9_]+')
       UNION ALL
       SELECT o_orderkey, 'line break' FROM orders WHERE o_orderkey % 3 = 0""",
)
def _(spark, sf):
    broken = F.when(F.col("o_orderkey") % 3 == 0, "\n").otherwise("")
    rules = {
        "status": L.in_domain(F.col("o_orderstatus"), ["O", "F"]),
        "priority": L.is_label(F.col("o_orderpriority")),
        "line break": L.is_label(F.concat("o_orderstatus", broken)),
    }
    return L.violations(table(spark, sf, "orders"), ["o_orderkey"], rules)


@plan(
    "fk_violations",
    """SELECT l_orderkey, count(*) AS cnt FROM lineitem
       WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
       GROUP BY l_orderkey""",
)
def _(spark, sf):
    kept = table(spark, sf, "orders").where(F.col("o_orderstatus") != "P")
    return L.orphan_keys(table(spark, sf, "lineitem"), kept, "l_orderkey", "o_orderkey")


@plan(
    "unique_violations",
    "SELECT p_name, count(*) AS cnt FROM part GROUP BY p_name HAVING count(*) > 1",
)
def _(spark, sf):
    return L.duplicate_keys(table(spark, sf, "part"), ["p_name"])
