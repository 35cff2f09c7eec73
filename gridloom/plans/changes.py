"""Edits of the orders grid, kept as a change log, and whole-row changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.operators import changes as C
from gridloom.plans.registry import NOW, USER, plan, table
from gridloom.session import checkpointed

_STAMP = f"TIMESTAMP '{NOW}'"

# --- the grid and its log ----------------------------------------------------------

ORDERS_GRID_SQL = """
    SELECT o_orderkey AS id, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
           'loader' AS add_usr, o_orderdate AS add_ts,
           CAST(NULL AS VARCHAR) AS upd_usr, CAST(NULL AS TIMESTAMP) AS upd_ts
    FROM orders"""

_NAMES = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def orders_grid(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        *_NAMES,
        F.lit("loader").alias("add_usr"),
        F.col("o_orderdate").alias("add_ts"),
        F.lit(None).cast("string").alias("upd_usr"),
        F.lit(None).cast("timestamp_ntz").alias("upd_ts"),
    )


# The editor's session, step by step: which orders it touches (status, only or all but one
# priority), the operation, on the row itself or on a new one, the field, old and new value.
# Finished orders are re-prioritised (urgent ones twice, back to where they were; low ones
# to nothing) and re-priced. Pending ones are deleted; urgent ones among them come back, one
# edit while deleted and one after. Open ones get a copy as a new row, some edited, some
# withdrawn, some deleted again. "@" stands for a value of the order.
_STEP_NAMES = "step status only_prio not_prio op prefix field old_value new_value".split()
_STEPS = [
    ("F", None, "5-LOW", "update", "", "o_orderpriority", "@priority", "CLOSED"),
    ("F", "5-LOW", None, "update", "", "o_orderpriority", "@priority", None),
    ("F", "1-URGENT", None, "update", "", "o_orderpriority", "CLOSED", "@priority"),
    ("F", "2-HIGH", None, "update", "", "o_totalprice", "?", "99.5"),
    ("F", "3-MEDIUM", None, "update", "", "o_totalprice", "?", "a lot"),
    ("P", None, None, "update", "", "o_custkey", "@customer", "7"),
    ("P", None, None, "delete", "", None, None, None),
    ("P", "1-URGENT", None, "update", "", "o_custkey", "@customer", "8"),
    ("P", "1-URGENT", None, "undelete", "", None, None, None),
    ("P", "1-URGENT", None, "update", "", "o_orderpriority", "@priority", "REOPENED"),
    ("O", None, None, "insert", "temp_", None, None, None),
    ("O", None, None, "update", "temp_", "o_custkey", None, "@customer"),
    ("O", "3-MEDIUM", None, "update", "temp_", "o_custkey", "@customer", "9"),
    ("O", None, None, "update", "temp_", "o_orderstatus", None, "N"),
    ("O", "4-NOT SPECIFIED", None, "uninsert", "temp_", None, None, None),
    ("O", "2-HIGH", None, "delete", "temp_", None, None, None),
]
_NUMBERED_STEPS = [(k, *step) for k, step in enumerate(_STEPS)]


def _value(name: str) -> str:
    return (
        f"CASE {name} WHEN '@priority' THEN o_orderpriority "
        f"WHEN '@customer' THEN CAST(o_custkey AS VARCHAR(20)) ELSE {name} END AS {name}"
    )


_LOG_COLUMNS = [
    "o_orderkey * 100 + step AS seq",
    "op",
    "concat(prefix, CAST(o_orderkey AS VARCHAR(20))) AS row_id",
    "field",
    _value("old_value"),
    _value("new_value"),
]
_LOG_FILTER = (
    "(only_prio IS NULL OR only_prio = o_orderpriority) "
    "AND (not_prio IS NULL OR not_prio <> o_orderpriority)"
)


def orders_log(spark, sf) -> DataFrame:
    schema = "step bigint, " + ", ".join(f"{n} string" for n in _STEP_NAMES[1:])
    steps = F.broadcast(spark.createDataFrame(_NUMBERED_STEPS, schema))  # 16 rows
    orders = table(spark, sf, "orders").withColumn("status", F.col("o_orderstatus"))
    return orders.join(steps, "status").where(_LOG_FILTER).selectExpr(*_LOG_COLUMNS)


def _sql_row(values: tuple) -> str:
    cells = ("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in values)
    return f"({', '.join(cells)})"


ORDERS_LOG_SQL = f"""
    SELECT {', '.join(_LOG_COLUMNS)}
    FROM orders JOIN (VALUES {', '.join(map(_sql_row, _NUMBERED_STEPS))})
        AS steps({', '.join(_STEP_NAMES)}) ON status = o_orderstatus
    WHERE {_LOG_FILTER}"""

# Events as an edit log: users are rows, event types are fields or row operations. Values
# are coarse, so cells often return to where they started.
_EVENTS_LOG_SQL = """
    SELECT event_id AS seq,
           CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'undelete'
                ELSE 'update' END AS op,
           CAST(user_id AS VARCHAR) AS row_id, event_type AS field,
           CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS old_value,
           CAST(CAST(floor(value / 15) AS BIGINT) AS VARCHAR) AS new_value
    FROM events"""


def events_log(spark, sf) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.when(kind == "error", "delete")
        .when(kind == "signup", "undelete")
        .otherwise("update")
        .alias("op"),
        F.col("user_id").cast("string").alias("row_id"),
        kind.alias("field"),
        F.floor(F.col("value") / 20).cast("string").alias("old_value"),
        F.floor(F.col("value") / 15).cast("string").alias("new_value"),
    )


def _net_sql(log: str) -> str:
    """SQL for the net changes of a log, walking each row's entries in order."""
    marks = "PARTITION BY row_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
        WITH log AS ({log}),
        walked AS (
            SELECT *,
                coalesce(last_value(CASE op WHEN 'delete' THEN true WHEN 'undelete' THEN false END
                    IGNORE NULLS) OVER ({marks}), false) AS deleted,
                coalesce(last_value(CASE op WHEN 'insert' THEN true WHEN 'uninsert' THEN false END
                    IGNORE NULLS) OVER ({marks}), false) AS inserted,
                coalesce(max(CASE WHEN op = 'delete' THEN seq END)
                    OVER (PARTITION BY row_id), -1) AS last_delete,
                coalesce(max(CASE WHEN op = 'undelete' THEN seq END)
                    OVER (PARTITION BY row_id), -1) AS last_undelete,
                coalesce(max(CASE WHEN op = 'uninsert' THEN seq END)
                    OVER (PARTITION BY row_id), -1) AS last_uninsert
            FROM log WHERE op <> 'update' OR old_value IS DISTINCT FROM new_value),
        sorted AS (
            SELECT *, CASE
                WHEN op = 'delete' AND seq = last_delete AND last_delete > last_undelete THEN 'delete'
                WHEN (op = 'insert' OR (op = 'update' AND inserted AND NOT deleted))
                    AND seq > last_uninsert THEN 'insert'
                WHEN op = 'update' AND NOT inserted AND NOT deleted AND seq > last_delete
                    THEN 'update' END AS kind
            FROM walked)
        SELECT min(seq) AS seq, kind AS op, row_id, field,
               CASE WHEN kind = 'update' THEN first(old_value ORDER BY seq) END AS old_value,
               last(new_value ORDER BY seq) AS new_value
        FROM sorted WHERE kind IS NOT NULL GROUP BY kind, row_id, field
        HAVING kind <> 'update' OR first(old_value ORDER BY seq)
            IS DISTINCT FROM last(new_value ORDER BY seq)"""


ORDERS_NET_SQL = _net_sql(ORDERS_LOG_SQL)

# One row per changed row; has_x says whether column x is set at all.
_ROWS_SQL = f"""
    SELECT row_id, min(seq) AS seq,
           bool_or(op = 'insert') AS new_row, bool_or(op = 'delete') AS gone,
           bool_or(op = 'update') AS updated,
           {', '.join(f"bool_or(coalesce(op <> 'delete' AND field = '{c}', false)) AS has_{c}, "
                      f"max(CASE WHEN op <> 'delete' AND field = '{c}' THEN new_value END) AS {c}"
                      for c in _NAMES)}
    FROM ({ORDERS_NET_SQL}) GROUP BY row_id"""

_TYPES = {"o_custkey": "BIGINT", "o_totalprice": "DOUBLE"}


def _merged(name: str, condition: str) -> str:
    """SQL for a grid cell with its change laid over it."""
    new = f"n.{name}"
    given = f"n.has_{name} AND {condition}"
    if name in _TYPES:
        new = f"TRY_CAST(n.{name} AS {_TYPES[name]})"
        given += f" AND (n.{name} IS NULL OR {new} IS NOT NULL)"
    return f"CASE WHEN {given} THEN {new} ELSE g.{name} END AS {name}"


def _inserted(name: str) -> str:
    if name in _TYPES:
        return f"TRY_CAST({name} AS {_TYPES[name]}) AS {name}"
    return name


@plan("compact_changes", _net_sql(_EVENTS_LOG_SQL))
def _(spark, sf):
    return C.compact_changes(events_log(spark, sf), seq_run=1_000)


@plan("compact_orders_log", ORDERS_NET_SQL)
def _(spark, sf):
    return C.compact_changes(orders_log(spark, sf))


@plan(
    "changes_summary",
    f"""SELECT count(*) FILTER (WHERE op = 'insert') AS inserts,
               count(*) FILTER (WHERE op = 'update') AS updates,
               count(*) FILTER (WHERE op = 'delete') AS deletes, count(*) AS total
        FROM (SELECT DISTINCT op, row_id FROM ({ORDERS_NET_SQL}))""",
)
def _(spark, sf):
    return C.changes_summary(C.compact_changes(orders_log(spark, sf)))


@plan(
    "invalid_changes",
    f"""SELECT *, 'not parsed' AS reason FROM ({ORDERS_NET_SQL})
        WHERE field = 'o_totalprice' AND TRY_CAST(new_value AS DOUBLE) IS NULL""",
)
def _(spark, sf):
    net = C.compact_changes(orders_log(spark, sf))
    return C.invalid_changes(net, orders_grid(spark, sf))


@plan(
    "overlay_updates",
    f"""SELECT g.id, {', '.join(_merged(c, 'n.updated AND NOT n.gone') for c in _NAMES)},
               g.add_usr, g.add_ts, g.upd_usr, g.upd_ts
        FROM ({ORDERS_GRID_SQL}) g LEFT JOIN ({_ROWS_SQL}) n ON n.row_id = CAST(g.id AS VARCHAR)""",
)
def _(spark, sf):
    net = C.compact_changes(orders_log(spark, sf))
    return C.overlay_updates(orders_grid(spark, sf), net)


_PREVIEW_SQL = f"""
    SELECT CAST(g.id AS VARCHAR) AS id,
           {', '.join(_merged(c, 'n.updated AND NOT n.gone') for c in _NAMES)},
           g.add_usr, g.add_ts, g.upd_usr, g.upd_ts,
           CASE WHEN n.gone THEN 'deleted' WHEN n.updated THEN 'updated' ELSE 'stored'
           END AS row_state
    FROM ({ORDERS_GRID_SQL}) g LEFT JOIN ({_ROWS_SQL}) n ON n.row_id = CAST(g.id AS VARCHAR)
    UNION ALL
    SELECT row_id, {', '.join(_inserted(c) for c in _NAMES)}, NULL, NULL, NULL, NULL,
           CASE WHEN gone THEN 'deleted' ELSE 'inserted' END
    FROM ({_ROWS_SQL}) WHERE new_row"""


@plan("overlay_preview", _PREVIEW_SQL)
def _(spark, sf):
    net = C.compact_changes(orders_log(spark, sf))
    return C.overlay_preview(orders_grid(spark, sf), net)


# The page holds the last new rows and the first stored rows.
@plan(
    "page_overlay",
    f"""WITH fresh AS (
            SELECT row_id AS id, {', '.join(_inserted(c) for c in _NAMES)},
                   CAST(NULL AS VARCHAR) AS add_usr, CAST(NULL AS TIMESTAMP) AS add_ts,
                   CAST(NULL AS VARCHAR) AS upd_usr, CAST(NULL AS TIMESTAMP) AS upd_ts,
                   row_number() OVER (ORDER BY seq) - 1 AS _position
            FROM ({_ROWS_SQL}) WHERE new_row),
        stored AS (
            SELECT CAST(g.id AS VARCHAR) AS id,
                   {', '.join(_merged(c, 'n.updated AND NOT n.gone') for c in _NAMES)},
                   g.add_usr, g.add_ts, g.upd_usr, g.upd_ts,
                   (SELECT count(*) FROM fresh)
                   + row_number() OVER (ORDER BY g.o_totalprice DESC, g.id) - 1 AS _position
            FROM ({ORDERS_GRID_SQL}) g
            LEFT JOIN ({_ROWS_SQL}) n ON n.row_id = CAST(g.id AS VARCHAR)
            WHERE g.o_orderpriority NOT ILIKE '%low%')
        SELECT * FROM (SELECT * FROM fresh UNION ALL SELECT * FROM stored)
        WHERE _position >= (SELECT count(*) FROM fresh) - 50
          AND _position < (SELECT count(*) FROM fresh) + 150""",
)
def _(spark, sf):
    grid = orders_grid(spark, sf)
    net = C.checkpointed(C.compact_changes(orders_log(spark, sf)))
    fresh = C.changes_summary(net).first()["inserts"]
    kept = grid.where(~F.col("o_orderpriority").ilike("%low%"))
    return C.overlay_page(
        kept, net, [("o_totalprice", "desc")], start=fresh - 50, end=fresh + 150
    )


def _applied_sql() -> str:
    rows = [_merged(c, "n.updated AND NOT n.gone AND NOT n.new_row") for c in _NAMES]
    touched = "n.updated AND NOT n.gone AND NOT n.new_row"
    return f"""
        SELECT g.id, {', '.join(rows)}, g.add_usr, g.add_ts,
               CASE WHEN {touched} THEN '{USER}' ELSE g.upd_usr END AS upd_usr,
               CASE WHEN {touched} THEN {_STAMP} ELSE g.upd_ts END AS upd_ts
        FROM ({ORDERS_GRID_SQL}) g LEFT JOIN ({_ROWS_SQL}) n ON n.row_id = CAST(g.id AS VARCHAR)
        WHERE NOT coalesce(n.gone, false)
        UNION ALL
        SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY seq, row_id),
               {', '.join(_inserted(c) for c in _NAMES)},
               '{USER}', {_STAMP}, '{USER}', {_STAMP}
        FROM ({_ROWS_SQL}) WHERE new_row AND NOT gone"""


@plan("apply_changes", _applied_sql())
def _(spark, sf):
    return C.apply_changes(orders_grid(spark, sf), orders_log(spark, sf), USER, NOW)


# --- whole rows --------------------------------------------------------------------


@plan(
    "insert_rows",
    f"""SELECT * FROM ({ORDERS_GRID_SQL})
        UNION ALL
        SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY o_orderkey),
               o_custkey, 'N', NULL, o_orderpriority, '{USER}', {_STAMP}, '{USER}', {_STAMP}
        FROM orders WHERE o_orderstatus = 'O'""",
)
def _(spark, sf):
    is_open = table(spark, sf, "orders").where(F.col("o_orderstatus") == "O")
    new = is_open.select(
        "o_custkey",
        F.lit("N").alias("o_orderstatus"),
        "o_orderpriority",
        F.lit("somebody").alias("add_usr"),
        F.col("o_orderkey").alias("id"),
    )
    return C.insert_rows(orders_grid(spark, sf), new, USER, NOW, [F.col("id").asc()])


def _updates(spark, sf):
    finished = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    low = F.col("o_orderpriority") == "5-LOW"
    return finished.select(
        F.col("o_orderkey").alias("id"),
        F.when(~low, F.lit("CLOSED")).alias("o_orderpriority"),
        F.lit("somebody").alias("add_usr"),
    )


@plan(
    "update_rows",
    f"""SELECT id, o_custkey, o_orderstatus, o_totalprice,
               CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority
                    WHEN o_orderpriority <> '5-LOW' THEN 'CLOSED' END AS o_orderpriority,
               add_usr, add_ts,
               CASE WHEN o_orderstatus = 'F' THEN '{USER}' END AS upd_usr,
               CASE WHEN o_orderstatus = 'F' THEN {_STAMP} END AS upd_ts
        FROM ({ORDERS_GRID_SQL})""",
)
def _(spark, sf):
    return C.update_rows(orders_grid(spark, sf), _updates(spark, sf), USER, NOW)


@plan(
    "missing_updates",
    """SELECT id, status FROM (SELECT o_orderkey * 2 AS id, o_orderstatus AS status FROM orders)
       WHERE id NOT IN (SELECT o_orderkey FROM orders)""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    updates = orders.select(
        (F.col("o_orderkey") * 2).alias("id"), F.col("o_orderstatus").alias("status")
    )
    return C.missing_updates(orders_grid(spark, sf), updates)


@plan(
    "delete_rows",
    f"""SELECT * FROM ({ORDERS_GRID_SQL})
        WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""",
)
def _(spark, sf):
    big = table(spark, sf, "lineitem").where(F.col("l_quantity") > 45)
    return C.delete_rows(orders_grid(spark, sf), big.select(F.col("l_orderkey").alias("id")))


# The source repeats keys and has rows without one.
_SUPPLIER_AS_CUSTOMER_SQL = """
    SELECT s_suppkey * 20 AS c_custkey, s_name AS c_name, s_acctbal AS c_acctbal FROM supplier
    UNION ALL
    SELECT s_suppkey * 20, s_name || ' again', -s_acctbal FROM supplier WHERE s_suppkey % 2 = 0
    UNION ALL
    SELECT NULL, s_name, s_acctbal FROM supplier WHERE s_suppkey % 4 = 0"""


def _one_per_key_sql(direction: str) -> str:
    return f"""
    SELECT c_custkey, c_name, c_acctbal FROM (
        SELECT *, row_number() OVER (
            PARTITION BY c_custkey ORDER BY c_name {direction}, c_acctbal {direction}) AS nth
        FROM ({_SUPPLIER_AS_CUSTOMER_SQL})) WHERE nth = 1 OR c_custkey IS NULL"""


def _supplier_as_customer(spark, sf):
    supplier = table(spark, sf, "supplier")
    key, name, balance = F.col("s_suppkey") * 20, F.col("s_name"), F.col("s_acctbal")
    names = ["c_custkey", "c_name", "c_acctbal"]
    again = supplier.where(F.col("s_suppkey") % 2 == 0)
    keyless = supplier.where(F.col("s_suppkey") % 4 == 0)
    return (
        supplier.select(key, name, balance)
        .union(again.select(key, F.concat(name, F.lit(" again")), -balance))
        .union(keyless.select(F.lit(None).cast("long"), name, balance))
        .toDF(*names)
    )


@plan(
    "upsert",
    f"""SELECT coalesce(c.c_custkey, s.c_custkey) AS c_custkey,
               CASE WHEN s.c_name IS NOT NULL THEN s.c_name ELSE c.c_name END AS c_name,
               c.c_nationkey,
               CASE WHEN s.c_name IS NOT NULL THEN s.c_acctbal ELSE c.c_acctbal END AS c_acctbal,
               c.c_mktsegment
        FROM customer c FULL JOIN ({_one_per_key_sql("DESC")}) s ON c.c_custkey = s.c_custkey""",
)
def _(spark, sf):
    source = _supplier_as_customer(spark, sf)
    return C.upsert(table(spark, sf, "customer"), source, "c_custkey", ["c_name"])


@plan(
    "insert_if_absent",
    f"""SELECT c_custkey, c_name, c_acctbal FROM customer
        UNION ALL
        SELECT * FROM ({_one_per_key_sql("")}) s
        WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = s.c_custkey)""",
)
def _(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return C.insert_if_absent(customer, _supplier_as_customer(spark, sf), "c_custkey", ["c_name"])


@plan(
    "replace_rows",
    """SELECT * FROM part WHERE p_size <= 25
       UNION ALL
       SELECT p_partkey, upper(p_name), p_brand, 'REPLACED', p_size, NULL FROM part
       WHERE p_size > 25""",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    rows = part.where(F.col("p_size") > 25).withColumns(
        {
            "p_name": F.upper("p_name"),
            "p_type": F.lit("REPLACED"),
            "p_retailprice": F.lit(None).cast("double"),
        }
    )
    return C.replace_rows(part, rows, "p_partkey")


@plan(
    "replay_changes",
    """WITH last AS (
           SELECT user_id, arg_max(event_type, event_id) AS event_type,
                  arg_max(value, event_id) AS value
           FROM events GROUP BY user_id)
       SELECT c_custkey AS id, 'none' AS event_type, c_acctbal AS value FROM customer
       WHERE c_custkey NOT IN (SELECT user_id FROM last)
       UNION ALL
       SELECT user_id, event_type, value FROM last WHERE event_type <> 'error'""",
)
def _(spark, sf):
    base = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.lit("none").alias("event_type"),
        F.col("c_acctbal").alias("value"),
    )
    kind = F.col("event_type")
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.when(kind == "error", "delete").when(kind == "signup", "insert").otherwise("update").alias("op"),
        F.col("user_id").alias("id"),
        "event_type",
        "value",
    )
    return C.replay_images(base, events)


@plan(
    "sync_late_events",
    """WITH last AS (
           SELECT user_id, arg_max(event_type, event_id) AS event_type,
                  arg_max(value, event_id) AS value, max(event_id) AS seq
           FROM events GROUP BY user_id)
       SELECT c_custkey AS id, 'none' AS event_type, c_acctbal AS value,
              CAST(0 AS BIGINT) AS seq FROM customer
       WHERE c_custkey NOT IN (SELECT user_id FROM last)
       UNION ALL
       SELECT user_id, event_type, value, seq FROM last WHERE event_type <> 'error'""",
)
def _(spark, sf):
    # All events in four batches, each with old and new ones; one is sent again. After two
    # batches the deltas are folded in.
    columns = [F.col("c_custkey").alias("id"), F.lit("none").alias("event_type"), F.col("c_acctbal").alias("value")]
    state = table(spark, sf, "customer").select(
        *columns, F.lit(None).cast("long").alias(C.SEQ), F.lit(False).alias(C.GONE)
    )
    kind = F.col("event_type")
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.when(kind == "error", "delete").otherwise("update").alias("op"),
        F.col("user_id").alias("id"),
        "event_type",
        "value",
        F.pmod(F.xxhash64("event_id"), F.lit(4)).alias("batch"),
    )
    images = [C.event_images(events.where(F.col("batch") == n).drop("batch")) for n in (3, 1, 2, 0, 2)]
    folded = checkpointed(C.merge_images(state, images[0].unionByName(images[1])))
    late = images[2].unionByName(images[3]).unionByName(images[4])
    rows = C.merge_images(folded, late)
    seq = F.coalesce(C.SEQ, F.lit(0)).alias("seq")
    return rows.where(~F.col(C.GONE)).select("id", "event_type", "value", seq)
