"""Text rows to typed rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from gridloom.functions.names import normalize_headers
from gridloom.functions.types import field_of
from gridloom.operators import changes as C
from gridloom.operators import ingest as I
from gridloom.operators.lengths import length_rejects
from gridloom.operators.paging import page
from gridloom.operators.query import filter_model
from gridloom.plans.registry import plan, table
from gridloom.sources.arrow import from_ipc, to_ipc
from gridloom.session import ensure_checkpoint_dir
from gridloom.sources.csv import csv_lines, parse_lines, read_csv, write_csv


def _clean(column: str) -> str:
    """SQL for the cell clean-up rule."""
    text = rf"regexp_replace({column}, '^[\x01-\x20]+|[\x01-\x20]+$', '', 'g')"
    return f"CASE WHEN {text} <> '' AND lower({text}) <> 'null' THEN {text} END"


def _as_text(df):
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


# --- CSV ---------------------------------------------------------------------------


@plan(
    "csv_scan",
    f"""SELECT doc_id, {_clean('text')} AS text, {_clean('lang')} AS lang,
               {_clean('source')} AS source, n_chars FROM documents""",
)
def _(spark, sf):
    documents = table(spark, sf, "documents")
    cells = parse_lines(csv_lines(documents), "line", documents.columns)
    types = {"doc_id": "BIGINT", "text": "TEXT", "lang": "TEXT", "source": "TEXT", "n_chars": "BIGINT"}
    return I.parse_typed(cells, types)


@plan(
    "csv_file_round_trip",
    """SELECT CAST(doc_id AS VARCHAR) AS id, text, source FROM documents
       UNION ALL SELECT CAST(page_id AS VARCHAR), html, url FROM pages""",
)
def _(spark, sf):
    """Through files, line breaks in quotes included."""
    documents = table(spark, sf, "documents").selectExpr("doc_id AS id", "text", "source")
    pages = table(spark, sf, "pages").selectExpr("page_id AS id", "html AS text", "url AS source")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    write_csv(documents.union(pages), folder)
    return read_csv(spark, folder)


@plan(
    "csv_export",
    """SELECT c_custkey || ',' || c_name || ',' || c_nationkey || ',' || c_acctbal || ','
              || c_mktsegment AS line FROM customer""",
)
def _(spark, sf):
    return csv_lines(table(spark, sf, "customer"))


@plan(
    "csv_export_quoted",
    """SELECT page_id, page_id || ',' ||
              CASE WHEN contains(url, ',') OR contains(url, '"') OR contains(url, chr(10))
                   THEN '"' || replace(url, '"', '""') || '"' ELSE url END || ',' ||
              '"' || replace(html, '"', '""') || '"' AS line
       FROM pages""",
)
def _(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return csv_lines(pages, keep=["page_id"])


@plan("arrow_export", "SELECT * FROM lineitem")
def _(spark, sf):
    lineitem = table(spark, sf, "lineitem")
    return from_ipc(to_ipc(lineitem), lineitem.schema)


@plan(
    "csv_header_normalize",
    """SELECT c_custkey AS "Cust_Key", c_name AS column_2, c_nationkey AS "Nation__no__",
              c_acctbal AS balance, c_mktsegment AS "BALANCE_2" FROM customer""",
)
def _(spark, sf):
    raw = [" Cust \t Key ", "  ", "Nation (no.)", "balance", "BALANCE"]
    return table(spark, sf, "customer").toDF(*normalize_headers(raw))


@plan("csv_select_columns", "SELECT l_shipdate, l_orderkey, l_extendedprice FROM lineitem")
def _(spark, sf):
    return I.select_by_index(table(spark, sf, "lineitem"), [10, 0, 5])


# --- cells -------------------------------------------------------------------------

_MESSY_SQL = """
    SELECT doc_id,
           chr(9) || '  ' || text || chr(10) AS text,
           CASE lang WHEN 'de' THEN ' NuLL ' WHEN 'es' THEN '   ' ELSE lang END AS lang,
           ' ' || source || ' ' AS source
    FROM documents"""


def _messy(spark, sf):
    lang = F.col("lang")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("\t  "), "text", F.lit("\n")).alias("text"),
        F.when(lang == "de", " NuLL ").when(lang == "es", "   ").otherwise(lang).alias("lang"),
        F.concat(F.lit(" "), "source", F.lit(" ")).alias("source"),
    )


@plan(
    "normalize_cells",
    f"""SELECT doc_id, {_clean('text')} AS text, {_clean('lang')} AS lang,
               {_clean('source')} AS source FROM ({_MESSY_SQL})""",
)
def _(spark, sf):
    return I.normalize_cells(_messy(spark, sf), ["text", "lang", "source"])


def _order_cells(spark, sf):
    """Orders as text cells, some in forms that must not parse."""
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(status == "F", "Yes").when(status == "O", "n").otherwise("maybe").alias("closed"),
        F.when(priority == "1-URGENT", F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
        .when(priority == "2-HIGH", F.concat(F.lit("+"), F.col("o_custkey").cast("string")))
        .otherwise(F.col("o_custkey").cast("string"))
        .alias("customer"),
        F.when(priority == "5-LOW", F.lit("n/a"))
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("price"),
        F.when(priority == "3-MEDIUM", F.date_format("o_orderdate", "yyyy/MM/dd"))
        .otherwise(day)
        .alias("day"),
        F.when(priority == "1-URGENT", F.concat(day, F.lit("T10:30:00+05:30")))
        .when(priority == "2-HIGH", F.concat(day, F.lit(" 10:30:00")))
        .when(priority == "3-MEDIUM", F.concat(day, F.lit("T10:30:00.250")))
        .otherwise(F.concat(day, F.lit("T10:30Z")))
        .alias("at"),
    )


@plan(
    "typed_parse",
    """SELECT o_orderkey,
              CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS closed,
              CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS customer,
              CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS price,
              CASE WHEN o_orderpriority <> '3-MEDIUM' THEN CAST(o_orderdate AS DATE) END AS day,
              CASE o_orderpriority
                   WHEN '2-HIGH' THEN NULL
                   WHEN '3-MEDIUM' THEN date_trunc('day', o_orderdate)
                        + INTERVAL 10 HOUR + INTERVAL 30 MINUTE + INTERVAL 250 MILLISECOND
                   ELSE date_trunc('day', o_orderdate) + INTERVAL 10 HOUR + INTERVAL 30 MINUTE
              END AS at
       FROM orders""",
)
def _(spark, sf):
    types = {
        "closed": "bool",
        "customer": "BIGINT",
        "price": "double",
        "day": "DATE",
        "at": "timestamp",
    }
    return I.parse_typed(_order_cells(spark, sf), types)


def _infer_sql(source: str, columns: list[str]) -> str:
    """SQL naming the narrowest type all cells of each column read as."""
    parts = []
    for i, c in enumerate(columns):
        v = f"({_clean(c)})"
        offset = "(Z|[+-][0-9]{2}(:?[0-9]{2})?)?"
        parts.append(
            f"""SELECT {i} AS position, '{c}' AS "column", CASE
                WHEN count({v}) = 0 THEN 'TEXT'
                WHEN bool_and(lower({v}) IN ('true','t','yes','y','1','false','f','no','n','0'))
                    THEN 'BOOLEAN'
                WHEN bool_and(regexp_full_match({v}, '[+-]?[0-9]+')
                    AND try_cast({v} AS BIGINT) IS NOT NULL) THEN 'BIGINT'
                WHEN bool_and(regexp_full_match({v},
                    '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')) THEN 'DECIMAL'
                WHEN bool_and(regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
                    AND try_cast({v} AS DATE) IS NOT NULL) THEN 'DATE'
                WHEN bool_and(regexp_full_match({v},
                    '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]{{1,9}})?)?{offset}'))
                    THEN 'TIMESTAMP'
                ELSE 'TEXT' END AS "type", count({v}) AS value_count FROM ({source})"""
        )
    return " UNION ALL ".join(parts)


_EVENT_TEXT = ["event_id", "ts", "user_id", "event_type", "value", "props", "flag", "nothing"]
_EVENT_TEXT_SQL = """
    SELECT CAST(event_id AS VARCHAR) AS event_id,
           replace(CAST(ts AS VARCHAR), ' ', 'T') AS ts,
           CAST(user_id AS VARCHAR) AS user_id, event_type, CAST(value AS VARCHAR) AS value,
           props, CASE WHEN event_type = 'error' THEN 'Y' WHEN event_type = 'click' THEN ' no '
                  ELSE 'null' END AS flag, ' ' AS nothing
    FROM events"""


def _event_text(spark, sf):
    kind = F.col("event_type")
    text = _as_text(table(spark, sf, "events"))
    return text.withColumn("ts", F.translate("ts", " ", "T")).withColumns(
        {
            "flag": F.when(kind == "error", "Y").when(kind == "click", " no ").otherwise("null"),
            "nothing": F.lit(" "),
        }
    )


@plan("infer_types", _infer_sql(_EVENT_TEXT_SQL, _EVENT_TEXT))
def _(spark, sf):
    return I.infer_types(_event_text(spark, sf).select(*_EVENT_TEXT), conservative=False)


@plan(
    "infer_types_text",
    " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS "column",
            'TEXT' AS "type", count({c}) AS value_count FROM customer"""
        for i, c in enumerate(["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    ),
)
def _(spark, sf):
    return I.infer_types(_as_text(table(spark, sf, "customer")))


@plan(
    "type_overrides",
    """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_totalprice,
              CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    text = _as_text(orders.withColumn("o_orderdate", F.to_date("o_orderdate")))
    inferred = ["TEXT"] * len(text.columns)
    types = I.apply_type_overrides(inferred, ["BIGINT", " ", None, " double", "DATE"])
    return I.parse_typed(text, dict(zip(text.columns, types)))


_LIMITED = {"text": "VARCHAR(1500)", "lang": "VARCHAR(2)", "source": "VARCHAR(5)"}


@plan(
    "varchar_rejects",
    " UNION ALL ".join(
        f"""SELECT doc_id, '{c}' AS "column", {c} AS raw_value, '{t}' AS target_type,
            'too long' AS reason FROM documents WHERE length({c}) > {t[8:-1]}"""
        for c, t in _LIMITED.items()
    ),
)
def _(spark, sf):
    """Texts longer than the columns of the table they are meant for take."""
    struct = T.StructType([field_of(c, t) for c, t in _LIMITED.items()])
    return length_rejects(table(spark, sf, "documents"), struct, ["doc_id"])



@plan(
    "drop_empty_rows",
    """SELECT CASE WHEN event_type = 'click' THEN user_id END AS who,
              CASE WHEN event_type = 'view' THEN props END AS what,
              CASE WHEN event_type = 'error' THEN false END AS flag
       FROM events WHERE event_type IN ('click', 'view', 'error')""",
)
def _(spark, sf):
    kind = F.col("event_type")
    cells = table(spark, sf, "events").select(
        F.when(kind == "click", F.col("user_id").cast("string")).otherwise(" ").alias("who"),
        F.when(kind == "view", F.col("props")).otherwise("NULL").alias("what"),
        F.when(kind == "signup", "perhaps").when(kind == "error", "f").alias("flag"),
    )
    typed = I.parse_typed(cells, {"who": "BIGINT", "what": "TEXT", "flag": "BOOLEAN"})
    return I.drop_empty_rows(typed)


# --- rejects -----------------------------------------------------------------------

_UPLOAD_TYPES = {"doc_id": "INTEGER", "source": "VARCHAR(4)", "n_chars": "BIGINT"}
_UPLOAD_SQL = """
    SELECT CASE WHEN lang = 'fr' THEN CAST(doc_id + 3000000000 AS VARCHAR)
                WHEN lang = 'es' THEN '' ELSE CAST(doc_id AS VARCHAR) END AS doc_id,
           CASE WHEN lang = 'es' THEN ' ' ELSE source END AS source,
           CASE WHEN lang = 'de' THEN n_chars || 'x' WHEN lang = 'es' THEN 'null'
                ELSE CAST(n_chars AS VARCHAR) END AS n_chars
    FROM documents"""
_JUDGED_SQL = f"""
    SELECT *, CASE WHEN doc_id <> '' AND TRY_CAST(doc_id AS INTEGER) IS NULL THEN 'doc_id'
                   WHEN length(trim(source)) > 4 THEN 'source'
                   WHEN n_chars <> 'null' AND TRY_CAST(n_chars AS BIGINT) IS NULL THEN 'n_chars'
              END AS bad,
           doc_id = '' AND trim(source) = '' AND n_chars = 'null' AS empty
    FROM ({_UPLOAD_SQL})"""


def _upload(spark, sf):
    lang = F.col("lang")
    return table(spark, sf, "documents").select(
        F.when(lang == "fr", (F.col("doc_id") + F.lit(3_000_000_000)).cast("string"))
        .when(lang == "es", "")
        .otherwise(F.col("doc_id").cast("string"))
        .alias("doc_id"),
        F.when(lang == "es", " ").otherwise(F.col("source")).alias("source"),
        F.when(lang == "de", F.concat(F.col("n_chars").cast("string"), F.lit("x")))
        .when(lang == "es", "null")
        .otherwise(F.col("n_chars").cast("string"))
        .alias("n_chars"),
    )


@plan(
    "reject_rows",
    f"""SELECT 'documents' AS source, bad AS "column",
               CASE bad WHEN 'doc_id' THEN doc_id WHEN 'source' THEN source ELSE n_chars END
                   AS raw_value,
               CASE bad WHEN 'doc_id' THEN 'INTEGER' WHEN 'source' THEN 'VARCHAR(4)'
                   ELSE 'BIGINT' END AS target_type,
               CASE bad WHEN 'doc_id' THEN 'out of range' WHEN 'source' THEN 'too long'
                   ELSE 'not parsed' END AS reason,
               doc_id || ',' || source || ',' || n_chars AS raw
        FROM ({_JUDGED_SQL}) WHERE bad IS NOT NULL""",
)
def _(spark, sf):
    judged = I.judge_rows(_upload(spark, sf), _UPLOAD_TYPES)
    return I.reject_rows(judged, _UPLOAD_TYPES, F.lit("documents"))


@plan(
    "accepted_rows",
    f"""SELECT CAST(doc_id AS INTEGER) AS doc_id, source, CAST(n_chars AS BIGINT) AS n_chars
        FROM ({_JUDGED_SQL}) WHERE bad IS NULL AND NOT empty""",
)
def _(spark, sf):
    good, _rejects = I.split_rejects(_upload(spark, sf), _UPLOAD_TYPES)
    return good


@plan(
    "load_report",
    f"""SELECT CASE WHEN count(bad) > 100 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
               count(*) FILTER (WHERE NOT empty) AS read_count,
               count(*) FILTER (WHERE bad IS NULL AND NOT empty) AS write_count,
               count(bad) AS skip_count,
               count(*) FILTER (WHERE empty) AS empty_count,
               min(CASE bad WHEN 'doc_id' THEN 'doc_id: out of range: ' || doc_id
                            WHEN 'source' THEN 'source: too long: ' || source
                            WHEN 'n_chars' THEN 'n_chars: not parsed: ' || n_chars END)
                   AS first_failure
        FROM ({_JUDGED_SQL})""",
)
def _(spark, sf):
    return I.load_report(I.judge_rows(_upload(spark, sf), _UPLOAD_TYPES))


@plan(
    "load_runs_page",
    f"""WITH runs AS (
            SELECT CASE WHEN count(bad) > 5 THEN 'FAILED' ELSE 'COMPLETED' END AS status, run,
                   count(*) FILTER (WHERE NOT empty) AS read_count, count(bad) AS skip_count
            FROM (SELECT *, trim(source) AS run FROM ({_JUDGED_SQL})) GROUP BY run)
        SELECT *, row_number() OVER (ORDER BY skip_count DESC, run) - 1 AS _position
        FROM runs WHERE status = 'FAILED'
        ORDER BY _position LIMIT 10""",
)
def _(spark, sf):
    judged = I.judge_rows(_upload(spark, sf), _UPLOAD_TYPES)
    runs = I.load_report(judged.withColumn("run", F.trim("source")), limit=5, by=["run"])
    failed = filter_model(runs, {"status": {"filterType": "text", "filter": "failed"}})
    shown = failed.select("status", "run", "read_count", "skip_count")
    return page(shown, [("skip_count", "desc")], ["run"], 0, 10)


# --- row payloads ------------------------------------------------------------------


def _payloads(spark, sf):
    kind = F.col("event_type")
    payload = F.map_from_arrays(
        F.array(F.lit("user_id"), F.lit("value"), F.lit("seen_at"), kind),
        F.array(
            F.col("user_id").cast("string"),
            F.col("value").cast("string"),
            F.translate(F.col("ts").cast("string"), " ", "T"),
            F.lit("true"),
        ),
    )
    return table(spark, sf, "events").select("event_id", payload.alias("row_data"))


_PAYLOAD_TYPES = {
    "user_id": "BIGINT",
    "value": "DOUBLE",
    "seen_at": "TIMESTAMP",
    "click": "BOOLEAN",
    "view": "BOOLEAN",
}


@plan(
    "map_payload_to_columns",
    """SELECT event_id, user_id, value, ts AS seen_at,
              CASE WHEN event_type = 'click' THEN true END AS click,
              CASE WHEN event_type = 'view' THEN true END AS "view"
       FROM events""",
)
def _(spark, sf):
    return I.payload_to_columns(_payloads(spark, sf), "row_data", _PAYLOAD_TYPES, ["event_id"])


@plan(
    "payload_unknown_keys",
    """SELECT event_id, event_type AS "column", 'true' AS raw_value FROM events
       WHERE event_type NOT IN ('click', 'view')""",
)
def _(spark, sf):
    return I.payload_unknown_keys(_payloads(spark, sf), "row_data", _PAYLOAD_TYPES, ["event_id"])


@plan(
    "payload_rejects",
    """SELECT event_id, 'value' AS "column", CAST(value AS VARCHAR) || 'x' AS raw_value,
              'DOUBLE' AS target_type, 'not parsed' AS reason
       FROM events WHERE event_type = 'error'
       UNION ALL
       SELECT event_id, 'short', event_type, 'VARCHAR(6)', 'too long' FROM events
       WHERE length(event_type) > 6
       UNION ALL
       SELECT event_id, event_type, 'true', NULL, 'no such column' FROM events
       WHERE event_type IN ('signup', 'view')""",
)
def _(spark, sf):
    kind, value = F.col("event_type"), F.col("value").cast("string")
    payload = F.map_from_arrays(
        F.array(F.lit("value"), F.lit("short"), kind),
        F.array(F.when(kind == "error", F.concat(value, F.lit("x"))).otherwise(value), kind, F.lit("true")),
    )
    payloads = table(spark, sf, "events").select("event_id", payload.alias("row_data"))
    types = {"value": "DOUBLE", "short": "VARCHAR(6)", "click": "TEXT", "error": "TEXT", "purchase": "TEXT"}
    return I.payload_rejects(payloads, "row_data", types, ["event_id"])


def _named_text(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.when(kind == "error", "none").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(kind == "view", "1.5").otherwise(F.length("props").cast("string")).alias("props_count"),
        F.when(kind == "click", "TRUE").otherwise("yes").alias("is_click"),
        F.when(kind == "signup", "free").otherwise(F.col("value").cast("string")).alias("amount"),
        kind,
    )


@plan(
    "coerce_by_name",
    """SELECT event_id AS id,
              CASE WHEN event_type <> 'error' THEN CAST(user_id AS INTEGER) END AS user_id,
              CASE WHEN event_type <> 'view' THEN CAST(length(props) AS INTEGER) END AS props_count,
              event_type = 'click' AS is_click,
              CASE WHEN event_type <> 'signup' THEN value END AS amount,
              event_type
       FROM events""",
)
def _(spark, sf):
    return C.coerce_by_name(_named_text(spark, sf))


@plan(
    "coercion_rejects",
    """SELECT CAST(event_id AS VARCHAR) AS id,
              CASE event_type WHEN 'error' THEN 'user_id' WHEN 'view' THEN 'props_count'
                   ELSE 'amount' END AS "column",
              CASE event_type WHEN 'error' THEN 'none' WHEN 'view' THEN '1.5'
                   ELSE 'free' END AS raw_value,
              CASE event_type WHEN 'signup' THEN 'DOUBLE' ELSE 'INTEGER' END AS target_type
       FROM events WHERE event_type IN ('error', 'view', 'signup')""",
)
def _(spark, sf):
    return C.coercion_rejects(_named_text(spark, sf), ["id"])
