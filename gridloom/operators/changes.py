"""Row changes: insert, update, delete, upsert, and change logs of cell edits.

A change log has the columns ``seq, op, row_id, field, old_value, new_value`` with ``op``
one of insert, update, delete, undelete, uninsert. New rows carry temporary ids, so
``row_id`` and all values are text. ``seq`` is a unique number in edit order.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridloom.functions.cells import parse_value, strip, timestamp_literal
from gridloom.functions.names import AUDIT_COLUMNS, ID_COLUMN, type_by_name
from gridloom.functions.types import max_lengths, parse_type, type_of
from gridloom.operators.keys import assign_ids
from gridloom.operators.paging import PAGE_SIZE, SortModel, page, total_order
from gridloom.operators.query import filter_model
from gridloom.operators.skew import broadcast_if_small
from gridloom.session import checkpointed

CHANGE_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("row_id", T.StringType(), False),
        T.StructField("field", T.StringType()),
        T.StructField("old_value", T.StringType()),
        T.StructField("new_value", T.StringType()),
    ]
)

# Fixed value: how many pending changes an interactive edit session may hold.
SESSION_LIMIT = 50

# Edits of one row are looked at in runs of this many sequence numbers, so a row edited
# without end is spread over tasks.
SEQ_RUN = 200_000


def stamp_insert(df: DataFrame, user: str, now: datetime.datetime) -> DataFrame:
    """Set all audit columns, whatever values the caller sent."""
    return df.withColumns(
        {
            "add_usr": F.lit(user),
            "add_ts": timestamp_literal(now),
            "upd_usr": F.lit(user),
            "upd_ts": timestamp_literal(now),
        }
    )


# --- whole-row changes -------------------------------------------------------------


def insert_rows(
    base: DataFrame,
    new: DataFrame,
    user: str,
    now: datetime.datetime,
    order: list[Column] | None = None,
    id_col: str = ID_COLUMN,
) -> DataFrame:
    """``base`` with ``new`` rows added under fresh ids, numbered in ``order`` if given."""
    unknown = set(new.columns) - set(base.columns)
    if unknown:
        raise ValueError(f"columns not in the table: {sorted(unknown)}")
    numbered = assign_ids(new, base, order, id_col)
    return base.unionByName(stamp_insert(numbered, user, now), allowMissingColumns=True)


def update_rows(
    base: DataFrame,
    updates: DataFrame,
    user: str,
    now: datetime.datetime,
    id_col: str = ID_COLUMN,
) -> DataFrame:
    """``base`` with the columns of ``updates`` set by id, one update row per id.

    A given NULL is stored as NULL. ``add_*`` stays, ``upd_*`` is set.
    """
    given = [c for c in updates.columns if c != id_col and c not in AUDIT_COLUMNS]
    unknown = set(given) - set(base.columns)
    if unknown:
        raise ValueError(f"columns not in the table: {sorted(unknown)}")
    incoming = updates.select(id_col, F.struct(*given).alias("_new"))
    hit = F.col("_new").isNotNull()
    columns = []
    for name in base.columns:
        if name in given:
            new = F.col(f"_new.{name}").cast(base.schema[name].dataType)
        elif name == "upd_usr":
            new = F.lit(user)
        elif name == "upd_ts":
            new = timestamp_literal(now)
        else:
            columns.append(F.col(name))
            continue
        columns.append(F.when(hit, new).otherwise(F.col(name)).alias(name))
    return base.join(incoming, id_col, "left").select(*columns)


def missing_updates(base: DataFrame, updates: DataFrame, id_col: str = ID_COLUMN) -> DataFrame:
    """Updates whose row does not exist; the caller decides whether that is an error."""
    return updates.join(base.select(id_col), id_col, "left_anti")


def delete_rows(base: DataFrame, ids: DataFrame, id_col: str = ID_COLUMN) -> DataFrame:
    """``base`` without the given ids; ids it does not hold are no error."""
    return base.join(ids.select(id_col).distinct(), id_col, "left_anti")


def one_per_key(
    source: DataFrame, key: str, order: list[str] | None = None, last: bool = False
) -> DataFrame:
    """The first or last row of each key by the columns ``order``, then by all others.

    NULLs come first. Rows with a NULL key are all kept: NULL repeats no key.
    """
    rest = [c for c in source.columns if c != key and c not in (order or [])]
    row = F.struct(*(order or []), *rest)
    picked = source.where(F.col(key).isNotNull()).groupBy(key)
    picked = picked.agg((F.max if last else F.min)(row).alias("_row")).select(key, "_row.*")
    return picked.select(source.columns).union(source.where(F.col(key).isNull()))


def upsert(
    base: DataFrame, source: DataFrame, key: str, order: list[str] | None = None
) -> DataFrame:
    """Insert rows with new keys, replace the given columns of rows with known keys.

    Of source rows that repeat a key the last by ``order`` counts.
    """
    source = one_per_key(source, key, order, last=True)
    rows = base.withColumn("_base", F.struct(*base.columns)).select(key, "_base")
    incoming = source.select(key, F.struct(*source.columns).alias("_source"))
    hit = F.col("_source").isNotNull()
    columns = []
    for name in base.columns:
        stored = F.col(f"_base.{name}")
        if name in source.columns:
            new = F.col(f"_source.{name}").cast(base.schema[name].dataType)
            stored = F.when(hit, new).otherwise(stored)
        columns.append(stored.alias(name))
    return rows.join(incoming, key, "full_outer").select(*columns)


def replace_rows(base: DataFrame, rows: DataFrame, id_col: str = ID_COLUMN) -> DataFrame:
    """Delete the ids of ``rows``, then insert ``rows`` whole."""
    return delete_rows(base, rows, id_col).unionByName(rows)


def insert_if_absent(
    base: DataFrame, source: DataFrame, key: str, order: list[str] | None = None
) -> DataFrame:
    """Add only rows whose key is not there yet, the first by ``order`` of those that repeat one."""
    source = one_per_key(source, key, order)
    return base.unionByName(source.join(base.select(key).distinct(), key, "left_anti"))


def coerce_by_name(df: DataFrame) -> DataFrame:
    """Type text columns by their names; a value that does not convert becomes NULL
    here and is listed by ``coercion_rejects``."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        target = type_by_name(field.name)
        if target and isinstance(field.dataType, T.StringType):
            column = _coerced(column, target).alias(field.name)
        columns.append(column)
    return df.select(*columns)


def _coerced(text: Column, target: str) -> Column:
    if target == "BOOLEAN":  # anything but "true" is false
        return F.lower(text) == "true"
    if target == "DOUBLE":
        text = strip(text)
    return parse_value(text, parse_type(target))


def coercion_rejects(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per text value that its column's name-based type refuses."""
    cells = []
    for field in df.schema.fields:
        target = type_by_name(field.name)
        if target in (None, "BOOLEAN") or not isinstance(field.dataType, T.StringType):
            continue
        raw = F.col(field.name)
        bad = raw.isNotNull() & _coerced(raw, target).isNull()
        cell = F.struct(
            F.lit(field.name).alias("column"),
            raw.alias("raw_value"),
            F.lit(target).alias("target_type"),
        )
        cells.append(F.when(bad, cell))
    cell = df.select(*keep, F.explode(F.array(*cells)).alias("_cell"))
    return cell.where(F.col("_cell").isNotNull()).select(*keep, "_cell.*")


# --- change logs -------------------------------------------------------------------


def _mark(on: str, off: str) -> Column:
    """What an operation makes of a state of its row: true, false, or NULL for no change."""
    return F.when(F.col("op") == on, True).when(F.col("op") == off, False)


def _reduced_runs(changes: DataFrame, seq_run: int) -> DataFrame:
    """The log reduced to what each run of sequence numbers does to each row.

    Inside a run an entry knows the state of its row from the entries before it, or not at
    all (NULL) when none of them sets it. Updates and inserts of one cell made in the same state
    are one; so a run leaves a few rows per cell, however often the cell was edited.

    Columns: row_id, _run, op, field, seq and _last_seq, old_value and new_value; _deleted and
    _inserted, the state before; _after_delete and _after_uninsert, whether the run's last delete and
    uninsert come before; and of the run as a whole _ends_deleted, _ends_inserted (NULL when
    it sets nothing), _delete and _uninsert, the last of each.
    """
    op, seq = F.col("op"), F.col("seq")
    in_run = Window.partitionBy("row_id", "_run").orderBy("seq")
    earlier = in_run.rowsBetween(Window.unboundedPreceding, -1)
    whole = in_run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    deleted, inserted = _mark("delete", "undelete"), _mark("insert", "uninsert")
    log = changes.withColumn("_run", F.expr(f"seq div {seq_run}")).withColumns(
        {
            "_deleted": F.last(deleted, ignorenulls=True).over(earlier),
            "_inserted": F.last(inserted, ignorenulls=True).over(earlier),
            "_ends_deleted": F.last(deleted, ignorenulls=True).over(whole),
            "_ends_inserted": F.last(inserted, ignorenulls=True).over(whole),
            "_delete": F.max(F.when(op == "delete", seq)).over(whole),
            "_uninsert": F.max(F.when(op == "uninsert", seq)).over(whole),
        }
    )
    # An update of a deleted row counts for nothing; only the last delete may become a change.
    cell = op.isin("insert", "update") & ~F.coalesce((op == "update") & F.col("_deleted"), F.lit(False))
    kept = F.when(cell | (seq == F.col("_delete")), op)
    log = log.withColumns(
        {
            "op": kept,
            "field": F.when(kept.isNotNull(), F.col("field")),
            "_deleted": F.when(cell, F.col("_deleted")),
            "_inserted": F.when(cell, F.col("_inserted")),
            "_after_delete": F.when(cell, seq > F.coalesce("_delete", F.lit(-1))),
            "_after_uninsert": F.when(cell, seq > F.coalesce("_uninsert", F.lit(-1))),
        }
    )
    run = ["_ends_deleted", "_ends_inserted", "_delete", "_uninsert"]
    keys = ["row_id", "_run", "op", "field", "_deleted", "_inserted", "_after_delete", "_after_uninsert"]
    return log.groupBy(*keys, *run).agg(
        F.min("seq").alias("seq"),
        F.max("seq").alias("_last_seq"),
        F.min_by("old_value", "seq").alias("old_value"),
        F.max_by("new_value", "seq").alias("new_value"),
    )


def compact_changes(changes: DataFrame, seq_run: int = SEQ_RUN) -> DataFrame:
    """Reduce a change log to its net changes, one per inserted cell, updated cell or
    deleted row.

    A cell keeps the first old and the last new value and vanishes when they are equal.
    Edits of a new row belong to its insert. A delete drops the row's earlier updates,
    and edits made while a row is deleted count for nothing.

    The log is read once and shuffled by row and run, so that no task holds all entries of one
    row; what the runs leave is shuffled by row, where the state is carried from run to run.
    """
    op = F.col("op")
    real_edit = (op != "update") | ~F.col("old_value").eqNullSafe(F.col("new_value"))
    runs = _reduced_runs(changes.where(real_edit), seq_run)
    row = Window.partitionBy("row_id")
    before = row.orderBy("_run").rangeBetween(Window.unboundedPreceding, -1)
    at_end = F.max(F.when(F.col("_ends_deleted").isNotNull(), F.struct("_run", "_ends_deleted")))
    runs = runs.withColumns(
        {
            "_was_deleted": F.last("_ends_deleted", ignorenulls=True).over(before),
            "_was_inserted": F.last("_ends_inserted", ignorenulls=True).over(before),
            "_last_delete": F.max("_delete").over(row),
            "_last_uninsert": F.max("_uninsert").over(row),
            "_at_end": at_end.over(row),
        }
    )
    no = F.lit(False)
    deleted = F.coalesce("_deleted", "_was_deleted", no)
    inserted = F.coalesce("_inserted", "_was_inserted", no)

    def after(last: str, in_run: str) -> Column:
        """Whether the last such entry of the row comes before."""
        its_run = F.expr(f"{last} div {seq_run}")
        return F.col(last).isNull() | (F.col("_run") > its_run) | ((F.col("_run") == its_run) & F.col(in_run))

    alive = (op == "insert") | (inserted & ~deleted)
    ends_deleted = F.coalesce(F.col("_at_end")["_ends_deleted"], no)
    kind = (
        F.when((op == "delete") & ends_deleted & (F.col("seq") == F.col("_last_delete")), "delete")
        .when(op.isin("insert", "update") & alive & after("_last_uninsert", "_after_uninsert"), "insert")
        .when((op == "update") & ~inserted & ~deleted & after("_last_delete", "_after_delete"), "update")
    )
    cells = (
        runs.select(kind.alias("op"), "row_id", "field", "seq", "_last_seq", "old_value", "new_value")
        .where(op.isNotNull())
        .groupBy("op", "row_id", "field")
        .agg(
            F.min("seq").alias("seq"),
            F.min_by("old_value", "seq").alias("old_value"),
            F.max_by("new_value", "_last_seq").alias("new_value"),
        )
    )
    unchanged = (op == "update") & F.col("old_value").eqNullSafe(F.col("new_value"))
    old_value = F.when(op == "update", F.col("old_value")).alias("old_value")
    return cells.where(~unchanged).select(
        "seq", "op", "row_id", "field", old_value, "new_value"
    )


def changes_summary(net: DataFrame) -> DataFrame:
    """Pending inserts, updated rows and deletes of net changes, and their total."""
    by_row = net.groupBy("op", "row_id").agg(F.count(F.lit(1)).alias("cells"))

    def rows(op: str) -> Column:
        return F.count_if(F.col("op") == op)

    return by_row.agg(
        rows("insert").alias("inserts"),
        rows("update").alias("updates"),
        rows("delete").alias("deletes"),
        F.count(F.lit(1)).alias("total"),
    )


def check_limit(net: DataFrame, limit: int | None = None) -> None:
    """Raise when net changes touch more rows than ``limit``; None means no limit.

    SESSION_LIMIT is that of an interactive edit session.
    """
    if limit is not None and changes_summary(net).first()["total"] > limit:
        raise ValueError(f"more than {limit} pending changes")


def _typed_cells(net: DataFrame, base: DataFrame, id_col: str) -> DataFrame:
    """Net changes with ``_value``, the new value as the table's own text form of it, and
    ``_reason`` why the table refuses the cell, NULL when it takes it.

    Columns of one type are checked together, so wide tables do not make wide plans.
    """
    editable: dict[tuple, list[str]] = {}
    lengths = max_lengths(base.schema)
    for field in base.schema.fields:
        if field.name != id_col and field.name not in AUDIT_COLUMNS:
            kind = (field.dataType.json(), lengths.get(field.name))
            editable.setdefault(kind, []).append(field.name)
    raw, name = F.col("new_value"), F.col("field")
    known = [c for names in editable.values() for c in names]
    reason = F.when(name.isNotNull() & ~name.isin(*known), F.lit("unknown column"))
    value = F.when(F.lit(False), raw)
    for (_, length), names in editable.items():
        data_type, mine = base.schema[names[0]].dataType, name.isin(*names)
        if isinstance(data_type, T.StringType):
            if length is not None:
                reason = reason.when(mine & (F.length(raw) > length), F.lit("too long"))
            continue
        parsed = parse_value(strip(raw), type_of(data_type))
        value = value.when(mine, parsed.cast("string"))
        if not isinstance(data_type, T.BooleanType):
            bad = mine & raw.isNotNull() & parsed.isNull()
            reason = reason.when(bad, F.lit("not parsed"))
    return net.withColumns({"_value": value.otherwise(raw), "_reason": reason})


def net_rows(net: DataFrame, base: DataFrame, id_col: str = ID_COLUMN) -> DataFrame:
    """Net changes with one row per changed row.

    Columns: ``row_id``, ``_op`` (insert, update, delete), ``_new_row``, ``_seq`` and
    ``_cells``, a map from field to a struct of its new value; the struct tells "set to
    NULL" from "not set". A map holds at most one entry per table column, and cells the
    table refuses are left out. An inserted row marked for deletion keeps the delete.
    """
    op, field = F.col("op"), F.col("field")
    entry = F.struct("field", F.struct(F.col("_value").alias("new_value")).alias("cell"))
    taken = field.isNotNull() & F.col("_reason").isNull()

    def cells(kind: str) -> Column:
        return F.map_from_entries(F.collect_list(F.when((op == kind) & taken, entry)))

    new_row = F.bool_or(op == "insert")
    row_op = (
        F.when(F.bool_or(op == "delete"), "delete").when(new_row, "insert").otherwise("update")
    )
    return _typed_cells(net, base, id_col).groupBy("row_id").agg(
        row_op.alias("_op"),
        new_row.alias("_new_row"),
        F.min("seq").alias("_seq"),
        F.when(new_row, cells("insert")).otherwise(cells("update")).alias("_cells"),
    )


def invalid_changes(net: DataFrame, base: DataFrame, id_col: str = ID_COLUMN) -> DataFrame:
    """Net cells the table refuses: unknown or system columns, values that do not parse, and
    texts longer than the column's metadata says it takes."""
    cells = _typed_cells(net.where(F.col("op") != "delete"), base, id_col)
    refused = cells.where(F.col("_reason").isNotNull())
    return refused.drop("_value").withColumnRenamed("_reason", "reason")


def _keyed_by_id(rows: DataFrame, base: DataFrame, id_col: str) -> DataFrame:
    """Changed rows with ``row_id`` read as the table's id type; ids compare as text.

    The pattern keeps temporary ids away from the cast, which is slow on what it refuses.
    """
    data_type, text = base.schema[id_col].dataType, F.col("row_id")
    if isinstance(data_type, T.IntegralType):
        row_id = F.when(text.rlike(r"^(0|-?[1-9][0-9]{0,18})$"), text.try_cast(data_type))
    else:
        value = text.try_cast(data_type)
        row_id = F.when(value.cast("string") == text, value)
    keyed = rows.withColumn("row_id", row_id).where(F.col("row_id").isNotNull())
    return keyed.withColumnRenamed("row_id", id_col)


def _new_cell(name: str, data_type: T.DataType) -> tuple[Column, Column]:
    """(changed, new value) of one column of a net row."""
    cell = F.col("_cells")[name]
    return cell.isNotNull(), cell["new_value"].cast(data_type)


def stored_net_rows(net: DataFrame, base: DataFrame, id_col: str = ID_COLUMN) -> DataFrame:
    """``net_rows`` written to the checkpoint folder, for plans that use them twice.

    Edits are few beside the table, so a small set is broadcast and the table itself is
    not shuffled.
    """
    return broadcast_if_small(checkpointed(net_rows(net, base, id_col)))


def overlay_updates(base: DataFrame, net: DataFrame, id_col: str = ID_COLUMN) -> DataFrame:
    """Stored rows with pending cell updates laid over them."""
    return _overlaid(base, net_rows(net, base, id_col), id_col)


def _overlaid(
    base: DataFrame, changed: DataFrame, id_col: str, keep_state: bool = False
) -> DataFrame:
    """With ``keep_state`` a ``row_state`` column tells updated and deleted rows apart;
    deleted rows stay visible and show their stored values."""
    keyed = _keyed_by_id(changed, base, id_col).select(id_col, "_op", "_cells")
    rows = base.join(keyed, id_col, "left")
    columns = []
    for name in base.columns:
        if name == id_col or name in AUDIT_COLUMNS:
            columns.append(F.col(name))
            continue
        given, value = _new_cell(name, base.schema[name].dataType)
        live = (F.col("_op") == "update") & given
        columns.append(F.when(live, value).otherwise(F.col(name)).alias(name))
    if keep_state:
        state = F.when(F.col("_op") == "delete", "deleted").when(
            F.col("_op") == "update", "updated"
        )
        columns.append(F.coalesce(state, F.lit("stored")).alias("row_state"))
    return rows.select(*columns)


def pending_inserts(net: DataFrame, base: DataFrame, id_col: str = ID_COLUMN) -> DataFrame:
    """New rows of net changes in the table's columns, the temporary id as text, plus
    ``_seq`` for their order and ``_op``, delete for those marked for deletion."""
    return _new_rows(net_rows(net, base, id_col), base, id_col)


def _new_rows(changed: DataFrame, base: DataFrame, id_col: str) -> DataFrame:
    rows = changed.where(F.col("_new_row"))
    columns = [F.col("row_id").alias(id_col)]
    for name in base.columns:
        if name == id_col:
            continue
        data_type = base.schema[name].dataType
        if name in AUDIT_COLUMNS:
            columns.append(F.lit(None).cast(data_type).alias(name))
            continue
        given, value = _new_cell(name, data_type)
        columns.append(F.when(given, value).cast(data_type).alias(name))
    return rows.select(*columns, "_op", "_seq")


def overlay_preview(base: DataFrame, net: DataFrame, id_col: str = ID_COLUMN) -> DataFrame:
    """The table as an editor shows it: stored rows with updates, new rows, and a
    ``row_state`` of stored, updated, deleted or inserted. Ids are text."""
    changed = stored_net_rows(net, base, id_col)
    stored = _overlaid(base, changed, id_col, keep_state=True)
    stored = stored.withColumn(id_col, F.col(id_col).cast("string"))
    state = F.when(F.col("_op") == "delete", "deleted").otherwise("inserted")
    new = _new_rows(changed, base, id_col).withColumn("row_state", state)
    return stored.unionByName(new.drop("_op", "_seq"))


def overlay_page(
    base: DataFrame,
    net: DataFrame,
    sort: SortModel,
    filters: dict[str, dict] | None = None,
    start: int = 0,
    end: int = PAGE_SIZE,
    id_col: str = ID_COLUMN,
    **deep,
) -> DataFrame:
    """Rows [start, end) of "new rows first, then stored rows with updates".

    Filter and sort read stored values, so the page is cut from the table first and only
    its rows meet the pending changes.
    """
    changed = checkpointed(net_rows(net, base, id_col))
    pending = _new_rows(changed, base, id_col).drop("_op")
    n_pending = changed.where(F.col("_new_row")).count()
    out = base.columns
    table_start, table_end = max(0, start - n_pending), max(0, end - n_pending)
    stored = page(
        filter_model(base, filters or {}), sort, [id_col], table_start, table_end, **deep
    )
    numbers = stored.select(id_col, (F.col("_position") + n_pending).alias("_position"))
    shown = _overlaid(stored.select(*out), changed, id_col).join(numbers, id_col)
    shown = shown.withColumn(id_col, F.col(id_col).cast("string")).select(*out, "_position")
    if start >= n_pending:
        return shown
    by_seq = total_order([("_seq", "asc")], [id_col])
    first = page(pending, by_seq, [], start, min(end, n_pending), **deep)
    return first.select(*out, "_position").unionByName(shown)


def apply_changes(
    base: DataFrame,
    changes: DataFrame,
    user: str,
    now: datetime.datetime,
    id_col: str = ID_COLUMN,
    seq_run: int = SEQ_RUN,
    next_id: int | None = None,
) -> DataFrame:
    """``base`` after a change log: rows inserted, then updated, then deleted. New rows get ids
    from ``next_id`` on, by default those after the largest.

    The log is compacted and pivoted once and written to the checkpoint folder; the
    table is read once and joined once. Cells listed by ``invalid_changes`` keep their
    stored value.
    """
    rows = stored_net_rows(compact_changes(changes, seq_run), base, id_col)
    by_id = _keyed_by_id(rows.where(~F.col("_new_row")), base, id_col)
    by_id = by_id.select(id_col, "_op", "_cells")
    updated = F.coalesce(F.col("_op") == "update", F.lit(False))
    stored, new = [], []
    for name in base.columns:
        data_type = base.schema[name].dataType
        if name == id_col:
            stored.append(F.col(name))
        elif name in ("add_usr", "add_ts"):
            stored.append(F.col(name))
        elif name in ("upd_usr", "upd_ts"):
            value = F.lit(user) if name == "upd_usr" else timestamp_literal(now)
            stored.append(F.when(updated, value).otherwise(F.col(name)).alias(name))
        else:
            given, value = _new_cell(name, data_type)
            stored.append(F.when(updated & given, value).otherwise(F.col(name)).alias(name))
            new.append(F.when(given, value).cast(data_type).alias(name))
    kept = base.join(by_id, id_col, "left").where(
        F.coalesce(F.col("_op") != "delete", F.lit(True))
    )
    fresh = rows.where(F.col("_op") == "insert")
    numbered = assign_ids(
        fresh.select("_seq", "row_id", *new),
        base,
        [F.col("_seq").asc(), F.col("row_id").asc()],
        id_col,
        next_id,
    )
    added = numbered.drop("_seq", "row_id")
    if any(c in base.columns for c in AUDIT_COLUMNS):
        stamped = stamp_insert(added, user, now)
        added = stamped.select(*[c for c in stamped.columns if c in base.columns])
    return kept.select(*stored).unionByName(added, allowMissingColumns=True)


# --- replayed row images -----------------------------------------------------------

# State of a row that events change: the number of the last one, and whether it was a delete.
SEQ, GONE = "_seq", "_gone"


def last_images(events: DataFrame, id_col: str = ID_COLUMN) -> DataFrame:
    """The last change per row of an event stream ``(seq, op, <row columns>)``."""
    columns = [c for c in events.columns if c != id_col]
    return (
        events.groupBy(id_col)
        .agg(F.max_by(F.struct(*columns), "seq").alias("_last"))
        .select(id_col, *[F.col(f"_last.{c}").alias(c) for c in columns])
    )


def replay_images(base: DataFrame, events: DataFrame, id_col: str = ID_COLUMN) -> DataFrame:
    """Bring a copy up to date with insert, update and delete events carrying whole rows."""
    last = last_images(events, id_col)
    kept = base.join(last.select(id_col), id_col, "left_anti")
    images = last.where(F.col("op") != "delete").select(*base.columns)
    return kept.unionByName(images)


def event_images(events: DataFrame, id_col: str = ID_COLUMN) -> DataFrame:
    """Events ``(seq, op, <row columns>)`` as row images with their state, the newest of each id.

    Events without ``seq`` or id say nothing and are left out.
    """
    known = events.where(F.col("seq").isNotNull() & F.col(id_col).isNotNull())
    columns = [c for c in events.columns if c not in ("seq", "op")]
    gone = F.coalesce(F.col("op") == "delete", F.lit(False))
    return newest_images(known.select(*columns, F.col("seq").alias(SEQ), gone.alias(GONE)), id_col)


def newest_images(images: DataFrame, id_col: str = ID_COLUMN) -> DataFrame:
    """The image with the highest ``_seq`` of each id; of several events with one number a
    delete, then the one that sorts last."""
    rest = [c for c in images.columns if c not in (id_col, SEQ, GONE)]
    newest = F.max(F.struct(SEQ, GONE, *rest)).alias("_newest")
    found = images.groupBy(id_col).agg(newest).select(id_col, "_newest.*")
    return found.select(images.columns)


def merge_images(
    state: DataFrame, images: DataFrame, id_col: str = ID_COLUMN, small: bool = False
) -> DataFrame:
    """``state`` with newer images laid over it; both have the state columns.

    An image holds where its ``_seq`` is higher than the row's own; a row without one is older
    than any. So images may come in any order, late and more than once. Deleted rows stay as
    marks. ``small`` says that the images are known to fit for a broadcast; then the rows they do
    not touch are not shuffled.
    """
    newest = newest_images(images, id_col)
    marks = newest.select(id_col, F.col(SEQ).alias("_new_seq"))
    marks = F.broadcast(marks) if small else marks
    holds = F.coalesce(F.col(SEQ) >= F.col("_new_seq"), F.col("_new_seq").isNull())
    kept = state.join(marks, id_col, "left").where(holds).drop("_new_seq")
    # Late images: those a row already there has outrun.
    late = state.select(id_col, SEQ).join(marks, id_col).where(F.col(SEQ) >= F.col("_new_seq"))
    return kept.unionByName(newest.join(late.select(id_col), id_col, "left_anti"))
