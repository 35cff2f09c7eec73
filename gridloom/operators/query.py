"""Filters, lookups, totals and label projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.names import AUDIT_COLUMNS, ID_COLUMN

# Header text of the system columns.
SYSTEM_LABELS = {
    "id": "ID",
    "add_usr": "CREATED BY",
    "add_ts": "CREATED AT",
    "upd_usr": "UPDATED BY",
    "upd_ts": "UPDATED AT",
}


def text_filter(column: Column, needle: str, literal: bool = False) -> Column:
    """Case-insensitive contains. ``%`` and ``_`` are wildcards unless ``literal``."""
    pattern = needle.replace("\\", "\\\\")
    if literal:
        pattern = pattern.replace("%", "\\%").replace("_", "\\_")
    return column.cast("string").ilike(f"%{pattern}%")


def number_filter(column: Column, kind: str, value: float) -> Column:
    """greaterThan, lessThan or equals; any other kind means equals."""
    if kind == "greaterThan":
        return column > F.lit(value)
    if kind == "lessThan":
        return column < F.lit(value)
    return column == F.lit(value)


def filter_condition(model: dict[str, dict]) -> Column | None:
    """AND over the columns of a filter model, None when nothing is filtered.

    Each entry is ``{"filterType": "text"|"number", "type": ..., "filter": ...}``. Empty
    needles and other filter types (the date filter among them) filter nothing.
    """
    condition = None
    for name, entry in model.items():
        value = entry.get("filter")
        if entry.get("filterType") == "text" and value:
            part = text_filter(F.col(name), str(value), entry.get("literal", False))
        elif entry.get("filterType") == "number" and value is not None:
            part = number_filter(F.col(name), entry.get("type", "equals"), value)
        else:
            continue
        condition = part if condition is None else condition & part
    return condition


def filter_model(df: DataFrame, model: dict[str, dict]) -> DataFrame:
    condition = filter_condition(model)
    return df if condition is None else df.where(condition)


def lookup(df: DataFrame, row_id: int, id_col: str = ID_COLUMN) -> DataFrame:
    return df.where(F.col(id_col) == F.lit(row_id))


def lookup_first(df: DataFrame, column: str, value, id_col: str = ID_COLUMN) -> DataFrame:
    """The row with the smallest id among those holding ``value``."""
    return df.where(F.col(column) == F.lit(value)).orderBy(id_col).limit(1)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def table_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("long").alias("column_count"),
    )


def page_total(df: DataFrame, model: dict[str, dict], pending: int = 0) -> DataFrame:
    """Rows a pager shows: the filtered count plus the pending inserts."""
    total = F.count(F.lit(1)) + F.lit(pending)
    return filter_model(df, model).agg(total.cast("long").alias("total"))


def label_projection(
    df: DataFrame, labels: dict[str, str], id_col: str = ID_COLUMN
) -> DataFrame:
    """Show physical columns under upper-case labels: id first, audit columns last."""
    hidden = {id_col, *AUDIT_COLUMNS}
    columns = [F.col(id_col).alias(SYSTEM_LABELS["id"])] if id_col in df.columns else []
    columns += [
        F.col(c).alias(labels.get(c, c).upper()) for c in df.columns if c.lower() not in hidden
    ]
    columns += [F.col(c).alias(SYSTEM_LABELS[c]) for c in AUDIT_COLUMNS if c in df.columns]
    return df.select(*columns)


def editable_columns(df: DataFrame, id_col: str = ID_COLUMN) -> list[str]:
    return [c for c in df.columns if c.lower() not in {id_col, *AUDIT_COLUMNS}]


def column_search(columns: DataFrame, needle: str, fields: list[str]) -> DataFrame:
    """Catalog rows whose name or type holds ``needle`` as plain text, ignoring case."""
    condition = F.lit(False)
    for name in fields:
        condition = condition | F.contains(F.lower(F.col(name)), F.lit(needle.lower()))
    return columns.where(condition)


def exists(df: DataFrame, condition: Column) -> DataFrame:
    """One row telling whether any row meets ``condition``."""
    found = df.where(condition).limit(1)
    return found.agg((F.count(F.lit(1)) > 0).alias("found"))
