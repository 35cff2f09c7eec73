"""Sorting and paging, shallow and deep."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from gridloom.functions.cells import timestamp_literal
from gridloom.operators.keys import with_positions

PAGE_SIZE = 100
# Pages ending before this row come from a plain top-k; deeper ones narrow first.
TOP_K_ROWS = 200_000
SAMPLE_ROWS = 10_000

SortModel = list[tuple[str, str]]


def _ascending(direction: str) -> bool:
    if direction.lower() not in ("asc", "desc"):
        raise ValueError(f"unknown sort direction: {direction}")
    return direction.lower() == "asc"


def order_columns(sort: SortModel) -> list[Column]:
    """ORDER BY columns of a sort model; NULLs come last in both directions."""
    return [
        F.col(c).asc_nulls_last() if _ascending(d) else F.col(c).desc_nulls_last()
        for c, d in sort
    ]


def total_order(sort: SortModel, tie_break: list[str]) -> SortModel:
    """The sort model extended by tie-break columns it does not name yet."""
    named = {c for c, _ in sort}
    return [*sort, *[(c, "asc") for c in tie_break if c not in named]]


def sort_model(df: DataFrame, sort: SortModel, tie_break: list[str]) -> DataFrame:
    """Sort the whole table. Ties go by ``tie_break``, which also lets the range
    partitioning cut through a hot leading value."""
    return df.orderBy(*order_columns(total_order(sort, tie_break)))


def _literal(df: DataFrame, name: str, value) -> Column:
    """A literal of the column's own type, so the comparison stays on the bare column."""
    data_type = df.schema[name].dataType
    if isinstance(value, datetime.datetime) and isinstance(data_type, T.TimestampNTZType):
        return timestamp_literal(value)
    return F.lit(value).cast(data_type)


def is_before(
    df: DataFrame, sort: SortModel, bound: Row | tuple, inclusive: bool = False
) -> Column:
    """True for rows sorting before ``bound``, a value for each sort column."""
    result = F.lit(inclusive)
    for (name, direction), value in reversed(list(zip(sort, bound))):
        column = F.col(name)
        if value is None:  # NULL is last: everything else comes before it
            result = column.isNotNull() | result
            continue
        at = _literal(df, name, value)
        earlier = column < at if _ascending(direction) else column > at
        result = F.coalesce(earlier, F.lit(False)) | (column.eqNullSafe(at) & result)
    return result


def _lead_from(df: DataFrame, sort: SortModel, last: Row | tuple) -> Column:
    """A plain bound on the first sort column that every later row meets."""
    name, direction = sort[0]
    column = F.col(name)
    if last[0] is None:
        return column.isNull()
    at = _literal(df, name, last[0])
    return (column >= at if _ascending(direction) else column <= at) | column.isNull()


def _lead_range(df: DataFrame, sort: SortModel, low: Row | None, high: Row | None) -> Column:
    """A plain range on the first sort column, which file sources can use to skip data."""
    name, direction = sort[0]
    if low is None or high is None or low[0] is None or high[0] is None:
        return F.lit(True)
    first, last = (low[0], high[0]) if _ascending(direction) else (high[0], low[0])
    return F.col(name).between(_literal(df, name, first), _literal(df, name, last))


def _narrow(
    df: DataFrame, sort: SortModel, start: int, end: int, max_rows: int, sample_rows: int
) -> tuple[DataFrame, int, int]:
    """Cut ``df`` to a sort-key range that holds rows [start, end).

    Also return how many rows sort before the range and how many it has. Each round samples
    about ``sample_rows`` sort keys of the current range, brackets the page between two of
    them and counts exactly; a bracket that misses the page is drawn wider. It ends when the
    range has ``max_rows`` rows or a round no longer halves it, because the page itself is
    wide or the rows tie.
    """
    names = [c for c, _ in sort]
    order = order_columns(sort)
    window, rows, skipped = df, df.count(), 0
    end = min(end, rows)
    spread, seed = 2.0, 17
    while rows > max_rows and start < end and 2 * (end - start) < rows:
        sample = window.select(*names).sample(min(1.0, sample_rows / rows), seed)
        sample = sample.orderBy(*order).collect()
        seed += 1
        n = len(sample)
        slack = spread * math.sqrt(n) + 1
        low_at = math.floor((start - skipped) / rows * n - slack)
        high_at = math.ceil((end - skipped) / rows * n + slack)
        low = sample[low_at] if low_at >= 0 else None
        high = sample[high_at] if high_at < n else None
        if low is None and high is None:
            break
        before = is_before(df, sort, low) if low is not None else F.lit(False)
        up_to = is_before(df, sort, high, inclusive=True) if high is not None else F.lit(True)
        below, inside = window.agg(
            F.count_if(before), F.count_if(up_to & ~before)
        ).first()
        if below > start - skipped or below + inside < end - skipped:
            spread *= 2
            continue
        window = window.where(_lead_range(df, sort, low, high) & up_to & ~before)
        skipped += below
        halved, rows = 2 * inside <= rows, inside
        if not halved:
            break
    return window, skipped, rows


def page(
    df: DataFrame,
    sort: SortModel,
    tie_break: list[str],
    start: int = 0,
    end: int = PAGE_SIZE,
    *,
    top_k_rows: int = TOP_K_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Rows [start, end) of the sorted table, numbered from ``start`` in ``_position``.

    OFFSET makes a task hold every row up to the page's end. Beyond ``top_k_rows`` of them the
    table is first narrowed to the range of sort keys around the page; if that is still wide,
    its rows are numbered where they are sorted and the page is a filter on the numbers, so
    neither a task nor the driver ever holds a page wider than ``top_k_rows``.
    """
    ordered = total_order(sort, tie_break)
    order = order_columns(ordered)
    skipped = 0
    if end > top_k_rows:
        df, skipped, rows = _narrow(df, ordered, start, end, top_k_rows, sample_rows)
        if rows > top_k_rows:
            numbered = with_positions(df, order, "_position")
            numbered = numbered.withColumn("_position", F.col("_position") + F.lit(skipped))
            return numbered.where((F.col("_position") >= start) & (F.col("_position") < end))
    rows = df.orderBy(*order).offset(start - skipped).limit(max(0, end - start))
    return number_page(rows, order, start)


def number_page(rows: DataFrame, order: list[Column], start: int) -> DataFrame:
    """Add ``_position`` to the rows of one page; only a page goes through the window."""
    position = F.row_number().over(Window.orderBy(*order)) + F.lit(start - 1)
    return rows.withColumn("_position", position.cast("long"))


def page_after(
    df: DataFrame, sort: SortModel, tie_break: list[str], last: Row | tuple | None, rows: int
) -> DataFrame:
    """The next ``rows`` rows after ``last``, the sort values of the row seen last."""
    ordered = total_order(sort, tie_break)
    if last is not None:
        later = ~is_before(df, ordered, last, inclusive=True)
        df = df.where(_lead_from(df, ordered, last) & later)
    return df.orderBy(*order_columns(ordered)).limit(rows)
