"""Integrity checks on tables and their copies."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.cells import timestamp_literal
from gridloom.functions.names import ID_COLUMN, LABEL, matches_whole


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, with their row counts."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))
    return counted.where(F.col("cnt") > 1)


def distinct_ids(df: DataFrame, id_col: str = ID_COLUMN) -> DataFrame:
    return df.select(id_col).distinct()


def missing_ids(expected: DataFrame, copy: DataFrame, id_col: str = ID_COLUMN) -> DataFrame:
    """Expected ids the copy does not hold."""
    return distinct_ids(expected, id_col).join(distinct_ids(copy, id_col), id_col, "left_anti")


def integrity_report(
    initial_count: int, tracked: DataFrame, copy: DataFrame, id_col: str = ID_COLUMN
) -> DataFrame:
    """One row comparing a copy with what it should hold.

    Expected are the ``initial_count`` rows there were, tracked ids not among them, plus
    the tracked inserts. Both id lists go through one aggregation, so ids repeated
    without bound are summed up before they move.
    """
    marked = tracked.select(id_col, F.lit(1).alias("_tracked"), F.lit(0).alias("_copied"))
    marked = marked.unionByName(
        copy.select(id_col, F.lit(0).alias("_tracked"), F.lit(1).alias("_copied"))
    )
    ids = marked.groupBy(id_col).agg(
        F.max("_tracked").alias("_tracked"), F.sum("_copied").alias("_copies")
    )
    is_tracked = F.col("_tracked") == 1
    counts = ids.agg(
        F.count_if(is_tracked).alias("tracked_inserts"),
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("actual_count"),
        F.count_if(is_tracked & (F.col("_copies") == 0)).alias("missing_count"),
        F.count_if(F.col("_copies") > 1).alias("duplicate_ids"),
    )
    expected = F.col("tracked_inserts") + F.lit(initial_count)
    loss, mismatch = F.col("missing_count") > 0, F.col("actual_count") != expected
    return counts.select(
        expected.alias("expected_count"),
        "actual_count",
        "tracked_inserts",
        "missing_count",
        "duplicate_ids",
        loss.alias("data_loss"),
        mismatch.alias("count_mismatch"),
        (~loss & ~mismatch).alias("valid"),
    )


def insert_stats(
    df: DataFrame, at: str, start: datetime.datetime, end: datetime.datetime
) -> DataFrame:
    """Rows inserted before, during and after [start, end], three separate classes."""
    begin, finish, ts = timestamp_literal(start), timestamp_literal(end), F.col(at)
    return df.agg(
        F.count(F.lit(1)).alias("total_inserts"),
        F.count_if(ts < begin).alias("inserts_before"),
        F.count_if((ts >= begin) & (ts <= finish)).alias("inserts_during"),
        F.count_if(ts > finish).alias("inserts_after"),
    )


def violations(df: DataFrame, keep: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule and row; a rule that is NULL counts as broken."""
    broken = [
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()
    ]
    rules_broken = df.select(*keep, F.explode(F.array(*broken)).alias("rule"))
    return rules_broken.where(F.col("rule").isNotNull())


def in_domain(column: Column, values: list) -> Column:
    return column.isin(*values)


def is_label(column: Column) -> Column:
    return (F.trim(column) != "") & matches_whole(column, LABEL)


def orphan_keys(
    children: DataFrame, parents: DataFrame, child_key: str, parent_key: str
) -> DataFrame:
    """Child keys without a parent and how many rows hold them.

    Keys are counted first, so a key repeated without bound joins as one row. NULL refers
    to no parent and is no violation.
    """
    used = children.groupBy(child_key).agg(F.count(F.lit(1)).alias("cnt"))
    known = parents.select(F.col(parent_key).alias(child_key))
    return used.where(F.col(child_key).isNotNull()).join(known, child_key, "left_anti")
