"""Consecutive numbers over a distributed sort order, and new row ids from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridloom.session import checkpointed

_IN_PARTITION = (1 << 33) - 1  # low bits of monotonically_increasing_id

# Where a row lies: its partition and its place there.
PLACED = [T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())]


def placed_columns() -> list[Column]:
    """The columns ``PLACED`` of rows about to be written; ``numbered_rows`` reads them."""
    at = F.monotonically_increasing_id().bitwiseAND(_IN_PARTITION)
    return [F.spark_partition_id().alias("_part"), at.alias("_at")]


def numbered_rows(placed: DataFrame, name: str) -> DataFrame:
    """Number stored rows by where they lay, from 0 on.

    Numbers are without gaps where ``placed`` holds all rows that were written, and have gaps
    where rows in between were left out.
    """
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.max(F.col("_at") + 1).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    # One row per partition, so the broadcast is bounded by the partition count.
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_at"))
        .drop("_part", "_at", "_start")
    )


def with_positions(df: DataFrame, order: list[Column] | None, name: str) -> DataFrame:
    """Add the 0-based position of each row under ``order``.

    A window without partitions would put every row in one task. Here the rows are
    range-partitioned by the sort, written once to the checkpoint folder, and numbered
    inside each partition; the only global step adds up one count per partition. Without
    an order the rows are numbered where they are and nothing is shuffled.

    A hash of the row ends the sort, so an order with many ties is still cut into even
    ranges; give no order where very many rows may be exact copies of each other.
    """
    if order is not None:
        df = df.orderBy(*order, F.xxhash64(*df.columns))
    return numbered_rows(checkpointed(df.select("*", *placed_columns())), name)


def max_id(df: DataFrame, id_col: str) -> int:
    """The largest id in use, 0 for an empty table."""
    return df.agg(F.max(id_col)).first()[0] or 0


def assign_ids(
    new: DataFrame,
    base: DataFrame,
    order: list[Column] | None,
    id_col: str,
    first: int | None = None,
) -> DataFrame:
    """Give ``new`` rows the ids from ``first`` on, by default following the largest in ``base``."""
    first = max_id(base, id_col) + 1 if first is None else first
    numbered = with_positions(new.drop(id_col), order, id_col)
    id_type = base.schema[id_col].dataType
    return numbered.withColumn(id_col, (F.col(id_col) + F.lit(first)).cast(id_type))
