"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# A key with more rows than this is spread over several tasks.
ROWS_PER_TASK = 2_000_000

# A side is broadcast only when it was measured to be below both.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20


def join_unique(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    *,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join ``left``, whose keys may repeat without bound, to ``right``, one row per key.

    ``how`` is inner, left, left_semi or left_anti. Rows of a hot key, the NULL key included,
    are spread over as many salts as they fill tasks, and only that key's single right row is
    copied. The salt is a hash of the row, so a recomputed task places every row where it was
    before. The list of hot keys goes to all tasks; it has at most one entry for each
    ``rows_per_task`` rows of ``left``, half a million at 10^12 rows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    keys = [f"_hot{i}" for i in range(len(on))]
    hot = F.broadcast(
        left.groupBy(*[F.col(c).alias(k) for c, k in zip(on, keys)])
        .agg(F.ceil(F.count(F.lit(1)) / rows_per_task).cast("int").alias("_salts"))
        .where(F.col("_salts") > 1)
    )

    def salted(side: DataFrame) -> DataFrame:
        same = F.lit(True)
        for c, k in zip(on, keys):
            same &= side[c].eqNullSafe(hot[k])
        joined = side.join(hot, same, "left").drop(*keys)
        return joined.withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    spread = F.pmod(F.xxhash64(*left.columns), F.col("_salts")).cast("int")
    salted_left = salted(left).withColumn("_salt", spread).drop("_salts")
    copies = F.sequence(F.lit(0), F.col("_salts") - 1)
    salted_right = salted(right).withColumn("_salt", F.explode(copies)).drop("_salts")
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def broadcast_if_small(
    stored: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Mark a checkpointed frame for broadcast when it really is small.

    Estimates stop at the first join or aggregate, so every task adds up its own rows and
    their size, and only those sums meet. A larger frame is returned as it is and joins by
    shuffle.
    """
    rows, size = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum(_width(stored)), F.lit(0))).first()
    return F.broadcast(stored) if rows <= max_rows and size <= max_bytes else stored


def _width(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    width = F.lit(0).cast("long")
    for field in df.schema.fields:
        if isinstance(field.dataType, T.AtomicType) and not isinstance(field.dataType, T.StringType):
            width += 8
        else:
            text = F.col(field.name)
            if not isinstance(field.dataType, T.StringType):
                text = F.to_json(F.struct(text))
            width += F.coalesce(F.octet_length(text), F.lit(0)) + 8
    return width


def data_bytes(df: DataFrame) -> int:
    """About how many bytes the rows take, by reading them once."""
    return df.agg(F.coalesce(F.sum(_width(df)), F.lit(0))).first()[0]
