"""Columns that take texts of limited length, VARCHAR(n).

The length is metadata of the column (``types.field_of``), counted in characters. Spark does not
check it, so every way into a stored table does, with the functions here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridloom.functions.types import MAX_LENGTH, max_lengths


def _too_long(name: str, length: int) -> Column:
    return F.length(F.col(name)) > length


def length_rejects(df: DataFrame, struct: T.StructType, keep: list[str]) -> DataFrame:
    """One row per text of ``df`` that is longer than its column in ``struct`` takes.

    Columns: ``keep``, then column, raw_value, target_type, reason. One pass, no shuffle; NULL
    always fits, and columns ``df`` lacks are not looked at.
    """
    cells = []
    for name, length in _present(df, struct).items():
        cell = F.struct(
            F.lit(name).alias("column"),
            F.col(name).alias("raw_value"),
            F.lit(f"VARCHAR({length})").alias("target_type"),
            F.lit("too long").alias("reason"),
        )
        cells.append(F.when(_too_long(name, length), cell))
    if not cells:
        shape = "column string, raw_value string, target_type string, reason string"
        none = F.from_json(F.lit(None).cast("string"), f"array<struct<{shape}>>")
        return df.select(*keep, F.inline(none))
    return df.select(*keep, F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))


def fitting_rows(df: DataFrame, struct: T.StructType) -> DataFrame:
    """Rows whose texts all fit; those ``length_rejects`` names are left out."""
    for name, length in _present(df, struct).items():
        df = df.where(~F.coalesce(_too_long(name, length), F.lit(False)))
    return df


def checked(df: DataFrame, struct: T.StructType) -> DataFrame:
    """``df`` with its lengths as metadata, failing the job that meets a text that does not fit.

    The check is part of the projection, so a write needs no pass of its own for it, and a write
    that fails is not published.
    """
    lengths = _present(df, struct)
    columns = []
    for name in df.columns:
        column = F.col(name)
        if name in lengths:
            message = F.lit(f"too long for VARCHAR({lengths[name]}) in {name}")
            column = F.when(_too_long(name, lengths[name]), F.raise_error(message)).otherwise(column)
        columns.append(column.alias(name))
    return described(df.select(*columns) if lengths else df, struct)


def described(df: DataFrame, struct: T.StructType) -> DataFrame:
    """``df`` with the lengths of ``struct`` as metadata of its columns; nothing is checked."""
    lengths = _present(df, struct)
    if max_lengths(df.schema) == lengths:
        return df
    return df.select(
        *[
            F.col(c).alias(c, metadata={MAX_LENGTH: lengths[c]}) if c in lengths else F.col(c)
            for c in df.columns
        ]
    )


def _present(df: DataFrame, struct: T.StructType) -> dict[str, int]:
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return {n: length for n, length in max_lengths(struct).items() if n in texts}


def inherited(struct: T.StructType, old: T.StructType) -> T.StructType:
    """``struct`` with the lengths its text columns had in ``old``, where it names none itself."""
    known = max_lengths(old)
    fields = []
    for f in struct.fields:
        if isinstance(f.dataType, T.StringType) and f.name in known and MAX_LENGTH not in (f.metadata or {}):
            f = T.StructField(f.name, f.dataType, f.nullable, {MAX_LENGTH: known[f.name]})
        fields.append(f)
    return T.StructType(fields)
