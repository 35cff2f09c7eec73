"""Schema changes. Each one is a projection into a new version of the table."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gridloom.functions.cells import parse_value, strip, timestamp_literal
from gridloom.functions.names import LABEL, check_identifier
from gridloom.functions.types import ColumnType, field_of, field_type_name, parse_type, type_metadata

BASE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("add_usr", T.StringType()),
        T.StructField("add_ts", T.TimestampNTZType()),
        T.StructField("upd_usr", T.StringType()),
        T.StructField("upd_ts", T.TimestampNTZType()),
    ]
)

# Where a table may be defined.
DEPLOYMENT_TYPES = ("DESIGN_TIME", "RUN_TIME")


def check_deployment_type(value: str | None, default: str = "DESIGN_TIME") -> str:
    if value is None or not value.strip():
        return default
    if value not in DEPLOYMENT_TYPES:
        raise ValueError("a table is deployed as RUN_TIME or DESIGN_TIME")
    return value


def check_table_form(label: str | None, columns: dict[str, str]) -> dict[str, str]:
    """Check the label and columns of a table about to be made; blank columns are left out."""
    named = {c: t for c, t in columns.items() if c.strip()}
    if label is None or not label.strip():
        raise ValueError("a table needs a name")
    if not named:
        raise ValueError("a table needs a column")
    for text in (label, *named):
        if not re.fullmatch(LABEL, text):
            raise ValueError(f"only letters, digits and underscores are allowed: {text}")
    for type_text in named.values():
        parse_type(type_text)
    return named


def add_column(df: DataFrame, name: str, type_text: str) -> DataFrame:
    """Add a column that is NULL in the rows there are."""
    check_identifier(name)
    if name.lower() in [c.lower() for c in df.columns]:
        raise ValueError(f"the table has a column {name} already")
    added = df.withColumn(name, F.lit(None).cast(parse_type(type_text).spark))
    return added.withMetadata(name, type_metadata(type_text))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"no column {name} in the table")
    return df.drop(name)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename columns; new names must be free, counting names that differ in case as equal."""
    for old, new in names.items():
        if old not in df.columns:
            raise ValueError(f"no column {old} in the table")
        check_identifier(new)
    after = [names.get(c, c).lower() for c in df.columns]
    taken = sorted({n for n in after if after.count(n) > 1})
    if taken:
        raise ValueError(f"several columns would be called {', '.join(taken)}")
    return df.withColumnsRenamed(names)


def _converted(column: Column, source: T.DataType, target: ColumnType) -> Column:
    if isinstance(source, T.StringType) and not isinstance(target.spark, T.StringType):
        return parse_value(strip(column), target)
    if isinstance(source, (T.DoubleType, T.FloatType)) and isinstance(
        target.spark, T.IntegralType
    ):
        column = F.rint(column)  # rounds to even, where a plain cast would cut off
    value = column.try_cast(target.spark)
    if target.max_length is not None:
        value = F.when(F.length(value) <= target.max_length, value)
    return value


def conversion_failures(df: DataFrame, name: str, type_text: str, keep: list[str]) -> DataFrame:
    """Rows whose value in ``name`` has no counterpart in the new type."""
    target = parse_type(type_text)
    converted = _converted(F.col(name), df.schema[name].dataType, target)
    return df.where(F.col(name).isNotNull() & converted.isNull()).select(*keep, name)


def converted_column(df: DataFrame, name: str, type_text: str) -> DataFrame:
    """``df`` with one column in the new type, NULL where a value does not convert."""
    target = parse_type(type_text)
    converted = df.withColumn(name, _converted(F.col(name), df.schema[name].dataType, target))
    return converted.withMetadata(name, type_metadata(type_text))


def change_column_type(df: DataFrame, name: str, type_text: str) -> DataFrame:
    """Change a column's type; one value that does not convert fails the whole change."""
    if name not in df.columns:
        raise ValueError(f"no column {name} in the table")
    if not conversion_failures(df, name, type_text, []).isEmpty():
        raise ValueError(f"Values of {name} do not convert to {type_text}")
    return converted_column(df, name, type_text)


def table_structure(df: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """One row ``(ordinal, column, type, default)`` per column, in table order."""
    defaults = defaults or {}
    rows = [
        (i, f.name, field_type_name(f), defaults.get(f.name))
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    schema = "ordinal int, column string, type string, default string"
    return df.sparkSession.createDataFrame(rows, schema)


def clone_structure(df: DataFrame) -> DataFrame:
    """An empty table with the same columns."""
    return df.sparkSession.createDataFrame([], df.schema)


def empty_table(spark: SparkSession, columns: dict[str, str] | None = None) -> DataFrame:
    """A new table: id, audit columns, then the given columns."""
    extra = [field_of(check_identifier(c), t) for c, t in (columns or {}).items()]
    return spark.createDataFrame([], T.StructType([*BASE_SCHEMA.fields, *extra]))


def backfill_default(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill the NULLs of newly added columns."""
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in defaults.items()}
    )


def rename_label(
    tables: DataFrame, table_id: Column, new_label: Column, user: str, now: datetime.datetime
) -> DataFrame:
    """Relabel the catalog rows where ``table_id`` is true; data stays as it is."""
    return tables.withColumns(
        {
            "tbl_label": F.when(table_id, new_label).otherwise(F.col("tbl_label")),
            "upd_usr": F.when(table_id, F.lit(user)).otherwise(F.col("upd_usr")),
            "upd_ts": F.when(table_id, timestamp_literal(now)).otherwise(F.col("upd_ts")),
        }
    )
