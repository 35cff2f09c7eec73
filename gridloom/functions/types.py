"""Type names users write, and the Spark types behind them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

DEFAULT_VARCHAR = 255
DEFAULT_DECIMAL = T.DecimalType(38, 18)

# Accepted type names -> canonical name.
TYPE_NAMES = {
    "TEXT": "TEXT",
    "INTEGER": "INTEGER",
    "INT": "INTEGER",
    "BIGINT": "BIGINT",
    "LONG": "BIGINT",
    "BOOLEAN": "BOOLEAN",
    "BOOL": "BOOLEAN",
    "DATE": "DATE",
    "TIMESTAMP": "TIMESTAMP",
    "DECIMAL": "DECIMAL",
    "NUMERIC": "DECIMAL",
    "DOUBLE": "DOUBLE",
    "DOUBLE PRECISION": "DOUBLE",
    "FLOAT": "REAL",
    "REAL": "REAL",
}

_SPARK = {
    "TEXT": T.StringType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "DECIMAL": DEFAULT_DECIMAL,
    "DOUBLE": T.DoubleType(),
    "REAL": T.FloatType(),
}

_SIZED = re.compile(r"^(VARCHAR|DECIMAL|NUMERIC)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?$")


@dataclass(frozen=True)
class ColumnType:
    """A parsed type name: canonical name, Spark type, and VARCHAR length if any."""

    name: str
    spark: T.DataType
    max_length: int | None = None


def parse_type(name: str) -> ColumnType:
    """Parse a type name, ignoring case and outer blanks; unknown names raise."""
    if name is None or not name.strip():
        raise ValueError("a column needs a type")
    text = " ".join(name.upper().split())
    sized = _SIZED.match(text)
    if sized and sized.group(1) == "VARCHAR":
        length = int(sized.group(2) or DEFAULT_VARCHAR)
        return ColumnType(f"VARCHAR({length})", T.StringType(), length)
    if sized and sized.group(2):
        precision, scale = int(sized.group(2)), int(sized.group(3) or 0)
        return ColumnType(f"DECIMAL({precision},{scale})", T.DecimalType(precision, scale))
    if text not in TYPE_NAMES:
        raise ValueError(f"not a type of this library: {name!r}")
    canonical = TYPE_NAMES[text]
    return ColumnType(canonical, _SPARK[canonical])


def type_name(data_type: T.DataType) -> str:
    """The name a column of this Spark type reads back as."""
    if isinstance(data_type, (T.VarcharType, T.CharType)):
        return f"VARCHAR({data_type.length})"
    if isinstance(data_type, T.DecimalType):
        return "DECIMAL"
    if isinstance(data_type, T.TimestampType):
        return "TIMESTAMPTZ"
    for canonical, spark_type in _SPARK.items():
        if type(spark_type) is type(data_type):
            return canonical
    if isinstance(data_type, T.ShortType):
        return "SMALLINT"
    if isinstance(data_type, T.ByteType):
        return "TINYINT"
    return data_type.simpleString().upper()


# Metadata of a text column: the most characters it takes.
MAX_LENGTH = "max_length"


def type_metadata(type_text: str) -> dict[str, int]:
    """What a column of this type has to remember beside its Spark type."""
    length = parse_type(type_text).max_length
    return {} if length is None else {MAX_LENGTH: length}


def field_of(name: str, type_text: str) -> T.StructField:
    """A table's column of the named type, its length kept as metadata."""
    return T.StructField(name, parse_type(type_text).spark, True, type_metadata(type_text))


def field_type_name(field: T.StructField) -> str:
    """The name a table's column reads back as, its length included."""
    length = (field.metadata or {}).get(MAX_LENGTH)
    return type_name(field.dataType) if length is None else f"VARCHAR({length})"


def max_lengths(struct: T.StructType) -> dict[str, int]:
    """The columns that hold texts of limited length."""
    return {f.name: f.metadata[MAX_LENGTH] for f in struct.fields if MAX_LENGTH in (f.metadata or {})}


def type_of(data_type: T.DataType) -> ColumnType:
    """The column type that parses text into ``data_type``."""
    if isinstance(data_type, T.DecimalType):
        return parse_type(f"DECIMAL({data_type.precision},{data_type.scale})")
    if isinstance(data_type, (T.ShortType, T.ByteType)):
        return ColumnType(type_name(data_type), data_type)
    return parse_type(type_name(data_type))
