"""Column expressions over text cells: clean-up, typed parsing, type predicates.

Everything is a built-in expression, so a whole row parses inside one generated
stage. ``try_cast`` is more lenient than the ISO and number formats wanted here,
so a pattern guards each cast.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, functions as F, types as T

from gridloom.functions.types import ColumnType, parse_type

# Characters removed at both ends of a cell (U+0000 to U+0020).
_BLANKS = "".join(chr(c) for c in range(0x21))

# Words read as booleans.
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")

_INTEGER = r"^[+-]?[0-9]+\z"
_NUMBER = r"([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_DECIMAL = rf"^[+-]?{_NUMBER}\z"
_DOUBLE = rf"^[+-]?(NaN|Infinity|{_NUMBER}[fFdD]?)\z"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
_WALL_CLOCK = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?"
_OFFSET = r"(?:[Zz]|[+-][0-9]{2}(?::?[0-9]{2}(?::?[0-9]{2})?)?)?"
_TIMESTAMP = rf"^({_WALL_CLOCK}){_OFFSET}\z"


def timestamp_literal(at: datetime.datetime) -> Column:
    """A wall-clock timestamp that no session time zone shifts."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def strip(cell: Column) -> Column:
    return F.trim(cell, F.lit(_BLANKS))


def normalize_cell(cell: Column) -> Column:
    """Trim; an empty cell or the word null (any case) becomes NULL."""
    text = strip(cell)
    return F.when((text != "") & (F.lower(text) != "null"), text)


def parse_boolean(text: Column) -> Column:
    word = F.lower(text)
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def _guarded(text: Column, pattern: str, data_type: T.DataType) -> Column:
    return F.when(text.rlike(pattern), text.try_cast(data_type))


def parse_date(text: Column) -> Column:
    return _guarded(text, _DATE, T.DateType())


def parse_timestamp(text: Column) -> Column:
    """ISO date and time; an offset is dropped and the wall clock kept."""
    wall_clock = F.upper(F.regexp_extract(text, _TIMESTAMP, 1))
    return F.when(wall_clock != "", wall_clock.try_cast(T.TimestampNTZType()))


def parse_value(text: Column, column_type: ColumnType) -> Column:
    """Parse clean text as ``column_type``; NULL where it does not parse."""
    spark_type = column_type.spark
    if isinstance(spark_type, T.StringType):
        return text
    if isinstance(spark_type, T.BooleanType):
        return parse_boolean(text)
    if isinstance(spark_type, T.DateType):
        return parse_date(text)
    if isinstance(spark_type, T.TimestampNTZType):
        return parse_timestamp(text)
    if isinstance(spark_type, T.IntegralType):
        return _guarded(text, _INTEGER, spark_type)
    if isinstance(spark_type, T.DecimalType):
        return _guarded(text, _DECIMAL, spark_type)
    if isinstance(spark_type, (T.DoubleType, T.FloatType)):
        return _guarded(text, _DOUBLE, spark_type)
    return text.try_cast(spark_type)


def parse_cell(cell: Column, type_name: str) -> Column:
    return parse_value(normalize_cell(cell), parse_type(type_name))


def reject_reason(text: Column, value: Column, type_name: str) -> Column:
    """Why a table column of this type refuses clean ``text`` that parsed to ``value``;
    NULL when it fits.

    An unknown boolean word is stored as NULL and refuses nothing.
    """
    column_type = parse_type(type_name)
    if column_type.max_length is not None:
        return F.when(F.length(text) > column_type.max_length, F.lit("too long"))
    if isinstance(column_type.spark, (T.StringType, T.BooleanType)):
        return F.lit(None).cast("string")
    bad = text.isNotNull() & value.isNull()
    if isinstance(column_type.spark, T.IntegerType):
        in_long_range = parse_value(text, parse_type("BIGINT")).isNotNull()
        return F.when(bad & in_long_range, F.lit("out of range")).when(bad, F.lit("not parsed"))
    return F.when(bad, F.lit("not parsed"))


# The types inference knows, in the order it prefers them.
TYPE_ORDER = ("BOOLEAN", "BIGINT", "DECIMAL", "DATE", "TIMESTAMP")


def type_bits(text: Column) -> Column:
    """The types a clean cell reads as: bit k stands for ``TYPE_ORDER[k]``.

    Only words and numbers of up to five bytes can be several types at once. The first
    character, then the length, rule out most patterns before any is tried.
    """
    size = F.octet_length(text)
    boolean = F.when((size <= 5) & parse_boolean(text).isNotNull(), 1).otherwise(0)
    # An integer that a long cannot hold is still a decimal.
    short = (size <= 18) | text.try_cast(T.LongType()).isNotNull()
    number = (
        F.when(text.rlike(_INTEGER), F.when(short, 6).otherwise(4))
        .when(text.rlike(_DECIMAL), 4)
        .otherwise(0)
    )
    date = F.when((size == 10) & parse_date(text).isNotNull(), 8).otherwise(0)
    moment = F.when((size >= 16) & parse_timestamp(text).isNotNull(), 16).otherwise(0)
    dashed = F.substring(text, 5, 1) == "-"
    first = F.substring(text, 1, 1)
    digits = F.when(dashed, number.bitwiseOR(date).bitwiseOR(moment)).otherwise(number)
    return (
        F.when(first.between("0", "9"), digits)
        .when(first.isin("+", "-", "."), number)
        .otherwise(0)
        .bitwiseOR(boolean)
    )
