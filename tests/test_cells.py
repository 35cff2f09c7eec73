import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from gridloom.functions import cells, names
from gridloom.functions.types import parse_type, type_name


def parsed(spark, values, type_name):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = df.select("i", cells.parse_cell(F.col("v"), type_name).alias("p")).orderBy("i")
    return [r.p for r in out.collect()]


def test_normalize_cell(spark):
    raw = ["  a b\t", "", "   ", "NULL", " nUll ", "nullx", None, "\x01\n x \r"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string")
    out = df.select("i", cells.normalize_cell(F.col("v")).alias("p")).orderBy("i").collect()
    assert [r.p for r in out] == ["a b", None, None, None, None, "nullx", None, "x"]


def test_boolean_words(spark):
    words = ["true", "T", "yes", "Y", "1", "FALSE", "f", "no", "n", "0", "on", "null"]
    assert parsed(spark, words, "bool") == [True] * 5 + [False] * 5 + [None, None]


def test_integers(spark):
    values = ["+5", "-7", "5.0", "1e3", "9223372036854775807", "9223372036854775808", " 12 "]
    assert parsed(spark, values, "BIGINT") == [5, -7, None, None, 2**63 - 1, None, 12]
    assert parsed(spark, ["2147483647", "2147483648"], "int") == [2147483647, None]


def test_numbers(spark):
    assert parsed(spark, ["1.50", "1e3", ".5", "5.", "1,5"], "numeric") == [
        Decimal("1.5"),
        Decimal("1000"),
        Decimal("0.5"),
        Decimal("5"),
        None,
    ]
    got = parsed(spark, ["1e3", "Infinity", "nan", "2.5d", "x", "-.5"], "double")
    assert got == [1000.0, float("inf"), None, 2.5, None, -0.5]
    assert str(parsed(spark, ["NaN"], "real")[0]) == "nan"


def test_dates(spark):
    values = ["2024-01-05", "2024-1-5", "2024-02-30", "2024", "2024-01-05T10:00:00"]
    assert parsed(spark, values, "DATE") == [datetime.date(2024, 1, 5), None, None, None, None]


def test_timestamps_keep_the_wall_clock(spark):
    at = datetime.datetime(2024, 1, 1, 10, 0, 0)
    values = [
        "2024-01-01T10:00:00+05:30",
        "2024-01-01T10:00:00Z",
        "2024-01-01T10:00",
        "2024-01-01t10:00:00.5",
        "2024-01-01 10:00:00",
        "2024-01-01",
        "2024-01-01T25:00:00",
    ]
    half = at.replace(microsecond=500000)
    assert parsed(spark, values, "timestamp") == [at, at, at, half, None, None, None]


def test_reject_reason(spark):
    cases = [
        ("5", "VARCHAR(3)", None),
        ("12345", "VARCHAR(3)", "too long"),
        ("3000000000", "INTEGER", "out of range"),
        ("x", "INTEGER", "not parsed"),
        ("maybe", "BOOLEAN", None),
        (" null ", "DATE", None),
        ("2024-13-01", "DATE", "not parsed"),
        ("1" * 25, "DECIMAL", "not parsed"),
    ]
    for raw, type_text, expected in cases:
        df = spark.createDataFrame([(raw,)], "v string")
        text = cells.normalize_cell(F.col("v"))
        value = cells.parse_value(text, parse_type(type_text))
        got = df.select(cells.reject_reason(text, value, type_text)).first()[0]
        assert got == expected, (raw, type_text)


def test_type_names():
    assert parse_type(" varchar ").name == "VARCHAR(255)"
    assert parse_type("VarChar(10)").max_length == 10
    assert parse_type("long").spark == T.LongType()
    assert parse_type("DECIMAL(10,2)").spark == T.DecimalType(10, 2)
    assert parse_type("float").name == "REAL"
    for bad in ("", None, "JSON", "VARCHAR(x)"):
        with pytest.raises(ValueError):
            parse_type(bad)
    assert type_name(T.TimestampNTZType()) == "TIMESTAMP"
    assert type_name(T.TimestampType()) == "TIMESTAMPTZ"
    assert type_name(T.VarcharType(9)) == "VARCHAR(9)"
    assert type_name(T.DecimalType(10, 2)) == "DECIMAL"


def test_headers():
    raw = ["", None, " a  b ", "a\tb", "A_B", "x-y", "é"]
    assert names.normalize_headers(raw) == [
        "column_1",
        "column_2",
        "a_b",
        "a_b_2",
        "A_B_3",
        "x_y",
        "_",
    ]
    assert names.normalize_headers(["Name", "name"], case_sensitive=True) == ["Name", "name"]
    assert names.normalize_headers(["a", "a", "a_2", "a"]) == ["a", "a_2", "a_2_2", "a_3"]


def test_identifiers():
    assert names.check_identifier("_a1") == "_a1"
    for bad in ("1a", "a-b", "", None, "a b"):
        with pytest.raises(ValueError):
            names.check_identifier(bad)


def test_type_by_name():
    rules = {
        "age": "INTEGER",
        "page": None,
        "User_ID": "INTEGER",
        "id": "BIGINT",
        "discount": "INTEGER",
        "is_open": "BOOLEAN",
        "enabled": "BOOLEAN",
        "unit_price": "DOUBLE",
        "rating": None,
        "rate": "DOUBLE",
        "name": None,
    }
    assert {n: names.type_by_name(n) for n in rules} == rules
