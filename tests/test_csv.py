import gzip

import pytest
from pyspark.sql import functions as F

from gridloom.operators import ingest as I
from gridloom.sources import csv
from gridloom.sources.csv import (
    broken_records,
    csv_lines,
    parse_lines,
    read_csv,
    read_header,
    read_records,
    write_csv,
)

DIRTY = (
    ' id ,,Name,name,a b\r\n'
    '1,x,"p""q","r\\"s",tail\r\n'
    '\r\n'
    '2,, NULL ,"a,b"\r\n'
    '3,"", "lead",x"y,z,extra\r\n'
    '4,"q"",t","""s""",C:\\tmp,"e\\\\f"\r\n'
)


@pytest.mark.parametrize("suffix", [".csv", ".csv.gz", ".csv.gzip"])
def test_dirty_file(spark, tmp_path, suffix):
    path = str(tmp_path / f"dirty{suffix}")
    if "gz" in suffix:
        with gzip.open(path, "wt", newline="") as f:
            f.write(DIRTY)
    else:
        with open(path, "w", newline="") as f:
            f.write(DIRTY)
    df = read_csv(spark, path)
    assert df.columns == ["id", "column_2", "Name", "name_2", "a_b"]
    assert sorted(tuple(r) for r in df.collect()) == [
        ("1", "x", 'p"q', 'r"s', "tail"),
        ("2", "", "NULL ", "a,b", None),
        ("3", "", "lead", 'x"y', "z"),
        ("4", 'q",t', '"s"', "C:\\tmp", "e\\f"),
    ]
    picked = read_csv(spark, path, columns=[4, 0])
    assert picked.columns == ["a_b", "id"]
    with pytest.raises(IndexError):
        read_csv(spark, path, columns=[5])


@pytest.mark.parametrize("delimiter", [";", "|", "\t"])
def test_delimiters(spark, tmp_path, delimiter):
    path = tmp_path / "d.csv"
    path.write_text(delimiter.join("ab") + "\n" + delimiter.join(["1", f'"x{delimiter}y"']) + "\n")
    assert tuple(read_csv(spark, str(path), delimiter=delimiter).first()) == ("1", f"x{delimiter}y")


def test_several_files_each_lose_their_header(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.csv").write_text(f"a,b\n{n},x\n")
    df = read_csv(spark, str(tmp_path))
    assert sorted(r.a for r in df.collect()) == ["0", "1", "2"]


MULTI = (
    'a,b,c\n1,"two\nlines",x\n2,"q""q\r\n\n, ""\n""",y\n3,x"y,z\n4,"bs \\" and\n \\"more",w\n'
    '5,\uffff and \x00,v\n6,"","\n\n"\n7,"a\n","b\n"\n'
)
MULTI_ROWS = [
    ("1", "two\nlines", "x"), ("2", 'q"q\r\n\n, "\n"', "y"), ("3", 'x"y', "z"), ("4", 'bs " and\n "more', "w"),
    ("5", "\uffff and \x00", "v"), ("6", "", "\n\n"), ("7", "a\n", "b\n"),
]


@pytest.mark.parametrize("split_bytes", ["8", "23", "64m"])
def test_line_breaks_in_quotes(spark, tmp_path, split_bytes):
    """Whatever the splits: also with line breaks, escapes and quotes at their ends."""
    for n in range(2):
        (tmp_path / f"m{n}.csv").write_bytes(MULTI.encode())
    settings = {"spark.sql.files.maxPartitionBytes": split_bytes, "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = read_csv(spark, str(tmp_path))
        assert sorted(tuple(r) for r in df.collect()) == sorted(MULTI_ROWS * 2)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_header_with_a_line_break_and_open_end(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text('\n"a\nb",c\n1,2\n3,"4\n5,6\n')
    df = read_csv(spark, str(path))
    assert df.columns == ["a_b", "c"] and [tuple(r) for r in df.collect()] == [("1", "2")]
    broken = broken_records(read_records(spark, str(path))).collect()
    assert [(r.raw, r.reason) for r in broken] == [('3,"4\n5,6', "a quote is not closed")]
    assert broken[0].source.endswith("h.csv")


def test_empty_file(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text("")
    with pytest.raises(ValueError):
        read_header(spark, str(path))


def test_long_quoted_cell(spark):
    cell = '"' + 'a""' * 100_000 + '"'
    df = spark.createDataFrame([(cell + ",z",)], "line string")
    row = parse_lines(df, "line", ["a", "b"]).select(F.length("a"), "b").first()
    assert tuple(row) == (200_000, "z")


def test_export_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame(
        [(1, 'a"b', True, None), (2, "c,d", False, ""), (3, " e ", None, "f\\g")],
        "id int, s string, ok boolean, t string",
    )
    out = str(tmp_path / "out")
    write_csv(df, out)
    back = read_csv(spark, out)
    assert back.columns == df.columns
    assert rows(back) == [
        ("1", 'a"b', "t", ""),
        ("2", "c,d", "f", ""),
        ("3", "e ", "", "f\\g"),
    ]
    assert sorted(r.line for r in csv_lines(df).collect()) == [
        '1,"a""b",t,',
        '2,"c,d",f,""',
        "3, e ,,f\\g",
    ]


def test_fixture_load(spark, tmp_path, rows):
    path = tmp_path / "people.csv"
    path.write_text("id,name,email,age\n1,John,j@x.org,30\n2,Jane,,25\n,,,\n3,Bob,b@x.org,forty\n")
    df = read_csv(spark, str(path))
    inferred = I.infer_types(df.where("age <> 'forty'"), conservative=False)
    assert [r.type for r in inferred.orderBy("position").collect()] == [
        "BIGINT",
        "TEXT",
        "TEXT",
        "BIGINT",
    ]
    types = dict(zip(df.columns, ["BIGINT", "VARCHAR(10)", "TEXT", "INTEGER"]))
    report = I.append_load(df, types, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert (report["read_count"], report["write_count"], report["skip_count"]) == (3, 2, 1)
    assert report["empty_count"] == 1 and report["status"] == "COMPLETED"
    assert report["failures"] == ["age: not parsed: forty"]
    assert rows(spark.read.parquet(str(tmp_path / "good"))) == [
        (1, "John", "j@x.org", 30),
        (2, "Jane", None, 25),
    ]
    assert rows(spark.read.parquet(str(tmp_path / "bad")), "column", "raw_value") == [
        ("age", "forty")
    ]


def test_too_many_rejects_fail(spark, tmp_path):
    df = spark.range(0, 200).selectExpr("concat('x', id) AS n")
    with pytest.raises(ValueError):
        I.append_load(df, {"n": "BIGINT"}, str(tmp_path / "g"), str(tmp_path / "b"))
    _, rejects = I.split_rejects(df, {"n": "BIGINT"})
    with pytest.raises(ValueError):
        I.check_skip_limit(rejects)
    I.check_skip_limit(rejects, limit=200)


def test_infer_edge_cases(spark):
    df = spark.createDataFrame(
        [("1", "1", "1.5", "2024-01-01", "2024-01-01T00:00:00Z", None, "a"),
         ("0", "2", "2", "2024-01-02", "2024-01-02T00:00", " ", "1"),
         (None, " null", "", "2024-01-03", "NULL", "null", "2")],
        "a string, b string, c string, d string, e string, f string, g string",
    )
    got = I.infer_types(df, conservative=False).orderBy("position").collect()
    assert [r.type for r in got] == [
        "BOOLEAN", "BIGINT", "DECIMAL", "DATE", "TIMESTAMP", "TEXT", "TEXT",
    ]
    assert {r.type for r in I.infer_types(df).collect()} == {"TEXT"}
    assert [r.value_count for r in got] == [2, 2, 2, 3, 2, 0, 3]
    empty = I.infer_types(df.limit(0), conservative=False).orderBy("position").collect()
    assert [(r.column, r.type, r.value_count) for r in empty] == [(c, "TEXT", 0) for c in df.columns]
    assert I.apply_type_overrides(["TEXT"] * 3, ["", None, " DATE "]) == ["TEXT", "TEXT", "DATE"]
    assert I.apply_type_overrides(["TEXT"], None) == ["TEXT"]


def test_header_looks_at_one_file(spark, tmp_path, monkeypatch):
    """Only the first file that has a record is searched for quotes, not all of them."""
    (tmp_path / "a 0.csv").write_text("\r\n\n")
    (tmp_path / "a 1.csv").write_text('"x\ny",z\n1,2\n')
    (tmp_path / "b.csv").write_text("other,names\n3,4\n")
    searched, real = [], csv.join_records

    def joined(lines, *rest):
        searched.append(lines.select("_file").distinct().count())
        return real(lines, *rest)

    monkeypatch.setattr(csv, "join_records", joined)
    assert read_header(spark, str(tmp_path)) == ["x\ny", "z"]
    assert searched == [1]
