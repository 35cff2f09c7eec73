import datetime

import pytest
from pyspark.sql import functions as F, types as T

from gridloom.functions.names import is_identifier
from gridloom.operators import catalog as K
from gridloom.operators import evolve as E
from gridloom.operators import quality as L
from gridloom.operators import query as Q
from gridloom.operators import versions as V

NOW = datetime.datetime(2024, 6, 1, 12)


def day(n):
    return datetime.datetime(2024, 1, n)


def test_catalog_order(spark):
    df = spark.createDataFrame(
        [(1, day(1), None), (2, day(2), day(3)), (3, day(5), None), (4, day(1), day(9))],
        "id int, add_ts timestamp_ntz, upd_ts timestamp_ntz",
    )
    assert [r.id for r in K.by_recent_update(df).collect()] == [4, 2, 3, 1]
    assert [r.id for r in K.by_recent_touch(df).collect()] == [4, 3, 2, 1]


def test_parents_with_children(spark, rows):
    parents = spark.createDataFrame([(1, "a"), (2, "b")], "id int, label string")
    children = spark.createDataFrame([(10, 1), (11, 1), (12, 9)], "cid int, pid int")
    got = K.parents_with_children(parents, children, "id", "pid")
    assert rows(got) == [(1, "a", 10, 1), (1, "a", 11, 1), (2, "b", None, None)]
    salted = K.parents_with_children(
        parents, children, "id", "pid", rows_per_task=1
    )
    assert rows(salted) == rows(got)


def test_find_across_schemas(spark):
    make = lambda *ids: spark.createDataFrame([(i, f"x{i}") for i in ids], "id int, l string")
    schemas = {"published": make(1, 2), "public": make(2, 3), "other": make(3, 4)}
    order = K.schema_order(["published", "public", "other"])
    assert order == ["public", "published", "other"]
    found = K.find_across_schemas({s: schemas[s] for s in order})
    assert {r.id: r.schema_name for r in found.collect()} == {
        1: "published", 2: "public", 3: "public", 4: "other",
    }


def test_cascade(spark, rows):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "pid int, v string")
    gone = spark.createDataFrame([(1,), (1,), (7,)], "x int")
    left, kids = K.cascade_delete(parents, children, gone, "id", "pid")
    assert rows(left) == [(2,)]
    assert rows(kids) == [(2, "b"), (None, "c")]


def test_columns_with_types(spark, rows):
    columns = spark.createDataFrame([(1, "a"), (2, "gone")], "id int, col_link string")
    df = spark.createDataFrame([], "a timestamp_ntz, b int")
    got = K.columns_with_types(columns, K.physical_types(df))
    assert rows(got) == [(1, "a", "TIMESTAMP"), (2, "gone", None)]


def test_filters(spark):
    df = spark.createDataFrame(
        [(1, "100% Wool"), (2, "1000 wool"), (3, None), (4, "a\\b")], "n int, s string"
    )

    def ids(condition):
        return [r.n for r in df.where(condition).orderBy("n").collect()]

    assert ids(Q.text_filter(F.col("s"), "0% w")) == [1, 2]
    assert ids(Q.text_filter(F.col("s"), "0% W", literal=True)) == [1]
    assert ids(Q.text_filter(F.col("s"), "a\\b")) == [4]
    assert ids(Q.text_filter(F.col("n"), "2")) == [2]
    assert ids(Q.number_filter(F.col("n"), "notBetween", 2)) == [2]
    assert Q.filter_model(df, {"s": {"filterType": "date", "filter": "x"}}).count() == 4
    assert Q.filter_condition({}) is None
    both = {
        "s": {"filterType": "text", "filter": "wool"},
        "n": {"filterType": "number", "type": "lessThan", "filter": 2},
    }
    assert Q.page_total(df, both, pending=2).first().total == 3


def test_label_projection(spark):
    df = spark.createDataFrame(
        [], "x1 string, add_usr string, id long, x2 int, upd_ts timestamp_ntz"
    )
    shown = Q.label_projection(df, {"x1": "First name"})
    assert shown.columns == ["ID", "FIRST NAME", "X2", "CREATED BY", "UPDATED AT"]
    assert Q.editable_columns(df) == ["x1", "x2"]


def test_column_search_is_literal(spark):
    df = spark.createDataFrame([("a_b", "TEXT"), ("axb", "Text"), ("c", "INT")], "n string, t string")
    assert Q.column_search(df, "A_B", ["n", "t"]).count() == 1
    assert Q.column_search(df, "text", ["n", "t"]).count() == 2


def test_identifier_column(spark):
    df = spark.createDataFrame([("a",), ("1a",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(is_identifier(F.col("s"))).collect()] == [True, False, False, False]


def test_exists_and_lookup(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b")], "id int, l string")
    assert Q.lookup_first(df, "l", "a").first().id == 1
    assert Q.lookup(df, 3).count() == 1
    assert Q.exists(df, F.col("l") == "b").first().found is True
    assert Q.exists(df, F.col("l") == "z").first().found is False


def test_evolution(spark, rows):
    df = spark.createDataFrame([(1, "5", 2.5), (2, None, 3.5)], "id int, s string, f double")
    added = E.add_column(df, "t", "date")
    assert added.schema["t"].dataType == T.DateType() and added.where("t is null").count() == 2
    with pytest.raises(ValueError):
        E.add_column(df, "S", "date")
    with pytest.raises(ValueError):
        E.drop_column(df, "zz")
    assert E.drop_column(df, "s").columns == ["id", "f"]
    assert rows(E.change_column_type(df, "s", "int"), "s") == [(5,), (None,)]
    assert rows(E.change_column_type(df, "f", "bigint"), "f") == [(2,), (4,)]
    bad = df.withColumn("s", F.lit("x"))
    with pytest.raises(ValueError):
        E.change_column_type(bad, "s", "int")
    with pytest.raises(ValueError):
        E.change_column_type(df.withColumn("id", F.lit(1 << 40)), "id", "int")
    assert E.conversion_failures(bad, "s", "varchar(0)", ["id"]).count() == 2
    assert E.rename_columns(df, {"s": "t"}).columns == ["id", "t", "f"]
    with pytest.raises(ValueError):
        E.rename_columns(df, {"s": "a b"})
    assert E.clone_structure(df).schema == df.schema and E.clone_structure(df).count() == 0
    assert rows(E.table_structure(df, {"id": "0"})) == [
        (1, "id", "INTEGER", "0"), (2, "s", "TEXT", None), (3, "f", "DOUBLE", None),
    ]
    assert rows(E.backfill_default(df, {"s": "z"}), "s") == [("5",), ("z",)]
    empty = E.empty_table(spark, {"name": "varchar(9)"})
    assert empty.columns == ["id", "add_usr", "add_ts", "upd_usr", "upd_ts", "name"]
    assert E.check_table_form("T_1", {"a": "int", " ": "x"}) == {"a": "int"}
    bad_forms = [(" ", {"a": "int"}), ("t", {}), ("t-1", {"a": "int"}), ("t", {"a b": "int"}), ("t", {"a": "blob"})]
    for label, columns in bad_forms:
        with pytest.raises(ValueError):
            E.check_table_form(label, columns)
    assert E.check_deployment_type(None) == "DESIGN_TIME"
    with pytest.raises(ValueError):
        E.check_deployment_type("SOMETIME")


@pytest.fixture
def history(spark):
    """Key 1 is hot and has tied times; key 2 has few rows."""
    times = [1, 2, 2, 3, 4, 5, 5, 6, 6, 6]
    data = [(1, day(t), i) for i, t in enumerate(times)] + [(2, day(1), 100), (2, day(9), 101)]
    return spark.createDataFrame(data, "k int, at timestamp_ntz, v int")


@pytest.mark.parametrize("skew", [{}, {"rows_per_task": 2}])
def test_retention(history, skew):
    kept = V.retain_last_versions(history, ["k"], "at", **skew)
    assert sorted(r.v for r in kept.collect()) == [5, 6, 7, 8, 9, 100, 101]
    kept = V.retain_last_snapshots(history, ["k"], "at", **skew)
    assert sorted(r.v for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 100, 101]
    kept = V.retain_last_versions(history, ["k"], "at", keep=1, **skew)
    assert sorted(r.v for r in kept.collect()) == [7, 8, 9, 101]


def test_swap_and_rollback(spark, rows):
    tables = spark.createDataFrame(
        [(1, "a", "old", "d", 1, "RUN_TIME", day(1), "u", None, None),
         (2, "b", "keep", "d", 3, "RUN_TIME", day(1), "u", None, None)],
        K.TABLES_SCHEMA,
    )
    links = spark.createDataFrame([(1, "new")], "id long, new_link string")
    backup = V.backup_rows(tables, F.col("id") == 1, NOW)
    swapped = V.swap_links(tables, links, "me", NOW)
    got = {r.id: (r.tbl_link, r.version_no, r.upd_usr) for r in swapped.collect()}
    assert got == {1: ("new", 2, "me"), 2: ("keep", 3, None)}
    older = V.backup_rows(tables.withColumn("tbl_link", F.lit("oldest")), F.col("id") == 1, day(1))
    assert rows(V.rollback_tables(swapped, backup.unionByName(older))) == rows(tables)


def test_bulk_copy(spark):
    source = spark.createDataFrame([(1, "a")], "id int, s string")
    target = T.StructType.fromDDL("s string, id long, extra date")
    assert [tuple(r) for r in V.bulk_copy(source, target).collect()] == [("a", 1, None)]
    with pytest.raises(ValueError):
        V.bulk_copy(source, T.StructType.fromDDL("id long"))
    shadow = V.migrate_shadow(
        spark.createDataFrame([(1, "src", 5)], "id int, s string, n int"), source
    )
    assert [tuple(r) for r in shadow.collect()] == [(1, "a", None)]
    merged = V.migrate_shadow(
        spark.createDataFrame([(1, "src", 5), (2, "new", 6)], "id int, s string, n int"),
        source,
        merge_source=True,
    )
    assert sorted(tuple(r) for r in merged.collect()) == [(1, "src", 5), (2, "new", 6)]


def test_check_migration():
    assert V.check_migration("published", ["public", "published"], True) == "published"
    for target, there in ((None, True), (" ", True), ("else", True), ("published", False)):
        with pytest.raises(ValueError):
            V.check_migration(target, ["public", "published"], there)


def test_integrity(spark):
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "id long")
    good = L.integrity_report(2, ids(3, 4), ids(1, 2, 3, 4)).first()
    assert good.valid and good.expected_count == 4 and good.missing_count == 0
    lost = L.integrity_report(2, ids(3, 4), ids(1, 2, 3, 3)).first()
    assert lost.data_loss and not lost.count_mismatch and not lost.valid
    assert (lost.missing_count, lost.duplicate_ids) == (1, 1)
    short = L.integrity_report(2, ids(3), ids(1, 3)).first()
    assert short.count_mismatch and not short.data_loss
    empty = L.integrity_report(0, ids(), ids()).first()
    assert empty.valid and empty.actual_count == 0


def test_checks(spark, rows):
    df = spark.createDataFrame([(1, "A"), (1, "x"), (2, None), (3, "a b")], "k int, s string")
    assert rows(L.duplicate_keys(df, ["k"])) == [(1, 2)]
    rules = {"domain": L.in_domain(F.col("s"), ["A", "x"]), "label": L.is_label(F.col("s"))}
    assert rows(L.violations(df, ["k"], rules)) == [
        (2, "domain"), (2, "label"), (3, "domain"), (3, "label"),
    ]
    parents = spark.createDataFrame([(1,)], "id int")
    children = df.unionByName(spark.createDataFrame([(None, "z")], "k int, s string"))
    assert rows(L.orphan_keys(children, parents, "k", "id")) == [(2, 1), (3, 1)]
    events = spark.createDataFrame([(day(n),) for n in range(1, 8)], "at timestamp_ntz")
    got = L.insert_stats(events, "at", day(3), day(5)).first()
    assert (got.total_inserts, got.inserts_before, got.inserts_during, got.inserts_after) == (7, 2, 3, 2)
