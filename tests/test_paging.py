import datetime
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators.keys import assign_ids, with_positions
from gridloom.operators.paging import order_columns, page, page_after, sort_model, total_order
from gridloom.operators.skew import join_unique


@pytest.fixture(scope="module")
def hot(spark):
    """3000 rows: a third share one leading value, some are NULL."""
    rng = random.Random(5)
    data = []
    for i in range(3000):
        lead = 50 if i % 3 == 0 else (None if i % 11 == 0 else rng.randrange(100))
        data.append((i, lead, rng.choice("abc"), datetime.datetime(2024, 1, 1 + i % 28)))
    rng.shuffle(data)
    df = spark.createDataFrame(data, "id long, lead int, word string, at timestamp_ntz")
    return df.repartition(5).cache()


SORTS = [
    [("lead", "asc")],
    [("lead", "desc"), ("word", "asc")],
    [("at", "desc"), ("lead", "asc")],
    [("word", "asc"), ("at", "asc"), ("lead", "desc")],
]


def expected(df, sort):
    rows = [r.asDict() for r in df.collect()]
    rows.sort(key=lambda r: r["id"])
    for name, direction in reversed(sort):
        known = [r for r in rows if r[name] is not None]
        known.sort(key=lambda r: r[name], reverse=direction == "desc")
        rows = known + [r for r in rows if r[name] is None]
    return [r["id"] for r in rows]


@pytest.mark.parametrize("sort", SORTS)
@pytest.mark.parametrize("start", [0, 37, 1490, 2960, 5000])
def test_deep_page_equals_sorted_slice(hot, sort, start):
    want = expected(hot, sort)[start : start + 50]
    got = page(hot, sort, ["id"], start, start + 50, top_k_rows=200, sample_rows=300)
    got = got.orderBy("_position").collect()
    assert [r.id for r in got] == want
    assert [r._position for r in got] == list(range(start, start + len(want)))
    plain = page(hot, sort, ["id"], start, start + 50).orderBy("_position").collect()
    assert [r.id for r in plain] == want


def test_descending_ties_keep_id_order(hot):
    got = [r.id for r in sort_model(hot, [("lead", "desc")], ["id"]).collect()]
    assert got == expected(hot, [("lead", "desc")])


def test_page_of_identical_rows(spark):
    df = spark.range(0, 5000).select(F.lit(1).alias("v"))
    got = page(df, [("v", "asc")], [], 4000, 4010, top_k_rows=100, sample_rows=200)
    assert got.count() == 10


def test_wide_pages_collect_little(spark, monkeypatch):
    df = spark.range(0, 6000).select((F.col("id") * 7919 % 6000).alias("id"))
    collected, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: collected.append(out := collect(self)) or out)
    for start, end in ((0, 6000), (0, 1 << 40), (100, 5000), (2500, 4000)):
        got = page(df, [("id", "desc")], [], start, end, top_k_rows=500, sample_rows=300)
        assert sum(map(len, collected)) < 2_000
        rows = got.orderBy("_position")
        rows = [(r.id, r._position) for r in collect(rows)]
        assert rows == [(5999 - p, p) for p in range(start, min(end, 6000))]
        collected.clear()


def test_page_after_walks_the_table(hot):
    sort = [("lead", "desc"), ("word", "asc")]
    seen, last = [], None
    while True:
        rows = page_after(hot, sort, ["id"], last, 700).collect()
        if not rows:
            break
        seen += [r.id for r in rows]
        last = (rows[-1].lead, rows[-1].word, rows[-1].id)
    assert seen == expected(hot, sort)


def test_bad_direction(hot):
    with pytest.raises(ValueError):
        sort_model(hot, [("lead", "up")], ["id"])


def test_positions_are_consecutive(hot):
    sort = total_order([("lead", "desc")], ["id"])
    got = with_positions(hot, order_columns(sort), "p").orderBy("p").collect()
    assert [r.p for r in got] == list(range(3000))
    assert [r.id for r in got] == expected(hot, [("lead", "desc")])


def test_positions_without_order(hot):
    got = with_positions(hot, None, "p").select("p").collect()
    assert sorted(r.p for r in got) == list(range(3000))


def test_ids_follow_the_largest(spark):
    base = spark.createDataFrame([(7,), (3,)], "id long")
    new = spark.createDataFrame([("b",), ("a",)], "v string")
    got = assign_ids(new, base, [F.col("v").asc()], "id").orderBy("id").collect()
    assert [(r.id, r.v) for r in got] == [(8, "a"), (9, "b")]
    empty = spark.createDataFrame([], "id long")
    assert assign_ids(new, empty, [F.col("v").asc()], "id").agg(F.min("id")).first()[0] == 1


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, rows, how):
    left = spark.range(0, 4000).select(
        F.when(F.col("id") % 3 == 0, 1)
        .when(F.col("id") % 50 == 0, None)
        .otherwise(F.col("id") % 40)
        .alias("k"),
        "id",
    )
    right = spark.range(0, 30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = rows(left.join(right, ["k"], how))
    got = join_unique(left, right, ["k"], how, rows_per_task=100)
    assert rows(got) == want
    assert got.columns == left.join(right, ["k"], how).columns
    with pytest.raises(ValueError):
        join_unique(left, right, ["k"], "full_outer")
