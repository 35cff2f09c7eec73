import datetime
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import changes as C

NOW = datetime.datetime(2024, 6, 1, 12)
EARLIER = datetime.datetime(2024, 1, 1)


def log_frame(spark, entries):
    rows = [(i, *e) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, C.CHANGE_SCHEMA)


def insert(row):
    return ("insert", row, None, None, None)


def update(row, field, old, new):
    return ("update", row, field, old, new)


def op(name, row):
    return (name, row, None, None, None)


class Session:
    """The editing rules, one entry at a time."""

    def __init__(self):
        self.inserts, self.updates, self.deletes = {}, {}, set()

    def play(self, entry):
        kind, row, field, old, new = entry
        if kind == "insert":
            self.inserts[row] = {}
        elif kind == "uninsert":
            self.inserts.pop(row, None)
        elif kind == "delete":
            if row not in self.deletes:
                self.deletes.add(row)
                self.updates = {k: v for k, v in self.updates.items() if k[0] != row}
        elif kind == "undelete":
            self.deletes.discard(row)
        elif old != new and row not in self.deletes:
            if row in self.inserts:
                self.inserts[row][field] = new
            elif (row, field) not in self.updates:
                self.updates[row, field] = (old, new)
            elif self.updates[row, field][0] == new:
                del self.updates[row, field]
            else:
                self.updates[row, field] = (self.updates[row, field][0], new)

    def net(self):
        out = [("insert", r, None, None, None) for r in self.inserts]
        out += [("insert", r, f, None, v) for r, d in self.inserts.items() for f, v in d.items()]
        out += [("update", r, f, o, n) for (r, f), (o, n) in self.updates.items()]
        out += [("delete", r, None, None, None) for r in self.deletes]
        return sorted(out, key=repr)


def net_of(df):
    cols = ["op", "row_id", "field", "old_value", "new_value"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def random_session(rng, steps, rows, fields, hot=None):
    """A log as an editor writes it: old values are what the editor shows."""
    session, shown, entries = Session(), {}, []
    temp = 0
    for _ in range(steps):
        row = hot if hot and rng.random() < 0.4 else rng.choice([*rows, *session.inserts])
        kind = rng.choices(
            ["update", "delete", "undelete", "insert", "uninsert"], [12, 2, 2, 1, 1]
        )[0]
        if kind == "insert":
            temp += 1
            entry = insert(f"temp_{temp}")
        elif kind == "uninsert":
            if not session.inserts:
                continue
            entry = op("uninsert", rng.choice(list(session.inserts)))
        elif kind == "update":
            field = rng.choice(fields)
            if row in session.inserts:
                old = session.inserts[row].get(field)
            else:
                base = f"{row}{field}0"
                old = session.updates.get((row, field), (base, base))[1]
            new = rng.choice([f"{row}{field}0", f"{row}{field}1", "x", None])
            entry = update(row, field, old, new)
        else:
            entry = op(kind, row)
        entries.append(entry)
        session.play(entry)
    return entries, session


@pytest.mark.parametrize("seed", range(6))
def test_compaction_equals_step_by_step(spark, seed):
    rng = random.Random(seed)
    entries, session = random_session(rng, 400, list("12345"), list("ab"), hot="1")
    log = log_frame(spark, entries)
    assert net_of(C.compact_changes(log, seq_run=7)) == session.net()
    assert net_of(C.compact_changes(log)) == session.net()


CASES = {
    "insert": ([insert("t1")], (1, 0, 0)),
    "insert taken back": ([insert("t1"), op("uninsert", "t1")], (0, 0, 0)),
    "update": ([update("1", "name", "Old", "New")], (0, 1, 0)),
    "no change": ([update("1", "name", "Old", "Old"), update("1", "x", None, None)], (0, 0, 0)),
    "reverted": ([update("1", "n", "Old", "New"), update("1", "n", "New", "Old")], (0, 0, 0)),
    "two cells": ([update("1", "n", "a", "b"), update("1", "m", "a", "b")], (0, 1, 0)),
    "delete drops updates": ([update("1", "n", "a", "b"), op("delete", "1")], (0, 0, 1)),
    "undelete": ([op("delete", "1"), op("undelete", "1")], (0, 0, 0)),
    "edit while deleted": (
        [op("delete", "1"), update("1", "n", "a", "b"), op("undelete", "1")],
        (0, 0, 0),
    ),
    "edited insert": ([insert("t1"), update("t1", "n", None, "b")], (1, 0, 0)),
    "insert, update, delete": (
        [insert("t1"), update("1", "n", "a", "b"), op("delete", "2")],
        (1, 1, 1),
    ),
    "to NULL": ([update("1", "n", "a", None)], (0, 1, 0)),
}


@pytest.mark.parametrize("name", CASES)
def test_summary(spark, name):
    entries, counts = CASES[name]
    net = C.compact_changes(log_frame(spark, entries))
    row = C.changes_summary(net).first()
    assert (row.inserts, row.updates, row.deletes) == counts
    assert row.total == sum(counts)


def test_session_limit(spark):
    entries = [update(str(i), "n", "a", "b") for i in range(50)]
    C.check_limit(C.compact_changes(log_frame(spark, entries)), C.SESSION_LIMIT)
    # More cells of a known row and cells of a new row are free.
    free = [*entries, update("1", "m", "a", "b")]
    C.check_limit(C.compact_changes(log_frame(spark, free)), C.SESSION_LIMIT)
    over = C.compact_changes(log_frame(spark, [*entries, op("delete", "99")]))
    with pytest.raises(ValueError):
        C.check_limit(over, C.SESSION_LIMIT)
    C.check_limit(over)


def test_empty_log(spark):
    net = C.compact_changes(spark.createDataFrame([], C.CHANGE_SCHEMA))
    assert net.count() == 0
    assert C.changes_summary(net).first().total == 0


@pytest.fixture
def grid(spark):
    rows = [
        (i, f"n{i}", 10 * i, "loader", EARLIER, None, None) for i in range(1, 7)
    ]
    schema = (
        "id long, name string, age int, add_usr string, add_ts timestamp_ntz, "
        "upd_usr string, upd_ts timestamp_ntz"
    )
    return spark.createDataFrame(rows, schema)


SESSION = [
    update("1", "name", "n1", "one"),
    update("2", "age", "20", None),
    update("3", "age", "30", "old"),
    update("4", "nope", "x", "y"),
    op("delete", "5"),
    op("delete", "77"),
    update("01", "name", "n1", "never"),
    insert("t2"),
    insert("t1"),
    update("t1", "name", None, "new"),
    update("t1", "age", None, " 5 "),
    insert("t3"),
    op("delete", "t3"),
]


def test_apply_changes(spark, grid):
    got = C.apply_changes(grid, log_frame(spark, SESSION), "me", NOW).orderBy("id").collect()
    rows = {r.id: r for r in got}
    assert sorted(rows) == [1, 2, 3, 4, 6, 7, 8]
    assert (rows[1].name, rows[1].upd_usr, rows[1].upd_ts, rows[1].add_usr) == (
        "one", "me", NOW, "loader",
    )
    assert rows[2].age is None and rows[2].name == "n2"
    assert rows[3].age == 30
    assert rows[6].upd_usr is None
    assert (rows[7].name, rows[7].age) == (None, None)
    assert (rows[8].name, rows[8].age, rows[8].add_usr, rows[8].upd_ts) == ("new", 5, "me", NOW)


def test_invalid_changes(spark, grid):
    net = C.compact_changes(log_frame(spark, SESSION))
    got = {(r.row_id, r.field, r.reason) for r in C.invalid_changes(net, grid).collect()}
    assert got == {("3", "age", "not parsed"), ("4", "nope", "unknown column")}


def test_overlay(spark, grid):
    net = C.compact_changes(log_frame(spark, SESSION))
    states = {r.id: r.row_state for r in C.overlay_preview(grid, net).collect()}
    assert states == {
        "1": "updated", "2": "updated", "3": "updated", "4": "updated", "5": "deleted",
        "6": "stored", "t1": "inserted", "t2": "inserted", "t3": "deleted",
    }
    shown = {r.id: r for r in C.overlay_updates(grid, net).collect()}
    assert shown[1].name == "one" and shown[2].age is None and shown[5].name == "n5"


@pytest.mark.parametrize("start,end", [(0, 3), (2, 5), (3, 6), (0, 100), (8, 20)])
def test_overlay_page_is_a_slice(spark, grid, start, end):
    net = C.compact_changes(log_frame(spark, SESSION))
    everything = ["t2", "t1", "t3", "6", "5", "4", "3", "2", "1"]
    rows = C.overlay_page(grid, net, [("age", "desc")], start=start, end=end)
    got = [(r._position, r.id) for r in rows.orderBy("_position").collect()]
    assert got == list(enumerate(everything))[start:end]


def test_apply_compacted_equals_apply_one_by_one(spark):
    rng = random.Random(3)
    base = {str(r): {"a": f"{r}a0", "b": f"{r}b0"} for r in range(1, 6)}
    entries, session = random_session(rng, 120, list(base), ["a", "b"])
    for (row, field), (_, new) in session.updates.items():
        base[row][field] = new
    want = [(d["a"], d["b"]) for r, d in base.items() if r not in session.deletes]
    want += [
        (d.get("a"), d.get("b")) for r, d in session.inserts.items() if r not in session.deletes
    ]
    frame = spark.createDataFrame(
        [(int(r), f"{r}a0", f"{r}b0") for r in base], "id long, a string, b string"
    )
    got = C.apply_changes(frame, log_frame(spark, entries), "me", NOW)
    assert sorted(map(tuple, got.select("a", "b").collect()), key=repr) == sorted(want, key=repr)


def test_insert_rows(spark, grid):
    new = spark.createDataFrame([("b", "hacker"), ("a", "hacker")], "name string, add_usr string")
    got = C.insert_rows(grid, new, "me", NOW, [F.col("name").asc()])
    rows = {r.id: r for r in got.collect()}
    assert rows[7].name == "a" and rows[8].name == "b" and rows[7].add_usr == "me"
    assert rows[7].upd_usr == "me" and rows[7].age is None
    with pytest.raises(ValueError):
        C.insert_rows(grid, new.withColumn("zzz", F.lit(1)), "me", NOW, [F.col("name").asc()])


def test_update_rows(spark, grid):
    updates = spark.createDataFrame([(1, None), (9, "x")], "id long, name string")
    rows = {r.id: r for r in C.update_rows(grid, updates, "me", NOW).collect()}
    assert len(rows) == 6
    assert rows[1].name is None and rows[1].age == 10 and rows[1].upd_usr == "me"
    assert rows[1].add_usr == "loader" and rows[2].upd_usr is None
    assert [r.id for r in C.missing_updates(grid, updates).collect()] == [9]


def test_delete_rows(spark, grid):
    ids = spark.createDataFrame([(1,), (99,), (1,)], "id long")
    assert C.delete_rows(grid, ids).count() == 5


def test_upsert_and_absent(spark, rows):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int")
    source = spark.createDataFrame([(2, None), (3, "c")], "k int, s string")
    assert rows(C.upsert(base, source, "k")) == [(1, "a", 1), (2, None, 2), (3, "c", None)]
    full = source.withColumn("n", F.lit(0))
    assert rows(C.insert_if_absent(base, full, "k")) == [(1, "a", 1), (2, "b", 2), (3, "c", 0)]
    assert rows(C.replace_rows(base, full, "k")) == [(1, "a", 1), (2, None, 0), (3, "c", 0)]


def test_coercion(spark, rows):
    df = spark.createDataFrame(
        [("1", "5", "TRUE", "1.5", "x"), ("2", "5.0", "yes", "abc", "y")],
        "id string, age string, is_on string, price string, name string",
    )
    assert rows(C.coerce_by_name(df)) == [(1, 5, True, 1.5, "x"), (2, None, False, None, "y")]
    assert rows(C.coercion_rejects(df, ["id"])) == [
        ("2", "age", "5.0", "INTEGER"),
        ("2", "price", "abc", "DOUBLE"),
    ]


def test_replay(spark, rows):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    events = spark.createDataFrame(
        [(1, "update", 1, "A"), (2, "delete", 2, "b"), (3, "insert", 4, "d"),
         (4, "update", 4, "D"), (5, "delete", 9, None), (6, "insert", 2, "back")],
        "seq long, op string, id long, v string",
    )
    once = C.replay_images(base, events)
    assert rows(once) == [(1, "A"), (2, "back"), (3, "c"), (4, "D")]
    assert rows(C.replay_images(once, events)) == rows(once)
