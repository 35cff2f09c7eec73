"""Row events that come late, delta folders, buckets that split, and versions that stay whole."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F, types as T

from gridloom.operators import changes as C, evolve as E
from gridloom.sources.data import TableData, bits_for
from gridloom.sources.store import TableStore, VersionConflict
from gridloom.streaming.sync import event_schema, sync_copy

NOW = datetime.datetime(2024, 6, 1, 12)
STRUCT = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
EVENTS = event_schema(STRUCT)


@pytest.fixture
def data(spark, tmp_path):
    found = TableData(spark, str(tmp_path / "root"), "public", "t")
    found.create(STRUCT, 3)
    return found


def fill(spark, data, count):
    rows = spark.range(1, count + 1).select("id", F.concat(F.lit("v"), F.col("id")).alias("v"))
    data.replace(rows)


def shown(df):
    return {r.id: r.v for r in df.collect()}


def replay(rows, events):
    """The rows after all events in the order of their numbers."""
    rows = dict(rows)
    for seq, op, row_id, v in sorted(e for e in events if e[0] is not None and e[2] is not None):
        rows.pop(row_id, None)
        if op != "delete":
            rows[row_id] = v
    return rows


def some_events(rng, count):
    kinds = ["insert", "update", "update", "delete"]
    return [(n, rng.choice(kinds), rng.randint(1, 40), f"e{n}") for n in range(1, count + 1)]


def files(data):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{data.path}/data") for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order(spark, data, seed):
    rng = random.Random(seed)
    fill(spark, data, 30)
    base = shown(data.read())
    events = some_events(rng, 120)
    sent = events + rng.sample(events, 25)  # some come twice
    rng.shuffle(sent)
    cuts = [0, 3, 40, 41, 100, len(sent)]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batch = [*sent[a:b], (None, "update", 1, "no number"), (999, "update", None, "no id")]
        data.apply_images(spark.createDataFrame(batch, EVENTS))
        assert shown(data.read()) == replay(base, sent[:b])
        if n == 2:  # what was folded in still knows its numbers, deleted rows as well
            data.compact()
    assert shown(data.read()) == replay(base, events)
    assert data.manifest().next_id == 41


def test_stream_of_late_events(spark, data, tmp_path):
    rng = random.Random(5)
    fill(spark, data, 20)
    base, events = shown(data.read()), some_events(rng, 60)
    rng.shuffle(events)
    folder = tmp_path / "in"
    for n in range(4):
        mine = events[15 * n : 15 * n + 15] + events[:3]
        spark.createDataFrame(mine, EVENTS).coalesce(1).write.json(str(folder / str(n)))
        stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).json(str(folder))
        sync_copy(stream, data, "late", str(tmp_path / "cp"), compact_after=2).awaitTermination(120)
        assert data.deepest() < 2
    assert shown(data.read()) == replay(base, events)
    assert data.manifest().streams["late"]["batch"] == 3


def test_a_batch_writes_deltas_only(spark, data):
    fill(spark, data, 200)
    before, stored = data.manifest(), files(data)
    events = [(n, "update", 5 * n, f"new{n}") for n in range(1, 41)]
    after = data.apply_images(spark.createDataFrame(events, EVENTS))
    assert after.buckets == before.buckets and stored < files(data)
    assert len(after.deltas) > 1 and data.deepest() == 1
    held = shown(data.read())
    assert held[5] == "new1" and held[200] == "new40" and held[1] == "v1"
    folded = data.compact()
    assert not folded.deltas and shown(data.read()) == held
    assert data.compact() == folded
    assert shown(data.read(after.version)) == held and shown(data.read(before.version))[5] == "v5"


def test_forgotten_marks(spark, data):
    fill(spark, data, 4)
    data.apply_images(spark.createDataFrame([(5, "delete", 1, None), (9, "delete", 2, None)], EVENTS))
    data.compact(forget=7)
    late = [(4, "update", 1, "late"), (4, "update", 2, "late")]
    data.apply_images(spark.createDataFrame(late, EVENTS))
    assert shown(data.read()) == {1: "late", 3: "v3", 4: "v4"}


def test_state_survives_a_new_structure(spark, data):
    fill(spark, data, 4)
    data.apply_images(spark.createDataFrame([(5, "delete", 1, None), (6, "update", 2, "b")], EVENTS))
    data.replace(data.state().withColumn("more", F.lit(1)))
    assert data.read().columns == ["id", "v", "more"]
    schema = event_schema(data.manifest().struct)
    data.apply_images(spark.createDataFrame([(3, "update", 1, "late", 0), (4, "update", 2, "late", 0)], schema))
    assert shown(data.read()) == {2: "b", 3: "v3", 4: "v4"}


def test_buckets_split_as_data_grows(spark, tmp_path):
    data = TableData(spark, str(tmp_path / "root"), "public", "t", bucket_bytes=4000)
    struct = T.StructType([*E.BASE_SCHEMA.fields, T.StructField("v", T.StringType())])
    data.create(struct)
    for n in range(6):
        stored = files(data)
        rows = spark.range(300 * n, 300 * n + 300).select(F.format_string("x%06d", F.col("id")).alias("v"))
        data.insert(rows, [F.col("v").asc()], "ann", NOW)
        assert stored < files(data)
        assert shown(data.read()) == {i + 1: f"x{i:06}" for i in range(300 * n + 300)}
    manifest = data.manifest()
    assert manifest.bits >= 2 and len({bits for bits, _ in manifest.folders.values()}) > 1
    row = {"seq": 1, "op": "update", "id": 8, "v": "eight"}
    gone = {"seq": 2, "op": "delete", "id": 7}
    schema = event_schema(struct)
    data.apply_images(spark.createDataFrame([tuple(e.get(f) for f in schema.names) for e in (row, gone)], schema))
    want = {i + 1: f"x{i:06}" for i in range(1800)} | {8: "eight"}
    want.pop(7)
    assert shown(data.read()) == want
    ids = spark.createDataFrame([(8,), (9,), (1500,), (7,), (10**9,)], "id long")
    assert shown(data.lookup(ids)) == {i: want[i] for i in (8, 9, 1500)}
    folded = data.compact()
    assert {bits for bits, _ in folded.folders.values()} == {manifest.bits}
    assert shown(data.read()) == want
    assert bits_for(0, 2, 100) == 2 and bits_for(100, 0, 100) == 0 and bits_for(101, 0, 100) == 1
    assert bits_for(800, 0, 100) == 3 and bits_for(801, 0, 100) == 4


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    data = TableData(spark, str(tmp_path / "root"), "public", "t")
    data.create(STRUCT, 0)
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "20k")
    try:
        data.replace(spark.range(0, 20_000, 1, 8).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("v")))
    finally:
        spark.conf.set(name, before)
    assert data.manifest().bucket_count == 1 and len(files(data)) > 2
    assert data.read().count() == 20_000


def test_lookup_and_edits_open_only_their_buckets(spark, data):
    fill(spark, data, 100)
    bucket = data._buckets_of(spark.createDataFrame([(17,)], "id long"), data.manifest())
    found = data.lookup(spark.createDataFrame([(17,)], "id long"))
    assert shown(found) == {17: "v17"}
    assert {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()} == bucket
    data.apply_images(spark.createDataFrame([(5, "delete", 17, None), (6, "update", 18, "b")], EVENTS))
    before = data.manifest()
    log = [
        (1, "update", "17", "v", "v17", "edited"),
        (2, "update", "18", "v", "b", "edited"),
        (3, "insert", "temp_1", None, None, None),
        (4, "update", "temp_1", "v", None, "new"),
    ]
    touched = data._buckets_of(spark.createDataFrame([(17,), (18,)], "id long"), before)
    after = data.apply_changes(spark.createDataFrame(log, C.CHANGE_SCHEMA), "ann", NOW)
    for b in set(before.buckets) - touched:
        assert set(before.buckets[b]) <= set(after.buckets[b])
    want = {i: f"v{i}" for i in range(1, 101)} | {18: "edited", 101: "new"}
    want.pop(17)
    assert shown(data.read()) == want and after.next_id == 102
    # A late event for a deleted row, and one for an edited row, come too late.
    data.apply_images(spark.createDataFrame([(4, "update", 17, "x"), (5, "update", 18, "x")], EVENTS))
    assert shown(data.read()) == want


def test_a_writer_that_stops_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path / "store"), bucket_count=2)
    table_id = store.create_table("T", "ann", NOW)
    link = store.add_columns(table_id, {"a": "text"}, "ann", NOW)["a"]
    data = store.data(table_id)
    data.insert(spark.createDataFrame([("x",)], f"{link} string"), None, "ann", NOW)
    before = data.manifest()

    def stop(*args, **more):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(TableStore, "_save", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            store.add_columns(table_id, {"b": "int"}, "ann", NOW)
        with pytest.raises(RuntimeError, match="stopped"):
            store.drop_column(table_id, store.columns(table_id).first().id)
    assert data.manifest() == before and data.latest() > before.version
    assert store.scan(table_id).columns == data.read().columns and link in data.read().columns
    assert [r.col_label for r in store.columns(table_id).collect()] == ["a"]
    # The next writer goes on from there.
    data.insert(spark.createDataFrame([("y",)], f"{link} string"), None, "ann", NOW)
    second = store.add_columns(table_id, {"b": "int"}, "ann", NOW)["b"]
    assert store.scan(table_id).count() == 2 and second in store.scan(table_id).columns
    # Half a version file is never seen: the text is whole before it gets its name.
    with monkeypatch.context() as patch:
        patch.setattr(type(data._folder), "_rename", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            data.replace(data.read().limit(1))
    assert data.read().count() == 2
    with pytest.raises(VersionConflict):
        data._publish(data.manifest())
