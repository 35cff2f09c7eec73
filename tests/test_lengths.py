"""VARCHAR(n) on every way into a stored table, loads that read once, and progress of streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F, types as T

from gridloom.functions.types import field_of, max_lengths
from gridloom.operators import changes as C, lengths
from gridloom.sources.store import TableStore
from gridloom.streaming.ingest import StreamProgress, ingest_payloads
from gridloom.streaming.sync import event_schema

NOW = datetime.datetime(2024, 6, 1, 12)


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"), bucket_count=4)


@pytest.fixture
def tags(spark, store):
    table_id = store.create_table("Tags", "ann", NOW)
    links = store.add_columns(table_id, {"tag": "varchar(3)", "note": "text"}, "ann", NOW)
    rows = spark.createDataFrame([("abc", "one"), ("d", "two"), (None, None)], "tag string, note string")
    store.data(table_id).insert(rows.withColumnsRenamed(links), None, "ann", NOW)
    return table_id, links


def kinds(store, table_id, schema="public"):
    return {r.col_label: r.type for r in store.columns(table_id, schema).collect()}


def test_rejects_and_fitting_rows(spark, rows):
    struct = T.StructType([field_of("a", "VARCHAR(2)"), field_of("b", "VARCHAR(3)"), field_of("c", "TEXT")])
    df = spark.createDataFrame(
        [(1, "ab", "abc", "x" * 999), (2, "abc", "abcd", None), (3, None, "", ""), (4, "é€", "日本語", "")],
        "k int, a string, b string, c string",
    )
    assert rows(lengths.length_rejects(df, struct, ["k"])) == [
        (2, "a", "abc", "VARCHAR(2)", "too long"), (2, "b", "abcd", "VARCHAR(3)", "too long"),
    ]
    assert [r.k for r in lengths.fitting_rows(df, struct).orderBy("k").collect()] == [1, 3, 4]
    assert lengths.length_rejects(df.select("k", "c"), struct, ["k"]).count() == 0
    assert lengths.length_rejects(df.limit(0), struct, ["k"]).count() == 0
    assert max_lengths(lengths.checked(df.where("k <> 2"), struct).schema) == {"a": 2, "b": 3}
    with pytest.raises(Exception, match="too long for VARCHAR"):
        lengths.checked(df, struct).collect()


def test_lengths_are_kept_and_read_back(spark, store, tags):
    table_id, links = tags
    assert kinds(store, table_id) == {"tag": "VARCHAR(3)", "note": "TEXT"}
    assert store.data(table_id).types() == {links["tag"]: "VARCHAR(3)", links["note"]: "TEXT"}
    store.add_columns(table_id, {"more": "varchar(7)"}, "ann", NOW)
    assert kinds(store, table_id)["tag"] == "VARCHAR(3)" and kinds(store, table_id)["more"] == "VARCHAR(7)"
    store.migrate(table_id, "published", "ann", NOW)
    copy = store.catalog("published")["tables"].first().id
    assert kinds(store, copy, "published")["tag"] == "VARCHAR(3)"
    store.migrate(table_id, "published", "ann", NOW)  # through a shadow
    assert kinds(store, copy, "published")["tag"] == "VARCHAR(3)"
    tag = store.columns(table_id).where("col_label = 'tag'").first().id
    with pytest.raises(ValueError):
        store.change_column_type(table_id, tag, "VARCHAR(2)")
    store.change_column_type(table_id, tag, "TEXT")
    assert kinds(store, table_id) == {"tag": "TEXT", "note": "TEXT", "more": "VARCHAR(7)"}
    store.change_column_type(table_id, tag, "VARCHAR(5)")
    assert kinds(store, table_id)["tag"] == "VARCHAR(5)"


def test_insert_refuses_what_is_too_long(spark, store, tags, tmp_path):
    table_id, links = tags
    data = store.data(table_id)
    before = data.manifest()
    more = spark.createDataFrame([("long one", "n"), ("ok", "n")], "tag string, note string").withColumnsRenamed(links)
    with pytest.raises(Exception, match="too long"):
        data.insert(more, None, "ann", NOW)
    assert data.manifest() == before
    data.insert(more, None, "ann", NOW, rejects=str(tmp_path / "bad"))
    assert sorted(r[0] or "" for r in data.read().select(links["tag"]).collect()) == ["", "abc", "d", "ok"]
    refused = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert [(r.column, r.raw_value, r.reason) for r in refused] == [(links["tag"], "long one", "too long")]
    assert json.loads(refused[0].raw)[links["note"]] == "n"
    with pytest.raises(Exception, match="too long"):
        data.replace(data.read().withColumn(links["tag"], F.lit("far too long")))


def test_change_logs_and_events_refuse_it_too(spark, store, tags):
    table_id, links = tags
    data = store.data(table_id)
    log = spark.createDataFrame(
        [(1, "update", "1", links["tag"], "abc", "abcd"), (2, "update", "2", links["tag"], "d", "xyz")], C.CHANGE_SCHEMA
    )
    refused = C.invalid_changes(C.compact_changes(log), data.read()).collect()
    assert [(r.row_id, r.reason) for r in refused] == [("1", "too long")]
    data.apply_changes(log, "bob", NOW)
    assert {r.id: r[links["tag"]] for r in data.read().collect()} == {1: "abc", 2: "xyz", 3: None}
    schema = event_schema(data.manifest().struct)

    def event(seq, row_id, tag):
        values = {"seq": seq, "op": "update", "id": row_id, links["tag"]: tag}
        return tuple(values.get(f) for f in schema.names)

    data.apply_images(spark.createDataFrame([event(1, 3, "new")], schema))
    assert max_lengths(data.read().schema) == {links["tag"]: 3}
    # Also over deltas not folded in yet.
    assert C.invalid_changes(C.compact_changes(log), data.read()).count() == 1
    with pytest.raises(Exception, match="too long"):
        data.apply_images(spark.createDataFrame([event(2, 3, "newer")], schema))


def test_payloads_take_the_tables_types(spark, store, tags, tmp_path):
    table_id, links = tags
    data, folder = store.data(table_id), str(tmp_path / "in")
    schema = "seq long, row_data map<string,string>"
    spark.createDataFrame([(1, {links["tag"]: "abcd", links["note"]: "kept"})], schema).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    bad = str(tmp_path / "bad")
    ingest_payloads(stream, data, None, "p", str(tmp_path / "cp"), "rpc", lambda: NOW, rejects=bad).awaitTermination(120)
    assert [(r.column, r.reason) for r in spark.read.parquet(bad).collect()] == [(links["tag"], "too long")]
    assert data.read().where(F.col(links["note"]) == "kept").count() == 1


def test_payloads_typed_by_name(spark, store, tmp_path):
    table_id = store.create_table("Named", "ann", NOW)
    data = store.data(table_id)
    data.restructure(T.StructType([*data.manifest().struct.fields, field_of("age", "INTEGER"), field_of("who", "TEXT")]))
    folder, bad = str(tmp_path / "in"), str(tmp_path / "bad")
    schema = "seq long, row_data map<string,string>"
    spark.createDataFrame([(1, {"age": "41", "who": "7"}), (2, {"age": "old", "who": "x"})], schema).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    ingest_payloads(stream, data, ["age", "who"], "n", str(tmp_path / "cp"), "rpc", lambda: NOW, rejects=bad).awaitTermination(120)
    assert sorted(((r.age, r.who) for r in data.read().collect()), key=str) == [(41, "7"), (None, "x")]
    assert [(r.seq, r.column) for r in spark.read.parquet(bad).collect()] == [(2, "age")]


def test_load_reads_its_input_once(spark, store, tags):
    table_id, links = tags
    data = store.data(table_id)
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    text = [(f"t{i % 7}" if i % 10 else "toolong", f"n{i}", "part.csv") for i in range(200)] + [(" ", None, "part.csv")]
    frame = spark.createDataFrame(text, f"{links['tag']} string, {links['note']} string, _file string").repartition(5)
    report = data.load(frame.mapInPandas(count, frame.schema), "ann", NOW)
    assert seen.value == 201
    counts = {k: report[k] for k in ("status", "read_count", "write_count", "skip_count", "empty_count")}
    assert counts == {"status": "COMPLETED", "read_count": 200, "write_count": 180, "skip_count": 20, "empty_count": 1}
    assert len(report["failures"]) == 20
    refused = spark.read.parquet(report["rejects"]).select("_refused.*").collect()
    assert {(r.source, r.column, r.raw_value, r.target_type, r.reason) for r in refused} == {
        ("part.csv", links["tag"], "toolong", "VARCHAR(3)", "too long")
    }
    rows = data.read().collect()
    assert len(rows) == 183 and len({r.id for r in rows}) == 183
    assert max(r.id for r in rows) < data.manifest().next_id
    fresh = [r for r in rows if r.id > 3]
    assert {r.add_usr for r in fresh} == {"ann"} and {r.add_ts for r in fresh} == {NOW}
    before = data.manifest()
    with pytest.raises(ValueError, match="refused"):
        data.load(frame, "ann", NOW, limit=19)
    assert data.manifest() == before
    assert data.load(frame.limit(0), "ann", NOW)["read_count"] == 0
    assert data.manifest() == before


def test_load_csv_makes_a_table(spark, store, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text('Name,age\n"Ann, A.",30\nBartholomew,40\nCid,old\n\nDee,\n')
    table_id, report = store.load_csv("People", str(path), "ann", NOW, {"Name": "VARCHAR(8)", "age": "INTEGER"})
    assert (report["write_count"], report["skip_count"]) == (2, 2)
    assert kinds(store, table_id) == {"Name": "VARCHAR(8)", "age": "INTEGER"}
    links = {r.col_label: r.col_link for r in store.columns(table_id).collect()}
    rows = store.scan(table_id).select(links["Name"], links["age"], "add_usr").collect()
    assert sorted(tuple(r) for r in rows) == [("Ann, A.", 30, "ann"), ("Dee", None, "ann")]
    refused = spark.read.parquet(report["rejects"]).select("_refused.*").collect()
    assert {(r.raw_value, r.reason, r.source[-10:]) for r in refused} == {
        ("Bartholomew", "too long", "people.csv"), ("old", "not parsed", "people.csv"),
    }
    with pytest.raises(ValueError, match="refused"):
        store.load_csv("Again", str(path), "ann", NOW, {"age": "INTEGER", "Name": "VARCHAR(2)"}, limit=1)
    with pytest.raises(ValueError, match="nobody"):
        store.load_csv("Other", str(path), "ann", NOW, {"nobody": "TEXT"})
    assert [r.tbl_label for r in store.tables().collect()] == ["People"]


def test_progress_adds_up_all_batches(spark, tmp_path):
    folder, name = str(tmp_path / "in"), "adds_up"
    schema = "n long"
    spark.range(0, 60, 1, 12).toDF("n").write.parquet(folder)
    total = StreamProgress({name: lambda: spark.read.parquet(folder).count()})
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    spark.streams.addListener(total)
    try:

        def run():
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
            writer = stream.writeStream.queryName(name).option("checkpointLocation", str(tmp_path / "cp"))
            query = writer.format("noop").trigger(availableNow=True).start()
            query.awaitTermination(120)
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
            return sum(r.numInputRows for r in query.recentProgress)

        assert total.of(name) == {"status": None, "batch": None, "rows": 0, "total": 60, "share": 0.0}
        assert run() < 60
        assert total.of(name) == {"status": "COMPLETED", "batch": 11, "rows": 60, "total": 60, "share": 1.0}
        spark.range(60, 75, 1, 3).toDF("n").write.mode("append").parquet(folder)
        assert total.of(name)["share"] == 0.8
        run()
        assert total.of(name)["rows"] == 75 and total.of(name)["batch"] == 14
    finally:
        spark.streams.removeListener(total)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
