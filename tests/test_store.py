import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.sources.store import TableStore, VersionConflict
from gridloom.streaming.ingest import ingest_csv, ingest_payloads, progress
from gridloom.streaming.sync import event_schema, sync_copy

NOW = datetime.datetime(2024, 6, 1, 12)
LATER = datetime.datetime(2024, 6, 2, 12)


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"), bucket_count=4)


@pytest.fixture
def people(spark, store):
    """A table of five people; returns (id, physical column names)."""
    table_id = store.create_table("People", "ann", NOW)
    links = store.add_columns(table_id, {"name": "varchar(20)", "age": "int"}, "ann", NOW)
    rows = spark.createDataFrame([(f"p{i}", 20 + i) for i in range(5)], "name string, age int")
    rows = rows.withColumnsRenamed(links)
    store.data(table_id).insert(rows, [F.col(links["name"]).asc()], "ann", NOW)
    return table_id, links


def shown(df, links, *extra):
    back = {v: k for k, v in links.items()}
    return sorted(tuple(r) for r in df.withColumnsRenamed(back).select("id", "name", "age", *extra).collect())


def test_lifecycle(spark, store, people):
    table_id, links = people
    assert shown(store.scan(table_id), links) == [(i + 1, f"p{i}", 20 + i) for i in range(5)]
    first = store.scan(table_id).first()
    assert (first.add_usr, first.upd_ts) == ("ann", NOW)
    assert [(r.col_label, r.type) for r in store.columns(table_id).collect()] == [
        ("name", "VARCHAR(20)"), ("age", "INTEGER"),
    ]
    store.rename_table(table_id, "Staff", "bob", LATER)
    other = store.create_table("Other", "ann", NOW, "RUN_TIME")
    assert [r.tbl_label for r in store.tables().collect()] == ["Staff", "Other"]
    columns = store.columns(table_id).collect()
    store.change_column_type(table_id, columns[1].id, "BIGINT")
    assert store.columns(table_id).collect()[1].type == "BIGINT"
    with pytest.raises(ValueError):
        store.change_column_type(table_id, columns[0].id, "INTEGER")
    with pytest.raises(ValueError):
        store.drop_column(other, columns[0].id)
    store.drop_column(table_id, columns[0].id)
    assert links["name"] not in store.scan(table_id).columns
    assert store.scan(table_id).count() == 5
    store.drop_table(table_id)
    assert [r.tbl_label for r in store.tables().collect()] == ["Other"]
    assert store.catalog("public")["columns"].count() == 0
    with pytest.raises(ValueError):
        store.scan(table_id)


def test_versions_stay_readable(spark, store, people):
    table_id, links = people
    data = store.data(table_id)
    before = data.manifest().version
    old = data.read()
    data.replace(data.read().where("id > 3"))
    assert data.read().count() == 2
    assert data.read(before).count() == 5 and old.count() == 5
    more = spark.createDataFrame([("z", 1)], "name string, age int").withColumnsRenamed(links)
    data.insert(more, [F.col(links["name"]).asc()], "ann", NOW)
    assert sorted(r.id for r in data.read().collect()) == [4, 5, 6]


def test_cached_copy(spark, store, people):
    table_id, links = people
    copy = store.open(table_id)
    assert copy.is_cached and copy.count() == 5
    assert store.open(table_id) is copy
    assert store.open(table_id, refresh=True) is not copy
    data = store.data(table_id)
    data.replace(data.read().where("id > 3"))
    assert store.open(table_id).count() == 2
    store.close(table_id)
    store.close(table_id)


def test_second_writer_fails(store, people):
    data = store.data(people[0])
    manifest = data.manifest()
    with pytest.raises(VersionConflict):
        data._publish(manifest)


def test_migrate_and_rollback(spark, store, people):
    table_id, links = people
    link = store.migrate(table_id, "published", "ann", NOW)
    assert link == store.catalog("public")["tables"].first().tbl_link
    copy = store.catalog("published")["tables"].first()
    assert (copy.tbl_label, copy.tbl_link, copy.version_no) == ("People", link, 1)
    assert shown(store.scan(copy.id, "published"), links) == shown(store.scan(table_id), links)
    # The target changes, the source gets a column, and a second run builds a shadow.
    target = store.data(copy.id, "published")
    target.replace(target.read().where("id <> 1"))
    city = store.add_columns(table_id, {"city": "text"}, "ann", NOW)["city"]
    shadow = store.migrate(table_id, "published", "bob", LATER)
    assert shadow != link
    after = store.catalog("published")["tables"].first()
    assert (after.id, after.tbl_link, after.version_no, after.upd_usr) == (copy.id, shadow, 2, "bob")
    rows = store.scan(copy.id, "published")
    assert city in rows.columns and sorted(r.id for r in rows.collect()) == [2, 3, 4, 5]
    labels = store.columns(copy.id, "published").collect()
    assert sorted(r.col_label for r in labels) == ["age", "city", "name"]
    assert {r.tbl_link for r in labels} == {shadow}
    assert len({r.id for r in labels}) == 3
    store.rollback(copy.id, "published")
    restored = store.catalog("published")["tables"].first()
    assert (restored.tbl_link, restored.version_no, restored.upd_usr) == (link, 1, None)
    assert sorted(r.col_label for r in store.columns(copy.id, "published").collect()) == ["age", "name"]
    with pytest.raises(ValueError):
        store.rollback(copy.id, "published")


def test_history_is_bounded(store, people):
    table_id, _ = people
    for n in range(8):
        store.migrate(table_id, "published", "ann", NOW + datetime.timedelta(days=n))
    frames = store.catalog("published")
    assert frames["tables_bak"].count() == 5
    assert frames["columns_bak"].select("backup_ts").distinct().count() == 5
    assert frames["tables"].first().version_no == 8


def test_migration_checks(store, people):
    with pytest.raises(ValueError):
        store.migrate(people[0], "elsewhere", "ann", NOW)
    with pytest.raises(ValueError):
        store.migrate(99, "published", "ann", NOW)
    assert store.find(people[0])[0] == "public"
    with pytest.raises(ValueError):
        store.find(99)


def events_file(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/{name}")


def test_sync_stream(spark, store, people, tmp_path):
    table_id, links = people
    copy = store.data(table_id)
    name, age = links["name"], links["age"]
    schema = event_schema(copy.manifest().struct)

    def event(seq, op, row_id, who=None, years=None):
        values = {"seq": seq, "op": op, "id": row_id, name: who, age: years, "upd_usr": "sync"}
        return tuple(values.get(f) for f in schema.names)

    folder, checkpoint = tmp_path / "events", str(tmp_path / "cp")

    def drop(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(folder / str(n)))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(str(folder))
        query = sync_copy(stream, copy, "people_sync", checkpoint)
        query.awaitTermination(120)
        return query

    drop(1, [event(1, "update", 1, "one", 1), event(2, "insert", 9, "nine", 9), event(3, "delete", 2)])
    assert progress(run())["rows"] == 3
    drop(2, [event(4, "update", 9, "NINE", 99), event(5, "delete", 3), event(6, "insert", 3, "three", 3)])
    run()
    want = [(1, "one", 1), (3, "three", 3), (4, "p3", 23), (5, "p4", 24), (9, "NINE", 99)]
    assert shown(store.scan(table_id), links) == want
    state = copy.manifest()
    assert state.streams["people_sync"]["batch"] == 1
    # A batch delivered again changes nothing, not even the version.
    again = spark.createDataFrame([event(7, "delete", 1)], schema)
    assert copy.apply_images(again, ("people_sync", 1)) == state
    assert shown(store.scan(table_id), links) == want


def test_payload_stream(spark, store, people, tmp_path):
    table_id, links = people
    data = store.data(table_id)
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    schema = "seq long, row_data map<string,string>"
    for n in range(2):
        rows = [(10 * n + i, {links["name"]: f"s{n}{i}", links["age"]: str(i)}) for i in range(3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        ingest_payloads(
            stream, data, {links["name"]: "TEXT", links["age"]: "INTEGER"}, "payloads",
            checkpoint, "rpc", lambda: LATER, rejects=f"{checkpoint}-bad",
        ).awaitTermination(120)
    rows = shown(data.read().where("add_usr = 'rpc'"), links)
    assert rows == [(6, "s00", 0), (7, "s01", 1), (8, "s02", 2), (9, "s10", 0), (10, "s11", 1), (11, "s12", 2)]
    assert data.manifest().streams["payloads"] == {"batch": 1, "rows": 6}
    assert spark.read.parquet(f"{checkpoint}-bad").count() == 0
    bad = [(50, {links["name"]: "late", links["age"]: "old", "nobody": "x"})]
    spark.createDataFrame(bad, schema).coalesce(1).write.mode("append").parquet(folder)
    args = [data, {links["name"]: "TEXT", links["age"]: "INTEGER"}, "payloads", checkpoint, "rpc", lambda: LATER]
    stream = spark.readStream.schema(schema).parquet(folder)
    with pytest.raises(Exception, match="refused"):
        ingest_payloads(stream, *args).awaitTermination(120)
    ingest_payloads(stream, *args, rejects=f"{checkpoint}-bad").awaitTermination(120)
    refused = spark.read.parquet(f"{checkpoint}-bad").collect()
    assert {(r.seq, r.column, r.reason) for r in refused} == {
        (50, links["age"], "not parsed"), (50, "nobody", "no such column"),
    }
    late = data.read().where(F.col(links["name"]) == "late").collect()
    assert len(late) == 1 and late[0][links["age"]] is None


def test_csv_stream(spark, tmp_path, rows):
    folder = tmp_path / "csv"
    folder.mkdir()
    out, bad, checkpoint = (str(tmp_path / n) for n in ("out", "bad", "cp"))
    types = {"a": "BIGINT", "b": "TEXT"}

    def run(**more):
        query = ingest_csv(spark, str(folder), types, out, bad, "csv", checkpoint, **more)
        query.awaitTermination(120)
        return query

    (folder / "1.csv").write_text('a,b\n1,"x ""y"""\n,\nq,z\n')
    run()
    (folder / "2.csv").write_text('B,a\n"y\nz",2\n"open,3\n')
    run()
    assert rows(spark.read.parquet(out), "a", "b") == [(1, 'x "y"'), (2, "y\nz")]
    refused = spark.read.parquet(bad).collect()
    assert {(r.column, r.raw_value, r.reason) for r in refused} == {
        ("a", "q", "not parsed"), (None, None, "a quote is not closed"),
    }
    assert sorted(r.source[-5:] for r in refused) == ["1.csv", "2.csv"]
    (folder / "3.csv").write_text("a,b\n" + "q,z\n" * 5)
    with pytest.raises(Exception, match="refused"):
        run(skip_limit=3)


def test_skip_limit_counts_over_batches(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    out, bad, checkpoint = (str(tmp_path / n) for n in ("out", "bad", "cp"))

    def run(limit):
        ingest_csv(
            spark, str(folder), {"a": "BIGINT"}, out, bad, "limited", checkpoint, skip_limit=limit
        ).awaitTermination(120)

    for n, lines in enumerate(["q\n1\n", "q\n2\n", "3\n", "q\n4\n"]):
        (folder / f"{n}.csv").write_text("a\n" + lines)
        if n < 3:
            run(2)
    with pytest.raises(Exception, match="refused"):
        run(2)
    run(3)
    assert sorted(r.a for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]
