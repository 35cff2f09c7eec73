"""Tables kept as versioned Parquet folders.

Layout below a root folder every executor can reach::

    <schema>/_catalog/<n>.json   names the folder of catalog version n
    <schema>/_catalog/<folder>/{tables,columns,tables_bak,columns_bak}
    <schema>/<link>/             the rows of a table, see ``data``

Nothing written is ever changed: a write goes to a new folder, and renaming the next
numbered file into place publishes it. A reader sees the version it opened to the end, and the
second of two writers fails instead of losing the first one's work. A change of catalog and
structure together is published by the catalog: the table's new version names the catalog
version it belongs to, and does not count without it.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridloom.functions.names import check_identifier
from gridloom.operators import catalog as K
from gridloom.operators import evolve as E
from gridloom.operators import versions as V
from gridloom.operators.ingest import SKIP_LIMIT, Types
from gridloom.operators.keys import assign_ids, max_id
from gridloom.sources.csv import read_csv
from gridloom.sources.data import HIDDEN, Manifest, TableData, bits_for
from gridloom.sources.files import Folder, VersionConflict

__all__ = ["Manifest", "TableData", "TableStore", "VersionConflict"]

_FRAMES = {
    "tables": K.TABLES_SCHEMA,
    "columns": K.COLUMNS_SCHEMA,
    "tables_bak": K.TABLES_BAK_SCHEMA,
    "columns_bak": K.COLUMNS_BAK_SCHEMA,
}


class TableStore:
    """Tables by id and label in a fixed list of schemas.

    A table starts with ``bucket_count`` buckets, rounded up to a power of two, and has more when
    they hold more than ``bucket_bytes`` each.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schemas: tuple[str, ...] = ("public", "published"),
        bucket_count: int = 16,
        bucket_bytes: int | None = None,
    ):
        self.spark = spark
        self.root = root
        self.schemas = [check_identifier(s) for s in schemas]
        self.bits = max(bucket_count - 1, 0).bit_length()
        self.bucket_bytes = bucket_bytes
        self._open: dict[str, tuple[int, DataFrame]] = {}

    # catalog

    def _folder(self, schema: str) -> Folder:
        if schema not in self.schemas:
            raise ValueError(f"unknown schema: {schema}")
        return Folder(self.spark, f"{self.root}/{schema}")

    def catalog(self, schema: str) -> dict[str, DataFrame]:
        """Frames ``tables, columns, tables_bak, columns_bak`` of the newest version."""
        folder = self._folder(schema)
        version = folder.latest("_catalog")
        if not version:
            return {n: self.spark.createDataFrame([], s) for n, s in _FRAMES.items()}
        name = json.loads(folder.read(f"_catalog/{version}.json"))["folder"]
        path = f"{folder.path}/_catalog/{name}"
        return {n: self.spark.read.schema(s).parquet(f"{path}/{n}") for n, s in _FRAMES.items()}

    def _save(
        self, schema: str, frames: dict[str, DataFrame], version: int, commits: tuple[str, ...] = ()
    ) -> None:
        """Publish the catalog that follows ``version``, and with it the table versions that
        were written under the tokens ``commits``."""
        folder, name = self._folder(schema), uuid.uuid4().hex
        for frame, frame_schema in _FRAMES.items():
            rows = frames[frame].select(
                *[F.col(f.name).cast(f.dataType).alias(f.name) for f in frame_schema.fields]
            )
            rows.write.parquet(f"{folder.path}/_catalog/{name}/{frame}")
        text = json.dumps({"folder": name, "commits": commits})
        folder.create(f"_catalog/{version + 1}.json", text)

    def _version(self, schema: str) -> int:
        return self._folder(schema).latest("_catalog")

    def tables(self, schema: str = K.DEFAULT_SCHEMA) -> DataFrame:
        return K.by_recent_update(self.catalog(schema)["tables"])

    def columns(self, table_id: int, schema: str = K.DEFAULT_SCHEMA) -> DataFrame:
        """Catalog columns of a table with their types, in id order."""
        rows = self.catalog(schema)["columns"].where(F.col("tbl_id") == table_id)
        types = K.physical_types(self.scan(table_id, schema))
        return K.columns_with_types(rows, types).orderBy("id")

    def _entry(self, table_id: int, schema: str):
        row = self.catalog(schema)["tables"].where(F.col("id") == table_id).first()
        if row is None:
            raise ValueError(f"schema {schema} has no table {table_id}")
        return row

    def find(self, table_id: int):
        """(schema, catalog row) of a table, looked for in all schemas."""
        order = K.schema_order(self.schemas)
        found = K.find_across_schemas({s: self.catalog(s)["tables"] for s in order})
        row = found.where(F.col("id") == table_id).first()
        if row is None:
            raise ValueError(f"no schema has a table {table_id}")
        return row["schema_name"], row

    def data(self, table_id: int, schema: str = K.DEFAULT_SCHEMA) -> TableData:
        return self._data(schema, self._entry(table_id, schema)["tbl_link"])

    def _data(self, schema: str, link: str) -> TableData:
        return TableData(self.spark, self.root, schema, link, self.bucket_bytes)

    def _restructure(
        self, data: TableData, struct: T.StructType, schema: str, frames: dict[str, DataFrame], version: int
    ) -> None:
        """Publish a table's new structure and the catalog that follows ``version`` as one."""
        token = uuid.uuid4().hex
        written = data.restructure(struct, [version + 1, token])
        if data.latest() != written.version:
            raise VersionConflict(f"{data.path}: version {written.version}")
        self._save(schema, frames, version, (token,))

    def scan(self, table_id: int, schema: str = K.DEFAULT_SCHEMA) -> DataFrame:
        return self.data(table_id, schema).read()

    def open(
        self, table_id: int, schema: str = K.DEFAULT_SCHEMA, refresh: bool = False
    ) -> DataFrame:
        """A cached copy of a table for repeated queries.

        The copy is kept while the table's version stays the same; ``refresh`` drops it
        first. It spills to executor disks, so it may be larger than memory.
        """
        data = self.data(table_id, schema)
        version = data.manifest().version
        known = self._open.get(data.path)
        if known and known[0] == version and not refresh:
            return known[1]
        self.close(table_id, schema)
        copy = data.read(version).persist()
        self._open[data.path] = (version, copy)
        return copy

    def close(self, table_id: int, schema: str = K.DEFAULT_SCHEMA) -> None:
        """Drop the cached copy of a table, if there is one."""
        _, copy = self._open.pop(self.data(table_id, schema).path, (None, None))
        if copy is not None:
            copy.unpersist()

    # tables and columns

    def _catalog_row(self, schema_type: T.StructType, **values) -> DataFrame:
        row = tuple(values.get(f.name) for f in schema_type.fields)
        return self.spark.createDataFrame([row], schema_type)

    def create_table(
        self,
        label: str,
        user: str,
        now: datetime.datetime,
        deployment_type: str | None = None,
        schema: str = K.DEFAULT_SCHEMA,
    ) -> int:
        """An empty table with id and audit columns; returns its id."""
        if label is None or not label.strip():
            raise ValueError("a table needs a name")
        kind = E.check_deployment_type(deployment_type)
        version, frames = self._version(schema), self.catalog(schema)
        table_id, link = max_id(frames["tables"], "id") + 1, f"tbl_{uuid.uuid4().hex}"
        self._data(schema, link).create(E.BASE_SCHEMA, self.bits)
        row = self._catalog_row(
            K.TABLES_SCHEMA,
            id=table_id,
            tbl_label=label.strip(),
            tbl_link=link,
            version_no=1,
            deployment_type=kind,
            add_ts=now,
            add_usr=user,
        )
        self._save(schema, {**frames, "tables": frames["tables"].unionByName(row)}, version)
        return table_id

    def add_columns(
        self,
        table_id: int,
        columns: dict[str, str],
        user: str,
        now: datetime.datetime,
        schema: str = K.DEFAULT_SCHEMA,
    ) -> dict[str, str]:
        """Add columns by label and type; returns label -> physical name.

        Missing columns of a Parquet file read as NULL, so no data is rewritten.
        """
        version, frames = self._version(schema), self.catalog(schema)
        data, entry = self.data(table_id, schema), self._entry(table_id, schema)
        first = max_id(frames["columns"], "id") + 1
        links, added = {}, []
        probe = self.spark.createDataFrame([], data.manifest().struct)
        for i, (label, type_text) in enumerate(columns.items()):
            links[label] = f"col_{uuid.uuid4().hex}"
            probe = E.add_column(probe, links[label], type_text)
            values = dict(
                id=first + i,
                tbl_id=table_id,
                tbl_link=entry["tbl_link"],
                col_label=label,
                col_link=links[label],
                version_no=1,
                add_ts=now,
                add_usr=user,
            )
            added.append(tuple(values.get(f.name) for f in K.COLUMNS_SCHEMA.fields))
        rows = frames["columns"].unionByName(self.spark.createDataFrame(added, K.COLUMNS_SCHEMA))
        self._restructure(data, probe.schema, schema, {**frames, "columns": rows}, version)
        return links

    def load_csv(
        self,
        label: str,
        path: str,
        user: str,
        now: datetime.datetime,
        types: Types | None = None,
        delimiter: str = ",",
        limit: int = SKIP_LIMIT,
        schema: str = K.DEFAULT_SCHEMA,
    ) -> tuple[int, dict]:
        """A new table from CSV files: (its id, the report of ``TableData.load``).

        Columns are labelled with the cleaned-up header; ``types`` gives types by label, TEXT
        where it has none, and a label the files lack is an error. Rows get ids and audit
        columns. With more than ``limit`` refused rows the table is dropped again and the load
        raises; the rejects stay.
        """
        text = read_csv(self.spark, path, delimiter, keep=["_file"])
        labels = [c for c in text.columns if c != "_file"]
        types = types or {}
        unknown = sorted(set(types) - set(labels))
        if unknown:
            raise ValueError(f"columns not in the files: {unknown}")
        table_id = self.create_table(label, user, now, schema=schema)
        try:
            wanted = {c: types.get(c, "TEXT") for c in labels}
            links = self.add_columns(table_id, wanted, user, now, schema)
            report = self.data(table_id, schema).load(
                text.withColumnsRenamed(links), user, now, limit
            )
        except Exception:
            self.drop_table(table_id, schema)
            raise
        return table_id, report

    def _column(self, table_id: int, column_id: int, schema: str):
        row = self.catalog(schema)["columns"].where(F.col("id") == column_id).first()
        if row is None:
            raise ValueError(f"no column {column_id}")
        if row["tbl_id"] != table_id:
            raise ValueError(f"column {column_id} is of another table")
        return row

    def drop_column(
        self, table_id: int, column_id: int, schema: str = K.DEFAULT_SCHEMA
    ) -> None:
        """Take a column out of the structure and the catalog; its data is just not read."""
        version, frames = self._version(schema), self.catalog(schema)
        row, data = self._column(table_id, column_id, schema), self.data(table_id, schema)
        probe = self.spark.createDataFrame([], data.manifest().struct)
        probe = E.drop_column(probe, row["col_link"])
        kept = frames["columns"].where(F.col("id") != column_id)
        self._restructure(data, probe.schema, schema, {**frames, "columns": kept}, version)

    def change_column_type(
        self, table_id: int, column_id: int, type_text: str, schema: str = K.DEFAULT_SCHEMA
    ) -> None:
        row, data = self._column(table_id, column_id, schema), self.data(table_id, schema)
        changed = E.change_column_type(data.state(), row["col_link"], type_text)
        data.replace(changed, struct=changed.drop(*HIDDEN).schema)

    def rename_table(
        self,
        table_id: int,
        label: str,
        user: str,
        now: datetime.datetime,
        schema: str = K.DEFAULT_SCHEMA,
    ) -> None:
        self._entry(table_id, schema)
        version, frames = self._version(schema), self.catalog(schema)
        tables = E.rename_label(
            frames["tables"], F.col("id") == table_id, F.lit(label), user, now
        )
        self._save(schema, {**frames, "tables": tables}, version)

    def drop_table(self, table_id: int, schema: str = K.DEFAULT_SCHEMA) -> None:
        """Remove a table and its columns from the catalog; data folders stay for readers
        that still have them open."""
        self._entry(table_id, schema)
        version, frames = self._version(schema), self.catalog(schema)
        gone = self.spark.createDataFrame([(table_id,)], "id long")
        tables, columns = K.cascade_delete(
            frames["tables"], frames["columns"], gone, "id", "tbl_id"
        )
        self._save(schema, {**frames, "tables": tables, "columns": columns}, version)

    # copies

    def migrate(
        self,
        table_id: int,
        target_schema: str,
        user: str,
        now: datetime.datetime,
        source_schema: str = K.DEFAULT_SCHEMA,
        merge_source: bool = False,
    ) -> str:
        """Copy a table into another schema and return the link of the copy.

        A link the target does not have yet is copied as it is. Otherwise a shadow with
        the source's structure and the target's rows is built beside the target, the old
        catalog rows are backed up, and the catalog is pointed at the shadow last.
        """
        entry = self.catalog(source_schema)["tables"].where(F.col("id") == table_id).first()
        V.check_migration(target_schema, self.schemas, entry is not None)
        source = self._data(source_schema, entry["tbl_link"])
        version, frames = self._version(target_schema), self.catalog(target_schema)
        label = frames["tables"].where(F.col("tbl_label") == entry["tbl_label"])
        known = label.orderBy("id").first()
        same = self._data(target_schema, entry["tbl_link"])
        current = self._data(target_schema, known["tbl_link"]) if known else same
        if not current.exists():
            link, copy = entry["tbl_link"], same
            rows, size = source.read(), source.size()
        else:
            link = f"tbl_{uuid.uuid4().hex}"
            copy = self._data(target_schema, link)
            rows = V.migrate_shadow(source.read(), current.read(), merge_source)
            size = current.size() + (source.size() if merge_source else 0)
        copy.create(source.manifest().struct, bits_for(size, self.bits, copy.bucket_bytes))
        copy.replace(rows, size)
        if known:
            target_id = known["id"]
            frames = self._backed_up(frames, target_id, now)
            new_link = self.spark.createDataFrame([(target_id, link)], "id long, new_link string")
            tables = V.swap_links(frames["tables"], new_link, user, now)
        else:
            target_id = max_id(frames["tables"], "id") + 1
            row = self.spark.createDataFrame(
                [(target_id, *entry[1:2], link, *entry[3:])], K.TABLES_SCHEMA
            )
            tables = frames["tables"].unionByName(row)
        ids = self.spark.createDataFrame(
            [(table_id, target_id, link)], "source_id long, target_id long, new_link string"
        )
        synced = V.sync_columns(
            frames["columns"], self.catalog(source_schema)["columns"], ids
        )
        columns = self._numbered(synced)
        self._save(target_schema, {**frames, "tables": tables, "columns": columns}, version)
        return link

    def _numbered(self, columns: DataFrame) -> DataFrame:
        """Give ids to the new rows of a column catalog."""
        kept, fresh = columns.where(F.col("id").isNotNull()), columns.where(F.col("id").isNull())
        order = [F.col("tbl_id").asc(), F.col("add_ts").asc(), F.col("col_link").asc()]
        return kept.unionByName(assign_ids(fresh, kept, order, "id"))

    def _backed_up(
        self, frames: dict[str, DataFrame], table_id: int, now: datetime.datetime
    ) -> dict[str, DataFrame]:
        """Frames with the table's rows added to the history, the oldest versions dropped."""
        tables = V.backup_rows(frames["tables"], F.col("id") == table_id, now)
        columns = V.backup_rows(frames["columns"], F.col("tbl_id") == table_id, now)
        return {
            **frames,
            "tables_bak": V.retain_last_versions(
                frames["tables_bak"].unionByName(tables), ["id"], "backup_ts"
            ),
            "columns_bak": V.retain_last_snapshots(
                frames["columns_bak"].unionByName(columns), ["tbl_id"], "backup_ts"
            ),
        }

    def rollback(self, table_id: int, schema: str = K.DEFAULT_SCHEMA) -> None:
        """Point a table back at its newest backup and use that backup up."""
        version, frames = self._version(schema), self.catalog(schema)
        mine = frames["tables_bak"].where(F.col("id") == table_id)
        newest = mine.agg(F.max("backup_ts")).first()[0]
        if newest is None:
            raise ValueError(f"no backup of table {table_id}")
        ids = self.spark.createDataFrame([(table_id,)], "tbl_id long")
        at = F.col("backup_ts") == F.lit(newest.isoformat(sep=" ")).cast("timestamp_ntz")
        self._save(
            schema,
            {
                "tables": V.rollback_tables(frames["tables"], mine),
                "columns": V.rollback_columns(frames["columns"], frames["columns_bak"], ids),
                "tables_bak": frames["tables_bak"].where(~((F.col("id") == table_id) & at)),
                "columns_bak": frames["columns_bak"].where(~((F.col("tbl_id") == table_id) & at)),
            },
            version,
        )
