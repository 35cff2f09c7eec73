"""The rows of one table as versioned Parquet folders.

Layout below the table's folder::

    _versions/<n>.json         manifest of version n
    data/<folder>/bucket=<b>   rows whose id hashes to bucket b

Rows lie in 2^bits buckets by a hash of the id. A manifest names, for each bucket, the folders
of base rows and the folders of deltas: newest images of rows a stream has changed. Appends add
base folders and streams add deltas, neither reads or rewrites what is there. Readers lay the deltas
over the base, only in buckets that have any; ``compact`` folds them in.

Next to its columns a row keeps ``_seq``, the number of the last event that set it, and
``_gone``, set when that event deleted it. Deleted rows stay as such marks, so an event that
arrives late is recognised whatever it follows.

Buckets split without being rewritten. When the data has outgrown them, the next version has one bit
more; both halves of a bucket then name the folders the whole one had and take their own
rows from it, until something rewrites them.
"""

from __future__ import annotations

import datetime
import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gridloom.functions.names import AUDIT_COLUMNS
from gridloom.functions.types import field_type_name
from gridloom.operators import versions as V
from gridloom.operators.changes import (
    GONE,
    SEQ,
    apply_changes,
    event_images,
    merge_images,
    stamp_insert,
)
from gridloom.operators.ingest import (
    SKIP_LIMIT,
    Types,
    judge_rows,
    load_counts,
    refused_cell,
    report_of,
)
from gridloom.operators.keys import PLACED, max_id, numbered_rows, placed_columns, with_positions
from gridloom.operators.lengths import checked, described, fitting_rows, inherited, length_rejects
from gridloom.operators.skew import BROADCAST_BYTES, data_bytes
from gridloom.sources.files import Folder

ID = "id"

# What a row keeps besides its columns; files without them read as NULL.
STATE = [T.StructField(SEQ, T.LongType()), T.StructField(GONE, T.BooleanType())]
HIDDEN = [f.name for f in STATE]

BUCKET_BYTES = 256 << 20  # buckets split when they hold more than this on average

Buckets = dict[str, list[str]]


@dataclass(frozen=True)
class Manifest:
    """One version of a table's data."""

    version: int
    schema: str
    bits: int
    next_id: int = 1
    buckets: Buckets = field(default_factory=dict)
    deltas: Buckets = field(default_factory=dict)
    # Of each folder: the bits it was written with, and its bytes.
    folders: dict[str, list[int]] = field(default_factory=dict)
    streams: dict[str, dict] = field(default_factory=dict)
    # The catalog version that must name this token for the manifest to count.
    commit: list | None = None

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))

    @property
    def bucket_count(self) -> int:
        return 1 << self.bits

    def size(self, buckets: Buckets) -> int:
        """Bytes of the folders the buckets name, as far as they were written for them."""
        named = {f for folders in buckets.values() for f in folders}
        return sum(self.folders[f][1] for f in named)


def bits_for(size: int, least: int, bucket_bytes: int) -> int:
    """The bits that give buckets of at most ``bucket_bytes``."""
    return max(least, (max(size - 1, 0) // bucket_bytes).bit_length())


class TableData:
    """The versions of one physical table."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: str,
        link: str,
        bucket_bytes: int | None = None,
    ):
        self.spark = spark
        self.path = f"{root}/{schema}/{link}"
        self.bucket_bytes = BUCKET_BYTES if bucket_bytes is None else bucket_bytes
        self._folder = Folder(spark, self.path)
        self._catalog = Folder(spark, f"{root}/{schema}")

    # versions

    def _read_manifest(self, version: int) -> Manifest:
        return Manifest(**json.loads(self._folder.read(f"_versions/{version}.json")))

    def _counts(self, manifest: Manifest) -> bool:
        """Whether the catalog version a manifest belongs to was published."""
        if manifest.commit is None:
            return True
        number, token = manifest.commit
        name = f"_catalog/{number}.json"
        return self._catalog.exists(name) and token in json.loads(self._catalog.read(name)).get("commits", [])

    def exists(self) -> bool:
        return self.latest() > 0

    def latest(self) -> int:
        """The highest version anybody has written."""
        return self._folder.latest("_versions")

    def size(self) -> int:
        """Bytes of the newest version's files."""
        manifest = self.manifest()
        return manifest.size(manifest.buckets) + manifest.size(manifest.deltas)

    def manifest(self, version: int | None = None) -> Manifest:
        """A version by its number, or the newest; one left behind by a writer that stopped
        before it published its catalog does not count."""
        if version:
            return self._read_manifest(version)
        for number in self._folder.numbers("_versions"):
            found = self._read_manifest(number)
            if self._counts(found):
                return found
        raise ValueError(f"no such table: {self.path}")

    def _publish(self, manifest: Manifest) -> Manifest:
        """Publish the version after the one ``manifest`` was made from."""
        text = json.dumps(manifest.__dict__)
        self._folder.create(f"_versions/{manifest.version}.json", text)
        return manifest

    def _next(self, old: Manifest, **changes) -> Manifest:
        """The version that follows ``old``, with folders nobody names any more left out, and
        one bit more when the buckets have grown too large."""
        number = self.latest() + 1
        if number != old.version + 1 and self._counts(self._read_manifest(number - 1)):
            number = old.version + 1  # somebody was faster: publishing will say so
        new = replace(old, version=number, commit=None, **changes)
        named = {f for b in (new.buckets, new.deltas) for folders in b.values() for f in folders}
        new = replace(new, folders={f: x for f, x in new.folders.items() if f in named})
        return self._split(new) if new.size(new.buckets) > self.bucket_bytes << new.bits else new

    def _split(self, manifest: Manifest) -> Manifest:
        """Each bucket as two, by one more bit of the hash; no file is touched."""
        count = manifest.bucket_count

        def halves(buckets: Buckets) -> Buckets:
            return {str(int(b) + half): list(f) for b, f in buckets.items() for half in (0, count)}

        return replace(
            manifest,
            bits=manifest.bits + 1,
            buckets=halves(manifest.buckets),
            deltas=halves(manifest.deltas),
        )

    def create(self, schema: T.StructType, bits: int = 0) -> Manifest:
        """Publish an empty first version."""
        return self._publish(Manifest(1, schema.json(), bits))

    # reading

    def _bucket(self, bits: int) -> Column:
        return F.pmod(F.xxhash64(F.col(ID).cast("long")), F.lit(1 << bits))

    def _files(self, manifest: Manifest, buckets: Buckets, only: set[str] | None) -> DataFrame:
        """Rows with their state, of all buckets or those in ``only``.

        A folder written with fewer bits is shared; where not all sharers are asked for, or
        not all name it any more, only the rows of those that do are taken from it.
        """
        struct = T.StructType([*manifest.struct.fields, *STATE])
        asked: dict[tuple[str, int], set[int]] = {}
        for b, folders in buckets.items():
            if only is None or b in only:
                for f in folders:
                    bits = manifest.folders[f][0]
                    asked.setdefault((f, int(b) % (1 << bits)), set()).add(int(b))
        whole, shared = [], {}
        for (f, b), mine in asked.items():
            path = f"{self.path}/data/{f}/bucket={b}"
            if len(mine) == 1 << (manifest.bits - manifest.folders[f][0]):
                whole.append(path)
            else:
                shared.setdefault(frozenset(mine), []).append(path)
        rows = self.spark.createDataFrame([], struct)
        if whole:
            rows = self.spark.read.schema(struct).parquet(*whole)
        for mine, paths in shared.items():
            part = self.spark.read.schema(struct).parquet(*paths)
            rows = rows.unionByName(part.where(self._bucket(manifest.bits).isin(*sorted(mine))))
        return rows

    def _state(self, manifest: Manifest, only: set[str] | None = None) -> DataFrame:
        """Rows with their state, deltas laid over the base, marks of deleted rows included."""
        changed = {b for b in manifest.deltas if only is None or b in only}
        if not changed:
            return self._files(manifest, manifest.buckets, only)
        base = self._files(manifest, manifest.buckets, changed)
        images = self._files(manifest, manifest.deltas, changed)
        merged = merge_images(base, images, ID, manifest.size(manifest.deltas) <= BROADCAST_BYTES // 4)
        merged = described(merged, manifest.struct)
        rest = (set(manifest.buckets) if only is None else only) - changed
        return self._files(manifest, manifest.buckets, rest).unionByName(merged) if rest else merged

    def _load(self, manifest: Manifest, only: set[str] | None = None) -> DataFrame:
        rows = self._state(manifest, only)
        return rows.where(~F.coalesce(GONE, F.lit(False))).drop(*HIDDEN)

    def read(self, version: int | None = None) -> DataFrame:
        return self._load(self.manifest(version))

    def types(self) -> Types:
        """The type names of the columns users fill, lengths included."""
        system = {ID, *AUDIT_COLUMNS}
        fields = self.manifest().struct.fields
        return {f.name: field_type_name(f) for f in fields if f.name not in system}

    def state(self) -> DataFrame:
        """The rows with their state, for ``replace``."""
        return self._state(self.manifest())

    def _buckets_of(self, ids: DataFrame, manifest: Manifest) -> set[str]:
        """Buckets of some ids; there are at most as many as the manifest names."""
        return {str(r.bucket) for r in ids.select(self._bucket(manifest.bits).alias("bucket")).distinct().collect()}

    def lookup(self, ids: DataFrame) -> DataFrame:
        """Rows whose id is in the column ``id`` of ``ids``; only their buckets are opened."""
        manifest = self.manifest()
        ids = ids.select(F.col(ID).cast("long").alias(ID)).distinct()
        rows = self._load(manifest, self._buckets_of(ids, manifest))
        return rows.join(ids, ID, "left_semi")

    # writing

    def _write(self, df: DataFrame, bits: int) -> tuple[Buckets, dict[str, list[int]]]:
        """Write rows to a new folder, grouped by bucket; returns the buckets and the folder.

        Rows of a bucket are rebalanced: small buckets share a task, and one that is large
        is written by several, a file each.
        """
        folder = uuid.uuid4().hex
        bucketed = df.withColumn("bucket", self._bucket(bits)).hint("rebalance", F.col("bucket"))
        bucketed.write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        names = self._folder.names(f"data/{folder}")
        buckets = {n.split("=")[1]: [folder] for n in names if n.startswith("bucket=")}
        return buckets, {folder: [bits, self._folder.size(f"data/{folder}")]} if buckets else {}

    def replace(
        self, df: DataFrame, size: int | None = None, struct: T.StructType | None = None
    ) -> Manifest:
        """Publish ``df`` as the whole table, its columns as the new structure.

        The buckets are made for ``size`` bytes, measured when not given. Rows may come with
        their state (``state``); without it every event counts as newer. Text columns keep the
        lengths they had, unless ``struct`` gives the structure; a text that is too long fails.
        """
        old = self.manifest()
        bits = bits_for(data_bytes(df) if size is None else size, old.bits, self.bucket_bytes)
        struct = inherited(df.drop(*HIDDEN).schema, old.struct) if struct is None else struct
        buckets, folders = self._write(checked(df, struct), bits)
        written = replace(
            old, schema=struct.json(), bits=bits, buckets=buckets, deltas={}, folders=folders
        )
        last = max_id(self._files(written, buckets, None), ID) if buckets else 0
        changes = {f: getattr(written, f) for f in ("schema", "bits", "buckets", "deltas", "folders")}
        return self._publish(self._next(old, next_id=max(old.next_id, last + 1), **changes))

    def restructure(self, struct: T.StructType, commit: list | None = None) -> Manifest:
        """Publish another structure over the same files; ``commit`` is the catalog version and
        the token that version must name."""
        old = self.manifest()
        return self._publish(replace(self._next(old, schema=struct.json()), commit=commit))

    def insert(
        self,
        rows: DataFrame,
        order: list[Column] | None,
        user: str,
        now: datetime.datetime,
        stream: tuple[str, int] | None = None,
        rejects: str | None = None,
    ) -> Manifest:
        """Append rows under fresh ids; existing files are neither read nor rewritten.

        Columns starting with an underscore serve the order only and are not stored.
        ``stream`` is ``(name, batch)`` of a streaming source; a batch that is in already
        is left out. A text longer than its column takes fails the insert, or, with a new folder
        ``rejects``, is written there with its row, as JSON, and the other rows are inserted.
        """
        old = self.manifest()
        if stream and _seen(old, stream):
            return old
        rows = rows.drop(ID)
        if rejects is not None:
            whole = rows.withColumn("raw", F.to_json(F.struct(*rows.columns)))
            length_rejects(whole, old.struct, ["raw"]).write.parquet(rejects)
            rows = fitting_rows(rows, old.struct)
        return self._append(old, with_positions(rows, order, ID), user, now, stream)

    def _append(
        self,
        old: Manifest,
        numbered: DataFrame,
        user: str,
        now: datetime.datetime,
        stream: tuple[str, int] | None = None,
    ) -> Manifest:
        """Publish rows numbered from 0 on as new rows of ``old``."""
        numbered = numbered.withColumn(ID, F.col(ID) + F.lit(old.next_id)).drop(
            *[c for c in numbered.columns if c.startswith("_")]
        )
        added = V.bulk_copy(stamp_insert(numbered, user, now), old.struct)
        fresh, folders = self._write(checked(added, old.struct), old.bits)
        written = replace(old, folders={**old.folders, **folders})
        count, last = 0, 0
        if fresh:
            count, last = self._files(written, fresh, None).agg(F.count(F.lit(1)), F.max(ID)).first()
        return self._publish(
            self._next(
                old,
                next_id=max(old.next_id, last + 1),
                buckets=_with(old.buckets, fresh),
                folders=written.folders,
                streams=_advance(old, stream, count),
            )
        )

    def load(
        self,
        rows: DataFrame,
        user: str,
        now: datetime.datetime,
        limit: int = SKIP_LIMIT,
        types: Types | None = None,
    ) -> dict:
        """Parse rows of text, insert those the table takes and keep the others as rejects.

        Returns the report: status, read_count, write_count, skip_count, empty_count, failures
        (the first few as text), rejects (their folder, None without any). ``types`` are those
        of the table unless given; columns of the table that ``rows`` lacks become NULL, and a
        column ``_file`` names the source of a reject. New rows get ids and audit columns.

        The input is read and parsed once: good and refused rows are written side by side,
        by outcome, into a folder of the table, and the new version is made from the good
        ones. With more than ``limit`` refused rows nothing is published; the rejects stay.
        """
        old = self.manifest()
        types = self.types() if types is None else types
        here = {c: t for c, t in types.items() if c in rows.columns}
        staged = f"{self.path}/loads/{uuid.uuid4().hex}"
        source = F.col("_file") if "_file" in rows.columns else F.lit(None).cast("string")
        judged = judge_rows(rows.select(*here, source.alias("_source")), here)
        outcome = F.when(F.col("_reject").isNotNull(), "refused").when(F.col("_empty"), "empty")
        refused = refused_cell(here, F.col("_source"))
        judged.select(
            F.when(F.col("_reject").isNull(), F.col("_typed")).alias("_typed"),
            F.when(F.col("_reject").isNotNull(), refused).alias("_refused"),
            *placed_columns(),
            outcome.otherwise("good").alias("outcome"),
        ).write.partitionBy("outcome").parquet(staged)
        typed = judged.select("_typed", refused.alias("_refused")).schema
        schema = T.StructType([*typed.fields, *PLACED, T.StructField("outcome", T.StringType())])
        parts = self.spark.read.schema(schema).parquet(staged)
        report = load_counts(parts)
        rejects = parts.where("outcome = 'refused'").select("_refused.*")
        report = report_of(report, rejects, limit, f"{staged}/outcome=refused")
        good = parts.where("outcome = 'good'").select("_typed.*", *[f.name for f in PLACED])
        if report["write_count"]:
            self._append(old, numbered_rows(good, ID), user, now)
        return report

    def apply_images(
        self, events: DataFrame, stream: tuple[str, int] | None = None
    ) -> Manifest:
        """Take in row events ``(seq, op, <columns>)`` as deltas.

        Events may come late, repeated and in any order, also over several calls: of each
        id the one with the highest ``seq`` holds. Events without ``seq`` or id are left
        out. A streaming batch that is in already is left out.
        """
        old = self.manifest()
        if stream and _seen(old, stream):
            return old
        images = event_images(events.select("seq", "op", *old.struct.names), ID)
        fresh, folders = self._write(checked(images, old.struct), old.bits)
        written = replace(old, folders={**old.folders, **folders})
        rows, last = 0, 0
        if fresh:
            rows, last = self._files(written, fresh, None).agg(F.count(F.lit(1)), F.max(ID)).first()
        return self._publish(
            self._next(
                old,
                next_id=max(old.next_id, last + 1),
                deltas=_with(old.deltas, fresh),
                folders=written.folders,
                streams=_advance(old, stream, rows),
            )
        )

    def deepest(self) -> int:
        """The most delta folders any bucket has."""
        return max((len(f) for f in self.manifest().deltas.values()), default=0)

    def compact(self, forget: int | None = None) -> Manifest:
        """Fold the deltas into the base, and the folders of a bucket into one.

        Buckets without deltas and with a single folder of their own are left as they are. Marks of
        rows deleted by an event before ``forget`` go; an event for such a row that is later
        still would bring it back.
        """
        old = self.manifest()
        chosen = set(old.deltas) | {
            b for b, f in old.buckets.items() if len(f) > 1 or old.folders[f[0]][0] < old.bits
        }
        if not chosen:
            return old
        rows = self._state(old, chosen)
        if forget is not None:
            rows = rows.where(~F.coalesce(F.col(GONE) & (F.col(SEQ) < forget), F.lit(False)))
        fresh, folders = self._write(rows, old.bits)
        return self._publish(
            self._next(
                old,
                buckets={**{b: f for b, f in old.buckets.items() if b not in chosen}, **fresh},
                deltas={},
                folders={**old.folders, **folders},
            )
        )

    def apply_changes(
        self, changes: DataFrame, user: str, now: datetime.datetime
    ) -> Manifest:
        """Merge a change log of edits; only the buckets of edited rows are read and rewritten."""
        old = self.manifest()
        numeric = F.col("row_id").rlike(r"^(0|-?[1-9][0-9]{0,18})$")
        ids = changes.select(F.when(numeric, F.col("row_id").try_cast("long")).alias(ID))
        touched = self._buckets_of(ids.where(F.col(ID).isNotNull()), old)
        state = self._state(old, touched)
        gone = F.coalesce(GONE, F.lit(False))
        edited = apply_changes(state.where(~gone), changes, user, now, next_id=old.next_id)
        fresh, folders = self._write(edited.unionByName(state.where(gone)), old.bits)
        written = replace(old, folders={**old.folders, **folders})
        last = max_id(self._files(written, fresh, None), ID) if fresh else 0
        kept = {b: f for b, f in old.buckets.items() if b not in touched}
        return self._publish(
            self._next(
                old,
                next_id=max(old.next_id, last + 1),
                buckets=_with(kept, fresh),
                deltas={b: f for b, f in old.deltas.items() if b not in touched},
                folders=written.folders,
            )
        )


def _with(buckets: Buckets, fresh: Buckets) -> Buckets:
    return {b: [*buckets.get(b, []), *fresh.get(b, [])] for b in {**buckets, **fresh}}


def _seen(manifest: Manifest, stream: tuple[str, int]) -> bool:
    name, batch = stream
    return batch <= manifest.streams.get(name, {}).get("batch", -1)


def _advance(manifest: Manifest, stream: tuple[str, int] | None, rows: int) -> dict[str, dict]:
    if stream is None:
        return manifest.streams
    name, batch = stream
    before = manifest.streams.get(name, {}).get("rows", 0)
    return {**manifest.streams, name: {"batch": batch, "rows": before + rows}}
