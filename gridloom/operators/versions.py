"""Copies of a table between schemas, metadata history, link swap and rollback."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridloom.functions.cells import timestamp_literal
from gridloom.operators.changes import upsert
from gridloom.operators.skew import join_unique

# Fixed value: backups kept per table.
KEEP_VERSIONS = 5


def _newest_times(df: DataFrame, keys: list[str], at: str, keep: int) -> tuple[DataFrame, Window]:
    """The ``keep`` newest distinct times per key with their row counts.

    The filter on ``dense_rank`` is applied per task before the shuffle, so a key with
    very many times sends at most ``keep`` of them from each task.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col(at).desc())
    times = df.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("_rows"))
    top = times.withColumn("_rank", F.dense_rank().over(newest)).where(F.col("_rank") <= keep)
    return top, newest


def _cutoff(top: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The oldest time to keep per key; a kept NULL time, the oldest of all, keeps every row."""
    return top.groupBy(F.struct(*keys).alias("_key")).agg(
        F.min(at).alias("_since"), F.bool_or(F.col(at).isNull()).alias("_all")
    )


def _since(df: DataFrame, cutoff: DataFrame, keys: list[str], at: str, **skew) -> DataFrame:
    # Structs with NULL fields compare as equal, so rows with a NULL key keep their place.
    keyed = df.withColumn("_key", F.struct(*keys))
    joined = join_unique(keyed, cutoff, ["_key"], "inner", **skew)
    return joined.where(F.col("_all") | (F.col(at) >= F.col("_since"))).select(*df.columns)


def retain_last_versions(
    df: DataFrame, keys: list[str], at: str, keep: int = KEEP_VERSIONS, **skew
) -> DataFrame:
    """Rows as new as the ``keep`` newest rows of their key; ties with the oldest stay.

    A NULL key is a key of its own, and a NULL time is older than any other.
    """
    top, newest = _newest_times(df, keys, at, keep)
    newer_rows = F.sum("_rows").over(newest.rowsBetween(Window.unboundedPreceding, -1))
    top = top.withColumn("_newer", F.coalesce(newer_rows, F.lit(0))).where(F.col("_newer") < keep)
    return _since(df, _cutoff(top, keys, at), keys, at, **skew)


def retain_last_snapshots(
    df: DataFrame, keys: list[str], at: str, keep: int = KEEP_VERSIONS, **skew
) -> DataFrame:
    """Rows of the ``keep`` newest distinct times of their key; NULLs as above."""
    top, _ = _newest_times(df, keys, at, keep)
    return _since(df, _cutoff(top, keys, at), keys, at, **skew)


def backup_rows(rows: DataFrame, condition: Column, now: datetime.datetime) -> DataFrame:
    """The chosen metadata rows stamped with ``backup_ts``."""
    return rows.where(condition).withColumn("backup_ts", timestamp_literal(now))


def swap_links(
    tables: DataFrame, links: DataFrame, user: str, now: datetime.datetime
) -> DataFrame:
    """Point tables at new links ``(id, new_link)`` and raise their version."""
    hit = F.col("new_link").isNotNull()
    changed = {
        "tbl_link": F.col("new_link"),
        "version_no": F.col("version_no") + 1,
        "upd_usr": F.lit(user),
        "upd_ts": timestamp_literal(now),
    }
    return tables.join(links.select("id", "new_link"), "id", "left").select(
        *[
            F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
            for c in tables.columns
        ]
    )


def sync_columns(
    target: DataFrame, source: DataFrame, table_ids: DataFrame
) -> DataFrame:
    """Target column rows with those of the given tables replaced by the source's.

    ``table_ids`` is ``(source_id, target_id, new_link)``. New rows take the target
    table's id and link; their own ``id`` is left NULL for ``assign_ids``.
    """
    gone = table_ids.select(F.col("target_id").alias("tbl_id"))
    kept = join_unique(target, gone, ["tbl_id"], "left_anti").select(*target.columns)
    mapped = table_ids.withColumnRenamed("source_id", "tbl_id")
    replaced = {
        "id": F.lit(None).cast(target.schema["id"].dataType),
        "tbl_id": F.col("target_id").cast(target.schema["tbl_id"].dataType),
        "tbl_link": F.col("new_link"),
    }
    fresh = join_unique(source.drop("tbl_link"), mapped, ["tbl_id"], "inner").select(
        *[replaced.get(c, F.col(c)).alias(c) for c in target.columns]
    )
    return kept.unionByName(fresh)


def rollback_tables(tables: DataFrame, backups: DataFrame) -> DataFrame:
    """Catalog rows put back to their newest backup; version and link come with it."""
    fields = tables.columns
    newest = backups.groupBy("id").agg(
        F.max_by(F.struct(*[c for c in fields if c != "id"]), "backup_ts").alias("_bak")
    )
    restored = F.col("_bak").isNotNull()
    return tables.join(newest, "id", "left").select(
        *[
            F.col(c) if c == "id"
            else F.when(restored, F.col(f"_bak.{c}")).otherwise(F.col(c)).alias(c)
            for c in fields
        ]
    )


def rollback_columns(columns: DataFrame, backups: DataFrame, table_ids: DataFrame) -> DataFrame:
    """Column rows of the given tables ``(tbl_id)`` put back to their newest snapshot."""
    kept = join_unique(columns, table_ids, ["tbl_id"], "left_anti").select(*columns.columns)
    chosen = join_unique(backups, table_ids, ["tbl_id"], "left_semi")
    top, _ = _newest_times(chosen, ["tbl_id"], "backup_ts", 1)
    restored = _since(chosen, _cutoff(top, ["tbl_id"], "backup_ts"), ["tbl_id"], "backup_ts")
    return kept.unionByName(restored.select(*columns.columns))


# --- data copies -------------------------------------------------------------------


def bulk_copy(source: DataFrame, target_schema: T.StructType) -> DataFrame:
    """Source rows in the target's structure: source columns by name, the rest NULL.

    A source column the target lacks is an error.
    """
    missing = [c for c in source.columns if c not in target_schema.names]
    if missing:
        raise ValueError(f"columns not in the target: {missing}")
    return source.select(
        *[
            (F.col(f.name) if f.name in source.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in target_schema.fields
        ]
    )


def migrate_shadow(
    source: DataFrame, target: DataFrame, merge_source: bool = False, key: str = "id"
) -> DataFrame:
    """The shadow of an existing target table: the source's structure with the target's
    rows; with ``merge_source`` the source's rows are upserted by ``key``."""
    shadow = bulk_copy(target, source.schema)
    return upsert(shadow, source, key) if merge_source else shadow


def check_migration(
    target_schema: str | None, available: list[str], source_exists: bool
) -> str:
    """Raise unless a table may be copied into ``target_schema``."""
    if target_schema is None or not target_schema.strip():
        raise ValueError("name the schema to copy to")
    if target_schema not in available:
        raise ValueError(f"no schema {target_schema!r} to copy to")
    if not source_exists:
        raise ValueError("there is nothing to copy: no such table in the source schema")
    return target_schema
