"""The catalog of tables and columns, and parent/child operations over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from gridloom.functions.types import field_type_name
from gridloom.operators.skew import join_unique

_AUDIT = [
    T.StructField("add_ts", T.TimestampNTZType()),
    T.StructField("add_usr", T.StringType()),
    T.StructField("upd_ts", T.TimestampNTZType()),
    T.StructField("upd_usr", T.StringType()),
]

TABLES_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("tbl_label", T.StringType()),
        T.StructField("tbl_link", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("version_no", T.IntegerType()),
        T.StructField("deployment_type", T.StringType()),
        *_AUDIT,
    ]
)

COLUMNS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("tbl_id", T.LongType()),
        T.StructField("tbl_link", T.StringType()),
        T.StructField("col_label", T.StringType()),
        T.StructField("col_link", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("version_no", T.IntegerType()),
        *_AUDIT,
    ]
)

_BACKUP_TS = T.StructField("backup_ts", T.TimestampNTZType())
TABLES_BAK_SCHEMA = T.StructType([*TABLES_SCHEMA.fields, _BACKUP_TS])
COLUMNS_BAK_SCHEMA = T.StructType([*COLUMNS_SCHEMA.fields, _BACKUP_TS])

DEFAULT_SCHEMA = "public"


def by_recent_update(tables: DataFrame) -> DataFrame:
    """Newest update first, tables never updated last, then newest creation."""
    return tables.orderBy(
        F.col("upd_ts").desc_nulls_last(), F.col("add_ts").desc_nulls_first(), F.col("id").asc()
    )


def by_recent_touch(tables: DataFrame) -> DataFrame:
    """Newest update, or creation where there was none, first."""
    touched = F.coalesce("upd_ts", "add_ts")
    return tables.orderBy(
        touched.desc_nulls_first(), F.col("add_ts").desc_nulls_first(), F.col("id").asc()
    )


def parents_with_children(
    parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, **skew
) -> DataFrame:
    """Each parent with each of its children; a parent without any keeps one row with
    NULL child columns. Parents hold one row per key, children any number.

    Written as an inner join driven by the children plus the childless parents, so that
    a parent with very many children can be spread over tasks.
    """
    keyed = parents.withColumn("_key", F.col(parent_key))
    rows = children.withColumn("_key", F.col(child_key))
    matched = join_unique(rows, keyed, ["_key"], "inner", **skew)
    columns = [*parents.columns, *children.columns]
    used = children.select(F.col(child_key).alias("_key")).distinct()
    childless = keyed.join(used, "_key", "left_anti").select(
        *parents.columns,
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in children.schema.fields],
    )
    return matched.select(*columns).unionByName(childless)


def tables_with_columns(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Every table once per column, and once when it has none."""
    renamed = columns.withColumnsRenamed(
        {c: f"column_{c}" for c in columns.columns if c not in ("tbl_id", "col_label", "col_link")}
    )
    return parents_with_children(tables, renamed, "id", "tbl_id")


def physical_types(df: DataFrame) -> DataFrame:
    """``(col_link, type)`` of a physical table, read from its schema."""
    rows = [(f.name, field_type_name(f)) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "col_link string, type string")


def columns_with_types(columns: DataFrame, types: DataFrame) -> DataFrame:
    """Catalog columns with the type their physical column has, NULL when it is gone."""
    return join_unique(columns, types, ["col_link"], "left").select(*columns.columns, "type")


def find_across_schemas(schemas: dict[str, DataFrame], id_col: str = "id") -> DataFrame:
    """One row per id over several schemas; the schema listed first wins."""
    union = None
    for rank, (name, tables) in enumerate(schemas.items()):
        part = tables.select(
            id_col,
            F.lit(rank).alias("_rank"),
            F.struct(F.lit(name).alias("schema_name"), *tables.columns).alias("_row"),
        )
        union = part if union is None else union.unionByName(part)
    return union.groupBy(id_col).agg(F.min_by("_row", "_rank").alias("_row")).select("_row.*")


def schema_order(available: list[str]) -> list[str]:
    """Search order over schemas: the default one, then the others as listed."""
    return [DEFAULT_SCHEMA, *[s for s in available if s != DEFAULT_SCHEMA]]


def cascade_delete(
    parents: DataFrame,
    children: DataFrame,
    ids: DataFrame,
    parent_key: str,
    child_key: str,
    **skew,
) -> tuple[DataFrame, DataFrame]:
    """Parents and children left after deleting parents by id; ``ids`` is one column."""
    gone = ids.toDF("_key").distinct()
    kept_parents = parents.withColumn("_key", F.col(parent_key)).join(gone, "_key", "left_anti")
    kept_children = join_unique(
        children.withColumn("_key", F.col(child_key)), gone, ["_key"], "left_anti", **skew
    )
    return kept_parents.select(*parents.columns), kept_children.select(*children.columns)
