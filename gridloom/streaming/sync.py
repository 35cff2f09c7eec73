"""Keep a copy current with a stream of row changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming import StreamingQuery

from gridloom.sources.store import TableData

# Delta folders a bucket may have before they are folded in.
COMPACT_AFTER = 16


def event_schema(row: T.StructType) -> T.StructType:
    """Row events: a sequence number, insert, update or delete, and the row."""
    head = [T.StructField("seq", T.LongType()), T.StructField("op", T.StringType())]
    return T.StructType([*head, *row.fields])


def sync_copy(
    events: DataFrame,
    copy: TableData,
    name: str,
    checkpoint: str,
    compact_after: int = COMPACT_AFTER,
    **trigger,
) -> StreamingQuery:
    """Apply a stream of row events to ``copy``.

    Events may be repeated and may arrive in a later batch than newer ones of the same row. A
    batch writes deltas only; when a bucket has ``compact_after`` of them they are folded
    in. A batch may be delivered again after a failure; the copy's manifest remembers the last
    batch of each stream, so a repeated one changes nothing.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        copy.apply_images(batch, (name, batch_id))
        if copy.deepest() >= compact_after:
            copy.compact()

    writer = events.writeStream.queryName(name).foreachBatch(apply)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger or _NOW).start()


_NOW = {"availableNow": True}
