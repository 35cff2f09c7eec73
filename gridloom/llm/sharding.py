"""Sharding by proportional stratified interleaving, with built-in functions only.

Rows of each source are shuffled by a seeded hash and numbered; a row's fractional rank is
(number - 1/2) / rows of its source. Sorting all rows by fractional rank mixes the sources
in proportion everywhere, and equal cuts of that order are the shards: their row counts
differ by at most one, and a shard's share of each source by about one row.

No task holds a source or a shard. Both orders are cut into a few buckets per shuffle
partition, by the hash and by the fractional rank, both spread evenly; rows are numbered inside
their bucket and moved up by the counts of the buckets before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.session import checkpointed

BUCKETS_PER_PARTITION = 4
MOST_BUCKET_ROWS = 1_000_000
_BITS = 40  # of the hash and of the fractional rank; leaves 23 bits for the bucket count


def _before(counts: DataFrame, name: str, by: list[str]) -> DataFrame:
    """Rows in the buckets before each bucket; ``by`` names what the buckets belong to."""
    window = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum("bucket_rows").over(window), F.lit(0)))


def interleave(
    rows: DataFrame, source: Column, tie: list[Column], shards: int, seed: int = 0
) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1), ``slot`` (0, 1, ... in each shard) and ``position``.

    ``tie`` holds columns that identify a row; the shuffle depends on them and the seed. Rows
    that agree in all of them take consecutive places in any order. A NULL source is a source
    of its own. An empty table gives an empty result. Columns of the input named like those
    added, or ``source_key hash bucket bucket_rows below source_rows rank``, are replaced.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[_text(c) for c in tie]))
    keyed = rows.withColumns(
        {
            "source_key": _text(source),
            "hash": F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("long"),
            "tie_key": digest,
        }
    )
    # The seeded order is read three times below; it must be the same each time.
    keyed = checkpointed(keyed)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(BUCKETS_PER_PARTITION * partitions, -(-keyed.count() // MOST_BUCKET_ROWS))

    keyed = keyed.withColumn("bucket", F.shiftright(F.col("hash") * F.lit(buckets), _BITS))
    in_bucket = Window.partitionBy("source_key", "bucket").orderBy("hash", "tie_key")
    counts = keyed.groupBy("source_key", "bucket").agg(F.count(F.lit(1)).alias("bucket_rows"))
    totals = Window.partitionBy("source_key")
    starts = _before(counts, "below", ["source_key"]).withColumn(
        "source_rows", F.sum("bucket_rows").over(totals)
    )
    ranked = (
        keyed.withColumn("rank", F.row_number().over(in_bucket).cast("long"))
        .join(starts, ["source_key", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("below"))
        # The fractional rank (2 rank - 1) / (2 rows) as an integer of _BITS bits.
        .withColumn(
            "rank",
            F.expr(f"(cast(2 * rank - 1 as decimal(20)) * {1 << (_BITS - 1)}) div source_rows"),
        )
        .drop("bucket", "bucket_rows", "below", "source_rows")
    )

    ranked = ranked.withColumn("bucket", F.shiftright(F.col("rank") * F.lit(buckets), _BITS))
    order = Window.partitionBy("bucket").orderBy("rank", "hash", "source_key", "tie_key")
    counts = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("bucket_rows"))
    # One row per bucket, so the single task of this window stays small.
    total = Window.partitionBy()
    starts = _before(counts, "below", []).withColumn("source_rows", F.sum("bucket_rows").over(total))
    return (
        ranked.withColumn("position", F.row_number().over(order).cast("long") - 1)
        .join(starts, "bucket")
        .withColumn("position", F.col("position") + F.col("below"))
        .withColumn("shard", F.expr(f"cast(position * {shards} div source_rows as int)"))
        .withColumn(
            "slot", F.expr(f"position - (shard * source_rows + {shards} - 1) div {shards}")
        )
        .drop("bucket", "bucket_rows", "below", "source_rows", "rank", "hash", "source_key", "tie_key")
    )


def _text(column: Column) -> Column:
    """A text of a value that tells NULL and all values apart."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def shard_documents(documents: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Place of every document: doc_id, size, text_crc32, source, shard, slot.

    ``size`` is the UTF-8 length of the text (NULL: 0) plus 16; ``text_crc32`` is NULL for a
    NULL text. Documents that repeat an id or a text are placed like any others. Texts are
    reduced to size and checksum in the scan and never shuffled.
    """
    rows = documents.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    tie = [F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("source")]
    return interleave(rows, F.col("source"), tie, shards, seed)
