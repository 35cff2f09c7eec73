"""Arrow export: record batches per partition, as IPC payloads or as files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Rows of a partition's first batch and of the following ones.
FIRST_BATCH = 10_000
NEXT_BATCH = 50_000
# Rows with long texts fill a batch earlier.
BATCH_BYTES = 64 << 20

_PAYLOAD = "part int, batch int, row_count long, payload binary"
_FILES = "path string, part int, row_count long, batch_count long"


def _rebatched(
    batches: Iterable[pa.RecordBatch], max_bytes: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of the export sizes; holds one output batch at a time."""
    size, held, rows, space = FIRST_BATCH, [], 0, max_bytes
    for batch in batches:
        while batch.num_rows:
            row_bytes = max(1, batch.nbytes // batch.num_rows)
            take = min(size - rows, batch.num_rows, max(1, space // row_bytes))
            held.append(batch.slice(0, take))
            rows, space = rows + take, space - take * row_bytes
            batch = batch.slice(take)
            if rows == size or space < row_bytes:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                size, held, rows, space = NEXT_BATCH, [], 0, max_bytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def to_ipc(df: DataFrame) -> DataFrame:
    """One row per record batch with a self-contained IPC stream in ``payload``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, batch in enumerate(_rebatched(batches)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            row = {
                "part": pa.array([part], pa.int32()),
                "batch": pa.array([n], pa.int32()),
                "row_count": pa.array([batch.num_rows], pa.int64()),
                "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(row)

    return df.mapInArrow(encode, _PAYLOAD)


def from_ipc(payloads: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows held by IPC payloads."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload"):
                with pa.ipc.open_stream(payload.as_buffer()) as reader:
                    yield from reader

    return payloads.select("payload").mapInArrow(decode, schema)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_arrow(df: DataFrame, path: str) -> None:
    """Export a whole table as Arrow files in a shared folder, one per partition.

    A task writes a file of its own and reports it when done; the list of reported files
    is written last, as ``<path>/_files``. What a lost or repeated task left behind is not
    on the list and is not read. Without a scheme the path is a folder of this machine, which
    only a local session shares with its tasks.
    """
    if "://" not in path and not df.sparkSession.sparkContext.master.startswith("local["):
        raise ValueError(f"executors cannot share {path}: give a path with a scheme")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, folder = _filesystem(path)
        filesystem.create_dir(folder, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.arrow"
        writer, stream, rows, count = None, None, 0, 0
        for batch in _rebatched(batches):
            if writer is None:
                stream = filesystem.open_output_stream(f"{folder}/{name}")
                writer = pa.ipc.new_file(stream, batch.schema)
            writer.write_batch(batch)
            rows, count = rows + batch.num_rows, count + 1
        if writer is not None:
            writer.close()
            stream.close()
            row = {
                "path": pa.array([name], pa.string()),
                "part": pa.array([context.partitionId()], pa.int32()),
                "row_count": pa.array([rows], pa.int64()),
                "batch_count": pa.array([count], pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(row)

    df.mapInArrow(write, _FILES).write.parquet(f"{path}/_files")


def arrow_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of an export with their row and batch counts."""
    return spark.read.schema(_FILES).parquet(f"{path}/_files")


def read_arrow(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read an export back, one task per group of files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, folder = _filesystem(path)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with filesystem.open_input_file(f"{folder}/{name}") as stream:
                    reader = pa.ipc.open_file(stream)
                    for i in range(reader.num_record_batches):
                        yield reader.get_batch(i)

    names = arrow_files(spark, path).select("path").repartition(F.col("path"))
    return names.mapInArrow(read, schema)
