import datetime
from decimal import Decimal

import pyarrow as pa

from gridloom.sources.arrow import (
    FIRST_BATCH,
    NEXT_BATCH,
    _rebatched,
    arrow_files,
    from_ipc,
    read_arrow,
    to_ipc,
    write_arrow,
)


def test_batch_sizes():
    batches = [pa.RecordBatch.from_pydict({"a": list(range(7_000))}) for _ in range(20)]
    out = list(_rebatched(batches))
    assert [b.num_rows for b in out] == [FIRST_BATCH, NEXT_BATCH, NEXT_BATCH, 30_000]
    assert sum((b.column("a").to_pylist() for b in out), []) == list(range(7_000)) * 20
    assert list(_rebatched([])) == []


def test_long_rows_make_smaller_batches():
    texts = [str(i) * 1_000 for i in range(10, 60)]
    out = list(_rebatched([pa.RecordBatch.from_pydict({"t": texts})], max_bytes=10_000))
    assert max(b.num_rows for b in out) < 10 and sum(b.num_rows for b in out) == 50
    assert sum((b.column("t").to_pylist() for b in out), []) == texts


def sample(spark):
    row = (1, True, Decimal("1.50"), 2.5, datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3, 4, 5, 6), "x")
    schema = "id long, b boolean, d decimal(10,2), f double, day date, at timestamp_ntz, s string"
    return spark.createDataFrame([row, (2, *[None] * 6)], schema)


def test_payloads_round_trip(spark, rows):
    df = sample(spark)
    payloads = to_ipc(df.repartition(2))
    assert rows(from_ipc(payloads, df.schema)) == rows(df)


def test_files_round_trip(spark, tmp_path, rows):
    df = sample(spark).repartition(3)
    path = str(tmp_path / "export")
    write_arrow(df, path)
    assert arrow_files(spark, path).agg({"row_count": "sum"}).first()[0] == 2
    assert rows(read_arrow(spark, path, df.schema)) == rows(df)
    (tmp_path / "export" / "part-00099-7.arrow").write_bytes(b"left over by a lost task")
    assert rows(read_arrow(spark, path, df.schema)) == rows(df)
