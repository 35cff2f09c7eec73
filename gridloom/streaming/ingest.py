"""Continuous loads: row payloads and folders of CSV files."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from gridloom.operators.ingest import (
    SKIP_LIMIT,
    Types,
    good_rows,
    judge_rows,
    payload_rejects,
    payload_to_columns,
    reject_rows,
)
from gridloom.functions.names import normalize_headers, type_by_name
from gridloom.sources.csv import broken_records, join_records, parse_lines, split_line, text_lines
from gridloom.sources.files import Folder
from gridloom.sources.store import TableData

_NOW = {"availableNow": True}

Clock = Callable[[], datetime.datetime]


def ingest_payloads(
    payloads: DataFrame,
    table: TableData,
    columns: Types | list[str] | None,
    name: str,
    checkpoint: str,
    user: str,
    clock: Clock,
    rejects: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Insert a stream of string maps ``(seq, row_data)`` with ids and audit columns.

    Ids follow ``seq`` inside a batch. A batch delivered twice is inserted once. Unknown keys
    and values that do not fit are written to ``rejects``, a subfolder per batch; without
    that folder any of them fails the stream. The other cells of such a row are inserted.
    ``columns`` gives the types; a list of names takes the types their names suggest, TEXT where
    they suggest none, and None takes the table's own types.
    """
    if columns is None:
        columns = table.types()
    elif not isinstance(columns, dict):
        columns = {c: type_by_name(c) or "TEXT" for c in columns}

    def apply(batch: DataFrame, batch_id: int) -> None:
        refused = payload_rejects(batch, "row_data", columns, ["seq"])
        if rejects is not None:
            refused.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        elif first := refused.head():
            raise ValueError(f"a payload was refused: {first.column}: {first.reason}")
        rows = payload_to_columns(batch, "row_data", columns, ["seq"])
        ordered = rows.withColumnRenamed("seq", "_seq")
        table.insert(ordered, [F.col("_seq").asc()], user, clock(), (name, batch_id))

    writer = payloads.writeStream.queryName(name).foreachBatch(apply)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger or _NOW).start()


def ingest_csv(
    spark: SparkSession,
    folder: str,
    types: Types,
    out: str,
    rejects: str,
    name: str,
    checkpoint: str,
    delimiter: str = ",",
    skip_limit: int | None = SKIP_LIMIT,
    **trigger,
) -> StreamingQuery:
    """Load CSV files arriving in ``folder``: typed rows to ``out``, refused ones to
    ``rejects``. Each batch overwrites its own subfolder, so a repeated batch adds nothing.
    Columns are found by each file's own cleaned-up header; a column a file lacks is NULL.
    Records that end inside quotes are refused with their file. More than ``skip_limit``
    refused rows fail the stream, those of earlier batches counted, so it does not matter how
    files are cut into batches.
    """
    lines = text_lines(spark.readStream, folder)

    def apply(batch: DataFrame, batch_id: int) -> None:
        records = join_records(batch, delimiter).persist()
        cells = _by_header(records, list(types), delimiter)
        judged = judge_rows(cells, types).persist()
        try:
            if skip_limit is not None:
                room = max(skip_limit - _refused_before(spark, rejects, batch_id), 0)
                skipped = judged.where(F.col("_reject").isNotNull())
                if skipped.limit(room + 1).count() > room:
                    raise ValueError(f"more than {skip_limit} rows were refused")
            good_rows(judged, types).drop("_file").write.mode("overwrite").parquet(
                f"{out}/batch={batch_id}"
            )
            refused = reject_rows(judged, types, F.col("_file"))
            broken = broken_records(records).select(refused.columns)
            refused.unionByName(broken).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        finally:
            judged.unpersist()
            records.unpersist()

    writer = lines.writeStream.queryName(name).foreachBatch(apply)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger or _NOW).start()


def _refused_before(spark: SparkSession, rejects: str, batch_id: int) -> int:
    """Refused rows of the batches before this one; records with an open quote are not counted."""
    names = [n for n in Folder(spark, rejects).names("") if n.startswith("batch=")]
    earlier = [f"{rejects}/{n}" for n in names if int(n.split("=")[1]) < batch_id]
    if not earlier:
        return 0
    return spark.read.parquet(*earlier).where(F.col("column").isNotNull()).count()


def _by_header(records: DataFrame, names: list[str], delimiter: str) -> DataFrame:
    """The cells of each record under the names its file's header gives them, and ``_file``.

    Files with the same header are parsed together; a batch has few different headers.
    """
    line = F.rtrim(F.col("line"), F.lit("\r"))
    headers = records.where("_header").select(F.col("_file"), line.alias("_names"))
    rows = records.where(~F.col("_header") & F.col("_whole")).join(headers, "_file")
    cells = None
    different = headers.select("_names", split_line(F.col("_names"), delimiter).alias("cells"))
    for header in different.distinct().collect():
        found = normalize_headers(list(header.cells))
        mine = rows.where(F.col("_names") == header["_names"])
        parsed = parse_lines(mine, "line", found, delimiter, keep=["_file"])
        here = {c.lower(): c for c in found}
        parsed = parsed.select(
            "_file",
            *[
                (F.col(here[n.lower()]) if n.lower() in here else F.lit(None).cast("string")).alias(n)
                for n in names
            ],
        )
        cells = parsed if cells is None else cells.union(parsed)
    if cells is None:
        cells = parse_lines(rows, "line", names, delimiter, keep=["_file"])
    return cells


class StreamProgress(StreamingQueryListener):
    """Adds up every batch of a session's named streams, and relates them to their sources.

    Add it with ``spark.streams.addListener`` before a stream starts. ``totals`` gives, by
    stream name, a function that counts the rows of its source as they are now, such as the
    count of a batch read of the same folder; it is called by ``of``, not per batch. A restarted
    stream goes on where its earlier run under the same name and checkpoint stopped.
    """

    def __init__(self, totals: dict[str, Callable[[], int]] | None = None):
        self._totals = totals or {}
        self._state: dict[str, str] = {}
        self._names: dict[str, str] = {}
        self._sums: dict[str, list[int]] = {}

    def onQueryStarted(self, event) -> None:
        if event.name:
            self._names[str(event.runId)] = event.name
            self._state[event.name] = "RUNNING"

    def onQueryProgress(self, event) -> None:
        report = event.progress
        if not report.name:
            return
        # The last batch of a name: reported again while it idles, and once more after a restart
        # when it had not been committed.
        done = self._sums.setdefault(report.name, [-1, 0, 0])
        batch, rows, last = done
        if report.batchId > batch:
            done[:] = [report.batchId, rows + report.numInputRows, report.numInputRows]
        elif report.batchId == batch and report.numInputRows > last:
            done[1:] = [rows + report.numInputRows - last, report.numInputRows]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self._names.pop(str(event.runId), None)
        if name:
            self._state[name] = "FAILED" if event.exception else "COMPLETED"

    def of(self, name: str) -> dict:
        """``status``, last ``batch``, ``rows`` of all batches, and with a known source its
        ``total`` and the ``share`` that is in, at most 1."""
        batch, rows, _ = self._sums.get(name, [-1, 0, 0])
        found = {"status": self._state.get(name), "batch": batch if batch >= 0 else None, "rows": rows}
        if name in self._totals:
            found["total"] = self._totals[name]()
            found["share"] = min(rows / found["total"], 1.0) if found["total"] else 1.0
        return found


def progress(query: StreamingQuery) -> dict:
    """Batch number and input rows of a stream's latest batches; all of them: ``StreamProgress``."""
    reports = query.recentProgress
    return {
        "batch": reports[-1].batchId if reports else None,
        "rows": sum(r.numInputRows for r in reports),
    }
