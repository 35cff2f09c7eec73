"""From text rows to typed table rows, with rejects and a load report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from gridloom.functions.cells import (
    TYPE_ORDER,
    normalize_cell,
    parse_cell,
    parse_value,
    reject_reason,
    type_bits,
)
from gridloom.functions.types import parse_type

# Fixed value: refused rows a load may skip before it fails.
SKIP_LIMIT = 100

# Tables of more columns than this have their types inferred over cells as rows.
INFER_WIDE = 40

Types = dict[str, str]


def select_by_index(df: DataFrame, indices: list[int]) -> DataFrame:
    """Columns by position, in the given order; a position outside the table is an error."""
    outside = [i for i in indices if not 0 <= i < len(df.columns)]
    if outside:
        raise IndexError(f"column positions outside the file: {outside}")
    return df.select(*[df.columns[i] for i in indices])


def normalize_cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    chosen = set(df.columns if columns is None else columns)
    return df.select(
        *[normalize_cell(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns]
    )


def parse_typed(df: DataFrame, types: Types) -> DataFrame:
    """Parse the text columns named in ``types``; cells that do not parse become NULL.

    Clean-up is a projection of its own, so each cell is cleaned once.
    """
    clean = normalize_cells(df, list(types))
    return clean.select(
        *[
            parse_value(F.col(c), parse_type(types[c])).alias(c) if c in types else F.col(c)
            for c in df.columns
        ]
    )


def infer_types(
    df: DataFrame, columns: list[str] | None = None, conservative: bool = True
) -> DataFrame:
    """One row ``(position, column, type, value_count)`` per text column, from all rows in
    one pass; ``value_count`` is the number of non-empty cells.

    Each column has one verdict, the bits of the types its cells share and their count, which
    tasks sum up before anything is shuffled; up to INFER_WIDE columns are aggregated side by
    side, row by row. In wider tables cells become rows first, so the plan stays small. A type
    holds when every non-empty cell reads as it. ``conservative`` gives
    TEXT to every column, so that no later row can break it; False gives the narrowest type.
    """
    columns = columns or df.columns
    if len(columns) <= INFER_WIDE:
        summary = _verdicts(df, columns, conservative)
    else:
        summary = _exploded_verdicts(df, columns, conservative)
    verdict = F.when(F.col("value_count") == 0, "TEXT")
    for k, name in enumerate([] if conservative else TYPE_ORDER):
        verdict = verdict.when(F.col("bits").bitwiseAND(1 << k) != 0, name)
    names = F.array(*[F.lit(c) for c in columns])
    return summary.select(
        "position",
        F.get(names, F.col("position")).alias("column"),
        verdict.otherwise("TEXT").alias("type"),
        "value_count",
    )


def _verdicts(df: DataFrame, columns: list[str], conservative: bool) -> DataFrame:
    """``position, bits, value_count`` of each column, from one row of aggregates."""
    clean = df.select(*[normalize_cell(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    if not conservative:
        read = [type_bits(F.col(f"c{i}")).alias(f"b{i}") for i in range(len(columns))]
        clean = clean.select("*", *read)
    sums = []
    for i in range(len(columns)):
        sums.append(F.count(f"c{i}").alias(f"n{i}"))
        if not conservative:
            sums.append(F.bit_and(F.when(F.col(f"c{i}").isNotNull(), F.col(f"b{i}"))).alias(f"s{i}"))
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            (F.lit(0) if conservative else F.col(f"s{i}")).alias("bits"),
            F.col(f"n{i}").alias("value_count"),
        )
        for i in range(len(columns))
    ]
    return clean.agg(*sums).select(F.inline(F.array(*rows)))


def _exploded_verdicts(df: DataFrame, columns: list[str], conservative: bool) -> DataFrame:
    """The same over cells as rows, for plans of many columns."""
    cells = df.select(F.posexplode(F.array(*[F.col(c) for c in columns])).alias("position", "raw"))
    # An entry without a value per column keeps columns of an empty table in the result.
    every = df.sparkSession.createDataFrame(
        [(i, None) for i in range(len(columns))], "position int, raw string"
    )
    text = F.col("text")
    clean = cells.unionByName(every).select("position", normalize_cell(F.col("raw")).alias("text"))
    bits = F.lit(0) if conservative else type_bits(text)
    return clean.groupBy("position").agg(
        F.bit_and(F.when(text.isNotNull(), bits)).alias("bits"),
        F.count(text).alias("value_count"),
    )


def apply_type_overrides(inferred: list[str], overrides: list[str | None] | None) -> list[str]:
    """Replace inferred types by position; blank or missing overrides change nothing."""
    overrides = overrides or []
    padded = [*overrides, *[None] * len(inferred)][: len(inferred)]
    return [(o or "").strip() or t for t, o in zip(inferred, padded)]


def drop_empty_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows without any value in ``columns``."""
    return df.dropna(how="all", subset=columns or df.columns)


def judge_rows(df: DataFrame, types: Types) -> DataFrame:
    """Raw text rows with ``_typed`` (struct of parsed cells), ``_reject`` (struct for the
    first refused cell, NULL when the table takes the row) and ``_empty``.

    Cells are cleaned, then parsed, then judged, each step once.
    """
    clean = df.withColumn(
        "_text", F.struct(*[normalize_cell(F.col(c)).alias(c) for c in types])
    )
    parsed = clean.withColumn(
        "_typed",
        F.struct(
            *[parse_value(F.col("_text")[c], parse_type(t)).alias(c) for c, t in types.items()]
        ),
    )
    rejects, no_value = [], F.lit(True)
    for name, type_name in types.items():
        text, value = F.col("_text")[name], F.col("_typed")[name]
        reason = reject_reason(text, value, type_name)
        cell = F.struct(
            F.lit(name).alias("column"),
            F.col(name).alias("raw_value"),
            F.lit(parse_type(type_name).name).alias("target_type"),
            reason.alias("reason"),
        )
        rejects.append(F.when(reason.isNotNull(), cell))
        no_value = no_value & value.isNull()
    judged = parsed.withColumn("_reject", F.coalesce(*rejects))
    return judged.withColumn("_empty", F.col("_reject").isNull() & no_value).drop("_text")


def _only(condition: Column, row: Column) -> Column:
    """A generator giving ``row`` as columns where ``condition`` holds and nothing else.

    A filter would be pushed below the parsing and bring a second copy of it along.
    """
    return F.inline(F.when(condition, F.array(row)))


def good_rows(judged: DataFrame, types: Types) -> DataFrame:
    """Typed rows the table takes, in the column order of the input."""
    others = [c for c in judged.columns if c not in (*types, "_typed", "_reject", "_empty")]
    accepted = F.col("_reject").isNull() & ~F.col("_empty")
    order = [c for c in judged.columns if c in types or c in others]
    return judged.select(*others, _only(accepted, F.col("_typed"))).select(*order)


def reject_rows(judged: DataFrame, types: Types, source: Column | None = None) -> DataFrame:
    """Refused rows as ``(source, raw, column, raw_value, target_type, reason)``."""
    return judged.select(
        (source if source is not None else F.lit(None).cast("string")).alias("source"),
        F.to_csv(F.struct(*types)).alias("raw"),
        _only(F.col("_reject").isNotNull(), F.col("_reject")),
    )


def refused_cell(types: Types, source: Column) -> Column:
    """The row of ``reject_rows`` for a judged row, as a struct."""
    cell = F.col("_reject")
    parts = [cell[n].alias(n) for n in ("column", "raw_value", "target_type", "reason")]
    return F.struct(source.alias("source"), F.to_csv(F.struct(*types)).alias("raw"), *parts)


def split_rejects(df: DataFrame, types: Types) -> tuple[DataFrame, DataFrame]:
    """(typed rows the table takes, rejects) of raw text rows; both are lazy."""
    judged = judge_rows(df, types)
    return good_rows(judged, types), reject_rows(judged, types)


def check_skip_limit(rejects: DataFrame, limit: int = SKIP_LIMIT) -> None:
    """Raise when more than ``limit`` rows were refused; reads at most one row more."""
    if rejects.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows were refused")


def _counts() -> dict[str, Column]:
    refused, empty = F.col("_reject").isNotNull(), F.col("_empty")
    return {
        "read_count": F.count_if(~empty),
        "write_count": F.count_if(~refused & ~empty),
        "skip_count": F.count_if(refused),
        "empty_count": F.count_if(empty),
    }


def load_report(
    judged: DataFrame, limit: int = SKIP_LIMIT, by: list[str] | None = None
) -> DataFrame:
    """One row of counts, status and the first failure (in text order) of a load.

    ``by`` names columns that tell several loads apart, giving one row for each.
    """
    cell = F.col("_reject")
    line = F.concat_ws(": ", cell["column"], cell["reason"], cell["raw_value"])
    failure = F.min(F.when(cell.isNotNull(), line))
    counts = judged.groupBy(*(by or [])).agg(
        *[c.alias(name) for name, c in _counts().items()], failure.alias("first_failure")
    )
    status = F.when(F.col("skip_count") > limit, "FAILED").otherwise("COMPLETED")
    return counts.select(status.alias("status"), "*")


def failure_lines(judged: DataFrame, limit: int = 20) -> list[str]:
    """Some refused cells as text, for a person to read."""
    cell = F.col("_reject")
    lines = judged.where(cell.isNotNull()).select(
        F.concat_ws(": ", cell["column"], cell["reason"], cell["raw_value"]).alias("line")
    )
    return [r.line for r in lines.limit(limit).collect()]


def load_counts(outcomes: DataFrame) -> dict[str, int]:
    """The counts of a load from rows marked good, refused or empty in ``outcome``."""
    counts = [F.count_if(F.col("outcome") == o) for o in ("good", "refused", "empty")]
    good, refused, empty = outcomes.agg(*counts).first()
    return {
        "read_count": good + refused,
        "write_count": good,
        "skip_count": refused,
        "empty_count": empty,
    }


def report_of(counts: dict, rejects: DataFrame, limit: int, folder: str, shown: int = 20) -> dict:
    """The report of a load whose rejects are stored; more than ``limit`` of them raise."""
    report: dict = {**counts, "rejects": folder if counts["skip_count"] else None, "failures": []}
    if counts["skip_count"]:
        line = F.concat_ws(": ", "column", "reason", "raw_value")
        report["failures"] = [r[0] for r in rejects.select(line).limit(shown).collect()]
    if (more := counts["skip_count"] - len(report["failures"])) > 0:
        report["failures"].append(f"{more} more in {folder}")
    report["status"] = "FAILED" if counts["skip_count"] > limit else "COMPLETED"
    if report["status"] == "FAILED":
        raise ValueError(f"more than {limit} rows were refused: {report}")
    return report


def append_load(
    df: DataFrame, types: Types, path: str, rejects_path: str, limit: int = SKIP_LIMIT
) -> dict:
    """Write good rows to ``path`` and rejects to ``rejects_path``; return the report.

    The counts are observed while the good rows are written, so a clean load reads its
    input once. Both paths should be new: a failed load raises after writing, and the
    caller then does not publish what it wrote. A column ``_file`` of the input is not loaded
    but names the source of the rejects.
    """
    judged = judge_rows(df, types)
    source = F.col("_file") if "_file" in df.columns else None
    seen = Observation()
    observed = judged.observe(seen, *[c.alias(name) for name, c in _counts().items()])
    good_rows(observed, types).drop("_file").write.mode("append").parquet(path)
    report = dict(seen.get)
    if report["skip_count"]:
        reject_rows(judged, types, source).write.mode("append").parquet(rejects_path)
    report["status"] = "FAILED" if report["skip_count"] > limit else "COMPLETED"
    report["failures"] = failure_lines(judged) if report["skip_count"] else []
    if (more := report["skip_count"] - len(report["failures"])) > 0:
        report["failures"].append(f"{more} more in {rejects_path}")
    if report["status"] == "FAILED":
        raise ValueError(f"more than {limit} rows were refused: {report}")
    return report


def payload_to_columns(df: DataFrame, payload: str, columns: Types, keep: list[str]) -> DataFrame:
    """Turn a string map per row into typed columns; missing keys, and values the column does
    not take, give NULL."""
    cells = []
    for name, type_text in columns.items():
        cell, length = parse_cell(F.col(payload)[name], type_text), parse_type(type_text).max_length
        fits = cell if length is None else F.when(F.length(cell) <= length, cell)
        cells.append(fits.alias(name))
    return df.select(*keep, *cells)


def payload_unknown_keys(
    df: DataFrame, payload: str, columns: Types, keep: list[str]
) -> DataFrame:
    """One row per map entry whose key is no column of the table."""
    known = F.array(*[F.lit(c) for c in columns])
    unknown = F.map_filter(F.col(payload), lambda k, _: ~F.array_contains(known, k))
    return df.select(*keep, F.explode(unknown).alias("column", "raw_value"))


def payload_rejects(
    df: DataFrame, payload: str, columns: Types, keep: list[str]
) -> DataFrame:
    """One row per map entry the table refuses: an unknown key, or a value that does not fit.

    Columns: ``keep``, then column, raw_value, target_type (NULL for an unknown key), reason.
    """
    text = F.struct(*[normalize_cell(F.col(payload)[c]).alias(c) for c in columns])
    clean = df.select(*keep, payload, text.alias("_text"))
    cells = []
    for name, type_name in columns.items():
        value = parse_value(F.col("_text")[name], parse_type(type_name))
        reason = reject_reason(F.col("_text")[name], value, type_name)
        cell = F.struct(
            F.lit(name).alias("column"),
            F.col(payload)[name].alias("raw_value"),
            F.lit(parse_type(type_name).name).alias("target_type"),
            reason.alias("reason"),
        )
        cells.append(F.when(reason.isNotNull(), cell))
    refused = clean.select(*keep, F.explode(F.array(*cells)).alias("_cell"))
    refused = refused.where(F.col("_cell").isNotNull()).select(*keep, "_cell.*")
    unknown = payload_unknown_keys(df, payload, columns, keep)
    return refused.unionByName(
        unknown.withColumns({"target_type": F.lit(None).cast("string"), "reason": F.lit("no such column")})
    )
