"""CSV files in and out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from gridloom.functions.names import normalize_headers

def _patterns(delimiter: str, quote: str, escape: str) -> tuple[str, str, str, str, str]:
    """Delimiter, quote, escape, blanks and the inside of a quoted cell as patterns.

    They are possessive throughout, so long cells do not make the regex engine recurse.
    """
    d, q, e = (re.escape(c) for c in (delimiter, quote, escape))
    blank = r"[ \t]" if delimiter != "\t" else " "
    return d, q, e, blank, rf"[^{q}{e}]*+(?:(?:{e}[\s\S]|{q}{q})[^{q}{e}]*+)*+"


def split_line(
    line: Column, delimiter: str = ",", quote: str = '"', escape: str = "\\"
) -> Column:
    """Cells of one CSV record as an array of text.

    Blanks before a cell are ignored. Inside quotes both an escaped and a doubled quote
    stand for a quote.
    """
    d, q, e, blank, inside = _patterns(delimiter, quote, escape)
    quoted = rf"{q}{inside}{q}(?={blank}*(?:{d}|\z))"
    cell = rf"{d}{blank}*+({quoted}|[^{d}]*+)"
    cells = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(cell), F.lit(1))

    def unquote(raw: Column) -> Column:
        body = raw.substr(F.lit(2), F.length(raw) - 2)
        # Most cells hold no escape; a plain replacement serves them faster.
        doubled = F.replace(body, F.lit(quote * 2), F.lit(quote))
        either = F.regexp_replace(body, rf"{e}([{q}{e}])|({q}){q}", "$1$2")
        text = F.when(F.contains(raw, F.lit(escape)), either).otherwise(doubled)
        is_quoted = raw.startswith(quote) & raw.endswith(quote) & (F.length(raw) > 1)
        return F.when(is_quoted, text).otherwise(raw)

    return F.transform(cells, unquote)


def parse_lines(
    lines: DataFrame,
    column: str,
    names: list[str],
    delimiter: str = ",",
    quote: str = '"',
    escape: str = "\\",
    keep: list[str] | None = None,
) -> DataFrame:
    """One text column of CSV records as text columns; short rows are padded with NULL
    and extra cells dropped."""
    keep = keep or []
    record = F.rtrim(F.col(column), F.lit("\r"))
    cells = lines.select(*keep, split_line(record, delimiter, quote, escape).alias("_cells"))
    return cells.select(*keep, *[F.get("_cells", F.lit(i)).alias(c) for i, c in enumerate(names)])


def text_lines(reader, path: str) -> DataFrame:
    """The lines of CSV files, batch or stream, with their file and where its split begins.

    Plain files are read in splits; ``.gz`` and ``.gzip`` files are read whole by one task.
    """
    return (
        reader.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("value").alias("line"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
    )


def _ends_open(line: Column, delimiter: str, quote: str, escape: str) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted cell, if it begins outside and if it begins inside."""
    d, q, e, blank, inside = _patterns(delimiter, quote, escape)
    open_cell = rf"{q}{inside}{e}?+\z"
    cell = rf"{d}{blank}*+({q}{inside}{q}(?={blank}*(?:{d}|\r?\z))|{open_cell}|[^{d}]*+)"

    def opens(cells_text: Column) -> Column:
        cells = F.regexp_extract_all(cells_text, F.lit(cell), F.lit(1))
        return F.coalesce(F.get(cells, F.size(cells) - 1).rlike(rf"\A{open_cell}"), F.lit(False))

    bare = F.regexp_replace(line, rf"{e}[\s\S]|{q}{q}", "")
    close = rf"{q}{blank}*+({d}[\s\S]*+|\r?\z)"
    after = F.when(bare.rlike(close), opens(F.regexp_extract(bare, close, 1))).otherwise(True)
    quoted = F.contains(line, F.lit(quote))
    return (
        F.when(quoted, opens(F.concat(F.lit(delimiter), line))).otherwise(False),
        F.when(quoted, after).otherwise(True),
    )


def _odd(count: Column) -> Column:
    return F.coalesce(count, F.lit(0)) % 2 == 1


def join_records(
    lines: DataFrame, delimiter: str = ",", quote: str = '"', escape: str = "\\"
) -> DataFrame:
    """CSV records from the lines of ``text_lines``, still read in parallel.

    A line ends inside or outside quotes depending on where it begins: it keeps the state,
    sets it, or swaps it. The state before a line is what the last setting line left,
    swapped as often as lines have swapped it since; so it comes from a running count and a
    last value, first over the splits of a file, with one row for each, then over the lines
    of a split. Only splits that some line opens a quote in, or that begin inside one, have
    their lines counted, and only records of several lines are put together.

    Returns line, _file, _header (the first record of its file) and _whole: a record that its
    file ends inside of is not whole. Empty records outside quotes are left out.
    """
    split = ["_file", "_block"]
    from_out, from_in = _ends_open(F.col("line"), delimiter, quote, escape)
    lines = lines.withColumns(
        {"_at": F.monotonically_increasing_id(), "_out": from_out, "_in": from_in}
    )
    filled = F.rtrim(F.col("line"), F.lit("\r")) != ""
    sets, swaps = F.col("_out") == F.col("_in"), F.col("_out") & ~F.col("_in")

    def counted(rows: DataFrame) -> DataFrame:
        """Swaps before each line of a split, and what the last setting line amounts to."""
        earlier = Window.partitionBy(*split).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_swapped", _odd(F.sum(swaps.cast("int")).over(earlier)))
        rows = rows.withColumn("_mark", F.when(sets, F.col("_out") != F.col("_swapped")))
        return rows.withColumn("_set", F.last("_mark", ignorenulls=True).over(earlier))

    sums = lines.groupBy(*split).agg(
        F.count_if("_out").alias("_opening"),
        F.count_if(sets & ~F.col("_out")).alias("_closing"),
        F.min(F.when(filled, F.col("_at"))).alias("_first"),
    )
    opening = lines.join(F.broadcast(sums.where("_opening > 0").select(*split)), split)
    opening = counted(opening).groupBy(*split).agg(
        F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("_at"))).alias("_mark"),
        F.sum(swaps.cast("int")).alias("_swaps"),
    )
    sums = sums.join(opening, split, "left").withColumn(
        "_mark", F.when(F.col("_opening") > 0, F.col("_mark")).when(F.col("_closing") > 0, False)
    )
    in_file = Window.partitionBy("_file").orderBy("_block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    whole_file = in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.withColumn("_swapped", _odd(F.sum("_swaps").over(earlier)))
    marked = F.last(F.col("_mark") != F.col("_swapped"), ignorenulls=True).over(earlier)
    begins = F.coalesce(marked, F.lit(False)) != F.col("_swapped")
    states = sums.select(
        *split,
        (F.col("_opening") > 0).alias("_opening"),
        begins.alias("_begins"),
        F.first("_first", ignorenulls=True).over(whole_file).alias("_first"),
    )
    # One row per split of a file; a split is many megabytes.
    placed = lines.join(F.broadcast(states), split)
    quiet = placed.where(~F.col("_opening") & ~F.col("_begins"))
    mixed = counted(placed.where(F.col("_opening") | F.col("_begins")))
    before = F.coalesce("_set", "_begins") != F.col("_swapped")
    mixed = mixed.withColumn("_inside", before).withColumn(
        "_open", F.when(F.col("_inside"), F.col("_in")).otherwise(F.col("_out"))
    )
    alone = mixed.where(~F.col("_inside") & ~F.col("_open"))
    # The lines of records of several lines; those that open one are numbered per split.
    parts = mixed.where(F.col("_inside") | F.col("_open"))
    upto = Window.partitionBy(*split).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_nth", F.sum((~F.col("_inside")).cast("int")).over(upto))
    # Lines before a split's first opening belong to the last opening of an earlier split.
    owners = parts.groupBy(*split).agg(F.max("_nth").alias("_last"))
    last = F.when(F.col("_last") > 0, F.struct(F.col("_block"), F.col("_last")))
    owners = owners.withColumn("_owner", F.last(last, ignorenulls=True).over(earlier)).drop("_last")
    parts = parts.join(F.broadcast(owners), split)
    own = F.when(F.col("_nth") > 0, F.struct(F.col("_block"), F.col("_nth").alias("_last")))
    place = F.struct("_block", "_at")
    joined = (
        parts.withColumn("_record", F.coalesce(own, F.col("_owner")))
        .groupBy("_file", "_record")
        .agg(
            F.sort_array(F.collect_list(F.struct("_block", "_at", "line"))).alias("_lines"),
            F.max(F.col("_at") == F.col("_first")).alias("_header"),
            (~F.max_by("_open", place)).alias("_whole"),
        )
        .select(F.concat_ws("\n", F.col("_lines.line")).alias("line"), "_file", "_header", "_whole")
    )
    columns = ["line", "_file", "_at", "_first"]
    single = quiet.select(columns).union(alone.select(columns)).where(filled)
    first = (F.col("_at") == F.col("_first")).alias("_header")
    return single.select("line", "_file", first, F.lit(True).alias("_whole")).union(joined)


def read_records(
    spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', escape: str = "\\"
) -> DataFrame:
    """The records of CSV files; see ``join_records``."""
    return join_records(text_lines(spark.read, path), delimiter, quote, escape)


def broken_records(records: DataFrame) -> DataFrame:
    """Records that end inside quotes, in the form of rejects."""
    return records.where(~F.col("_whole")).select(
        F.col("_file").alias("source"),
        F.col("line").alias("raw"),
        F.lit(None).cast("string").alias("column"),
        F.lit(None).cast("string").alias("raw_value"),
        F.lit(None).cast("string").alias("target_type"),
        F.lit("a quote is not closed").alias("reason"),
    )


def header_cells(records: DataFrame, delimiter: str, quote: str, escape: str) -> list[str]:
    """The cells of the header of the first file, as written."""
    headers = records.where("_header").orderBy("_file").limit(1)
    record = F.rtrim(F.col("line"), F.lit("\r"))
    rows = headers.select(split_line(record, delimiter, quote, escape)).collect()
    if not rows:
        raise ValueError("no header line to read")
    return list(rows[0][0])


def first_file_records(
    spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', escape: str = "\\"
) -> DataFrame:
    """The records of the first file that has any; quotes of the others are not looked at."""
    lines = text_lines(spark.read, path)
    filled = lines.where(F.rtrim(F.col("line"), F.lit("\r")) != "")
    first = filled.agg(F.min("_file")).first()[0]
    return join_records(lines.where(F.col("_file") == F.lit(first)), delimiter, quote, escape)


def read_header(
    spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', escape: str = "\\"
) -> list[str]:
    """The cells of the header line, as written."""
    records = first_file_records(spark, path, delimiter, quote, escape)
    return header_cells(records, delimiter, quote, escape)


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    quote: str = '"',
    escape: str = "\\",
    columns: list[int] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Scan CSV files into text columns named by the cleaned-up header.

    ``columns`` picks cells by position. Escaped and doubled quotes and line breaks inside
    quotes may be mixed in one file, which is still read in parallel. A record whose quote is
    not closed before its file ends is no row; ``broken_records`` lists such. ``keep`` may
    name ``_file`` to have each row's file as a column.
    """
    records = read_records(spark, path, delimiter, quote, escape)
    raw = read_header(spark, path, delimiter, quote, escape)
    positions = list(range(len(raw))) if columns is None else columns
    outside = [i for i in positions if not 0 <= i < len(raw)]
    if outside:
        raise IndexError(f"column positions outside the file: {outside}")
    names = normalize_headers([raw[i] for i in positions])
    cells = [f"c{i}" for i in range(len(raw))]
    rows = records.where(~F.col("_header") & F.col("_whole"))
    every = parse_lines(rows, "line", cells, delimiter, quote, escape, keep)
    return every.select(*(keep or []), *[F.col(f"c{i}").alias(n) for i, n in zip(positions, names)])


def export_text(df: DataFrame) -> DataFrame:
    """Columns as the text a database copy writes: t/f, and a blank between date and time."""
    columns = []
    for f in df.schema.fields:
        column = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            column = F.when(column, "t").when(~column, "f")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            column = column.cast("string")
        columns.append(column.alias(f.name))
    return df.select(*columns)


_EXPORT = {
    "quote": '"',
    "escape": '"',
    "emptyValue": '""',
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_csv(df: DataFrame, path: str) -> None:
    """Export a whole table: one file per task, each with a header line."""
    writer = export_text(df).write.option("header", True)
    for key, value in _EXPORT.items():
        writer = writer.option(key, value)
    writer.csv(path)


def csv_lines(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The export as rows of text, one ``line`` per row."""
    text = export_text(df)
    options = {"sep": ",", **_EXPORT}
    return text.select(*(keep or []), F.to_csv(F.struct(*text.columns), options).alias("line"))
