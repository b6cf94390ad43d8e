"""CSV uploads read by column name, with a channel for malformed lines.

Every file has its own header: columns may stand in any order, be missing, or be
more than asked for. The lines of all files are landed once as a Parquet table
(file, block, seq, text); headers, line numbers, cells and the quarantine all
come from that table, so the raw files are read once and a lost executor changes
nothing. A header is a row of a small table joined by file, not a branch of the
plan: any number of layouts makes one plan, with one CSV schema for each
header *width*.

Records are single lines. A line whose number of cells differs from its header's
(too few, too many, or a quote left open) is malformed: it gives no row and is
kept in the quarantine with its file and line number. Blank lines are skipped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandlake.session import work_dir

LANDED = "file string, block bigint, seq bigint, text string"
_CORRUPT = "_corrupt_record"
#: a comma that is followed by whole quoted parts only
_HEADER_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


@dataclass
class Uploads:
    """``rows``: file, line and the asked columns as text, well-formed lines only;
    ``quarantine``: file, line, text, n_expected (cells of the file's header);
    ``files``: one row per file with its columns and counts."""

    rows: DataFrame
    quarantine: DataFrame
    files: DataFrame


def land_lines(spark: SparkSession, paths: str | Sequence[str], folder: str | None = None) -> DataFrame:
    """Writes the lines of the files to ``folder`` (new) and reads them back. ``seq``
    grows along a block of a file; ``block`` is where the block starts."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    folder = folder or work_dir(spark, "landed")
    lines = spark.read.option("recursiveFileLookup", False).text(paths)
    lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("seq"), F.col("value").alias("text")).write.parquet(folder)
    return spark.read.schema(LANDED).parquet(folder)


def header_names(text: Column) -> Column:
    """Column names of a header line: cells without quotes, blanks and byte order mark."""
    return F.transform(F.split(F.regexp_replace(text, "^﻿", ""), _HEADER_COMMA),
                       lambda c: F.trim(F.regexp_replace(F.trim(c), '^"|"$', "")))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A small table written and read back, so the planner knows its size and later uses do not derive it again."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_index(landed: DataFrame) -> DataFrame:
    """(file, block, first_seq, before, names): one row per block of a file, with the
    lines before it and the names of the file's header. Rows number the blocks, not the lines."""
    blocks = _stored(landed.groupBy("file", "block").agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n")), "blocks")
    first = blocks.where("block = 0").select("file", "block", F.col("first_seq").alias("seq"))
    heads = landed.join(first, ["file", "block", "seq"]).select("file", header_names(F.col("text")).alias("names"))
    by = Window.partitionBy("file").orderBy("block")
    before = blocks.select("file", "block", "first_seq", (F.sum("n").over(by) - F.col("n")).alias("before"))
    return before.join(heads, "file").select("file", "block", "first_seq", "before", "names")


def _split(text: Column, width: int) -> Column:
    """The cells c0, c1, ... of a line by a header of ``width`` columns, and the line if it is malformed."""
    schema = ", ".join(f"c{i} string" for i in range(width)) + f", {_CORRUPT} string"
    return F.from_csv(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})


def parse_lines(landed: DataFrame, columns: Sequence[str], index: DataFrame | None = None) -> DataFrame:
    """(file, line, text, n_expected, malformed, ``columns`` as text) of every line that is no
    header and not blank. Of equal names in a header the first counts; a column that a
    file lacks is null. ``index`` is the ``block_index`` if it is there already."""
    index = block_index(landed) if index is None else index
    widths = [r[0] for r in index.select(F.size("names")).distinct().orderBy(F.size("names")).collect()]
    # where each asked column stands in a header: found once a block, not once a line
    places = index.select("file", "block", "before", "first_seq", F.size("names").cast("int").alias("n_expected"), F.array(
        *[(F.array_position("names", F.lit(c)) - 1).cast("int") for c in columns]).alias("at"))
    rows = landed.join(places, ["file", "block"]).select(
        "file", (F.col("before") + F.col("seq") - F.col("first_seq") + 1).alias("line"), "text", "n_expected", "at")
    rows = rows.where((F.col("line") > 1) & (F.length(F.trim("text")) > 0))
    # each line is split once, in a projection of its own; the cells are picked from the result
    rows = rows.withColumns({f"_w{w}": F.when(F.col("n_expected") == w, _split(F.col("text"), w)) for w in widths})
    cells = F.lit(None).cast("array<string>")
    for w in widths:
        mine = F.col("n_expected") == w
        cells = F.when(mine, F.array(*[F.col(f"_w{w}.c{i}") for i in range(w)])).otherwise(cells)
    broken = F.coalesce(*[F.col(f"_w{w}.{_CORRUPT}") for w in widths], F.lit(None).cast("string"))
    rows = rows.select("file", "line", "text", "n_expected", "at", cells.alias("cells"), broken.isNotNull().alias("malformed"))
    asked = [F.get("cells", F.get("at", F.lit(i))).alias(name) for i, name in enumerate(columns)]
    return rows.select("file", "line", "text", "n_expected", "malformed", *asked)


def file_report(landed: DataFrame, parsed: DataFrame, columns: Sequence[str], index: DataFrame | None = None) -> DataFrame:
    """(file, n_rows, n_malformed, missing, unknown): per file its line counts and, sorted and
    comma-joined, the asked columns it lacks and those it has beyond them. A file of a
    header only has no lines; one without a line is not listed."""
    heads = (block_index(landed) if index is None else index).where("block = 0").select("file", "names")
    counts = parsed.groupBy("file").agg(F.count_if(~F.col("malformed")).alias("n_rows"),
                                        F.count_if("malformed").alias("n_malformed"))
    asked = F.array(*[F.lit(c) for c in columns])
    none = F.lit(0).cast("bigint")
    return heads.join(counts, "file", "left").select(
        "file", F.coalesce("n_rows", none).alias("n_rows"), F.coalesce("n_malformed", none).alias("n_malformed"),
        F.array_join(F.array_sort(F.array_except(asked, "names")), ",").alias("missing"),
        F.array_join(F.array_sort(F.array_except("names", asked)), ",").alias("unknown"))


def read_uploads(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str],
                 folder: str | None = None) -> Uploads:
    """Reads CSV files by their own headers (see the module's text for what is malformed).

    The parsed lines are written once beside the landed ones, so rows, quarantine and
    counts do not parse again."""
    landed = land_lines(spark, paths, folder)
    index = _stored(block_index(landed), "index")
    path = work_dir(spark, "parsed")
    parsed = parse_lines(landed, columns, index)
    parsed.write.partitionBy("malformed").parquet(path)
    parsed = spark.read.schema(parsed.schema).parquet(path)
    rows = parsed.where(~F.col("malformed")).select("file", "line", *columns)
    quarantine = parsed.where("malformed").select("file", "line", "text", "n_expected")
    return Uploads(rows, quarantine, file_report(landed, parsed, columns, index))
