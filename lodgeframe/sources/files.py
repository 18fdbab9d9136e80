"""CSV uploads and JSON results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeframe.schema import NA_TOKENS, RAW_COLUMNS, TABLE_COLUMNS, all_strings

_TOKENS = ", ".join(f"'{t}'" for t in NA_TOKENS)


def parse_cells(df: DataFrame, columns: dict[str, str] = RAW_COLUMNS, *kept: str) -> DataFrame:
    """Typed columns from text cells, and the columns ``kept``. Null tokens become null; any other cell of the wrong type fails the job."""

    def typed(c: str) -> str:
        return f"CAST({_cell(c, columns[c])} AS {columns[c]}) AS `{c}`"

    return df.selectExpr(*[typed(c) for c in columns if c in df.columns], *kept)


def cell_rejects(df: DataFrame, columns: dict[str, str] = RAW_COLUMNS) -> DataFrame:
    """The rows of text cells that :func:`parse_cells` would fail on, with the offending column names."""
    bad = ", ".join(
        f"IF(try_cast({_cell(c, t)} AS {t}) IS NULL AND {_cell(c, t)} IS NOT NULL, '{c}', NULL)"
        for c, t in columns.items()
        if c in df.columns
    )
    return df.selectExpr("*", f"array_compact(array({bad})) AS bad_columns").where("size(bad_columns) > 0")


def _cell(c: str, kind: str) -> str:
    # Whole numbers may be written with a fraction of zero.
    text = rf"regexp_replace(`{c}`, r'\.0*$', '')" if kind in ("int", "bigint") else f"`{c}`"
    return f"IF(`{c}` IN ({_TOKENS}), NULL, {text})"


#: Name of the text column that holds a row with too few or too many cells, whole.
TORN = "_torn_row"


def read_cells(spark: SparkSession, path: str, columns: list[str], multi_line: bool = True) -> DataFrame:
    """The cells of CSV files as text, and :data:`TORN`. Every file must have this header.

    Quotes inside quoted cells are doubled, and quoted cells may hold line feeds. Tasks share large files where a scan of
    the lines finds that each holds one row; a folder with a row over several lines is read by one task for each file.
    ``multi_line=False`` says that there are none, and spares the scan.
    """
    return csv_reader(spark.read, columns, multi_line and not one_line_rows(spark, path)).csv(path)


#: A line without escaped quotes and closed quoted cells; what is left opens a cell that does not end in the line.
_UNCLOSED = r"""regexp_replace(replace(value, '""', ''), r'(^|,)"[^"]*"[^,]*', '$1') RLIKE r'(^|,)"'"""


def one_line_rows(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether reading CSV files line by line gives the rows that reading them whole does; one scan, shared by tasks.

    It does if no line ends within a quoted cell, none consists of blanks, and a file's lines end in line feeds only or
    all in a carriage return and line feed.
    """
    lines = spark.read.text(path, lineSep="\n").selectExpr(
        "_metadata.file_path AS file",
        rf"""contains(value, '"') AND {_UNCLOSED} OR value RLIKE r'^[\x00-\x20]*[\x00-\x0C\x0E-\x20][\x00-\x20]*$'
            OR instr(value, '\r') BETWEEN 1 AND length(value) - 1 AS whole""",
        r"endswith(value, '\r') AS returned",
    )
    by_file = lines.groupBy("file").agg(F.expr("max(whole) OR max(returned) <> min(returned) AS whole"))
    return not by_file.agg(F.max("whole").alias("whole")).first().whole


def csv_reader(reader, columns: list[str], multi_line: bool = True):
    """A batch or stream reader of CSV cells with the options that :func:`write_clean_csv` writes with."""
    return reader.schema(all_strings([*columns, TORN])).options(
        header=True, escape='"', enforceSchema=False, multiLine=multi_line, columnNameOfCorruptRecord=TORN
    )


def whole_rows(cells: DataFrame) -> DataFrame:
    """``cells`` without :data:`TORN`; any use of it, a count too, fails the job if a row is torn."""
    # Naming a cell as well has the reader parse rows even where nothing else is read of them.
    cell = F.coalesce(F.col(f"`{cells.columns[0]}`"), F.lit(""))
    torn = F.raise_error(F.concat(F.lit("torn row: "), F.col(TORN), F.lit(" from "), cell)).cast("boolean")
    return cells.where(F.when(F.col(TORN).isNotNull(), torn).otherwise(True)).drop(TORN)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV upload (reads one row)."""
    return spark.read.options(header=True, escape='"', multiLine=True).csv(path).columns


def _upload(spark: SparkSession, path: str, multi_line: bool) -> tuple[DataFrame, dict[str, str]]:
    header = csv_header(spark, path)
    missing = [c for c in RAW_COLUMNS if c not in header]
    if missing:
        raise ValueError(f"columns missing from {path}: {', '.join(missing)}")
    known = {c: t for c, t in {"id": "bigint", **RAW_COLUMNS}.items() if c in header}
    return read_cells(spark, path, header, multi_line), known


def read_bookings_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """An uploaded bookings file: 32 columns, with or without a leading ``id``.

    Everything is read as text with a fixed schema, so no inference pass is needed. Columns go by the header,
    in any order; files of one folder must share it, else the job fails, as it does for a torn row or a cell of the wrong type.
    """
    cells, known = _upload(spark, path, multi_line)
    return parse_cells(whole_rows(cells), known)


def quarantine_bookings_csv(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """An upload in two: its good rows as :func:`read_bookings_csv` gives them, and its rejects.

    A reject is a row with too few or too many cells, or with a cell of the wrong type: (file, place, reason, bad_columns,
    row), ``place`` being the row's number in its file from 0, without the header, and ``row`` its text (of a torn one as it
    stands, else its cells as JSON). Every row is in one of the two. For that, columns cannot be pruned.
    """
    cells, known = _upload(spark, path, multi_line)
    return split_rejects(cells.select("*", "_metadata"), known)


def split_rejects(cells: DataFrame, columns: dict[str, str], *kept: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, parsed, with the columns ``kept``, and rejects of ``cells`` with ``_metadata``; see :func:`quarantine_bookings_csv`."""
    bad = ", ".join(f"IF(try_cast({_cell(c, t)} AS {t}) IS NULL AND {_cell(c, t)} IS NOT NULL, '{c}', NULL)" for c, t in columns.items())
    checked = cells.selectExpr("*", f"IF({TORN} IS NULL, array_compact(array({bad})), array()) AS bad_columns")
    fine = f"{TORN} IS NULL AND size(bad_columns) = 0"
    # Rows of a file block lie in one partition, in order; a block's first row is found without sorting.
    placed = checked.selectExpr(
        "*", "_metadata.file_path AS file", "_metadata.file_block_start AS _block", "monotonically_increasing_id() AS _at"
    )
    blocks = placed.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = blocks.selectExpr(
        "file", "_block",
        "_first - coalesce(sum(_n) OVER (PARTITION BY file ORDER BY _block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _origin",
    )
    named = ", ".join(f"`{c}`" for c in columns)
    rejects = placed.where(f"NOT ({fine})").join(before, ["file", "_block"]).selectExpr(
        "file",
        "_at - _origin AS place",
        f"IF({TORN} IS NULL, 'type', 'torn') AS reason",
        "array_join(bad_columns, ',') AS bad_columns",
        f"coalesce({TORN}, to_json(struct({named}))) AS row",
    )
    return parse_cells(checked.where(fine), columns, *kept), rejects


def write_rejects(rejects: DataFrame, table: str) -> None:
    """Append rejects to their table."""
    rejects.write.mode("append").parquet(table)


def read_clean_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A cleaned bookings file, strictly typed: a torn row, or a bad or empty number or date, fails the job.

    An empty country cell is the empty text, not null.
    """
    header = csv_header(spark, path)
    known = {c: t for c, t in TABLE_COLUMNS.items() if c in header}
    cells = whole_rows(read_cells(spark, path, header, multi_line))
    return cells.selectExpr(*[f"CAST(coalesce(`{c}`, '') AS {t}) AS `{c}`" for c, t in known.items()])


#: Options that CSV is written with, so that cells come back as they were, also with blanks and line feeds at their ends.
CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_clean_csv(df: DataFrame, base: str, timestamp: str) -> str:
    """Write cleaned rows as CSV under a timestamped folder name and return it."""
    path = f"{base}/hotel_bookings_clean_{timestamp}"
    df.write.options(emptyValue="", **CSV_OPTIONS).csv(path)
    return path


def latest_upload(spark: SparkSession, folder: str, pattern: str = "*") -> str | None:
    """The newest upload under a folder; file contents are not read.

    An upload is a single file, or a folder of part files written by Spark.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
        .selectExpr("regexp_replace(path, '/part-[^/]*$', '') AS upload", "modificationTime AS at")
    )
    return listed.agg(F.max_by("upload", F.struct("at", "upload")).alias("upload")).first()["upload"]


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest cleaned CSV upload of a folder."""
    path = latest_upload(spark, folder, "*.csv")
    if path is None:
        raise ValueError(f"no CSV file in {folder}")
    return read_clean_csv(spark, path)


def write_hits_json(df: DataFrame, folder: str, timestamp: str) -> str:
    """Write search hits as JSON lines under a timestamped folder name and return it."""
    path = f"{folder}/hits_{timestamp}"
    df.write.json(path)
    return path

