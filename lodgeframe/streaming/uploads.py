"""Recurring uploads: watch a folder of CSV files and keep a keyed bookings table."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodgeframe.operators.cleaning import clean
from lodgeframe.operators.upsert import latest
from lodgeframe.schema import RAW_COLUMNS, TABLE_COLUMNS, TABLE_SCHEMA
from lodgeframe.sources.files import parse_cells, read_cells, split_rejects, whole_rows, write_rejects
from lodgeframe.sources.table import with_new_ids
from lodgeframe.sources.workspace import stored_meanwhile, tidy_session


#: What orders two versions of a booking: when its file was written, the file's name, and the row's place in it.
VERSION = "_version"
_VERSION_OF = """struct(_metadata.file_modification_time AS at, _metadata.file_path AS file,
    _metadata.file_block_start AS block, monotonically_increasing_id() AS place)"""


def start_upload_sync(
    spark: SparkSession,
    folder: str,
    table: str,
    checkpoint: str,
    every: str | None = "1 hour",
    files_per_batch: int | None = 1,
    with_ids: bool = True,
    rejects: str | None = None,
    newest_first: bool = False,
) -> StreamingQuery:
    """Clean every uploaded file and store its rows as a new version.

    Files hold ``id`` and the 32 columns; with ``with_ids=False`` just these, and rows get the next free ids. Their headers
    must have the columns in this order. A torn row, one without an id, or a cell of the wrong type fails the batch; with
    ``rejects``, a table, torn rows and those with bad cells go there (once or, if a batch is repeated, again) and the
    others on. Of several rows of one id the one from the file written last counts (then by the file's name, then the
    row's place in it), whichever batch it came in: an old file that comes late wins nothing.

    Cleaning statistics are those of one micro-batch, by default one file; with
    ``files_per_batch=None`` all new files (say, the parts of one upload). A batch
    writes its own ``batch_id`` folder and overwrites only that, so a repeated
    batch changes nothing. Uploads cost their own size: the table is not rewritten.
    ``every=None`` handles the files present and stops. ``newest_first`` stores the newest of several waiting files first.
    """
    columns = {"id": "bigint", **RAW_COLUMNS} if with_ids else dict(RAW_COLUMNS)
    # Only the files' names are streamed; a batch finds out how tasks may share its files, and reads them.
    reader = spark.readStream.format("binaryFile").schema(_FILE).option("latestFirst", newest_first)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    uploads = reader.load(folder).select("path")
    # Numbering rows checkpoints them, which runs their query again.
    own = tidy_session(spark) if with_ids else spark

    def store(batch: DataFrame, batch_id: int) -> None:
        cells = read_cells(own, [_literal(file.path) for file in batch.collect()], list(columns))
        # Rows of a file block stand in one partition in their order, so the growing number orders them.
        batch = cells.selectExpr("*", "_metadata", f"{_VERSION_OF} AS {VERSION}")
        if rejects is None:
            good = parse_cells(whole_rows(batch), columns, VERSION)
        else:
            good, bad = split_rejects(batch, columns, VERSION)
            write_rejects(bad, rejects)
        # Stored, so that cleaning, which scans its input more than once, parses no cell again.
        with stored_meanwhile(good, "batch") as parsed:
            cleaned = clean(parsed)
            if with_ids:
                given = "coalesce(id, raise_error('a booking has no id')) AS id"
                rows = latest(cleaned.selectExpr(given, *[f"`{c}`" for c in cleaned.columns if c != "id"]), "id", VERSION)
            else:
                rows = with_new_ids(cleaned, _last_id(spark, table, batch_id) + 1)
            rows.select(*TABLE_COLUMNS, VERSION).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return (
        uploads.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


_FILE = "path string, modificationTime timestamp, length long, content binary"


def _literal(path: str) -> str:
    """A pattern that matches just this path."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


_VERSION_FIELD = T.StructField(
    VERSION,
    T.StructType(
        [
            T.StructField("at", T.TimestampType()),
            T.StructField("file", T.StringType()),
            T.StructField("block", T.LongType()),
            T.StructField("place", T.LongType()),
        ]
    ),
)


def _versions(spark: SparkSession, table: str) -> DataFrame:
    """All stored rows. Those stored without a version count as uploaded when they were stored."""
    rows = spark.read.option("basePath", table).schema(
        T.StructType([*TABLE_SCHEMA.fields, _VERSION_FIELD, T.StructField("batch_id", T.LongType())])
    ).parquet(table)
    stored = F.expr("struct(_metadata.file_modification_time AS at, '' AS file, 0L AS block, 0L AS place)")
    return rows.withColumn(VERSION, F.coalesce(VERSION, stored))


def _last_id(spark: SparkSession, table: str, batch_id: int) -> int:
    """The greatest id that batches before this one have stored, so that a repeated batch gives the same ids."""
    try:
        earlier = _versions(spark, table).where(F.col("batch_id") < batch_id)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            return 0
        raise
    return earlier.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first().n


def read_synced(spark: SparkSession, table: str) -> DataFrame:
    """The current table: of every booking the version of the file written last, in whichever batch it came."""
    return _current(spark, table).select(*TABLE_COLUMNS)


def _current(spark: SparkSession, table: str) -> DataFrame:
    return latest(_versions(spark, table), "id", VERSION)


def compact(spark: SparkSession, table: str, target: str) -> DataFrame:
    """Write the current table as plain Parquet, one row per booking, and read it.

    The rows lie in a folder ``batch_id=-1`` of ``target`` with their versions, so a sync may go on there with new batches.
    """
    _current(spark, table).select(*TABLE_COLUMNS, VERSION).write.mode("errorifexists").parquet(f"{target}/batch_id=-1")
    return read_synced(spark, target)
