"""The stored bookings table and its searchable copy, as Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeframe.operators.cleaning import clean
from lodgeframe.operators.upsert import upsert
from lodgeframe.schema import CLEAN_COLUMNS, SUGGEST_FIELDS, TABLE_SCHEMA
from lodgeframe.sources.files import read_bookings_csv, read_clean_csv, write_clean_csv
from lodgeframe.sources.workspace import checkpointed


def read_bookings(spark: SparkSession, path: str) -> DataFrame:
    """The bookings table. The fixed schema spares reading file footers for it."""
    return spark.read.schema(TABLE_SCHEMA).parquet(path)


def read_bookings_jdbc(
    spark: SparkSession, url: str, table: str, partitions: int, lower: int, upper: int, **options
) -> DataFrame:
    """The bookings table of a relational database, read in parallel by id range."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn="id",
            lowerBound=lower,
            upperBound=upper,
            numPartitions=partitions,
            **options,
        )
        .load()
    )


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return read_bookings(spark, path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            return None
        raise


def with_new_ids(df: DataFrame, first: int) -> DataFrame:
    """Number the rows ``first``, ``first + 1``, ... without gaps.

    Rows are counted per partition, the counts are summed up over partitions (a
    table as small as the number of partitions), and every row adds its position.
    The checkpoint keeps partitions the same for both uses.
    """
    rows = checkpointed(df).selectExpr(
        "*", "monotonically_increasing_id() AS _at", "spark_partition_id() AS _part"
    )
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.selectExpr(
        "_part",
        "sum(_n) OVER (ORDER BY _part ROWS UNBOUNDED PRECEDING) - _n AS _offset",
    )
    # The lower 33 bits of a monotonically increasing id count within the partition.
    position = f"{first}L + _offset + (_at & ((1L << 33) - 1)) AS id"
    return rows.join(offsets, "_part").selectExpr(position, *df.columns)


def append_bookings(df: DataFrame, table: str) -> None:
    """Append cleaned rows in one commit, giving each the next free id.

    Appending the same rows twice stores them twice.
    """
    existing = _existing(df.sparkSession, table)
    last = existing.agg(F.max("id")).first()[0] if existing is not None else None
    rows = with_new_ids(df.select(*CLEAN_COLUMNS), (last or 0) + 1)
    rows.select(*TABLE_SCHEMA.names).write.mode("append").parquet(table)


def is_empty(spark: SparkSession, table: str) -> bool:
    existing = _existing(spark, table)
    return existing is None or existing.isEmpty()


def bootstrap_if_empty(spark: SparkSession, table: str, csv: str, index: str | None = None) -> bool:
    """Load a cleaned file if the table holds no row yet; says whether it did."""
    if not is_empty(spark, table):
        return False
    append_bookings(read_clean_csv(spark, csv), table)
    if index is not None:
        append_documents(to_documents(read_bookings(spark, table)), index)
    return True


def run_etl(spark: SparkSession, csv: str, base: str, timestamp: str, table: str) -> DataFrame:
    """Read an upload, clean it, keep a cleaned CSV copy and append it to the table.

    Returns the cleaned rows as stored in the copy.
    """
    cleaned = clean(read_bookings_csv(spark, csv)).select(*CLEAN_COLUMNS)
    copy = write_clean_csv(cleaned, base, timestamp)
    stored = read_clean_csv(spark, copy)
    append_bookings(stored, table)
    return stored


def to_documents(df: DataFrame) -> DataFrame:
    """Table rows with their completion fields."""
    return df.selectExpr(
        "*",
        *[
            f"named_struct('input', array(`{column}`)) AS {name}"
            for name, column in SUGGEST_FIELDS.items()
        ],
    )


def append_documents(df: DataFrame, target: str) -> None:
    """Append documents to the searchable copy."""
    df.write.mode("append").parquet(target)


def sync(spark: SparkSession, source: str, current: str | None, target: str) -> DataFrame:
    """Upsert the whole table into the searchable copy and write it as a new folder.

    ``current`` is the copy before, if any; the folder being read is never
    overwritten. A failed task is retried by Spark and a failed job leaves the
    old copy in place, so no part of the table is skipped.
    """
    table = read_bookings(spark, source)
    synced = table if current is None else upsert(read_bookings(spark, current), table, unique=True)
    synced.write.mode("errorifexists").parquet(target)
    return read_bookings(spark, target)
