"""Reports kept up to date by changes: stored partial sums, to which every change of rows adds its difference.

A batch of changed rows is applied as retract-and-add: what the rows were counts -1, what they are now +1, grouped as
``reports.base_sums`` does. Batches are only ever added, each in a folder of its own that a repeated batch overwrites with the same, so an
update costs what changed and reports never read the table again. Sums of integers are exact; sums of prices may differ from a full
recomputation in their last digits. ``compact`` adds all batches up to one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeframe.plans.reports import BASE_KEYS, SUMS, base_sums, reports_from_sums

_KEYS = ["base", *BASE_KEYS]


def _totals(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*_KEYS).agg(*[F.sum(c).alias(c) for c in ("doc_count", *SUMS)])


def start(df: DataFrame, path: str) -> None:
    """Sums of the whole table, as batch 0."""
    base_sums(df).write.mode("overwrite").parquet(f"{path}/batch=0")


def apply(before: DataFrame, after: DataFrame, path: str, batch: int) -> None:
    """Replace the rows ``before``, as they were, by ``after``; either may hold rows that the other lacks."""
    # A group whose number of rows stays may still have other sums, so nothing is left out here.
    both = base_sums(before, -1).unionByName(base_sums(after))
    _totals(both).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def changed_rows(current: DataFrame, updates: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(before, after) of an upsert of whole rows: the current rows that the updates replace, and the updates."""
    return current.join(updates.select(key), key, "left_semi"), updates


def sums(spark: SparkSession, path: str) -> DataFrame:
    """The sums of all batches; groups that no row is left in are gone."""
    return _totals(spark.read.parquet(path)).where("doc_count <> 0")


def reports(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All reports as they are now."""
    return reports_from_sums(sums(spark, path))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the sums as they are now as batch 0 of a new folder."""
    sums(spark, path).write.mode("errorifexists").parquet(f"{target}/batch=0")
