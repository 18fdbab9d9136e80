"""A searchable copy kept by key in buckets, of which a sync rewrites only those whose rows changed.

Rows lie under ``rows/version=V/bucket=B``, B being a hash of the key; a sync writes the buckets it touches as a new version and then
lists them, with a digest of the table's rows in each, in ``manifest``. A bucket is read in its last listed version, so readers see a sync
as a whole or not at all, a failed one leaves no trace, and files of untouched buckets stay as they are.

A sync reads the table once to digest its buckets (as many rows as there are buckets leave the tasks), and reads and writes rows of the
changed ones only. Rows are never deleted: what the table no longer holds stays in the copy.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodgeframe.sources.workspace import stored

BUCKETS = 64


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/manifest")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            return None
        raise


def _latest(spark: SparkSession, path: str) -> dict[int, tuple[int, str, int]]:
    """bucket -> (version, digest, buckets of the copy); as many rows as there are buckets."""
    listed = _manifest(spark, path)
    if listed is None:
        return {}
    last = listed.groupBy("bucket").agg(F.max_by(F.struct("version", "digest", "buckets"), "version").alias("last"))
    return {r.bucket: (r.last.version, r.last.digest, r.last.buckets) for r in last.collect()}


def _folders(path: str, latest: dict[int, tuple[int, str, int]], buckets) -> list[str]:
    return [f"{path}/rows/version={latest[b][0]}/bucket={b}" for b in sorted(buckets) if b in latest]


def read_copy(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The copy's rows, every bucket in its last version."""
    latest = _latest(spark, path)
    if not latest:
        raise ValueError(f"no copy in {path}")
    return spark.read.schema(schema).parquet(*_folders(path, latest, latest))


def merged_rows(base: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Whole rows of ``updates``, and those of ``base`` with other keys.

    The updates' keys are stored first, so that their size is known: where they are few, by Spark's check, they are broadcast and
    the base is not shuffled.
    """
    return base.join(stored(updates.select(key), "keys"), key, "left_anti").select(*updates.columns).unionByName(updates)


def sync_copy(table: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> list[int]:
    """Bring the copy up to date with ``table``, which holds a key once at most; returns the buckets that were rewritten.

    ``buckets`` counts for a new copy only.
    """
    spark, latest = table.sparkSession, _latest(table.sparkSession, path)
    buckets = next((n for _, _, n in latest.values()), buckets)
    placed = table.withColumn("bucket", _bucket(key, buckets))
    cells = F.xxhash64(*[F.col(f"`{c}`") for c in table.columns], *[F.col(f"`{c}`").isNull() for c in table.columns])
    # Order does not matter to a sum; the count tells repeated rows apart.
    digest = F.concat_ws(":", F.count(F.lit(1)), F.sum(cells.cast("decimal(38,0)")))
    digests = {r.bucket: r.digest for r in placed.groupBy("bucket").agg(digest.alias("digest")).collect()}
    changed = sorted(b for b, d in digests.items() if b not in latest or latest[b][1] != d)
    if not changed:
        return []
    version = max((v for v, _, _ in latest.values()), default=-1) + 1
    updates = placed.where(F.col("bucket").isin(changed)).drop("bucket")
    folders = _folders(path, latest, changed)
    rows = merged_rows(spark.read.schema(table.schema).parquet(*folders), updates, key) if folders else updates
    written = rows.withColumn("bucket", _bucket(key, buckets)).repartition("bucket", F.pmod(F.hash(F.col(f"`{key}`")), F.lit(4)))
    written.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/version={version}")
    listed = [(version, b, digests[b], buckets) for b in changed]
    entries = spark.createDataFrame(listed, "version int, bucket int, digest string, buckets int")
    entries.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return changed
