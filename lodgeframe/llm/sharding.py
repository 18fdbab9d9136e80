"""Shards of near equal size by longest-processing-time scheduling.

Rows of one group (by default: equal texts) stay together. Groups, sorted by size, go to the
least-loaded shard through a heap. There may be as many groups as rows, so only groups of at
least 4 / (shards * GRAIN) of all bytes are scheduled alone; there are shards * GRAIN / 4 of them at
most. The others are dealt by hash into shards * GRAIN bundles of whole groups, and bundles are
scheduled as groups are. What the driver schedules is bounded by 2 * shards * GRAIN items, however many
rows there are, and rows never shuffle for it: the answer is broadcast.

Cases: a null text has no bytes and is grouped with empty ones, since both hash alike; an
empty table gives an empty result; repeated rows are separate rows of one group. A group larger than
a shard's share makes that shard larger, as it must stay together. Further columns are kept.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Items for each shard of either kind, at most.
GRAIN = 500
#: Rows that are numbered in one task, about.
SLOT_ROWS = 100_000


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + 8


def schedule(items: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Longest processing time first: every (size, item) to the shard with the least so far."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heap[0]
        placed[item] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return placed


def assign(df: DataFrame, shards: int, group: Column, size: Column, grain: int = GRAIN) -> DataFrame:
    """``df`` with _size and _shard; rows of equal ``group`` get the same shard."""
    if clash := {"_size", "_group", "_shard", "_own", "_bundled"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are used by this operator")
    rows = df.withColumn("_size", size).withColumn("_group", F.sha2(group, 256))
    bundles = shards * grain
    bundle = F.pmod(F.xxhash64("_group"), F.lit(bundles)).cast("int")
    # Bundles first: at most `bundles` rows. A group that is large enough to stand alone makes its bundle large.
    sums = rows.groupBy(bundle.alias("b")).agg(F.sum("_size").alias("bytes")).collect()
    total = sum(r.bytes for r in sums)
    least = max(1, -(-4 * total // bundles))
    spark = df.sparkSession
    crowded = spark.createDataFrame([(r.b,) for r in sums if r.bytes >= least], "b int")
    alone = (
        rows.select("_group", "_size", bundle.alias("b"))
        .join(F.broadcast(crowded), "b", "left_semi")
        .groupBy("b", "_group")
        .agg(F.sum("_size").alias("bytes"))
        .where(F.col("bytes") >= least)
        .collect()
    )
    rest = {r.b: r.bytes for r in sums}
    for r in alone:
        rest[r.b] -= r.bytes
    items = [(r.bytes, (r.b, r._group)) for r in alone] + [(n, (b, "")) for b, n in rest.items() if n]
    placed = schedule(items, shards)
    own = spark.createDataFrame([(g, s) for (_, g), s in placed.items() if g], "_group string, _own int")
    bundled = spark.createDataFrame([(b, s) for (b, g), s in placed.items() if not g], "_b int, _bundled int")
    return (
        rows.withColumn("_b", bundle)
        .join(F.broadcast(own), "_group", "left")
        .join(F.broadcast(bundled), "_b", "left")
        .withColumn("_shard", F.coalesce("_own", "_bundled"))
        .drop("_own", "_bundled", "_b", "_group")
    )


def with_slots(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """``df`` with _slot: gapless from 0 in each _shard; equal rows of ``order`` in any order among themselves.

    Each shard is cut by a hash of the ``order`` columns into parts of about SLOT_ROWS rows; a part's first slot
    is the sum of the parts before it, and rows are numbered within parts. So no task gets a whole shard.
    """
    parts = max(1, -(-rows // SLOT_ROWS))
    placed = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = placed.groupBy("_shard", "_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_shard", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    numbered = placed.withColumn("_row", F.row_number().over(Window.partitionBy("_shard", "_part").orderBy(*order)))
    return (
        numbered.join(firsts, ["_shard", "_part"])
        .withColumn("_slot", F.col("_first") + F.col("_row") - 1)
        .drop("_part", "_first", "_row")
    )


def shard(df: DataFrame, shards: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with _size, _shard and _slot: equal texts together, sizes near equal."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    assigned = assign(df, shards, whole, text_size(text))
    crc = F.crc32(whole.cast("binary"))
    return with_slots(assigned.withColumn("_crc32", crc), [key, "_crc32", "_size"], df.select(F.lit(1)).count())


def write_shards(df: DataFrame, path: str, shards: int, text: str = "text", key: str = "doc_id") -> None:
    """The rows as Parquet files, one folder for each shard."""
    sharded = assign(df, shards, F.coalesce(F.col(f"`{text}`"), F.lit("")), text_size(text))
    sharded.drop("_size").write.partitionBy("_shard").parquet(path)
