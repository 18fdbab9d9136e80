"""A blocked Bloom filter as a small table of bitmaps, built and tested with SQL functions only.

A 64-bit hash picks one block of 32,768 bits and sets CELLS bits of it. The table (_block, _bitmap) has
MOST_BLOCKS rows of 4 KB at most, 16 MB, whatever it is built from: beyond that it only fills up and lets more through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.columns import free_prefix

#: Bits of one block: what bitmap_construct_agg makes.
BLOCK_BITS = 32_768
BITS_A_ROW = 32
MOST_BLOCKS = 4_096
CELLS = 3


def filter_blocks(rows: int) -> int:
    """Blocks for so many rows."""
    return max(1, min(MOST_BLOCKS, -(-rows * BITS_A_ROW // BLOCK_BITS)))


def _block(hashed: Column, blocks: int) -> Column:
    return F.pmod(hashed, F.lit(blocks)).cast("int")


def _cells(hashed: Column) -> Column:
    """The positions, from 0, that a hash sets within its block; distinct."""
    return F.array_distinct(
        F.array(*(F.pmod(F.xxhash64(hashed, F.lit(k)), F.lit(BLOCK_BITS)).cast("int") for k in range(CELLS)))
    )


def _is_set(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), position % 8)) % 2 == 1


def bitmaps(hashes: DataFrame, blocks: int, least: int = 1) -> DataFrame:
    """The bits that ``least`` rows or more of ``hashes`` (one column h) set."""
    cells = hashes.select(_block(F.col("h"), blocks).alias("_block"), F.explode(_cells(F.col("h"))).alias("cell"))
    counted = cells.groupBy("_block", "cell").count().where(F.col("count") >= least)
    return counted.groupBy("_block").agg(F.bitmap_construct_agg(F.col("cell").cast("long")).alias("_bitmap"))


def tested(df: DataFrame, hashed: Column, table: DataFrame, blocks: int) -> tuple[DataFrame, Column]:
    """``df`` with three more columns, whose names it has not, and the condition that all bits of the row are set. Nothing shuffles."""
    prefix = free_prefix(df, "h", "block", "bitmap")
    h, block, bitmap = (prefix + name for name in ("h", "block", "bitmap"))
    marked = df.withColumn(h, hashed).withColumn(block, _block(F.col(h), blocks))
    marked = marked.join(F.broadcast(table.select(F.col("_block").alias(block), F.col("_bitmap").alias(bitmap))), block, "left")
    return marked, F.col(bitmap).isNotNull() & F.forall(_cells(F.col(h)), lambda p: _is_set(F.col(bitmap), p))


def matching(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``keys`` (one column of that name): the filter first, then an exact join."""
    return likely(df, key, keys).join(keys, key, "left_semi")


def split(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: the rows whose ``key`` may be in ``keys`` (one column of that name), and those whose is not."""
    blocks = filter_blocks(keys.select(F.lit(1)).count())
    marked, possible = tested(df, F.xxhash64(key), bitmaps(keys.select(F.xxhash64(key).alias("h")), blocks), blocks)
    own = [f"`{c}`" for c in df.columns]
    return marked.where(possible).select(*own), marked.where(~possible).select(*own)


def likely(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``keys``, and a few others: what the filter lets through."""
    return split(df, key, keys)[0]


def without(df: DataFrame, hashed: Column, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose 64-bit hash is not in ``keys`` (one column h): only rows that the filter lets through shuffle."""
    blocks = filter_blocks(keys.select(F.lit(1)).count())
    marked, possible = tested(df, hashed, bitmaps(keys, blocks), blocks)
    own = [f"`{c}`" for c in df.columns]
    h = next(c for c in marked.columns if c not in df.columns and c.endswith("h"))
    rest = marked.where(possible).join(keys.select(F.col("h").alias(h)), h, "left_anti")
    return marked.where(~possible).select(*own).unionByName(rest.select(*own))
