"""Keyed partial update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order_by: str | None = None) -> DataFrame:
    """One row per key: the one with the highest ``order_by`` (then the highest row).

    An aggregation rather than a window, so versions of a hot key are reduced
    before the shuffle; what moves holds every column once.
    """
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.distinct()
    ranked = [order_by, *(c for c in rest if c != order_by)] if order_by and order_by != key else rest
    best = df.groupBy(key).agg(F.max(F.struct(*ranked)).alias("_row"))
    return best.select(*[c if c == key else F.col("_row")[c].alias(c) for c in df.columns])


def upsert(
    base: DataFrame, updates: DataFrame, key: str = "id", order_by: str | None = None, unique: bool = False
) -> DataFrame:
    """Base rows with the fields of matching updates, plus the updates without a base row.

    Fields present in ``updates`` overwrite, nulls included; fields absent from it
    are kept. Several updates of one key collapse to the last one by ``order_by``.
    With ``unique`` the updates hold a key once at most, which spares the collapsing.
    Rows are never deleted. One shuffle per side: collapsing and joining share
    the key's partitioning.
    """
    sent = updates if unique else latest(updates, key, order_by)
    new = sent.withColumn("_sent", F.lit(True)).alias("u")
    joined = base.alias("b").join(new, key, "full_outer")
    present = F.col("u._sent").isNotNull()
    columns = []
    for c in base.columns:
        if c == key:
            columns.append(F.col(key))
        elif c in sent.columns:
            value = F.when(present, F.col(f"u.{c}").cast(base.schema[c].dataType))
            columns.append(value.otherwise(F.col(f"b.{c}")).alias(c))
        else:
            columns.append(F.col(f"b.{c}").alias(c))
    added = [F.col(f"u.{c}").alias(c) for c in sent.columns if c not in base.columns]
    return joined.select(*columns, *added)
