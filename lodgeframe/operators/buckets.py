"""Bucket aggregations: top terms, nested terms, month and number histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SIZE = 10

Aggs = Mapping[str, str]


def count_by(df: DataFrame, keys: Mapping[str, str], aggs: Aggs | None = None) -> DataFrame:
    """Group by named SQL key expressions: keys, doc_count and the named metrics.

    This is the only step of a bucket aggregation that touches the table. It is
    combined before the shuffle, so a hot key costs one row per task.
    """
    derived = {name: F.expr(sql) for name, sql in keys.items() if name != sql}
    rows = df.withColumns(derived) if derived else df
    metrics = [F.expr(sql).alias(name) for name, sql in (aggs or {}).items()]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("doc_count"), *metrics)


def top(counted: DataFrame, key: str, size: int = DEFAULT_SIZE, order: str = "count") -> DataFrame:
    """Of a grouped table, the best-counted keys (ties by key), or the lowest keys."""
    orderings = {"count": [F.desc("doc_count"), F.asc(key)], "key": [F.asc(key)]}
    if order not in orderings:
        raise ValueError(f"unknown order: {order}")
    return counted.where(F.col(key).isNotNull()).orderBy(*orderings[order]).limit(size)


def top_within(df: DataFrame, outer: Sequence[str], inner: str, size: int = DEFAULT_SIZE) -> DataFrame:
    """Of a grouped table, the best-counted ``inner`` keys of every ``outer`` group.

    The rank filter also runs before the shuffle, so an outer key with very many
    inner keys is cut down early.
    """
    by = ", ".join(f"`{c}`" for c in outer)
    rank = f"row_number() OVER (PARTITION BY {by} ORDER BY doc_count DESC, `{inner}`) AS _rank"
    ranked = df.where(F.col(inner).isNotNull()).selectExpr("*", rank)
    return ranked.where(F.col("_rank") <= size).drop("_rank")


def _top_of(
    pairs: DataFrame, outer: str, inner: str, outer_size: int, inner_size: int | None, outer_count: str
) -> DataFrame:
    """The top outer keys as (outer, outer_count, _inner): their kept pairs as a list of structs.

    The grouped table is used once, so the table below it is read once: outer totals are a window over the pairs.
    """
    over = Window.partitionBy(outer)
    rest = [c for c in pairs.columns if c != outer]
    counted = pairs.where(F.col(outer).isNotNull()).withColumn("_total", F.sum("doc_count").over(over))
    pair = F.when(F.col(inner).isNotNull(), F.struct(*rest))
    if inner_size is not None:
        ranked = over.orderBy(F.col(inner).isNull(), F.desc("doc_count"), F.asc(inner))
        counted = counted.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= inner_size)
    return (
        counted.groupBy(outer)
        .agg(F.max("_total").alias(outer_count), F.collect_list(pair).alias("_inner"))
        .orderBy(F.desc(outer_count), F.asc(outer))
        .limit(outer_size)
    )


def nested_top(
    pairs: DataFrame,
    outer: str,
    inner: str,
    outer_size: int = DEFAULT_SIZE,
    inner_size: int = DEFAULT_SIZE,
    outer_count: str | None = None,
) -> DataFrame:
    """Of a table grouped by two keys: the top outer keys and their top inner keys.

    An outer key whose rows all lack an inner key is kept with a null inner key.
    """
    outer_count = outer_count or f"{outer}_doc_count"
    best = _top_of(pairs, outer, inner, outer_size, inner_size, outer_count)
    rest = [c for c in pairs.columns if c not in (outer, inner)]
    rows = best.select(outer, outer_count, F.explode_outer("_inner").alias("_pair"))
    return rows.select(outer, outer_count, *[F.col("_pair")[c].alias(c) for c in (inner, *rest)])


def _months_from(rows: DataFrame, name: str) -> DataFrame:
    """Rows of one month each, given ``_months``: the month itself and the empty ones up to the next row.

    One row per calendar month at most, so a window over all of them is small.
    """
    next_month = F.lead(name).over(Window.orderBy(name))
    upto = F.add_months(F.coalesce(next_month, F.add_months(F.col(name), 1)), -1)
    return rows.withColumn("_months", F.sequence(F.col(name), upto, F.expr("interval 1 month")))


def fill_months(counted: DataFrame, name: str = "month", count: str = "doc_count") -> DataFrame:
    """Of a table grouped by month: add the empty months in between with count 0."""
    rest = [c for c in counted.columns if c != name]
    filled = _months_from(counted.where(F.col(name).isNotNull()), name)
    filled = filled.select(F.col(name).alias("_own"), *rest, F.explode("_months").alias(name))
    own = F.col("_own") == F.col(name)
    return filled.select(
        name, *[F.when(own, F.col(c)).otherwise(F.lit(0) if c == count else None).alias(c) for c in rest]
    )


def months_then_top(pairs: DataFrame, inner: str, inner_size: int = DEFAULT_SIZE) -> DataFrame:
    """Of a table grouped by month and key: gap-filled months and their top keys."""
    over = Window.partitionBy("month")
    rest = [c for c in pairs.columns if c not in ("month", inner)]
    ranked = over.orderBy(F.col(inner).isNull(), F.desc("doc_count"), F.asc(inner))
    months = (
        pairs.where("month IS NOT NULL")
        .withColumn("_total", F.sum("doc_count").over(over))
        .withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= inner_size)
        .groupBy("month")
        .agg(
            F.max("_total").alias("month_doc_count"),
            F.collect_list(F.when(F.col(inner).isNotNull(), F.struct(inner, *rest))).alias("_inner"),
        )
    )
    rows = fill_months(months, count="month_doc_count").select(
        "month", "month_doc_count", F.explode_outer("_inner").alias("_pair")
    )
    return rows.select("month", "month_doc_count", *[F.col("_pair")[c].alias(c) for c in (inner, *rest)])


def top_then_months(
    pairs: DataFrame, outer: str, outer_size: int = DEFAULT_SIZE, outer_count: str | None = None
) -> DataFrame:
    """Of a table grouped by key and month: the top keys and their non-empty months."""
    outer_count = outer_count or f"{outer}_doc_count"
    best = _top_of(pairs, outer, "month", outer_size, None, outer_count)
    rest = [c for c in pairs.columns if c not in (outer, "month")]
    rows = best.select(outer, outer_count, F.explode("_inner").alias("_pair"))
    return rows.select(outer, outer_count, *[F.col("_pair")[c].alias(c) for c in ("month", *rest)])


def terms(
    df: DataFrame,
    key: str,
    size: int = DEFAULT_SIZE,
    aggs: Aggs | None = None,
    order: str = "count",
    name: str | None = None,
) -> DataFrame:
    """The ``size`` most frequent keys with their row counts and metrics.

    ``key`` is a column or any SQL expression; rows without a key are not counted.
    ``order="key"`` returns the lowest keys instead.
    """
    name = name or key
    return top(count_by(df, {name: key}, aggs), name, size, order)


def terms_total(df: DataFrame, key: str, size: int = DEFAULT_SIZE) -> DataFrame:
    """One row: rows with a key, rows in the returned keys, rows in all other keys."""
    counted = count_by(df, {"_key": key}).where("_key IS NOT NULL")
    returned = top(counted, "_key", size).selectExpr("coalesce(sum(doc_count), 0L)").scalar()
    total = counted.selectExpr("coalesce(sum(doc_count), 0L) AS total_doc_count")
    return total.withColumn("returned_doc_count", returned).selectExpr(
        "*", "total_doc_count - returned_doc_count AS sum_other_doc_count"
    )


def nested_terms(
    df: DataFrame, outer: str, inner: str, aggs: Aggs | None = None, **sizes
) -> DataFrame:
    """Top ``outer`` keys, and within each its top ``inner`` keys with metrics."""
    return nested_top(count_by(df, {outer: outer, inner: inner}, aggs), outer, inner, **sizes)


def month_of(column: str) -> str:
    return f"trunc({column}, 'MM')"


def date_histogram(
    df: DataFrame, column: str, aggs: Aggs | None = None, fill: bool = True, name: str = "month"
) -> DataFrame:
    """Rows per calendar month; with ``fill`` the empty months in between count 0."""
    counted = count_by(df, {name: month_of(column)}, aggs)
    return fill_months(counted, name) if fill else counted.where(F.col(name).isNotNull())


def histogram(
    df: DataFrame, column: str, interval: float, aggs: Aggs | None = None, name: str = "bucket"
) -> DataFrame:
    """Rows per fixed-width number bucket; empty buckets are left out."""
    key = f"double(floor({column} / {interval}) * {interval})"
    return count_by(df, {name: key}, aggs).where(F.col(name).isNotNull())


def composite(
    df: DataFrame,
    columns: Sequence[str],
    after: Mapping[str, object] | None = None,
    size: int = DEFAULT_SIZE,
) -> DataFrame:
    """One page of distinct key combinations in key order, starting behind ``after``."""
    keys = list(columns)
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in keys))
    if after is not None:
        if list(after) != keys:
            raise ValueError("'after' must name the key columns in order")
        position = F.struct(*[F.lit(after[c]).cast(dict(df.dtypes)[c]).alias(c) for c in keys])
        # The first key by itself can be pushed down to the files.
        rows = rows.where(F.col(keys[0]) >= F.lit(after[keys[0]]).cast(dict(df.dtypes)[keys[0]]))
        rows = rows.where(F.struct(*keys) > position)
    return (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("doc_count")).orderBy(*keys).limit(size)
    )


def significant_terms(
    df: DataFrame, foreground: str, field: str, size: int = DEFAULT_SIZE, min_doc_count: int = 3
) -> DataFrame:
    """The ``size`` keys most over-represented in the foreground rows, by the JLH score.

    A key counts as significant with ``min_doc_count`` foreground rows or more.

    score = (fg% - bg%) * (fg% / bg%), where the background is the whole table.
    """
    counted = df.groupBy(field).agg(
        F.expr(f"count_if({foreground}) AS doc_count"), F.count(F.lit(1)).alias("bg_count")
    )
    totals = counted.agg(F.expr("sum(doc_count) AS fg_total"), F.expr("sum(bg_count) AS bg_total"))
    return (
        counted.where(F.col(field).isNotNull() & (F.col("doc_count") >= min_doc_count))
        .withColumn("_all", totals.select(F.struct("*")).scalar())
        .selectExpr(
            f"`{field}`",
            "doc_count",
            "bg_count",
            "doc_count / _all.fg_total AS fg_share",
            "bg_count / _all.bg_total AS bg_share",
        )
        .where("fg_share > bg_share")
        .selectExpr(
            f"`{field}`",
            "doc_count",
            "bg_count",
            "(fg_share - bg_share) * (fg_share / bg_share) AS score",
        )
        .orderBy(F.desc("score"), F.asc(field))
        .limit(size)
    )
