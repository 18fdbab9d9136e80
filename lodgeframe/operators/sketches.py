"""Mergeable summaries of uploads: percentiles and distinct counts without reading old uploads again.

Every batch of rows leaves one row for each column: how many values it has, their range, a quantile sketch (KLL) of numbers and
a distinct-count sketch (HLL) of any value. Sketches of any choice of batches merge, in any order and any number of steps, into the
sketch of all their rows, and their size does not grow with the rows. Both kinds are Spark's own aggregates, so they are
combined within each task before anything shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeframe.operators.profiling import NUMERIC_TYPES, classified

#: Size of a quantile sketch; ranks are then off by 0.7% of the values at most, with 99% certainty.
KLL_K = 400
#: Size of a distinct-count sketch, as a power of two: a standard error of 0.8%.
HLL_LG = 14

RANK_ERROR, DISTINCT_ERROR = 0.007, 0.03


def sketch_rows(df: DataFrame, columns: Sequence[str], batch: str | Column) -> DataFrame:
    """(batch, column, rows, n, min_value, max_value, quantiles, distincts): one row for each batch and column.

    ``n`` counts values that are not null; NaN counts as null and minus zero as zero. Text and dates have no range and no
    quantile sketch. One scan.
    """
    types = dict(df.dtypes)
    cells = []
    for c in columns:
        number = types[c] in NUMERIC_TYPES
        value = f"nullif(double(`{c}`) + 0D, double('NaN'))" if number else "CAST(NULL AS double)"
        text = f"string({value})" if number else f"string(`{c}`)"
        cells.append(f"named_struct('column', '{c}', 'number', {value}, 'text', {text})")
    given = F.col(batch) if isinstance(batch, str) else batch
    long = df.select(given.alias("batch"), F.expr(f"inline(array({', '.join(cells)}))"))
    return long.groupBy("batch", "column").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("text").alias("n"),
        F.min("number").alias("min_value"),
        F.max("number").alias("max_value"),
        F.kll_sketch_agg_double("number", KLL_K).alias("quantiles"),
        F.hll_sketch_agg("text", HLL_LG).alias("distincts"),
    )


def merged(sketches: DataFrame) -> DataFrame:
    """One row for each column: the sketches of all given batches as one. Choose batches by filtering before."""
    return sketches.groupBy("column").agg(
        F.sum("rows").alias("rows"),
        F.sum("n").alias("n"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("distincts").alias("distincts"),
    )


def sketched_percentiles(sketches: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(column, p, value): approximate percentiles of numeric columns; null for a column without values."""
    ps = F.array(*(F.lit(float(p)) for p in probabilities))
    each = merged(sketches).where("min_value IS NOT NULL").select(
        "column", F.explode(F.arrays_zip(ps.alias("p"), F.kll_sketch_get_quantile_double("quantiles", ps).alias("value"))).alias("q")
    )
    return each.select("column", "q.p", "q.value")


def sketched_distinct(sketches: DataFrame) -> DataFrame:
    """(column, n_rows, n_unique): approximate numbers of distinct values, nulls not counted."""
    return merged(sketches).select(
        "column", F.col("rows").alias("n_rows"), F.hll_sketch_estimate("distincts").alias("n_unique")
    )


def classify_sketched(sketches: DataFrame, types: dict[str, str]) -> DataFrame:
    """(column, class, n_unique) by :func:`profiling.classify_columns`'s rules, from the sketches of uploads alone."""
    return classified(sketched_distinct(sketches), types)
