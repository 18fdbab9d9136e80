"""Profiling of a bookings table; every result is a small long-form DataFrame."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.operators.cleaning import null_counts
from lodgeframe.operators.quantiles import order_statistics, value_counts
from lodgeframe.schema import FACET_COLUMNS

NUMERIC_TYPES = ("int", "bigint", "double", "float", "smallint", "tinyint", "boolean")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC_TYPES and c != "id"]


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint")
    )


def head(df: DataFrame, n: int = 5, key: str = "id") -> DataFrame:
    """The first ``n`` rows in key order."""
    return df.orderBy(key).limit(n)


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, nulls and non-null rows; one aggregation."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(c).alias(c) for c in df.columns],
    )
    cells = ", ".join(
        f"struct('{c}' AS column, '{t}' AS dtype, _rows - `{c}` AS nulls, `{c}` AS non_nulls)"
        for c, t in df.dtypes
    )
    return counts.selectExpr(f"inline(array({cells}))")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, stat, value): count, mean, std, min, 25%, 50%, 75%, max, all exact.

    Means and deviations are one plain aggregation, everything else follows from value counts. NaN counts as null.
    """
    columns = list(columns or numeric_columns(df))
    ranks = order_statistics(value_counts(df, columns), [0.25, 0.5, 0.75])
    number = "nullif(double(`{c}`), double('NaN'))"
    row = df.agg(*[F.expr(f"struct(avg({number}) AS mean, stddev_samp({number}) AS std)".format(c=c)).alias(c) for c in columns])
    cells = ", ".join(f"struct('{c}' AS column, `{c}`.mean AS mean, `{c}`.std AS std)" for c in columns)
    spread = row.selectExpr(f"inline(array({cells}))")
    # One row per column, hence the broadcast.
    return ranks.join(F.broadcast(spread), "column").selectExpr(
        "column",
        """stack(8, 'count', double(total), 'mean', mean, 'std', std, 'min', min_value,
             '25%', quantiles[0], '50%', quantiles[1], '75%', quantiles[2],
             'max', max_value) AS (stat, value)""",
    )


def unique_counts(df: DataFrame) -> DataFrame:
    """(column, n_unique, n_rows): exact distinct values per column, nulls not counted."""
    number = ("double", "float")
    texts = df.selectExpr(
        *[f"CAST(`{c}`{' + 0D' if t in number else ''} AS string) AS `{c}`" for c, t in df.dtypes]
    )
    return (
        texts.unpivot([], df.columns, "column", "value")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column")
        .agg(F.count("value").alias("n_unique"), F.sum("n").alias("n_rows"))
    )


def classify_columns(df: DataFrame) -> DataFrame:
    """(column, class, n_unique) by type and number of distinct values.

    Numbers with fewer distinct values than the 10% quantile over all columns are
    ``num_but_cat``; text with more than the 90% quantile, or more than a fifth
    of the rows, is ``high_cardinality``. From stored sketches of uploads: ``sketches.classify_sketched``.
    """
    return classified(unique_counts(df), dict(df.dtypes))


def classified(uniques: DataFrame, types: dict[str, str]) -> DataFrame:
    """The classes of columns by their distinct counts (column, n_unique, n_rows)."""
    kinds = {c: "number" if t in NUMERIC_TYPES else "date" if t == "date" else "other" for c, t in types.items()}
    cases = " ".join(f"WHEN '{c}' THEN '{k}'" for c, k in kinds.items())
    uniques = uniques.withColumn("kind", F.expr(f"CASE column {cases} END"))
    # One row per column of the table goes into these quantiles.
    cuts = uniques.agg(F.expr("percentile(n_unique, array(0.1D, 0.9D)) AS cuts"))
    return uniques.crossJoin(F.broadcast(cuts)).selectExpr(
        "column",
        """CASE WHEN kind = 'number' AND n_unique < cuts[0] THEN 'num_but_cat'
                WHEN kind = 'number' THEN 'numerical'
                WHEN kind = 'date' THEN 'date'
                WHEN n_unique > cuts[1] OR n_unique > n_rows * 0.2D THEN 'high_cardinality'
                ELSE 'categorical' END AS class""",
        "n_unique",
    )


_PARTIAL = (
    "a int, b int, n bigint, mean_x double, mean_y double, xx double, yy double, xy double,"
    " min_x double, max_x double, min_y double, max_y double"
)


def _co_moments_function():
    """The partition function; a closure, so executors need no copy of this package."""

    def of_batch(x: np.ndarray) -> list[np.ndarray]:
        """For all pairs of columns, over the rows where both are set: n, mean of the first, its square sum and co-moment, extremes."""
        seen = (~np.isnan(x)).astype(float)
        counts = seen.sum(axis=0)
        shift = np.divide(np.nan_to_num(x).sum(axis=0), counts, out=np.zeros(x.shape[1]), where=counts > 0)
        v = np.nan_to_num(x - shift)
        n, sums = seen.T @ seen, v.T @ seen
        safe = np.where(n > 0, n, 1.0)
        means = sums / safe + shift[:, None]
        squares = (v * v).T @ seen - sums * sums / safe
        products = v.T @ v - sums * sums.T / safe
        if seen.all():
            low = np.repeat(x.min(axis=0)[:, None], x.shape[1], axis=1)
            high = np.repeat(x.max(axis=0)[:, None], x.shape[1], axis=1)
        else:
            both = [np.where(seen[:, [j]] > 0, x, np.nan) for j in range(x.shape[1])]
            low = np.stack([np.nanmin(np.vstack([m, np.full(m.shape[1], np.inf)]), axis=0) for m in both], 1)
            high = np.stack([np.nanmax(np.vstack([m, np.full(m.shape[1], -np.inf)]), axis=0) for m in both], 1)
        return [n, means, squares, products, low, high]

    def merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        """Two sets of rows as one (Chan's rule)."""
        n = a[0] + b[0]
        share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
        apart = np.where(b[0] > 0, b[1] - a[1], 0.0)
        apart = np.where(a[0] > 0, apart, 0.0)
        means = np.where(a[0] > 0, a[1] + apart * share, b[1])
        weight = a[0] * share
        return [
            n, means, a[2] + b[2] + apart * apart * weight, a[3] + b[3] + apart * apart.T * weight,
            np.minimum(a[4], b[4]), np.maximum(a[5], b[5]),
        ]

    def co_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), dtype=float) for c in batch.columns])
                total = of_batch(x) if total is None else merged(total, of_batch(x))
        if total is None:
            return
        n, means, squares, products, low, high = total
        i, j = np.indices(n.shape).reshape(2, -1)
        cells = [
            i.astype("int32"), j.astype("int32"), n[i, j].astype("int64"), means[i, j], means[j, i],
            squares[i, j], squares[j, i], products[i, j], low[i, j], high[i, j], low[j, i], high[j, i],
        ]
        names = [f.split()[0] for f in _PARTIAL.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=names)

    return co_moments


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(col_a, col_b, r): Pearson correlation of all pairs, over rows where both are set; NaN counts as null.

    A constant column gives NaN. One scan: every partition turns into one small table of means and co-moments (matrix products per
    Arrow batch), and only those tables are shuffled. They are merged around the mean of all rows, so no large sums
    are taken from each other and values far from zero keep their digits.
    """
    columns = list(columns or numeric_columns(df))
    names = ", ".join(f"'{c}'" for c in columns)
    partials = df.selectExpr(*[f"double(`{c}`) AS `{c}`" for c in columns]).mapInArrow(_co_moments_function(), _PARTIAL).where("n > 0")
    # A pair has as many rows as the table has partitions.
    pair = "OVER (PARTITION BY a, b)"
    first, second = (f"mean_{c} - sum(mean_{c} * (n / sum_n)) {pair}" for c in "xy")
    around = partials.selectExpr("*", f"sum(n) {pair} AS sum_n").selectExpr("*", f"{first} AS off_x", f"{second} AS off_y")
    return (
        around.groupBy("a", "b")
        .agg(
            F.expr("sum(xx + n * off_x * off_x) AS xx"),
            F.expr("sum(yy + n * off_y * off_y) AS yy"),
            F.expr("sum(xy + n * off_x * off_y) AS xy"),
            *[F.min(c).alias(c) for c in ("min_x", "min_y")],
            *[F.max(c).alias(c) for c in ("max_x", "max_y")],
        )
        .selectExpr(
            f"element_at(array({names}), a + 1) AS col_a",
            f"element_at(array({names}), b + 1) AS col_b",
            """CASE WHEN min_x = max_x OR min_y = max_y THEN double('NaN')
                    ELSE try_divide(xy, sqrt(xx) * sqrt(yy)) END AS r""",
        )
    )


def value_counts_where(df: DataFrame, column: str, predicate: str) -> DataFrame:
    """Rows per value of ``column`` among the rows fulfilling ``predicate``."""
    return (
        df.where(predicate)
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("doc_count"))
        .orderBy(F.desc("doc_count"), F.asc(column))
    )


def distinct_values(df: DataFrame, columns: Sequence[str] = tuple(FACET_COLUMNS)) -> DataFrame:
    """(field, value): the distinct values of all given columns, as text, from one scan."""
    texts = df.selectExpr(*[f"CAST(`{c}` AS string) AS `{c}`" for c in columns])
    return texts.unpivot([], list(columns), "field", "value").distinct().orderBy("field", "value")


def date_bounds(df: DataFrame, column: str = "arrival_date") -> DataFrame:
    """One row: first and last date."""
    return df.agg(F.min(column).alias("min_date"), F.max(column).alias("max_date"))


__all__ = [
    "classify_columns",
    "column_profile",
    "correlation_matrix",
    "date_bounds",
    "describe",
    "distinct_values",
    "head",
    "null_counts",
    "numeric_columns",
    "shape",
    "value_counts_where",
]
