"""Cleaning of uploaded bookings: fills, null gate, outliers, country names, arrival date."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.countries import country_dimension
from lodgeframe.operators.quantiles import order_statistics, value_counts
from lodgeframe.schema import (
    CLEAN_COLUMNS,
    CONSTANT_FILLS,
    MEDIAN_FILLED,
    MONTH_NAMES,
    OUTLIER_COLUMNS,
    RAW_COLUMNS,
)

LOWER_P, UPPER_P, REACH = 0.01, 0.99, 1.5

# A column holds outliers when this is true of its extremes and limits.
# "reference": the flag "is above" (0 or 1) is itself compared with the upper
# limit, so a high value only counts where that limit is below 1, and every value
# counts where it is below 0.
_DETECTION = {
    "reference": """min_value < lower_limit OR upper_limit < 0
                    OR (upper_limit < 1 AND max_value > upper_limit)""",
    "two_sided": "min_value < lower_limit OR max_value > upper_limit",
}

_MONTHS = ", ".join(f"'{m}'" for m in MONTH_NAMES)
_ARRIVAL_DATE = (
    f"make_date(arrival_date_year, int(array_position(array({_MONTHS}), arrival_date_month)),"
    " arrival_date_day_of_month) AS arrival_date"
)


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, as (column, nulls); one aggregation over the table."""
    return df.agg(*[F.expr(f"count_if(`{c}` IS NULL) AS `{c}`") for c in df.columns]).unpivot(
        [], df.columns, "column", "nulls"
    )


def with_constants(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach a one-row DataFrame as the struct column ``_const`` (one subquery)."""
    return df.withColumn("_const", row.select(F.struct("*")).scalar())


def _one_row(table: DataFrame, picks: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Turn a one-row-per-column table into one row: name -> (column, expression)."""
    return table.agg(
        *[
            F.expr(f"max(CASE WHEN column = '{column}' THEN {value} END) AS `{name}`")
            for name, (column, value) in picks.items()
        ]
    )


def fill_median(df: DataFrame, columns: Sequence[str] = tuple(MEDIAN_FILLED)) -> DataFrame:
    """Replace nulls by the exact median of the column's other values."""
    types = dict(df.dtypes)
    medians = _one_row(
        order_statistics(value_counts(df, columns), []),
        {f"{c}_median": (c, "median") for c in columns},
    )
    return with_constants(df, medians).selectExpr(
        *[
            f"coalesce(`{c}`, CAST(_const.{c}_median AS {types[c]})) AS `{c}`" if c in columns else f"`{c}`"
            for c in df.columns
        ]
    )


def fill_constants(df: DataFrame, values: Mapping[str, object] = CONSTANT_FILLS) -> DataFrame:
    """Replace nulls by a constant per column."""
    return df.fillna(dict(values))


def require_no_nulls(df: DataFrame) -> DataFrame:
    """Return ``df`` unchanged, or raise naming the columns that hold nulls."""
    bad = [r["column"] for r in null_counts(df).where("nulls > 0").collect()]
    if bad:
        raise ValueError(f"null values left in: {', '.join(sorted(bad))}")
    return df


def _gated_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Columns of which no null may be left by :func:`clean`, and those that must hold something to take the median of."""
    checked = [c for c in df.columns if c in RAW_COLUMNS and c not in MEDIAN_FILLED and c not in CONSTANT_FILLS]
    return checked, [c for c in MEDIAN_FILLED if c in df.columns]


def _fail_where(df: DataFrame, bad: str) -> DataFrame:
    """``df``; any use of it fails the job if the text column ``bad`` names columns: no projection can leave the filter out."""
    failed = F.raise_error(F.concat(F.lit("null values left in: "), F.expr(bad))).cast("boolean")
    return df.where(F.when(F.expr(f"{bad} != ''"), failed).otherwise(True))


def null_gate(df: DataFrame) -> DataFrame:
    """``df`` itself; any use of it, a count too, fails the job if a column is left with nulls by :func:`clean`.

    One more scan finds the columns, as a scalar that a filter on all rows depends on.
    A filled column counts if it holds nothing to take the median of. (:func:`clean` finds them in its counting scan.)
    """
    checked, filled = _gated_columns(df)
    checks = [f"IF(count_if(`{c}` IS NULL) > 0, '{c}', NULL)" for c in checked]
    checks += [f"IF(count(1) > 0 AND count(`{c}`) = 0, '{c}', NULL)" for c in filled]
    if not checks:
        return df
    bad = df.selectExpr(f"array_join(array_compact(array({', '.join(checks)})), ', ') AS bad").scalar()
    return _fail_where(df.withColumn("_bad", bad), "_bad").drop("_bad")


def _limits(
    df: DataFrame, columns: Sequence[str], detect: str, median_filled: Sequence[str] = ()
) -> DataFrame:
    """One row per column: median, p01, p99, lower_limit, upper_limit, has_outliers."""
    return _limits_of(value_counts(df, columns), detect, median_filled)


def _limits_of(counts: DataFrame, detect: str, median_filled: Sequence[str]) -> DataFrame:
    if detect not in _DETECTION:
        raise ValueError(f"unknown detection rule: {detect}")
    return order_statistics(counts, [LOWER_P, UPPER_P], median_filled).selectExpr(
        "column",
        "median",
        "quantiles[0] AS p01",
        "quantiles[1] AS p99",
        f"p01 - {REACH}D * (p99 - p01) AS lower_limit",
        f"p99 + {REACH}D * (p99 - p01) AS upper_limit",
        f"coalesce({_DETECTION[detect]}, false) AS has_outliers",
    )


def outlier_thresholds(
    df: DataFrame, columns: Sequence[str] = tuple(OUTLIER_COLUMNS), median_filled: Sequence[str] = ()
) -> DataFrame:
    """Per column: exact 1st and 99th percentile and the limits 1.5 spans beyond them.

    ``median_filled`` columns count as if their nulls were filled, which spares a scan for the median.
    """
    return _limits(df, columns, "reference", median_filled).drop("median", "has_outliers")


def detect_outliers(
    df: DataFrame,
    columns: Sequence[str] = tuple(OUTLIER_COLUMNS),
    detect: str = "reference",
) -> DataFrame:
    """Per column: its limits and whether it holds outliers under the chosen rule."""
    return _limits(df, columns, detect).drop("median", "p01", "p99")


def _constants(
    df: DataFrame,
    columns: Sequence[str],
    detect: str,
    median_filled: Sequence[str] = (),
    gate: tuple[Sequence[str], Sequence[str]] | None = None,
) -> DataFrame:
    """One row: limits of flagged columns, exact and rounded (null for others), and medians.

    With ``gate``, also ``bad``: the names of its first columns that hold nulls and of its second that hold nothing else,
    from the same scan.
    """
    picks = {f"{c}_median": (c, "median") for c in median_filled}
    for c in columns:
        for side in ("lower", "upper"):
            limit = f"IF(has_outliers, {side}_limit, NULL)"
            picks[f"{c}_{side}"] = (c, limit)
            picks[f"{c}_{side}_to"] = (c, f"bround({limit}, 0)")
    if gate is None:
        return _one_row(_limits(df, columns, detect, median_filled), picks)
    checked, filled = gate
    counts = value_counts(df, list(dict.fromkeys([*columns, *filled])), [c for c in checked if c not in columns])
    rules = [f"(column IN ({_listed(checked)}) AND nulls > 0)"] * bool(checked)
    rules += [f"(column IN ({_listed(filled)}) AND present = 0)"] * bool(filled)
    held = counts.groupBy("column").agg(F.expr("count_if(value IS NULL)").alias("nulls"), F.count("value").alias("present"))
    bad = held.where(" OR ".join(rules)).agg(F.array_join(F.sort_array(F.collect_list("column")), ", ").alias("bad"))
    # Two tables of one row.
    return _one_row(_limits_of(counts, detect, median_filled), picks).crossJoin(F.broadcast(bad))


def _listed(names: Sequence[str]) -> str:
    return ", ".join(f"'{c}'" for c in names)


def _clip(c: str, dtype: str) -> str:
    # Limits of unflagged columns are null: both comparisons are then unknown
    # and the value passes through.
    return f"""CASE WHEN `{c}` > _const.{c}_upper THEN CAST(_const.{c}_upper_to AS {dtype})
                    WHEN `{c}` < _const.{c}_lower THEN CAST(_const.{c}_lower_to AS {dtype})
                    ELSE `{c}` END AS `{c}`"""


def suppress_outliers(
    df: DataFrame,
    columns: Sequence[str] = tuple(OUTLIER_COLUMNS),
    detect: str = "reference",
) -> DataFrame:
    """Clip flagged columns on both sides to their limits, rounded half to even."""
    types = dict(df.dtypes)
    return with_constants(df, _constants(df, columns, detect)).selectExpr(
        *[_clip(c, types[c]) if c in columns else f"`{c}`" for c in df.columns]
    )


def map_country(df: DataFrame, dim: DataFrame | None = None, unmapped: str = "") -> DataFrame:
    """Replace country codes by names; codes outside the lookup become ``unmapped``.

    ``dim`` is a (code, name) lookup. The built-in one has under 200 rows and is
    broadcast; for another one the join strategy is left to Spark's size check.
    """
    names = F.broadcast(country_dimension(df.sparkSession)) if dim is None else dim
    names = names.selectExpr("code AS country", "name AS _name")
    name = F.coalesce(F.col("_name"), F.lit(unmapped)).alias("country")
    return df.join(names, "country", "left").select(
        *[name if c == "country" else c for c in df.columns]
    )


def with_arrival_date(df: DataFrame) -> DataFrame:
    """Add ``arrival_date``; an impossible date or unknown month name is an error."""
    return df.selectExpr("*", _ARRIVAL_DATE)


def clean(
    df: DataFrame,
    detect: str = "reference",
    unmapped: str = "",
    columns: Sequence[str] | None = None,
    gate: bool = True,
) -> DataFrame:
    """The whole cleaning as one lazy projection.

    All data-dependent constants (median, limits) and the null gate's findings come from a single counting
    scan and enter through one scalar subquery. The gate looks at the whole input, whatever is
    read of the result: a null in an unfillable column fails the job (see :func:`null_gate`).
    ``columns`` names the output columns to build; with ``gate=False`` others are neither read nor checked.
    """
    extra = [c for c in df.columns if c not in RAW_COLUMNS]
    wanted = list(columns) if columns is not None else [*extra, *CLEAN_COLUMNS]
    types = dict(df.dtypes)
    clipped = [c for c in OUTLIER_COLUMNS if c in wanted]
    if clipped:
        medians = [c for c in MEDIAN_FILLED if c in clipped]
        df = with_constants(df, _constants(df, clipped, detect, medians, _gated_columns(df) if gate else None))
        df = _fail_where(df, "_const.bad") if gate else df
    elif gate:
        df = null_gate(df)

    def filled(c: str) -> str:
        if c in MEDIAN_FILLED:
            return f"coalesce({c}, CAST(_const.{c}_median AS {types[c]})) AS {c}"
        if c in CONSTANT_FILLS:
            return f"coalesce({c}, CAST('{CONSTANT_FILLS[c]}' AS {types[c]})) AS {c}"
        return f"`{c}`"

    rows = df.selectExpr(
        *[_ARRIVAL_DATE if c == "arrival_date" else filled(c) for c in wanted],
        *(["_const"] if clipped else []),
    )
    if clipped:
        rows = rows.selectExpr(*[_clip(c, types[c]) if c in clipped else f"`{c}`" for c in wanted])
    return map_country(rows, unmapped=unmapped) if "country" in wanted else rows


def cast_bookings(df: DataFrame, types: Mapping[str, str] = CLEAN_COLUMNS) -> DataFrame:
    """Strict casts of text columns; a value that does not fit fails the job."""
    return df.selectExpr(
        *[f"CAST(`{c}` AS {types[c]}) AS `{c}`" if c in types else f"`{c}`" for c in df.columns]
    )


def cast_rejects(df: DataFrame, types: Mapping[str, str] = CLEAN_COLUMNS) -> DataFrame:
    """Rows that :func:`cast_bookings` would fail on, with the offending column names."""
    bad = ", ".join(
        f"IF(`{c}` IS NOT NULL AND try_cast(`{c}` AS {types[c]}) IS NULL, '{c}', NULL)"
        for c in df.columns
        if c in types
    )
    return df.selectExpr("*", f"array_compact(array({bad})) AS bad_columns").where(
        "size(bad_columns) > 0"
    )
