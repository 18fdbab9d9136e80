"""Ad-hoc metrics: any list of (field, aggregation type) in long form."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.operators.buckets import DEFAULT_SIZE
from lodgeframe.operators.quantiles import order_statistics, value_counts
from lodgeframe.schema import resolve_field

PERCENTS = [1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0]

_NUMBER = {
    "avg": {None: "avg({c})"},
    "sum": {None: "sum({c})"},
    "min": {None: "min({c})"},
    "max": {None: "max({c})"},
    "stats": {
        "count": "count({c})",
        "min": "min({c})",
        "max": "max({c})",
        "avg": "avg({c})",
        "sum": "sum({c})",
    },
}
_NUMBER["extended_stats"] = {
    **_NUMBER["stats"],
    "sum_of_squares": "sum(double({c}) * {c})",
    "variance": "var_pop({c})",
    "variance_sampling": "var_samp({c})",
    "std_deviation": "stddev_pop({c})",
    "std_deviation_sampling": "stddev_samp({c})",
}
_DATE = {"min": {None: "min({c})"}, "max": {None: "max({c})"}}
_ANY = {"value_count": {None: "count({c})"}, "missing": {None: "count_if({c} IS NULL)"}}
_RANKED = ("percentiles", "median_absolute_deviation")
_OUTPUT = ["agg", "key", "doc_count", "value", "field", "type"]


def _fused(df: DataFrame, wanted: Sequence[tuple[str, str | None, str, str]]) -> DataFrame:
    """All single-pass metrics in one aggregation, turned into rows."""
    row = df.agg(*[F.expr(sql).alias(f"m{i}") for i, (_, _, sql, _) in enumerate(wanted)])
    cells = []
    for i, (name, key, _, kind) in enumerate(wanted):
        label = f"'{key}'" if key else "CAST(NULL AS string)"
        value = f"CAST(m{i} AS double)"
        if kind == "date":
            label, value = f"CAST(m{i} AS string)", f"double(unix_date(m{i})) * 86400000"
        cells.append(f"struct('{name}' AS agg, {label} AS key, CAST(NULL AS bigint) AS doc_count, {value} AS value)")
    return row.selectExpr(f"inline(array({', '.join(cells)}))")


def _terms(df: DataFrame, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """The top keys of all columns from one scan: every column is a grouping set of its own."""
    keys = [f"_t{i}" for i in range(len(wanted))]
    rows = df.select(*[F.col(f"`{c}`").alias(k) for k, (_, c) in zip(keys, wanted)])
    counted = rows.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("doc_count")
    )
    parts = []
    for i, (key, (name, _)) in enumerate(zip(keys, wanted)):
        # The grouping number has a 1 bit for every key left out, first key highest.
        number = (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i))
        parts.append(f"WHEN {number} THEN IF({key} IS NULL, NULL, struct('{name}' AS agg, CAST({key} AS string) AS key))")
    listed = counted.selectExpr(f"CASE _set {' '.join(parts)} END AS _of", "doc_count", *keys).where("_of IS NOT NULL")
    # Ties go by the key in its own type. The rank filter also runs before the shuffle.
    rank = f"row_number() OVER (PARTITION BY _of.agg ORDER BY doc_count DESC, {', '.join(keys)}) AS _rank"
    top = listed.selectExpr("_of.*", "doc_count", rank, "_of").where(F.col("_rank") <= DEFAULT_SIZE)
    return top.selectExpr("agg", "key", "doc_count", "CAST(NULL AS double) AS value")


def _ranked(df: DataFrame, wanted: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Percentiles and median absolute deviations from one counting scan."""
    counts = value_counts(df, sorted({c for _, c, _ in wanted}))
    stats = order_statistics(counts, [p / 100 for p in PERCENTS])

    def names(kind: str) -> DataFrame | None:
        """(column, agg): a join with it picks columns without a filter that would part the counting scan."""
        rows = [f"('{c}', '{name}')" for name, c, of in wanted if of == kind]
        return F.broadcast(df.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(column, agg)")) if rows else None

    parts = []
    if (of := names("percentiles")) is not None:
        labels = ", ".join(f"'{p}'" for p in PERCENTS)
        rows = stats.join(of, "column").selectExpr("agg", f"explode(arrays_zip(array({labels}), quantiles)) AS q")
        parts.append(rows.selectExpr("agg", "q['0'] AS key", "q.quantiles AS value"))
    if (of := names("median_absolute_deviation")) is not None:
        # One row per column.
        middle = F.broadcast(stats.join(of, "column").select("column", "agg", "median"))
        spread = counts.join(middle, "column").selectExpr("agg AS column", "abs(value - median) AS value", "n")
        parts.append(order_statistics(spread, []).selectExpr("column AS agg", "CAST(NULL AS string) AS key", "median AS value"))
    return reduce(DataFrame.unionByName, parts).selectExpr("agg", "key", "CAST(NULL AS bigint) AS doc_count", "value")


def aggregate(
    df: DataFrame, specs: Sequence[tuple[str, str]], exact_cardinality: bool = True
) -> DataFrame:
    """Long form (agg, key, doc_count, value, field, type) of any list of (field, type).

    Aggregations are named ``{field}_{type}``; repeating one changes nothing. All
    single-value metrics share one pass over the table, and so do all ``terms``, which give the top
    ten keys as text. A field or type that does not exist, or does not fit the
    field, is an error for the whole request.
    """
    fused, ranked, grouped, names = [], [], [], {}
    count = "count(DISTINCT {c})" if exact_cardinality else "approx_count_distinct({c})"
    for field, kind in dict.fromkeys((f, k) for f, k in specs):
        column, of = resolve_field(field)
        name = f"{field}_{kind}"
        names[name] = (field, kind)
        if of == "suggest":
            raise ValueError(f"{field} cannot be aggregated")
        if kind == "terms":
            grouped.append((name, column))
        elif kind == "cardinality":
            fused.append((name, None, count.format(c=column), "number"))
        elif kind in _ANY:
            fused += [(name, k, sql.format(c=column), "number") for k, sql in _ANY[kind].items()]
        elif of == "number" and kind in _RANKED:
            ranked.append((name, column, kind))
        elif kind in {"number": _NUMBER, "date": _DATE}.get(of, {}):
            table = _NUMBER if of == "number" else _DATE
            fused += [(name, k, sql.format(c=column), of) for k, sql in table[kind].items()]
        else:
            raise ValueError(f"aggregation {kind} does not apply to {field}")
    parts = []
    if fused:
        parts.append(_fused(df, fused))
    if ranked:
        parts.append(_ranked(df, ranked))
    if grouped:
        parts.append(_terms(df, grouped))
    if not parts:
        raise ValueError("no aggregation requested")
    known = " ".join(f"WHEN '{n}' THEN struct('{f}' AS field, '{k}' AS type)" for n, (f, k) in names.items())
    rows = reduce(DataFrame.unionByName, parts).selectExpr("*", f"CASE agg {known} END AS _of")
    return rows.select("agg", "key", "doc_count", "value", "_of.*").select(*_OUTPUT)


def metric(df: DataFrame, field: str, kind: str) -> DataFrame:
    """One metric, in the same long form as :func:`aggregate`."""
    return aggregate(df, [(field, kind)])
