"""Exact order statistics of many columns from one scan, by radix selection.

The built-in exact ``percentile`` ships every distinct value of a column to one
task. Here values are first counted (partial + final aggregation on
``(column, value)``, so a hot value is combined before the shuffle). The bits of a
double, read as a number that grows with it, are then taken digit by digit: the first
digit's histogram shows which digit each wanted rank has, only the values with that digit go into the
next digit's histogram, and so on, until all bits are taken.
A task holds one digit's histogram at most, whatever the values are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the digits, from the first: sign, exponent and the next eight, then the rest in two.
DIGITS = (20, 22, 22)
#: Nulls have the least key; no number has a key with the same first digit.
_NULL_KEY, _NULL_DIGIT = -(2**63), -(2 ** (DIGITS[0] - 1))


def sort_key(value: str) -> str:
    """SQL for a 64-bit number that orders doubles (neither null nor NaN; -0 as 0): their bits, negated below zero."""
    size = f"abs({value})"
    guess = f"greatest(floor(log2({size})), -1022L)"  # may be off by one next to a power of two
    power = f"({guess} + IF({size} >= power(2D, {guess} + 1), 1L, 0L) - IF({size} < power(2D, {guess}) AND {guess} > -1022L, 1L, 0L))"
    bits = f"shiftleft({power} + 1022L, 52) + bigint({size} / power(2D, {power}) * 4503599627370496D)"
    return f"""CASE WHEN {value} IS NULL THEN NULL WHEN {value} = 0 THEN 0L
        WHEN {size} = double('Infinity') THEN bigint(signum({value})) * 9218868437227405312L
        ELSE bigint(signum({value})) * ({bits}) END"""


def value_counts(df: DataFrame, columns: Sequence[str], null_checked: Sequence[str] = ()) -> DataFrame:
    """(column, value, n) over all given numeric columns, one scan; nulls are counted too.

    NaN counts as null and minus zero as zero. Of the ``null_checked`` columns, of any type, only the nulls are counted.
    """
    cells = [f"named_struct('column', '{c}', 'value', nullif(double(`{c}`) + 0D, double('NaN')))" for c in columns]
    if not null_checked:
        long = df.selectExpr(f"inline(array({', '.join(cells)}))")
    else:
        checks = [
            f"IF(`{c}` IS NULL, named_struct('column', '{c}', 'value', CAST(NULL AS double)), NULL)" for c in null_checked
        ]
        # Rows without a null, nearly all, build no array of the checks.
        any_null = " OR ".join(f"`{c}` IS NULL" for c in null_checked)
        empty = "CAST(array() AS array<struct<column:string,value:double>>)"
        nulls = f"IF({any_null}, array_compact(array({', '.join(checks)})), {empty})"
        long = df.selectExpr(f"inline(concat(array({', '.join(cells)}), {nulls}))" if cells else f"inline({nulls})")
    return long.selectExpr("coalesce(column, '') AS column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def order_statistics(
    counts: DataFrame, probabilities: Sequence[float], median_filled: Sequence[str] = ()
) -> DataFrame:
    """Exact, linearly interpolated percentiles of a (column, value, n) table.

    One row per column: column, total (non-null), nulls, min_value, max_value,
    median, quantiles (array in the order of ``probabilities``). For columns in
    ``median_filled`` the quantiles are those after nulls became the median: the
    filled rows sit as one block in the middle of the order, so a rank after
    filling maps to a rank before it and no second scan is needed. Columns without values have no row.
    """
    # Neither column nor key is ever null, so that all uses of ``counts`` keep the same plan and share one exchange.
    counts = counts.selectExpr("*", f"coalesce({sort_key('value')}, {_NULL_KEY + 1}L - 1L) AS key")

    def digits(taken: int) -> str:
        return f"shiftright(key, {64 - taken})"

    sums = counts.selectExpr("*", f"{digits(DIGITS[0])} AS digit").groupBy("column", "digit").agg(
        F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    present = f"if(digit = {_NULL_DIGIT}, 0, n)"
    names = ", ".join(f"'{c}'" for c in median_filled)
    spans = sums.selectExpr(
        "column",
        "digit",
        "low",
        "high",
        f"sum({present}) OVER (PARTITION BY column ORDER BY digit ROWS UNBOUNDED PRECEDING) AS stop",
        f"{present} AS present",
        f"sum({present}) OVER (PARTITION BY column) AS total",
        f"sum(n - {present}) OVER (PARTITION BY column) AS nulls",
        "min(low) OVER (PARTITION BY column) AS min_value",
        "max(high) OVER (PARTITION BY column) AS max_value",
    )

    # Zero-based ranks: the two middle ones, then two per probability. A rank
    # after filling is turned into one before it; -1 stands for a filled row.
    ps = ", ".join(f"{float(p)}D" for p in probabilities)
    ranks = spans.where("present > 0").selectExpr(
        "*",
        "floor((total - 1) / 2D) AS low_mid",
        "ceil((total - 1) / 2D) AS high_mid",
        f"if(column IN ({names}), nulls, 0L) AS inserted" if names else "0L AS inserted",
        f"transform(cast(array({ps}) AS array<double>), p -> p * (total + inserted - 1)) AS places",
        """transform(flatten(transform(places, x -> array(floor(x), ceil(x)))),
             r -> CASE WHEN r < high_mid THEN r
                       WHEN r < high_mid + inserted THEN -1L
                       ELSE r - inserted END) AS ends""",
    )
    searched = ranks.selectExpr(
        "column",
        "digit",
        "stop - present AS before",
        "struct(total, nulls, min_value, max_value, low_mid, high_mid, places, ends) AS of",
        """explode(array_distinct(filter(array_union(array(low_mid, high_mid), ends),
             r -> r >= stop - present AND r < stop))) AS rank""",
    )
    taken = DIGITS[0]
    for width in DIGITS[1:]:
        # A few rows per column, hence the broadcast.
        inside = counts.withColumn("digit", F.expr(digits(taken))).join(
            F.broadcast(searched.select("column", "digit", "rank", "before", "of")), ["column", "digit"]
        )
        taken += width
        histogram = inside.groupBy("column", "rank", F.expr(digits(taken)).alias("next")).agg(
            F.sum("n").alias("n"), F.min("value").alias("low"), F.first("before").alias("first"), F.first("of").alias("of")
        )
        reached = "first + sum(n) OVER (PARTITION BY column, rank ORDER BY next ROWS UNBOUNDED PRECEDING)"
        searched = histogram.selectExpr("column", "next AS digit", f"{reached} - n AS before", "n", "low", "of", "rank").where(
            "before <= rank AND before + n > rank"
        )
    # All bits are taken: a digit is one value.
    picked = searched.groupBy("column").agg(
        F.first("of").alias("of"), F.expr("map_from_entries(collect_list(struct(rank, low)))").alias("at")
    )
    return picked.select("column", "of.*", "at").selectExpr(
        "column",
        "total",
        "nulls",
        "min_value",
        "max_value",
        "(at[low_mid] + at[high_mid]) / 2 AS median",
        "transform(ends, r -> coalesce(at[r], median)) AS picked",
        """transform(places, (x, i) -> picked[2 * i]
             + (picked[2 * i + 1] - picked[2 * i]) * (x - floor(x))) AS quantiles""",
    ).drop("picked")


def percentiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Exact percentiles of numeric columns in long form: column, p, value."""
    points = F.array(*[F.lit(float(p)) for p in probabilities])
    return (
        order_statistics(value_counts(df, columns), probabilities)
        .select("column", F.explode(F.arrays_zip(points.alias("p"), "quantiles")).alias("q"))
        .select("column", F.col("q.p").alias("p"), F.col("q.quantiles").alias("value"))
    )
