"""The sixteen booking reports.

A report is a grouping (keys and metrics, the only pass over the table) followed
by a ranking of the grouped rows. One report runs its own grouping. All reports
together share a lattice: one pass keeps partial sums for a few groupings (BASES), each finer than several reports', and
every report rolls the smallest base above it up. Partial sums merge, so they also follow changes of the table without
reading it again: see ``rollups``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.functions.measures import COMPOSITION, REVENUE, TOTAL_NIGHTS
from lodgeframe.operators.buckets import (
    count_by,
    fill_months,
    month_of,
    months_then_top,
    nested_top,
    top,
    top_then_months,
)
from lodgeframe.sources.workspace import stored

_MONTH = month_of("arrival_date")

#: What is averaged or added up, by name.
MEASURES = {
    "canceled": "is_canceled",
    "adr": "adr",
    "lead": "lead_time",
    "stay": TOTAL_NIGHTS,
    "requests": "total_of_special_requests",
    "revenue": REVENUE,
}
#: Metrics as (aggregate, measure).
_CANCELLATION = {"cancellation_rate": ("avg", "canceled")}
_ADR = {"average_adr": ("avg", "adr")}
_LEAD = {"average_lead_time": ("avg", "lead")}
_STAY = {"average_stay_length": ("avg", "stay")}
_REQUESTS = {"special_requests_count": ("avg", "requests")}

#: Groupings whose partial sums are kept; every report's keys are among those of one of them.
BASES = (
    ("market_segment", "hotel", "distribution_channel", "is_canceled"),
    ("month", "hotel", "reserved_room_type"),
    ("is_repeated_guest", "country", "hotel"),
    ("length_of_stay", "total_of_special_requests"),
    ("lead_time_bucket",),
    ("booking_composition",),
    ("adr",),
)


@dataclass(frozen=True)
class Report:
    keys: Mapping[str, str]
    rank: Callable[[DataFrame], DataFrame]
    columns: tuple[str, ...]
    metrics: Mapping[str, tuple[str, str]] = field(default_factory=dict)

    def from_rows(self) -> dict[str, str]:
        """SQL of the metrics over rows of the table."""
        return {name: f"{kind}({MEASURES[of]})" for name, (kind, of) in self.metrics.items()}

    def from_sums(self) -> dict[str, str]:
        """SQL of the metrics over partial sums."""
        sums = {"avg": "try_divide(double(sum({m}_sum)), sum({m}_count))", "sum": "sum({m}_sum)", "count": "sum({m}_count)"}
        return {name: sums[kind].format(m=of) for name, (kind, of) in self.metrics.items()}

    def base(self) -> tuple[str, ...]:
        """The smallest base that is finer than the report."""
        return min((b for b in BASES if set(self.keys) <= set(b)), key=len)

    def labels(self) -> list[str]:
        """The columns that tell the report's rows apart; the others are values."""
        return [c for c in self.columns if c in self.keys or c in ("section", "key")]


def _simple(key: str, metrics: Mapping[str, tuple[str, str]] | None = None, sql: str | None = None, **how):
    metrics = dict(metrics or {})
    return Report(
        keys={key: sql or key},
        metrics=metrics,
        rank=lambda counted: top(counted, key, **how),
        columns=(key, "doc_count", *metrics),
    )


def _months_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("month", "yyyy-MM"))


def _repeat_guests(groups: DataFrame) -> DataFrame:
    guest = "is_repeated_guest"
    keys = [F.col(guest), F.col("country"), F.col("hotel")]
    # All three sections from one use of the grouped table.
    counted = groups.where(F.col(guest).isNotNull()).groupingSets([[guest], [guest, "country"], [guest, "hotel"]], *keys).agg(
        F.grouping("country").alias("no_country"),
        F.grouping("hotel").alias("no_hotel"),
        F.sum("doc_count").alias("doc_count"),
        F.expr("try_divide(sum(lead_time_sum), sum(lead_time_count))").alias("lead"),
    )
    sections = counted.selectExpr(
        guest,
        "CASE WHEN no_country = 0 THEN 'country' WHEN no_hotel = 0 THEN 'hotel' ELSE 'summary' END AS section",
        "coalesce(country, hotel) AS key",
        "doc_count",
        "IF(no_country = 1 AND no_hotel = 1, lead, NULL) AS average_lead_time",
    ).where("section = 'summary' OR key IS NOT NULL")
    rank = f"row_number() OVER (PARTITION BY {guest}, section ORDER BY doc_count DESC, key) AS _rank"
    kept = sections.selectExpr("*", rank).where(F.col("_rank") <= 10).drop("_rank")
    # At most 21 rows for each value; the two values with most rows stay.
    by_guest = kept.groupBy(guest).agg(
        F.max(F.expr("IF(section = 'summary', doc_count, NULL)")).alias("_total"),
        F.collect_list(F.struct("section", "key", "doc_count", "average_lead_time")).alias("_rows"),
    )
    best = by_guest.orderBy(F.desc("_total"), F.asc(guest)).limit(2)
    return best.select(guest, F.explode("_rows").alias("_row")).select(guest, "_row.*")


REPORTS: dict[str, Report] = {
    "cancellation_rate": Report(
        keys={"market_segment": "market_segment", "hotel": "hotel"},
        metrics=_CANCELLATION,
        rank=lambda pairs: nested_top(
            pairs, "market_segment", "hotel", outer_count="segment_doc_count"
        ),
        columns=("market_segment", "segment_doc_count", "hotel", "doc_count", "cancellation_rate"),
    ),
    "adr_by_month": Report(
        keys={"month": _MONTH, "hotel": "hotel"},
        metrics=_ADR,
        rank=lambda pairs: months_then_top(pairs, "hotel"),
        columns=("month", "month_doc_count", "hotel", "doc_count", "average_adr"),
    ),
    "top_countries": _simple("country"),
    "length_of_stay": _simple("length_of_stay", sql=f"string({TOTAL_NIGHTS})"),
    "booking_trends": Report(
        keys={"month": _MONTH},
        rank=lambda counted: _months_as_text(fill_months(counted)),
        columns=("month", "doc_count"),
    ),
    "special_requests": _simple("total_of_special_requests", _CANCELLATION),
    "lead_time_by_status": _simple("is_canceled", _LEAD),
    "room_types": _simple("reserved_room_type"),
    "guest_country": _simple("country"),
    "booking_source": _simple("distribution_channel", size=5),
    "revenue": Report(
        keys={"reserved_room_type": "reserved_room_type", "month": _MONTH},
        metrics={"revenue": ("sum", "revenue")},
        rank=lambda pairs: _months_as_text(
            top_then_months(pairs, "reserved_room_type", outer_count="room_doc_count")
        ),
        columns=("reserved_room_type", "room_doc_count", "month", "doc_count", "revenue"),
    ),
    "lead_time_adr": Report(
        keys={"lead_time_bucket": "double(floor(lead_time / 10) * 10)"},
        metrics=_ADR,
        rank=lambda counted: counted.where("lead_time_bucket IS NOT NULL"),
        columns=("lead_time_bucket", "doc_count", "average_adr"),
    ),
    "repeat_guests": Report(
        keys={"is_repeated_guest": "is_repeated_guest", "country": "country", "hotel": "hotel"},
        metrics={"lead_time_sum": ("sum", "lead"), "lead_time_count": ("count", "lead")},
        rank=_repeat_guests,
        columns=("is_repeated_guest", "section", "key", "doc_count", "average_lead_time"),
    ),
    "adr_factors": _simple("adr", {**_CANCELLATION, **_STAY, **_REQUESTS}, order="key"),
    "cancel_factors": _simple("is_canceled", {**_LEAD, **_STAY, **_REQUESTS}, size=2),
    "composition": _simple(
        "booking_composition", {**_LEAD, **_STAY, **_REQUESTS}, sql=COMPOSITION
    ),
}


def report(name: str, df: DataFrame) -> DataFrame:
    """One report over a cleaned bookings table."""
    spec = REPORTS[name]
    counted = count_by(df, spec.keys, spec.from_rows())
    return spec.rank(counted).select(*spec.columns)


#: SQL of every key of a base, in a fixed order.
BASE_KEYS = {key: sql for base in BASES for key in base for spec in REPORTS.values() for name, sql in spec.keys.items() if name == key}
SUMS = [f"{m}_{part}" for m in MEASURES for part in ("sum", "count")]


def base_sums(df: DataFrame, sign: int = 1) -> DataFrame:
    """(base, the keys of all bases, doc_count, a sum and a count for each measure): one row for each group of each base.

    One scan and one shuffle (grouping sets). Keys that are not the base's are null. With ``sign=-1`` the rows count as taken away.
    """
    rows = df.select(
        *[F.expr(sql).alias(f"k_{key}") for key, sql in BASE_KEYS.items()],
        *[F.expr(sql).alias(f"m_{m}") for m, sql in MEASURES.items()],
    )
    keys = [f"k_{key}" for key in BASE_KEYS]
    sums = []
    for m, sql in MEASURES.items():
        sums += [(F.sum(f"m_{m}") * sign).alias(f"{m}_sum"), (F.count(f"m_{m}") * sign).alias(f"{m}_count")]
    grouped = rows.groupingSets([[f"k_{key}" for key in base] for base in BASES], *keys).agg(
        F.grouping_id().alias("_set"), (F.count(F.lit(1)) * sign).alias("doc_count"), *sums
    )
    # The grouping number has a 1 bit for every key left out, first key highest.
    numbers = {int("".join("0" if key in base else "1" for key in BASE_KEYS), 2): n for n, base in enumerate(BASES)}
    cases = " ".join(f"WHEN {number} THEN {n}" for number, n in numbers.items())
    named = [F.col(f"k_{key}").alias(key) for key in BASE_KEYS]
    return grouped.select(F.expr(f"CASE _set {cases} END").alias("base"), *named, "doc_count", *SUMS)


def reports_from_sums(sums: DataFrame) -> dict[str, DataFrame]:
    """All reports by name, rolled up from :func:`base_sums`."""
    out = {}
    for name, spec in REPORTS.items():
        base = sums.where(F.col("base") == BASES.index(spec.base()))
        metrics = [F.expr(sql).alias(metric) for metric, sql in spec.from_sums().items()]
        counted = base.groupBy(*spec.keys).agg(F.sum("doc_count").alias("doc_count"), *metrics)
        out[name] = spec.rank(counted).select(*spec.columns)
    return out


def all_reports(df: DataFrame) -> dict[str, DataFrame]:
    """All sixteen reports by name over one shared pass.

    The sums are written once to the shared folder: each report
    filters and prunes them differently, which would otherwise repeat the scan.
    """
    return reports_from_sums(stored(base_sums(df), "sums"))


def report_values(reports: Mapping[str, DataFrame]) -> DataFrame:
    """(report, labels, metric, value) of all given reports as one table: their labels joined by '|', a row for each value."""
    parts = []
    for name, frame in reports.items():
        labels = REPORTS[name].labels()
        values = [c for c in frame.columns if c not in labels]
        cells = ", ".join(f"struct('{c}' AS metric, double(`{c}`) AS value)" for c in values)
        told = F.concat_ws("|", *[F.col(c).cast("string") for c in labels])
        parts.append(frame.select(F.lit(name).alias("report"), told.alias("labels"), F.expr(f"inline(array({cells}))")))
    return reduce(DataFrame.unionByName, parts)


def report_sizes(df: DataFrame) -> DataFrame:
    """(report, n_rows) for all reports as one query."""
    counts = [
        frame.agg(F.count(F.lit(1)).alias("n_rows")).selectExpr(f"'{name}' AS report", "n_rows")
        for name, frame in all_reports(df).items()
    ]
    return reduce(DataFrame.unionByName, counts)
