"""Display shapes of report results: renames, pivots, labels, text payloads.

Inputs are report results, which are small; nothing here touches the table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOTELS = ["City Hotel", "Resort Hotel"]
_STATUS = """CASE {0} WHEN 0 THEN 'Not Cancelled' WHEN 1 THEN 'Cancelled'
                  ELSE string({0}) END"""

# Reports that are shown as they are, under display names.
RENAMES: dict[str, dict[str, str]] = {
    "top_countries": {"country": "Country", "doc_count": "Booking Counts"},
    "special_requests": {"total_of_special_requests": "Special Requests", "doc_count": "Counts"},
    "room_types": {"reserved_room_type": "Room Type", "doc_count": "Bookings"},
    "guest_country": {"country": "Country", "doc_count": "Bookings"},
    "booking_source": {"distribution_channel": "Source", "doc_count": "Bookings"},
    "lead_time_adr": {"lead_time_bucket": "Lead Time", "average_adr": "Average ADR"},
}


def shape_report(name: str, df: DataFrame) -> DataFrame:
    """Select and rename the displayed columns of a report."""
    return df.select(*[F.col(old).alias(new) for old, new in RENAMES[name].items()])


def shape_all_renames(reports: dict[str, DataFrame]) -> DataFrame:
    """All renamed reports in one long table: report, key_label, key, value_label, value."""
    parts = []
    for name, labels in RENAMES.items():
        key, value = labels.values()
        parts.append(
            shape_report(name, reports[name]).selectExpr(
                f"'{name}' AS report",
                f"'{key}' AS key_label",
                f"CAST(`{key}` AS string) AS key",
                f"'{value}' AS value_label",
                f"CAST(`{value}` AS double) AS value",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def pivot_cancellation_rate(report: DataFrame) -> DataFrame:
    """One row per segment, one rate column per hotel; a missing combination is 0."""
    pivot = report.groupBy("market_segment").pivot("hotel", HOTELS).agg(F.first("cancellation_rate"))
    return pivot.select(
        F.col("market_segment").alias("Market Segment"),
        *[F.coalesce(F.col(h), F.lit(0.0)).alias(f"{h} Cancellation Rate") for h in HOTELS],
    )


def mean_of_segment_rates(report: DataFrame) -> DataFrame:
    """Per hotel the plain mean over segments (not weighted by bookings)."""
    wide = pivot_cancellation_rate(report)
    means = wide.agg(*[F.avg(f"{h} Cancellation Rate").alias(h) for h in HOTELS])
    return means.unpivot([], HOTELS, "Hotel Type", "Average Cancellation Rate")


def pivot_adr_by_month(report: DataFrame) -> DataFrame:
    """One row per month, one rate column per hotel; a missing combination stays null."""
    pivot = report.groupBy("month").pivot("hotel", HOTELS).agg(F.first("average_adr"))
    return pivot.select(
        F.date_format("month", "yyyy-MM").alias("Month"),
        *[F.col(h).alias(f"{h.split()[0]} Hotel ADR") for h in HOTELS],
    )


def shape_length_of_stay(report: DataFrame) -> DataFrame:
    """Nights as numbers in numeric order."""
    return report.selectExpr(
        "CAST(length_of_stay AS int) AS `Length of Stay`", "doc_count AS Counts"
    ).orderBy("Length of Stay")


def shape_lead_time_status(report: DataFrame) -> DataFrame:
    return report.selectExpr(
        f"{_STATUS.format('is_canceled')} AS `Cancellation Status`",
        "average_lead_time AS `Average Lead Time`",
    )


def trend_peaks(report: DataFrame) -> DataFrame:
    """Months in order, with a flag on every month that reaches the highest count."""
    peak = report.agg(F.max("doc_count").alias("_peak"))
    return (
        report.crossJoin(F.broadcast(peak))
        .selectExpr("month AS Date", "doc_count", "doc_count = _peak AS is_peak")
        .orderBy("Date")
    )


def flatten_revenue(report: DataFrame) -> DataFrame:
    """Room, month, revenue as a number and as text with separators."""
    return report.selectExpr(
        "reserved_room_type AS `Room Type`",
        "month AS Month",
        "revenue AS Revenue",
        "format_number(revenue, 2) AS `Revenue Text`",
    )


def group_revenue_series(report: DataFrame) -> DataFrame:
    """One row per room type with its (month, revenue) series in month order."""
    return report.groupBy(F.col("reserved_room_type").alias("Room Type")).agg(
        F.array_sort(F.collect_list(F.struct("month", "revenue"))).alias("series")
    )


def shape_composition(report: DataFrame) -> DataFrame:
    return report.selectExpr(
        "replace(booking_composition, '.0', '') AS `Booking Composition`",
        "doc_count AS `Number of Bookings`",
    )


def shape_cancel_factors(report: DataFrame) -> DataFrame:
    """Averages per status, labelled by the status itself rather than by row position."""
    return report.selectExpr(
        f"{_STATUS.format('is_canceled')} AS `Cancellation Status`",
        "special_requests_count AS `Special Requests Count`",
        "average_stay_length AS `Average Stay Length`",
        "average_lead_time AS `Average Lead Time`",
    )


def shape_repeat_guests(report: DataFrame) -> DataFrame:
    return report.where("section = 'hotel'").selectExpr(
        """concat_ws(' - ', if(is_repeated_guest = 1, 'Repeat Guests', 'First-time Guests'), key)
           AS `Guest Type`""",
        "doc_count AS `Number of Bookings`",
    )


def adr_factor_matrix(report: DataFrame) -> DataFrame:
    """(adr, factor, value): the three factors of every listed rate."""
    factors = {
        "special_requests_count": "Special Requests Count",
        "cancellation_rate": "Cancellation Rate",
        "average_stay_length": "Average Stay Length",
    }
    named = report.select("adr", *[F.col(c).alias(label) for c, label in factors.items()])
    return named.unpivot(["adr"], list(factors.values()), "factor", "value")


def report_payload(name: str, df: DataFrame) -> DataFrame:
    """One row (report, payload): the shaped result as JSON text, one object per row.

    ``df`` is a shaped report; its rows are few by construction.
    """
    rows = F.array_sort(F.collect_list(F.struct(*df.columns)))
    return df.agg(F.to_json(rows).alias("payload")).selectExpr(f"'{name}' AS report", "payload")


def shape_dynamic_aggregate(df: DataFrame) -> DataFrame:
    """Ad-hoc results for display: term rows keep key and count, metrics get a label."""
    return df.selectExpr(
        "if(doc_count IS NULL, concat(field, ' (', type, ')'), agg) AS label",
        "key",
        "coalesce(double(doc_count), value) AS value",
    )


SHAPES: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "pivot_cancellation_rate": ("cancellation_rate", pivot_cancellation_rate),
    "mean_of_segment_rates": ("cancellation_rate", mean_of_segment_rates),
    "pivot_adr_by_month": ("adr_by_month", pivot_adr_by_month),
    "shape_length_of_stay": ("length_of_stay", shape_length_of_stay),
    "shape_lead_time_status": ("lead_time_by_status", shape_lead_time_status),
    "trend_peaks": ("booking_trends", trend_peaks),
    "flatten_revenue": ("revenue", flatten_revenue),
    "group_revenue_series": ("revenue", group_revenue_series),
    "shape_composition": ("composition", shape_composition),
    "shape_cancel_factors": ("cancel_factors", shape_cancel_factors),
    "shape_repeat_guests": ("repeat_guests", shape_repeat_guests),
    "adr_factor_matrix": ("adr_factors", adr_factor_matrix),
}
