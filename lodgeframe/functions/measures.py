"""Derived booking measures used by several reports, as SQL expressions."""

from __future__ import annotations

TOTAL_NIGHTS = "stays_in_weekend_nights + stays_in_week_nights"
REVENUE = f"adr * ({TOTAL_NIGHTS})"
# ``children`` is a double and keeps its fraction in the label: '2 adults, 0.0 children, 0 babies'.
COMPOSITION = (
    "concat(adults, ' adults, ', double(children), ' children, ', babies, ' babies')"
)
MONTH = "trunc(arrival_date, 'MM')"
