"""Column types, field kinds and fixed values of the bookings table."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
}

# The uploaded file: 32 columns, in file order.
RAW_COLUMNS: dict[str, str] = {
    "hotel": "string",
    "is_canceled": "int",
    "lead_time": "int",
    "arrival_date_year": "int",
    "arrival_date_month": "string",
    "arrival_date_week_number": "int",
    "arrival_date_day_of_month": "int",
    "stays_in_weekend_nights": "int",
    "stays_in_week_nights": "int",
    "adults": "int",
    "children": "double",
    "babies": "int",
    "meal": "string",
    "country": "string",
    "market_segment": "string",
    "distribution_channel": "string",
    "is_repeated_guest": "int",
    "previous_cancellations": "int",
    "previous_bookings_not_canceled": "int",
    "reserved_room_type": "string",
    "assigned_room_type": "string",
    "booking_changes": "int",
    "deposit_type": "string",
    "agent": "double",
    "company": "double",
    "days_in_waiting_list": "int",
    "customer_type": "string",
    "adr": "double",
    "required_car_parking_spaces": "int",
    "total_of_special_requests": "int",
    "reservation_status": "string",
    "reservation_status_date": "date",
}

CLEAN_COLUMNS: dict[str, str] = {**RAW_COLUMNS, "arrival_date": "date"}
TABLE_COLUMNS: dict[str, str] = {"id": "bigint", **CLEAN_COLUMNS}

NUMERIC_COLUMNS = [c for c, t in RAW_COLUMNS.items() if t in ("int", "double")]


def struct_of(columns: dict[str, str]) -> T.StructType:
    """StructType for a name -> type mapping; ``id`` is the only required field."""
    return T.StructType(
        [
            T.StructField("id", T.LongType(), False)
            if name == "id"
            else T.StructField(name, _TYPES[kind], True)
            for name, kind in columns.items()
        ]
    )


def all_strings(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


RAW_SCHEMA = struct_of(RAW_COLUMNS)
CLEAN_SCHEMA = struct_of(CLEAN_COLUMNS)
TABLE_SCHEMA = struct_of(TABLE_COLUMNS)

# How a condition or aggregation treats a field. Text fields have an analysed
# form (matching) and an exact form (grouping); here both are one string column.
FIELD_KINDS: dict[str, str] = {
    name: {"string": "text", "date": "date"}.get(kind, "number")
    for name, kind in TABLE_COLUMNS.items()
}

# Completion fields and the column each one completes.
SUGGEST_FIELDS: dict[str, str] = {
    "hotel_suggest": "hotel",
    "country_suggest": "country",
    "reservation_status_suggest": "reservation_status",
}

OUTLIER_COLUMNS = [
    "lead_time",
    "adr",
    "days_in_waiting_list",
    "adults",
    "children",
    "babies",
    "previous_cancellations",
    "previous_bookings_not_canceled",
]

MEDIAN_FILLED = ["children"]
CONSTANT_FILLS: dict[str, object] = {"country": "Unknown", "agent": 0.0, "company": 0.0}

FACET_COLUMNS = [
    "hotel",
    "is_canceled",
    "country",
    "market_segment",
    "distribution_channel",
    "is_repeated_guest",
    "reserved_room_type",
    "booking_changes",
    "deposit_type",
    "customer_type",
    "meal",
    "total_of_special_requests",
    "reservation_status",
    "reservation_status_date",
]

# English month names, in calendar order.
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
]

# Cells read as null in an uploaded file, besides the empty cell.
NA_TOKENS = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]


def resolve_field(name: str) -> tuple[str, str]:
    """(column, kind) for a field name; completion fields resolve to their column."""
    if name in SUGGEST_FIELDS:
        return SUGGEST_FIELDS[name], "suggest"
    if name in FIELD_KINDS:
        return name, FIELD_KINDS[name]
    raise ValueError(f"unknown field: {name}")
