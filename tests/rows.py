"""Small hand-written bookings."""

from __future__ import annotations

import datetime as dt

from lodgeframe.schema import RAW_SCHEMA, TABLE_SCHEMA

DEFAULTS = dict(
    hotel="City Hotel", is_canceled=0, lead_time=10, arrival_date_year=2016,
    arrival_date_month="July", arrival_date_week_number=27, arrival_date_day_of_month=1,
    stays_in_weekend_nights=1, stays_in_week_nights=2, adults=2, children=0.0, babies=0,
    meal="BB", country="PRT", market_segment="Direct", distribution_channel="Direct",
    is_repeated_guest=0, previous_cancellations=0, previous_bookings_not_canceled=0,
    reserved_room_type="A", assigned_room_type="A", booking_changes=0,
    deposit_type="No Deposit", agent=1.0, company=1.0, days_in_waiting_list=0,
    customer_type="Transient", adr=100.0, required_car_parking_spaces=0,
    total_of_special_requests=0, reservation_status="Check-Out",
    reservation_status_date=dt.date(2016, 7, 4),
)


def raw(spark, changes: list[dict]):
    rows = [{**DEFAULTS, **c} for c in changes]
    return spark.createDataFrame([tuple(r[f] for f in RAW_SCHEMA.names) for r in rows], RAW_SCHEMA)


def table(spark, changes: list[dict]):
    rows = [
        {"id": i + 1, **DEFAULTS, "arrival_date": dt.date(2016, 7, 1), **c}
        for i, c in enumerate(changes)
    ]
    data = [tuple(r[f] for f in TABLE_SCHEMA.names) for r in rows]
    return spark.createDataFrame(data, TABLE_SCHEMA)


def values(df, *columns) -> list:
    picked = df.select(*columns) if columns else df
    return [tuple(r) if len(r) > 1 else r[0] for r in picked.collect()]
