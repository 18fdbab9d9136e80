"""Bookings derived from the star-schema tables ``orders`` and ``customer``.

One SQL text is valid in Spark and in the checking database, so both sides start
from the same rows. Every booking is one order; nothing is sampled or cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodgeframe.operators.cleaning import clean

RAW_BOOKINGS_SQL = """
WITH b AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS c, CAST(o.o_orderdate AS DATE) AS d,
         CAST(floor(o.o_totalprice) AS BIGINT) AS p, o.o_orderpriority AS pr,
         cu.c_nationkey AS n, cu.c_mktsegment AS seg
  FROM orders o JOIN customer cu ON o.o_custkey = cu.c_custkey
)
SELECT
  k AS id,
  CASE WHEN n % 3 = 0 THEN 'Resort Hotel' ELSE 'City Hotel' END AS hotel,
  CAST(CASE WHEN (k * 31 + c * 17) % 100 < 37 THEN 1 ELSE 0 END AS INT) AS is_canceled,
  CAST(CASE WHEN k % 997 = 0 THEN 737 ELSE (k * 7 + c * 13) % 320 END AS INT) AS lead_time,
  CAST(extract(year FROM d) AS INT) AS arrival_date_year,
  CASE CAST(extract(month FROM d) AS INT) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March'
    WHEN 4 THEN 'April' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August'
    WHEN 9 THEN 'September' WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END AS arrival_date_month,
  CAST(extract(week FROM d) AS INT) AS arrival_date_week_number,
  CAST(extract(day FROM d) AS INT) AS arrival_date_day_of_month,
  CAST((k + c) % 3 AS INT) AS stays_in_weekend_nights,
  CAST((k * 5 + c * 3) % 11 AS INT) AS stays_in_week_nights,
  CAST(CASE WHEN k % 2003 = 0 THEN 55 ELSE 1 + (k + 2 * c) % 3 END AS INT) AS adults,
  CASE WHEN k % 499 = 3 THEN NULL WHEN k % 11 = 0 THEN CAST(1 + k % 3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS children,
  CAST(CASE WHEN k % 150 = 0 THEN 1 + k % 2 ELSE 0 END AS INT) AS babies,
  CASE (k + c) % 5 WHEN 0 THEN 'BB' WHEN 1 THEN 'HB' WHEN 2 THEN 'FB' WHEN 3 THEN 'SC' ELSE 'Undefined' END AS meal,
  CASE WHEN k % 245 = 7 THEN NULL ELSE
    CASE n WHEN 0 THEN 'PRT' WHEN 1 THEN 'GBR' WHEN 2 THEN 'FRA' WHEN 3 THEN 'ESP' WHEN 4 THEN 'DEU' WHEN 5 THEN 'ITA'
      WHEN 6 THEN 'IRL' WHEN 7 THEN 'BEL' WHEN 8 THEN 'BRA' WHEN 9 THEN 'NLD' WHEN 10 THEN 'USA' WHEN 11 THEN 'CHE'
      WHEN 12 THEN 'CN' WHEN 13 THEN 'AUT' WHEN 14 THEN 'SWE' WHEN 15 THEN 'CHN' WHEN 16 THEN 'POL' WHEN 17 THEN 'ISR'
      WHEN 18 THEN 'RUS' WHEN 19 THEN 'NOR' WHEN 20 THEN 'ROU' WHEN 21 THEN 'CAF' WHEN 22 THEN 'KOR' WHEN 23 THEN 'TMP'
      ELSE 'XXX' END END AS country,
  seg AS market_segment,
  CASE pr WHEN '1-URGENT' THEN 'Direct' WHEN '2-HIGH' THEN 'Corporate' WHEN '3-MEDIUM' THEN 'TA/TO' WHEN '5-LOW' THEN 'GDS' ELSE 'Undefined' END AS distribution_channel,
  CAST(CASE WHEN c % 33 = 0 THEN 1 ELSE 0 END AS INT) AS is_repeated_guest,
  CAST(CASE WHEN k % 20 = 0 THEN k % 7 ELSE 0 END AS INT) AS previous_cancellations,
  CAST(CASE WHEN c % 33 = 0 THEN k % 9 ELSE 0 END AS INT) AS previous_bookings_not_canceled,
  substr('ABCDEFGHLP', CAST(1 + (k * 3 + c) % 10 AS INT), 1) AS reserved_room_type,
  substr('ABCDEFGHIKLP', CAST(1 + (k * 3 + c) % 12 AS INT), 1) AS assigned_room_type,
  CAST(CASE WHEN k % 7 = 0 THEN k % 4 ELSE 0 END AS INT) AS booking_changes,
  CASE k % 8 WHEN 0 THEN 'Non Refund' WHEN 1 THEN 'Refundable' ELSE 'No Deposit' END AS deposit_type,
  CASE WHEN k % 7 = 2 THEN NULL ELSE CAST(1 + c % 300 AS DOUBLE) END AS agent,
  CASE WHEN k % 16 = 0 THEN CAST(1 + c % 90 AS DOUBLE) ELSE NULL END AS company,
  CAST(CASE WHEN k % 40 = 0 THEN (k * 3) % 390 ELSE 0 END AS INT) AS days_in_waiting_list,
  CASE c % 4 WHEN 0 THEN 'Transient' WHEN 1 THEN 'Contract' WHEN 2 THEN 'Group' ELSE 'Transient-Party' END AS customer_type,
  CASE WHEN k = 1 THEN CAST(-638 AS DOUBLE) / 100 WHEN k = 2 THEN CAST(5400 AS DOUBLE) WHEN k = 4 THEN CAST(-9999 AS DOUBLE) ELSE CAST(p % 30000 AS DOUBLE) / 100 END AS adr,
  CAST(CASE WHEN k % 16 = 1 THEN 1 ELSE 0 END AS INT) AS required_car_parking_spaces,
  CAST((k * 11 + c) % 6 AS INT) AS total_of_special_requests,
  CASE WHEN (k * 31 + c * 17) % 100 < 37 THEN CASE WHEN k % 30 = 0 THEN 'No-Show' ELSE 'Canceled' END ELSE 'Check-Out' END AS reservation_status,
  d + CAST((k + c) % 13 AS INT) AS reservation_status_date
FROM b
"""


def bookings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncleaned bookings with their ``id``: 33 columns, nulls in four of them."""
    tables = {
        name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("orders", "customer")
    }
    text = RAW_BOOKINGS_SQL.replace("FROM orders o", "FROM {orders} o").replace(
        "JOIN customer cu", "JOIN {customer} cu"
    )
    return spark.sql(text, **tables)


def bookings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Cleaned bookings, optionally only the named columns; a pruned read leaves the null gate out."""
    return clean(bookings_raw(spark, sf_dir), columns=list(columns) or None, gate=not columns)
