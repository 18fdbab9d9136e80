"""Headline queries, timed: prints one JSON line.

The cleaned table is stored once as Parquet, as in use; reports, searches and
aggregations then read it. Cleaning itself is timed from the raw rows. Inputs are
stored in one file per core, since a single small file cannot be read in parallel.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodgeframe.fixture import bookings, bookings_raw
from lodgeframe.operators import buckets, cleaning, fulltext, metrics, profiling, search, textindex
from lodgeframe.operators.upsert import upsert
from lodgeframe.plans.reports import REPORTS, all_reports, report, report_values
from lodgeframe.schema import TABLE_COLUMNS
from lodgeframe.session import build_session
from lodgeframe.sources.table import read_bookings
from lodgeframe.sources.workspace import fresh_path

RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "7g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    raw_path, table_path = fresh_path(spark, "raw"), fresh_path(spark, "table")
    bookings_raw(spark, sf_dir).repartition(int(cpus)).write.parquet(raw_path)
    raw = spark.read.parquet(raw_path)
    start = time.perf_counter()
    cleaning.clean(raw).select(*TABLE_COLUMNS).write.parquet(table_path)
    load = time.perf_counter() - start
    table = read_bookings(spark, table_path)
    text_path = fresh_path(spark, "documents")
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(int(cpus)).write.parquet(text_path)
    documents = spark.read.parquet(text_path)
    index_path = fresh_path(spark, "tokens")
    textindex.build(documents, ["text"], index_path, "doc_id")
    changes = table.where("id % 10 = 0").selectExpr("id", "adr + 1 AS adr", "hotel")

    headline = {
        "clean_bookings": lambda: cleaning.clean(raw),
        "outlier_thresholds": lambda: cleaning.outlier_thresholds(cleaning.fill_median(raw)),
        **{f"report_{name}": (lambda n=name: report(n, table)) for name in REPORTS},
        "all_reports": lambda: report_values(all_reports(table)),
        "dynamic_aggregate": lambda: metrics.aggregate(
            table, [("adr", "avg"), ("lead_time", "stats"), ("hotel", "terms"), ("country", "terms")]
        ),
        "metric_percentiles": lambda: metrics.metric(table, "adr", "percentiles"),
        "nested_terms": lambda: buckets.nested_terms(
            table, "country", "meal", {"average_adr": "avg(adr)"}
        ),
        "describe": lambda: profiling.describe(table),
        "classify_columns": lambda: profiling.classify_columns(table),
        "correlation_matrix": lambda: profiling.correlation_matrix(table),
        "search": lambda: search.search(
            table,
            must={"hotel": "City Hotel"},
            must_not={"country": "United Kingdom"},
            should={"meal": "BB", "adults": 3},
            ranges={"lead_time": {"gte": 10, "lt": 300}},
        ),
        "suggest": lambda: fulltext.suggest(table, "s", "country_suggest"),
        "full_text_search": lambda: fulltext.full_text_search(
            documents, "worthles there", ["text"], key="doc_id"
        ),
        "full_text_indexed": lambda: textindex.search(spark, index_path, "worthles there", ["text"]),
        "upsert_by_id": lambda: upsert(table, changes),
        "end_to_end_cancellation_rate": lambda: report(
            "cancellation_rate", bookings(spark, sf_dir, "market_segment", "hotel", "is_canceled")
        ),
    }
    only = os.environ.get("BENCH_ONLY", "").split()
    times: dict[str, float] = {}
    for name, build in headline.items():
        if only and name not in only:
            continue
        taken = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
            spark.catalog.clearCache()
        times[name] = round(statistics.median(taken[1:]), 4)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "load_sec": round(load, 4),
                "rows": table.count(),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
