"""Every operator as a named query over the star-schema tables.

Each query takes (spark, sf_dir) and returns a DataFrame built from the whole
tables. Averages and sums are rounded here, so that results do not depend on the
order in which doubles are added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeframe import schema
from lodgeframe.countries import country_dimension
from lodgeframe.fixture import bookings, bookings_raw
from lodgeframe.functions.measures import COMPOSITION, REVENUE, TOTAL_NIGHTS
from lodgeframe.functions.text import clean_markdown, tokens
from lodgeframe.operators import buckets, cleaning, fulltext, metrics, profiling, search, sketches, textindex
from lodgeframe.operators.upsert import upsert
from lodgeframe.plans import rollups, shaping
from lodgeframe.plans.reports import REPORTS, all_reports, report, report_values
from lodgeframe.schema import OUTLIER_COLUMNS, RAW_COLUMNS, TABLE_COLUMNS
from lodgeframe.sources import files, keyed, table
from lodgeframe.sources.workspace import fresh_path, stored, tidy_session
from lodgeframe.streaming import uploads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STAMP = "20240101000000"


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; the nudge keeps exact halves from flipping with the order of addition."""
    return df.select(
        *[
            F.round(F.col(f"`{c}`") + 1e-9, digits).alias(c) if t == "double" else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


# --- sources and sinks -------------------------------------------------------


def _stored_table(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "bookings")
    bookings(spark, sf_dir).select(*TABLE_COLUMNS).write.parquet(path)
    return path


@query("scan_bookings_csv")
def _(spark, sf_dir):
    path = fresh_path(spark, "upload")
    bookings_raw(spark, sf_dir).write.options(**files.CSV_OPTIONS).csv(path)
    return files.read_bookings_csv(spark, path)


@query("scan_quoted_lines")
def _(spark, sf_dir):
    marked = bookings(spark, sf_dir).withColumn("hotel", F.expr("concat(hotel, ',\n\"', meal, '\"\n', country)"))
    return files.read_clean_csv(spark, files.write_clean_csv(marked, fresh_path(spark, "quoted"), STAMP))


def _upload_with_bad_rows(spark, sf_dir) -> str:
    """Raw bookings as text lines; of some the lead time is no number, others lack their last cells."""
    path = fresh_path(spark, "upload")
    rows = bookings_raw(spark, sf_dir).withColumn("lead_time", F.expr("if(id % 97 = 5, concat('x', lead_time), string(lead_time))"))
    cells = ", ".join(f"coalesce(string(`{c}`), '')" for c in rows.columns)
    torn = f"if(id % 89 = 7, concat_ws(',', slice(array({cells}), 1, 20)), concat_ws(',', {cells}))"
    header = f"'{','.join(rows.columns)}'"
    # A file for each partition, all with the header; one more holds nothing else, as there may be no rows.
    first = "monotonically_increasing_id() % 8589934592 = 0"
    lines = rows.selectExpr(f"{torn} AS line").selectExpr(f"explode(IF({first}, array({header}, line), array(line))) AS value")
    spark.range(0, 1, 1, 1).selectExpr(f"{header} AS value").unionByName(lines).write.text(path)
    return path


@query("quarantine_good_rows")
def _(spark, sf_dir):
    good, _ = files.quarantine_bookings_csv(spark, _upload_with_bad_rows(spark, sf_dir))
    return good


@query("quarantine_rejects")
def _(spark, sf_dir):
    base = fresh_path(spark, "rejects")
    _, bad = files.quarantine_bookings_csv(spark, _upload_with_bad_rows(spark, sf_dir))
    files.write_rejects(bad, base)
    return spark.read.parquet(base).selectExpr(
        "bigint(if(reason = 'torn', split(row, ',')[0], get_json_object(row, '$.id'))) AS id",
        "reason",
        "bad_columns",
        "place >= 0 AND file LIKE '%.txt' AS placed",
    )


@query("scan_clean_csv")
def _(spark, sf_dir):
    base = fresh_path(spark, "clean")
    return files.read_clean_csv(spark, files.write_clean_csv(bookings(spark, sf_dir), base, STAMP))


@query("scan_bookings_table")
def _(spark, sf_dir):
    return table.read_bookings(spark, _stored_table(spark, sf_dir))


@query("scan_latest_file")
def _(spark, sf_dir):
    folder, clean = fresh_path(spark, "uploads"), stored(bookings(spark, sf_dir), "clean")
    for stamp in ("1", "2"):  # the whole table twice; the upload is told by its marked hotels
        marked = clean.withColumn("hotel", F.concat("hotel", F.lit(f" {stamp}")))
        files.write_clean_csv(marked, folder, stamp)
    return files.read_latest(spark, folder)


@query("sink_clean_csv")
def _(spark, sf_dir):
    path = files.write_clean_csv(bookings(spark, sf_dir), fresh_path(spark, "clean"), STAMP)
    written = spark.read.options(**files.CSV_OPTIONS).csv(path).na.fill("")
    return written.select("id", "hotel", "country", "lead_time", "market_segment", "adr", "arrival_date", "reservation_status_date")


@query("append_bookings")
def _(spark, sf_dir):
    path = fresh_path(spark, "table")
    clean = bookings(spark, sf_dir)
    table.append_bookings(clean, path)
    table.append_bookings(clean, path)
    stored = table.read_bookings(spark, path)
    ids = stored.selectExpr(
        "struct(count(1) AS n_rows, count(DISTINCT id) AS n_ids, min(id) AS min_id, max(id) AS max_id) AS ids"
    ).scalar()
    return rounded(stored.drop("id").withColumn("ids", ids).select("*", "ids.*").drop("ids"))


@query("bootstrap_if_empty")
def _(spark, sf_dir):
    base = fresh_path(spark, "boot")
    csv = files.write_clean_csv(bookings(spark, sf_dir).drop("id"), base, STAMP)
    for _ in range(2):
        table.bootstrap_if_empty(spark, f"{base}/table", csv, f"{base}/index")
    return rounded(spark.read.parquet(f"{base}/index").drop("id", *schema.SUGGEST_FIELDS))


@query("to_documents")
def _(spark, sf_dir):
    docs = table.to_documents(bookings(spark, sf_dir, "id", "hotel", "country", "reservation_status"))
    return docs.selectExpr(
        "id", "hotel", "country", "reservation_status",
        *[f"{s}.input[0] AS {s}_input" for s in schema.SUGGEST_FIELDS],
    )


@query("bulk_insert")
def _(spark, sf_dir):
    path = fresh_path(spark, "index")
    table.append_documents(table.to_documents(bookings(spark, sf_dir)), path)
    return spark.read.parquet(path).drop(*schema.SUGGEST_FIELDS)


def _updates(spark, sf_dir):
    """Changed copies of every third booking; of these every second one is a new id."""
    return (
        bookings(spark, sf_dir, "id", "hotel", "adr", "lead_time")
        .where("id % 3 = 0")
        .selectExpr(
            "if(id % 2 = 0, id, id + 1000000000) AS id",
            "concat(hotel, ' *') AS hotel",
            "if(id % 4 = 0, NULL, adr + 1) AS adr",
            "lead_time",
        )
    )


@query("upsert_by_id")
def _(spark, sf_dir):
    base = bookings(spark, sf_dir, "id", "hotel", "adr", "lead_time", "country", "is_canceled")
    return rounded(upsert(base, _updates(spark, sf_dir)))


@query("sync_snapshot")
def _(spark, sf_dir):
    base = fresh_path(spark, "sync")
    clean = bookings(spark, sf_dir).select(*TABLE_COLUMNS)
    # The copy holds two thirds, the table then another two thirds with other prices: a third each is kept, updated and new.
    clean.where("id % 3 <> 2").write.parquet(f"{base}/first")
    changed = clean.where("id % 3 <> 0").withColumns({"adr": F.expr("adr + 1"), "hotel": F.expr("concat(hotel, ' *')")})
    changed.write.parquet(f"{base}/second")
    table.sync(spark, f"{base}/first", None, f"{base}/copy1")
    return rounded(table.sync(spark, f"{base}/second", f"{base}/copy1", f"{base}/copy2"))


@query("sync_changed_buckets")
def _(spark, sf_dir):
    """Three syncs into one copy: the whole table, the same again, then one with changes in the rows of some buckets only."""
    path, clean = fresh_path(spark, "copy"), stored(bookings(spark, sf_dir).select(*TABLE_COLUMNS), "clean")
    for _ in range(2):
        keyed.sync_copy(clean, path)
    some = "pmod(xxhash64(id), 64) < 5"
    changed = clean.withColumn("hotel", F.expr(f"IF({some} AND id % 2 = 0, concat(hotel, ' *'), hotel)"))
    rewritten = keyed.sync_copy(changed.where(f"NOT ({some} AND id % 3 = 0)"), path)
    copy = keyed.read_copy(spark, path, schema.TABLE_SCHEMA)
    # The checking database has no such hash, so the marks are judged here: each where it should be.
    marked = F.expr(f"{some} AND id % 2 = 0 AND id % 3 <> 0") == F.col("hotel").endswith(" *")
    plain = F.regexp_replace("hotel", r" \*$", "")
    return rounded(copy.withColumns({"hotel": plain, "as_expected": marked & F.lit(rewritten == [0, 1, 2, 3, 4])}))


@query("field_catalogue")
def _(spark, sf_dir):
    columns = bookings(spark, sf_dir).dtypes
    rows = ", ".join(f"('{c}', '{t}', '{schema.FIELD_KINDS[c]}')" for c, t in columns)
    # The facts of the catalogue, joined to the number of rows that hold each field.
    held = profiling.column_profile(bookings(spark, sf_dir)).select("column", "non_nulls")
    return spark.sql(f"SELECT * FROM VALUES {rows} AS f(column, dtype, kind)").join(held, "column")


@query("sink_search_json")
def _(spark, sf_dir):
    hits = search.search(bookings(spark, sf_dir), must={"is_canceled": 1}, scored=False)
    path = files.write_hits_json(search.project_hits(hits), fresh_path(spark, "hits"), STAMP)
    return spark.read.schema(schema.CLEAN_SCHEMA).json(path)


@query("run_etl")
def _(spark, sf_dir):
    base = fresh_path(spark, "etl")
    bookings_raw(spark, sf_dir).drop("id").write.options(header=True, escape='"').csv(f"{base}/raw")
    table.run_etl(spark, f"{base}/raw", base, STAMP, f"{base}/table")
    return table.read_bookings(spark, f"{base}/table").drop("id")


# --- cleaning ----------------------------------------------------------------


@query("null_counts")
def _(spark, sf_dir):
    return cleaning.null_counts(bookings_raw(spark, sf_dir))


@query("fill_median")
def _(spark, sf_dir):
    return cleaning.fill_median(bookings_raw(spark, sf_dir)).select("id", "children")


@query("fill_constant")
def _(spark, sf_dir):
    return cleaning.fill_constants(bookings_raw(spark, sf_dir)).select(
        "id", "country", "agent", "company"
    )


@query("assert_no_nulls")
def _(spark, sf_dir):
    filled = cleaning.require_no_nulls(cleaning.fill_constants(cleaning.fill_median(bookings_raw(spark, sf_dir))))
    rows = cleaning.null_gate(bookings_raw(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_rows")).scalar()
    return cleaning.null_counts(filled).agg(F.sum("nulls").alias("total_nulls")).withColumn("gated_rows", rows)


@query("outlier_thresholds")
def _(spark, sf_dir):
    return rounded(cleaning.outlier_thresholds(bookings_raw(spark, sf_dir), median_filled=schema.MEDIAN_FILLED))


@query("detect_outliers")
def _(spark, sf_dir):
    filled = cleaning.fill_median(bookings_raw(spark, sf_dir))
    rules = [
        cleaning.detect_outliers(filled, detect=rule).withColumn("rule", F.lit(rule))
        for rule in ("reference", "two_sided")
    ]
    return rounded(rules[0].unionByName(rules[1]))


@query("suppress_outliers")
def _(spark, sf_dir):
    filled = cleaning.fill_median(bookings_raw(spark, sf_dir))
    return rounded(cleaning.suppress_outliers(filled).select("id", *OUTLIER_COLUMNS))


@query("suppress_outliers_two_sided")
def _(spark, sf_dir):
    filled = cleaning.fill_median(bookings_raw(spark, sf_dir))
    clipped = cleaning.suppress_outliers(filled, detect="two_sided")
    return rounded(clipped.select("id", *OUTLIER_COLUMNS))


@query("map_country")
def _(spark, sf_dir):
    filled = cleaning.fill_constants(bookings_raw(spark, sf_dir)).select("id", "country")
    return cleaning.map_country(filled, country_dimension(spark))


@query("build_arrival_date")
def _(spark, sf_dir):
    return cleaning.with_arrival_date(bookings_raw(spark, sf_dir)).select("id", "arrival_date")


@query("clean_bookings")
def _(spark, sf_dir):
    return rounded(bookings(spark, sf_dir))


@query("strict_cast")
def _(spark, sf_dir):
    raw = bookings_raw(spark, sf_dir)
    text = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    return cleaning.cast_bookings(text, {"id": "bigint", **RAW_COLUMNS})


@query("strict_cast_rejects")
def _(spark, sf_dir):
    raw = bookings_raw(spark, sf_dir).selectExpr(
        "id",
        "if(id % 97 = 5, concat('x', lead_time), string(lead_time)) AS lead_time",
        "if(id % 89 = 7, 'n.a.', string(adr)) AS adr",
    )
    bad = cleaning.cast_rejects(raw, RAW_COLUMNS)
    return bad.select("id", F.array_join("bad_columns", ",").alias("bad_columns"))


# --- profiling ---------------------------------------------------------------


@query("profile_shape")
def _(spark, sf_dir):
    return profiling.shape(bookings(spark, sf_dir))


@query("head")
def _(spark, sf_dir):
    return rounded(profiling.head(bookings(spark, sf_dir)))


@query("profile_columns")
def _(spark, sf_dir):
    return profiling.column_profile(bookings_raw(spark, sf_dir))


@query("describe")
def _(spark, sf_dir):
    return rounded(profiling.describe(bookings(spark, sf_dir)))


@query("classify_columns")
def _(spark, sf_dir):
    filled = cleaning.fill_constants(cleaning.fill_median(bookings_raw(spark, sf_dir).drop("id")))
    return profiling.classify_columns(filled)


@query("correlation_matrix")
def _(spark, sf_dir):
    return rounded(profiling.correlation_matrix(bookings(spark, sf_dir)))


@query("value_counts_filtered")
def _(spark, sf_dir):
    clean = bookings(spark, sf_dir, "country")
    return profiling.value_counts_where(clean, "country", "country = 'Unknown'")


@query("distinct_values")
def _(spark, sf_dir):
    return profiling.distinct_values(bookings(spark, sf_dir, *schema.FACET_COLUMNS))


@query("date_bounds")
def _(spark, sf_dir):
    return profiling.date_bounds(bookings(spark, sf_dir, "arrival_date"))


# --- structured search -------------------------------------------------------

_HIT = ["id", "hotel", "country", "adults", "lead_time", "adr"]


def _hits(df: DataFrame) -> DataFrame:
    return rounded(df.select(*_HIT))


def _searchable(spark, sf_dir):
    return bookings(
        spark, sf_dir, *_HIT, "meal", "market_segment", "is_canceled", "arrival_date",
        "reservation_status", "arrival_date_month",
    )


@query("match_exact")
def _(spark, sf_dir):
    return _hits(_searchable(spark, sf_dir).where(search.match("adults", 2)))


@query("match_text")
def _(spark, sf_dir):
    return _hits(_searchable(spark, sf_dir).where(search.match("country", "United kingdom")))


@query("filter_must")
def _(spark, sf_dir):
    where = search.condition(must={"hotel": "resort", "is_canceled": 1, "country": None})
    return _hits(_searchable(spark, sf_dir).where(where))


@query("filter_must_not")
def _(spark, sf_dir):
    where = search.condition(must_not={"country": "United Kingdom", "adults": 2})
    return _hits(_searchable(spark, sf_dir).where(where))


@query("filter_should")
def _(spark, sf_dir):
    where = search.condition(should={"country": "Portugal", "adults": 55, "meal": "sc"})
    return _hits(_searchable(spark, sf_dir).where(where))


@query("filter_range")
def _(spark, sf_dir):
    where = search.condition(
        ranges={"lead_time": {"gte": 100, "lt": 200}, "arrival_date": {"gt": "1997-06-30", "lte": "1998-06-30"}}
    )
    return _hits(_searchable(spark, sf_dir).where(where))


_SEARCH = {
    "must": {"hotel": "City Hotel"},
    "must_not": {"country": "United Kingdom"},
    "should": {"meal": "BB", "adults": 3},
    "ranges": {"lead_time": {"gte": 10, "lt": 300}},
}


@query("search")
def _(spark, sf_dir):
    return _hits(search.search(_searchable(spark, sf_dir), **_SEARCH))


@query("search_all")
def _(spark, sf_dir):
    return _hits(search.search(_searchable(spark, sf_dir)))


@query("search_total")
def _(spark, sf_dir):
    return search.search_total(_searchable(spark, sf_dir), must={"hotel": "hotel"})


@query("search_score")
def _(spark, sf_dir):
    hits = search.search(_searchable(spark, sf_dir), **_SEARCH)
    return rounded(hits.select("id", "score"), 5)


@query("search_score_clauses")
def _(spark, sf_dir):
    twice = {"must": {"hotel": "City Hotel"}, "should": {"hotel": "city", "adults": 3}}
    return rounded(search.search(_searchable(spark, sf_dir), **twice).select("id", "score"), 5)


@query("project_hits")
def _(spark, sf_dir):
    docs = table.to_documents(bookings(spark, sf_dir))
    return rounded(search.project_hits(search.search(docs, must={"adults": 3}, scored=False)))


@query("search_arrival_day")
def _(spark, sf_dir):
    return _hits(search.search_arrival_day(_searchable(spark, sf_dir), meal="", is_canceled=0))


# --- aggregations ------------------------------------------------------------


@query("terms")
def _(spark, sf_dir):
    return buckets.terms(bookings(spark, sf_dir, "country"), "country")


@query("terms_envelope")
def _(spark, sf_dir):
    return buckets.terms_total(bookings(spark, sf_dir, "country"), "country")


def _metric(kind: str, field: str) -> Query:
    def run(spark, sf_dir):
        return rounded(metrics.metric(bookings(spark, sf_dir, field), field, kind).drop("field", "type"))

    return run


for _kind, _field in {
    "avg": "adr",
    "sum": "adr",
    "min": "adr",
    "max": "lead_time",
    "value_count": "country",
    "cardinality": "country",
    "stats": "lead_time",
    "extended_stats": "lead_time",
    "percentiles": "adr",
}.items():
    QUERIES[f"metric_{_kind}"] = _metric(_kind, _field)
QUERIES["metric_mad"] = _metric("median_absolute_deviation", "adr")


@query("metric_missing")
def _(spark, sf_dir):
    return metrics.metric(bookings_raw(spark, sf_dir), "company", "missing").drop("field", "type")


_DYNAMIC = [
    ("adr", "avg"),
    ("lead_time", "sum"),
    ("hotel", "terms"),
    ("arrival_date", "max"),
    ("adr", "avg"),
    ("adults", "terms"),
    ("lead_time", "stats"),
]


def _dynamic(spark, sf_dir):
    return metrics.aggregate(
        bookings(spark, sf_dir, "adr", "lead_time", "hotel", "arrival_date", "adults"), _DYNAMIC
    )


@query("dynamic_aggregate")
def _(spark, sf_dir):
    return rounded(_dynamic(spark, sf_dir).drop("field", "type"))


@query("composite")
def _(spark, sf_dir):
    return buckets.composite(
        bookings(spark, sf_dir, "hotel", "country", "meal"),
        ["hotel", "country"],
        after={"hotel": "City Hotel", "country": "Brazil"},
    )


@query("significant_terms")
def _(spark, sf_dir):
    clean = bookings(spark, sf_dir, "country", "hotel")
    return rounded(buckets.significant_terms(clean, "hotel = 'Resort Hotel'", "country"))


@query("nested_terms")
def _(spark, sf_dir):
    clean = bookings(spark, sf_dir, "country", "meal", "adr")
    return rounded(
        buckets.nested_terms(
            clean, "country", "meal", {"average_adr": "avg(adr)"}, outer_size=5, inner_size=2
        )
    )


@query("date_histogram")
def _(spark, sf_dir):
    return buckets.date_histogram(bookings(spark, sf_dir, "arrival_date"), "arrival_date")


@query("date_histogram_nofill")
def _(spark, sf_dir):
    return buckets.date_histogram(bookings(spark, sf_dir, "arrival_date"), "arrival_date", fill=False)


@query("histogram")
def _(spark, sf_dir):
    clean = bookings(spark, sf_dir, "lead_time", "adr")
    return rounded(buckets.histogram(clean, "lead_time", 10, {"average_adr": "avg(adr)"}))


_NIGHTS = ("stays_in_weekend_nights", "stays_in_week_nights")


@query("terms_scripted_num")
def _(spark, sf_dir):
    return buckets.terms(bookings(spark, sf_dir, *_NIGHTS), f"string({TOTAL_NIGHTS})", name="nights")


@query("terms_scripted_str")
def _(spark, sf_dir):
    clean = bookings(spark, sf_dir, "adults", "children", "babies")
    return buckets.terms(clean, COMPOSITION, name="composition")


@query("sum_scripted")
def _(spark, sf_dir):
    clean = bookings(spark, sf_dir, "adr", *_NIGHTS)
    return rounded(clean.selectExpr(f"sum({REVENUE}) AS revenue"), 4)


@query("avg_scripted")
def _(spark, sf_dir):
    return rounded(bookings(spark, sf_dir, *_NIGHTS).selectExpr(f"avg({TOTAL_NIGHTS}) AS average_stay"))


@query("terms_by_key")
def _(spark, sf_dir):
    return rounded(buckets.terms(bookings(spark, sf_dir, "adr"), "adr", order="key"))


@query("sub_aggs_multi")
def _(spark, sf_dir):
    clean = bookings(spark, sf_dir, "meal", "adr", "lead_time", "is_canceled")
    aggs = {
        "average_adr": "avg(adr)",
        "max_lead_time": "max(lead_time)",
        "canceled": "sum(is_canceled)",
    }
    return rounded(buckets.terms(clean, "meal", aggs=aggs))


# --- reports and their display shapes ----------------------------------------

_REPORT_COLUMNS = {
    "cancellation_rate": ["market_segment", "hotel", "is_canceled"],
    "adr_by_month": ["arrival_date", "hotel", "adr"],
    "top_countries": ["country"],
    "length_of_stay": [*_NIGHTS],
    "booking_trends": ["arrival_date"],
    "special_requests": ["total_of_special_requests", "is_canceled"],
    "lead_time_by_status": ["is_canceled", "lead_time"],
    "room_types": ["reserved_room_type"],
    "guest_country": ["country"],
    "booking_source": ["distribution_channel"],
    "revenue": ["reserved_room_type", "arrival_date", "adr", *_NIGHTS],
    "lead_time_adr": ["lead_time", "adr"],
    "repeat_guests": ["is_repeated_guest", "country", "hotel", "lead_time"],
    "adr_factors": ["adr", "is_canceled", "total_of_special_requests", *_NIGHTS],
    "cancel_factors": ["is_canceled", "lead_time", "total_of_special_requests", *_NIGHTS],
    "composition": ["adults", "children", "babies", "lead_time", "total_of_special_requests", *_NIGHTS],
}


def run_report(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return report(name, bookings(spark, sf_dir, *_REPORT_COLUMNS[name]))


def _report_query(name: str) -> Query:
    digits = 4 if name == "revenue" else 6
    return lambda spark, sf_dir: rounded(run_report(spark, sf_dir, name), digits)


for _name in REPORTS:
    QUERIES[f"report_{_name}"] = _report_query(_name)


_REPORTED = sorted({c for columns in _REPORT_COLUMNS.values() for c in columns})


@query("all_reports")
def _(spark, sf_dir):
    return rounded(report_values(all_reports(bookings(spark, sf_dir, *_REPORTED))), 4)


@query("reports_after_updates")
def _(spark, sf_dir):
    """Sums of two thirds of the table, then three batches of updates and new rows; no batch reads the table again."""
    base = fresh_path(spark, "sums")
    clean = stored(bookings(spark, sf_dir, "id", *_REPORTED), "bookings")
    other = clean.withColumns({"adr": F.expr("adr + 10"), "hotel": F.lit("City Hotel"), "is_canceled": F.expr("1 - is_canceled")})
    rollups.start(clean.where("id % 3 <> 0"), base)
    # Others' versions of some, all of the missing third, and the first ones again.
    some, missing = "id % 3 = 1 AND id % 2 = 0", "id % 3 = 0"
    current = clean.where("id % 3 <> 0")
    for _ in range(2):  # a repeated batch changes nothing
        rollups.apply(*rollups.changed_rows(current, other.where(some)), base, 1)
    rollups.apply(*rollups.changed_rows(current, clean.where(missing)), base, 2)
    rollups.apply(other.where(f"{some} AND id % 5 = 0"), clean.where(f"{some} AND id % 5 = 0"), base, 3)
    rollups.compact(spark, base, f"{base}-compact")
    return rounded(report_values(rollups.reports(spark, f"{base}-compact")), 4)


def _shape_query(name: str) -> Query:
    source, shape = shaping.SHAPES[name]
    digits = 4 if source == "revenue" else 6

    def run(spark, sf_dir):
        return shape(rounded(run_report(spark, sf_dir, source), digits))

    return run


for _name in shaping.SHAPES:
    QUERIES[_name] = _shape_query(_name)


@query("group_revenue_series")
def _(spark, sf_dir):
    series = shaping.group_revenue_series(rounded(run_report(spark, sf_dir, "revenue"), 4))
    return series.withColumn("series", F.to_json("series"))


@query("mean_of_segment_rates")
def _(spark, sf_dir):
    return rounded(shaping.mean_of_segment_rates(run_report(spark, sf_dir, "cancellation_rate")))


@query("shape_renames")
def _(spark, sf_dir):
    reports = {name: run_report(spark, sf_dir, name) for name in shaping.RENAMES}
    return rounded(shaping.shape_all_renames(reports))


@query("report_payload")
def _(spark, sf_dir):
    shaped = shaping.shape_report("room_types", run_report(spark, sf_dir, "room_types"))
    return shaping.report_payload("room_types", shaped)


@query("shape_dynamic_aggregate")
def _(spark, sf_dir):
    return rounded(shaping.shape_dynamic_aggregate(_dynamic(spark, sf_dir)))


# --- text --------------------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("tokenize")
def _(spark, sf_dir):
    return _documents(spark, sf_dir).select(
        "doc_id",
        F.size(tokens("text")).cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct(tokens("text"))).cast("bigint").alias("n_distinct"),
        F.array_join(tokens("text"), " ").alias("joined"),
    )


FUZZY_WORDS = ["of", "there", "worthless", "eauxment"]


@query("fuzzy_terms")
def _(spark, sf_dir):
    vocab = fulltext.vocabulary(_documents(spark, sf_dir), ["text"], FUZZY_WORDS)
    return fulltext.expand_terms(vocab, FUZZY_WORDS).select("word", "token", "distance", "doc_freq")


TEXT_QUERY = "worthles there"


@query("full_text_search")
def _(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return fulltext.full_text_matches(docs, TEXT_QUERY, ["text"]).select("doc_id")


@query("full_text_score")
def _(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    hits = fulltext.full_text_search(docs, TEXT_QUERY, ["text"], key="doc_id")
    return rounded(hits.select("doc_id", "score"), 4)


@query("full_text_total")
def _(spark, sf_dir):
    return fulltext.full_text_total(_documents(spark, sf_dir), TEXT_QUERY, ["text"])


@query("full_text_indexed")
def _(spark, sf_dir):
    path = fresh_path(spark, "tokens")
    textindex.build(_documents(spark, sf_dir), ["text"], path, "doc_id")
    hits = textindex.search(spark, path, TEXT_QUERY, ["text"], size=None)
    return rounded(hits.withColumnRenamed("key", "doc_id"), 4)


@query("full_text_index_updated")
def _(spark, sf_dir):
    """Every fifth document gets words, every seventh goes; both tables of statistics and the matches are the changed table's."""
    path, docs = fresh_path(spark, "tokens"), _documents(spark, sf_dir).select("doc_id", "text")
    textindex.build(docs, ["text"], path, "doc_id")
    before = docs.where("doc_id % 5 = 0 OR doc_id % 7 = 0")
    after = docs.where("doc_id % 5 = 0 AND doc_id % 7 <> 0").withColumn("text", F.expr("concat(text, ' worthless there')"))
    for _ in range(2):  # a repeated batch changes nothing
        textindex.update(spark, path, before, after, ["text"], 1, "doc_id")
    textindex.compact(spark, path, f"{path}-compact")
    hits = textindex.search(spark, f"{path}-compact", TEXT_QUERY, ["text"], size=None)
    return rounded(hits.withColumnRenamed("key", "doc_id"), 4)


@query("full_text_bookings")
def _(spark, sf_dir):
    clean = bookings(spark, sf_dir, "id", "country", "hotel")
    found = fulltext.full_text_matches(clean, "Unitd cty", ["country", "hotel"])
    return found.select("id", "country", "hotel")


@query("suggest")
def _(spark, sf_dir):
    return fulltext.suggest(bookings(spark, sf_dir, "country"), "s", "country_suggest")


@query("clean_markdown")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", clean_markdown("text").alias("text")
    )


# --- recurring uploads -------------------------------------------------------


@query("stream_upload_sync")
def _(spark, sf_dir):
    base = fresh_path(spark, "stream")
    bookings_raw(spark, sf_dir).write.options(**files.CSV_OPTIONS).csv(f"{base}/uploads")
    for _ in range(2):  # the second start finds nothing new
        uploads.start_upload_sync(
            spark,
            f"{base}/uploads",
            f"{base}/table",
            f"{base}/checkpoint",
            every=None,
            files_per_batch=None,
        ).awaitTermination()
    return rounded(uploads.read_synced(spark, f"{base}/table"))


LATE_ROWS = 500_000


@query("stream_late_file")
def _(spark, sf_dir):
    """Three uploads, stored newest first: what the older ones hold of the same bookings comes late, and wins nowhere."""
    base = fresh_path(spark, "late")
    raw = stored(bookings_raw(tidy_session(spark), sf_dir), "raw")
    # All uploads have the same number of files, of 500,000 rows at most, so a batch of so many is one upload.
    parts = -(-max(raw.count(), 1) // LATE_ROWS)
    for name, keep, shift in (("1", "true", 1000), ("2", "id % 2 = 0", 1), ("3", "id % 3 = 0", 2)):
        rows = raw.where(keep).withColumn("lead_time", F.expr(f"lead_time + {shift}"))
        rows.repartition(parts).write.options(**files.CSV_OPTIONS).csv(f"{base}/uploads/{name}")
    uploads.start_upload_sync(
        spark, f"{base}/uploads/*", f"{base}/table", f"{base}/checkpoint", every=None, files_per_batch=parts, newest_first=True
    ).awaitTermination()
    return uploads.read_synced(spark, f"{base}/table").select("id", "lead_time", "hotel", "arrival_date")


# --- sketches of uploads -----------------------------------------------------


def _sketches(spark, sf_dir) -> DataFrame:
    """Sketches of four uploads, stored one by one."""
    base = fresh_path(spark, "sketches")
    raw = bookings_raw(spark, sf_dir)
    for k in range(4):
        part = raw.where(f"id % 4 = {k}")
        sketches.sketch_rows(part, raw.columns, F.lit(k)).write.mode("append").parquet(base)
    return spark.read.parquet(base)


@query("sketched_percentiles")
def _(spark, sf_dir):
    """Whether each approximate percentile of three of four uploads lies within the promised error of its rank."""
    columns, ps = ["lead_time", "adr", "agent"], [0.01, 0.25, 0.5, 0.75, 0.99]
    held = sketches.sketched_percentiles(_sketches(spark, sf_dir).where("batch <> 1"), ps).where(F.col("column").isin(columns))
    values = bookings_raw(spark, sf_dir).where("id % 4 <> 1").selectExpr(*[f"double({c}) AS {c}" for c in columns])
    exact = values.unpivot([], columns, "column", "x").where("x IS NOT NULL")
    # Fifteen rows.
    ranks = exact.join(F.broadcast(held), "column").groupBy("column", "p").agg(
        F.expr("count_if(x < value) / count(1)").alias("below"), F.expr("count_if(x <= value) / count(1)").alias("upto")
    )
    error = sketches.RANK_ERROR
    return ranks.selectExpr("column", "p", f"below - {error} <= p AND p <= upto + {error} AS within")


@query("sketched_distinct")
def _(spark, sf_dir):
    """Whether each approximate number of distinct values of three of four uploads is within the promised error."""
    raw = bookings_raw(spark, sf_dir)
    guess = sketches.sketched_distinct(_sketches(spark, sf_dir).where("batch <> 1"))
    exact = profiling.unique_counts(raw.where("id % 4 <> 1")).withColumnsRenamed({"n_unique": "exact", "n_rows": "rows"})
    near = f"abs(n_unique - exact) <= greatest(1, {sketches.DISTINCT_ERROR} * exact) AND n_rows = rows"
    return guess.join(exact, "column").selectExpr("column", "exact AS n_unique", f"{near} AS within")
