import pytest
from rows import table, values

from lodgeframe.fixture import bookings
from lodgeframe.operators import profiling
from lodgeframe.plans import shaping
from lodgeframe.plans.reports import REPORTS, all_reports, report

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("reports") / "table")
    bookings(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", list(REPORTS))
def test_a_report_reads_the_table_once(stored, name):
    assert report(name, stored)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_shared_pass_equals_single_reports(stored):
    together = all_reports(stored)
    assert list(together) == list(REPORTS)
    for name, frame in together.items():
        alone = report(name, stored)
        assert frame.columns == alone.columns

        def plain(df):
            return sorted(
                [tuple(round(c, 6) if isinstance(c, float) else c for c in r) for r in values(df)],
                key=repr,
            )

        assert plain(frame) == plain(alone), name


def test_invariants(stored):
    n = stored.count()
    assert sum(c for _, c in values(report("booking_trends", stored))) == n
    assert values(report("top_countries", stored)) == values(report("guest_country", stored))
    rates = shaping.pivot_cancellation_rate(report("cancellation_rate", stored))
    assert all(0 <= c <= 1 for r in values(rates) for c in r[1:])


def test_reports_read_only_their_columns_and_use_no_python(stored):
    plan = report("cancellation_rate", stored)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<hotel:string,is_canceled:int,market_segment:string>" in plan
    for name in REPORTS:
        plan = report(name, stored)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan


def test_missing_combination_counts_as_zero(spark):
    df = table(
        spark,
        [{"market_segment": "A", "hotel": "City Hotel", "is_canceled": 1}] * 2
        + [{"market_segment": "B", "hotel": "City Hotel", "is_canceled": 0}]
        + [{"market_segment": "B", "hotel": "Resort Hotel", "is_canceled": 1}],
    )
    means = dict(values(shaping.mean_of_segment_rates(report("cancellation_rate", df))))
    assert means == {"City Hotel": 0.5, "Resort Hotel": 0.5}


def test_labels(spark):
    df = table(spark, [{"is_canceled": 1, "is_repeated_guest": 1}] * 2 + [{}])
    factors = dict(values(shaping.shape_cancel_factors(report("cancel_factors", df)), "Cancellation Status", "Average Lead Time"))
    assert factors == {"Cancelled": 10.0, "Not Cancelled": 10.0}
    guests = dict(values(shaping.shape_repeat_guests(report("repeat_guests", df))))
    assert guests == {"Repeat Guests - City Hotel": 2, "First-time Guests - City Hotel": 1}
    composition = values(shaping.shape_composition(report("composition", df)))
    assert composition == [("2 adults, 0 children, 0 babies", 3)]


def test_peaks_are_all_flagged(spark):
    df = spark.createDataFrame([("2016-01", 2), ("2016-02", 1), ("2016-03", 2)], "month string, doc_count long")
    assert values(shaping.trend_peaks(df), "is_peak") == [True, False, True]


def test_classification(spark):
    df = spark.range(100).selectExpr(
        "int(id % 2) AS flag", "int(id % 50) AS number", "string(id % 4) AS cat",
        "string(id) AS code", "date_add(DATE '2016-01-01', int(id % 9)) AS day",
    )
    got = {c: k for c, k, _ in values(profiling.classify_columns(df))}
    assert got == {
        "flag": "num_but_cat", "number": "numerical", "cat": "categorical",
        "code": "high_cardinality", "day": "date",
    }
