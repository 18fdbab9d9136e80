import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from rows import raw, values

from lodgeframe.operators import cleaning, profiling
from lodgeframe.operators.quantiles import order_statistics, percentiles, value_counts
from lodgeframe.schema import OUTLIER_COLUMNS


def test_high_outliers_alone_are_left_unless_two_sided(spark):
    df = raw(spark, [{"lead_time": i % 10} for i in range(300)] + [{"lead_time": 700}])
    kept = cleaning.suppress_outliers(df)
    assert max(values(kept, "lead_time")) == 700
    clipped = cleaning.suppress_outliers(df, detect="two_sided")
    assert max(values(clipped, "lead_time")) == 22  # 9 + 1.5 * 9 = 22.5, half to even


def test_one_low_outlier_clips_both_sides(spark):
    rates = [float(i % 11) for i in range(330)] + [-500.0, 900.0]
    got = values(cleaning.suppress_outliers(raw(spark, [{"adr": r} for r in rates])), "adr")
    assert min(got) == -15.0 and max(got) == 25.0


def test_rare_flag_column_becomes_constant_and_correlation_is_nan(spark):
    df = raw(spark, [{"babies": 1, "lead_time": 3}] + [{"babies": 0, "lead_time": i} for i in range(150)])
    cleaned = cleaning.clean(df)
    assert set(values(cleaned, "babies")) == {0}
    cells = {(a, b): r for a, b, r in values(profiling.correlation_matrix(cleaned, ["babies", "lead_time"]))}
    assert np.isnan(cells["babies", "lead_time"]) and cells["lead_time", "lead_time"] == pytest.approx(1)


def test_countries(spark):
    df = raw(spark, [{"country": c} for c in ("PRT", "CN", "XXX", None)])
    assert sorted(values(cleaning.clean(df), "country")) == ["", "Canada", "Portugal", "Unknown"]
    marked = cleaning.clean(df, unmapped="?")
    assert "?" in values(marked, "country")


def test_null_gate_names_the_column(spark):
    df = raw(spark, [{}, {"meal": None}])
    with pytest.raises(ValueError, match="meal"):
        cleaning.require_no_nulls(df)
    with pytest.raises(Exception, match="null values left in: meal"):
        cleaning.clean(df).collect()
    assert values(cleaning.clean(df, columns=["hotel"], gate=False)) == ["City Hotel"] * 2


def test_clean_data_passes_unchanged(spark):
    df = raw(spark, [{"adr": float(i)} for i in range(5)])
    cleaned = cleaning.clean(df)
    assert sorted(values(cleaned, "adr")) == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert {str(d) for d in values(cleaned, "arrival_date")} == {"2016-07-01"}


def test_impossible_date_fails(spark):
    df = raw(spark, [{"arrival_date_month": "February", "arrival_date_day_of_month": 30}])
    with pytest.raises(Exception):
        cleaning.with_arrival_date(df).collect()


def test_rejects_name_the_bad_columns(spark):
    df = spark.sql("SELECT '1' AS lead_time, 'x' AS adr UNION ALL SELECT '2', '3.5'")
    assert values(cleaning.cast_rejects(df), "lead_time", "bad_columns") == [("1", ["adr"])]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.one_of(st.none(), st.integers(-3, 3).map(float), st.floats(-1e9, 1e9, width=32)),
        min_size=1,
        max_size=40,
    )
)
def test_percentiles_equal_numpy(spark, numbers):
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    known = [x for x in numbers if x is not None]
    got = {p: v for _, p, v in values(percentiles(df, ["x"], [0.0, 0.01, 0.5, 0.99, 1.0]))}
    if not known:
        assert all(v is None for v in got.values())
        return
    for p, v in got.items():
        assert v == pytest.approx(np.quantile(known, p), rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("n, nulls", [(1, 4), (4, 3), (5, 0), (7, 20), (10, 1)])
def test_quantiles_after_median_fill(spark, n, nulls):
    numbers = [float((i * 37) % 101) for i in range(n)]
    df = spark.createDataFrame([(x,) for x in numbers + [None] * nulls], "x double")
    probabilities = [0.01, 0.25, 0.4, 0.6, 0.99]
    row = order_statistics(value_counts(df, ["x"]), probabilities, ["x"]).first()
    filled = numbers + [float(np.median(numbers))] * nulls
    assert row["quantiles"] == pytest.approx([np.quantile(filled, p) for p in probabilities])


def test_statistics_are_one_scan(spark, tmp_path):
    path = str(tmp_path / "raw")
    raw(spark, [{"adr": 1 + i / 1e6} for i in range(5)]).write.parquet(path)  # close values, so that a second pass is needed
    limits = cleaning.outlier_thresholds(spark.read.parquet(path))
    limits.collect()
    final = limits._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final
    assert sorted(values(limits, "column")) == sorted(OUTLIER_COLUMNS)


def test_no_use_of_cleaned_rows_leaves_the_gate_out(spark):
    dirty = cleaning.clean(raw(spark, [{}, {"hotel": None}]))
    for use in (lambda: dirty.count(), lambda: dirty.selectExpr("avg(adr)").first(), lambda: dirty.select("meal").collect()):
        with pytest.raises(Exception, match="null values left in: hotel"):
            use()
    pruned = cleaning.clean(raw(spark, [{}, {"hotel": None}]), columns=["adr"])
    with pytest.raises(Exception, match="hotel"):
        pruned.collect()
    assert cleaning.clean(raw(spark, [{}, {"hotel": None}]), columns=["adr"], gate=False).count() == 2


def test_a_column_within_one_bucket_is_cut_into_parts(spark):
    n = 200_001
    df = spark.range(n).selectExpr("double(5000000000 + id) AS x", "double(7) AS y")
    got = {r["column"]: r for r in order_statistics(value_counts(df, ["x", "y"]), [0.25, 0.333]).collect()}
    assert got["x"]["median"] == 5_000_100_000
    assert got["x"]["quantiles"] == [5_000_050_000, pytest.approx(5_000_066_600.0, abs=1e-3)]
    assert got["y"]["quantiles"] == [7.0, 7.0]
