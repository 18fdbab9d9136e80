import datetime as dt

import pytest
from rows import table, values

from lodgeframe.operators import buckets


def test_terms_breaks_ties_by_key_and_drops_nulls(spark):
    keys = ["k%02d" % i for i in range(12) for _ in range(3 if i < 9 else 1)] + [None] * 5
    df = table(spark, [{"country": k} for k in keys])
    got = values(buckets.terms(df, "country"))
    assert got == [("k%02d" % i, 3) for i in range(9)] + [("k09", 1)]
    assert values(buckets.terms_total(df, "country")) == [(30, 28, 2)]


def test_terms_by_expression_and_lowest_key(spark):
    df = table(spark, [{"adr": a} for a in (5.0, 5.0, 1.0, None)])
    assert values(buckets.terms(df, "adr", order="key")) == [(1.0, 1), (5.0, 2)]
    assert values(buckets.terms(df, "adr * 2", name="double", size=1)) == [(10.0, 2)]
    with pytest.raises(ValueError):
        buckets.terms(df, "adr", order="other")


def test_nested_terms_keeps_outer_key_without_inner_keys(spark):
    df = table(
        spark,
        [{"country": "a", "meal": None}] * 2
        + [{"country": "b", "meal": m} for m in ("x", "x", "y", "z", None)],
    )
    got = values(buckets.nested_terms(df, "country", "meal", inner_size=2))
    assert sorted(got, key=repr) == [("a", 2, None, None), ("b", 5, "x", 2), ("b", 5, "y", 1)]


def test_months_in_between_are_filled(spark):
    days = [dt.date(2016, 1, 5), dt.date(2016, 1, 6), dt.date(2016, 4, 1), None]
    df = table(spark, [{"arrival_date": d} for d in days])
    filled = sorted(values(buckets.date_histogram(df, "arrival_date")))
    assert [n for _, n in filled] == [2, 0, 0, 1]
    assert [d.month for d, _ in filled] == [1, 2, 3, 4]
    assert len(values(buckets.date_histogram(df, "arrival_date", fill=False))) == 2


def test_histogram_floors_negative_values(spark):
    df = table(spark, [{"adr": a} for a in (-0.5, 0.0, 9.99, 10.0)])
    assert sorted(values(buckets.histogram(df, "adr", 10))) == [(-10.0, 1), (0.0, 2), (10.0, 1)]


def test_composite_pages_cover_everything_once(spark):
    df = table(spark, [{"country": c, "meal": m} for c in "abc" for m in "xy"])
    first = values(buckets.composite(df, ["country", "meal"], size=4))
    rest = buckets.composite(
        df, ["country", "meal"], after={"country": first[-1][0], "meal": first[-1][1]}, size=4
    )
    assert [r[:2] for r in first + values(rest)] == [(c, m) for c in "abc" for m in "xy"]


def test_significant_terms_need_over_representation(spark):
    df = table(
        spark,
        [{"country": "a", "is_canceled": 1}] * 4
        + [{"country": "b", "is_canceled": c} for c in (1, 1, 1, 0, 0, 0, 0)],
    )
    got = values(buckets.significant_terms(df, "is_canceled = 1", "country"))
    fg, bg = 4 / 7, 4 / 11
    assert got == [("a", 4, 4, pytest.approx((fg - bg) * (fg / bg)))]
