import datetime as dt

import pytest
from rows import table, values

from lodgeframe.operators import metrics, search


@pytest.fixture(scope="module")
def hotels(spark):
    names = ["City Hotel", "Resort Hotel", "Hostel", None]
    return table(spark, [{"hotel": n, "adults": i} for i, n in enumerate(names)])


def test_match_is_any_token_whatever_the_case(hotels):
    assert values(hotels.where(search.match("hotel", "city hotel")), "id") == [1, 2]
    assert values(hotels.where(search.match("hotel", "!")), "id") == []


def test_must_not_keeps_null_fields(hotels):
    got = values(search.search(hotels, must_not={"hotel": "city hotel"}), "id")
    assert sorted(got) == [3, 4]


def test_must_and_must_not_partition_the_table(hotels):
    inside = values(search.search(hotels, must={"hotel": "resort"}), "id")
    outside = values(search.search(hotels, must_not={"hotel": "resort"}), "id")
    assert sorted(inside + outside) == [1, 2, 3, 4]


def test_should_ranges_and_none(hotels):
    got = search.search(hotels, must={"country": None}, should={"hotel": "city", "adults": 3})
    assert sorted(values(got, "id")) == [1, 4]
    got = search.search(hotels, ranges={"adults": {"gt": 0, "lte": 2}})
    assert sorted(values(got, "id")) == [2, 3]
    got = search.search(hotels, ranges={"arrival_date": {"lt": "2016-07-01"}})
    assert values(got, "id") == []


@pytest.mark.parametrize(
    "call",
    [
        lambda df: search.search(df, must={"nonsense": 1}),
        lambda df: search.search(df, must={"adults": "many"}),
        lambda df: search.search(df, ranges={"adults": {"near": 2}}),
        lambda df: metrics.metric(df, "hotel", "avg"),
        lambda df: metrics.metric(df, "arrival_date", "sum"),
        lambda df: metrics.metric(df, "adr", "rare_terms"),
        lambda df: metrics.metric(df, "hotel_suggest", "terms"),
        lambda df: metrics.aggregate(df, []),
    ],
)
def test_bad_requests(hotels, call):
    with pytest.raises(ValueError):
        call(hotels)


def test_totals_and_earliest_day(spark):
    days = [dt.date(2016, 7, 2), dt.date(2016, 7, 1), dt.date(2016, 7, 1)]
    df = table(spark, [{"arrival_date": d, "is_canceled": i % 2} for i, d in enumerate(days)])
    assert values(search.search_total(df, must={"is_canceled": 0})) == [2]
    assert sorted(values(search.search_arrival_day(df, is_canceled=0), "id")) in ([2, 3], [3])
    assert values(search.search_arrival_day(df, "2016-07-02"), "id") == [1]


@pytest.mark.parametrize("size", [1, 1500, 2000, 5000])
def test_large_answers_equal_a_plain_top_k(spark, size):
    df = spark.range(3000).selectExpr(
        "(id * 7919) % 3000 AS id", "concat(if(id % 3 = 0, 'City', 'Resort'), ' Hotel') AS hotel",
        "int(id % 5) AS adults",
    )
    conditions = dict(should={"hotel": "city", "adults": 2})
    plain = search.with_score(df, **conditions).where(search.condition(**conditions))
    want = sorted(values(plain, "score", "id"), key=lambda r: (-r[0], r[1]))[:size]
    got = values(search.search(df, **conditions, size=size), "score", "id")
    assert got == want
    got = values(search.search(df, size=size, scored=False), "id")
    assert got == list(range(min(size, 3000)))


def test_every_hit_is_returned_and_the_best_are_not_the_lowest(spark):
    df = spark.range(30_000).selectExpr("id", "concat(if(id >= 29000, 'Resort', 'City'), ' Hotel') AS hotel")
    found = search.search(df, must={"hotel": "resort hotel"})
    assert found.count() == 30_000
    assert values(search.search(df, must={"hotel": "resort hotel"}, size=3), "id") == [29_000, 29_001, 29_002]


def test_a_field_in_two_clauses_counts_twice(hotels):
    once = values(search.search(hotels, must={"hotel": "hotel"}, size=1), "score")
    twice = values(search.search(hotels, must={"hotel": "hotel"}, should={"hotel": "hotel"}, size=1), "score")
    assert twice == [pytest.approx(2 * once[0])]


def test_score_without_clauses(hotels):
    assert set(values(search.search(hotels, scored=True), "score")) == {1.0}
    only_not = search.search(hotels, must_not={"hotel": "city"}, scored=True)
    assert set(values(only_not, "score")) == {0.0}


def test_aggregate_long_form(hotels):
    got = metrics.aggregate(hotels, [("adults", "stats"), ("hotel", "terms"), ("adults", "stats")])
    rows = values(got)
    assert len(rows) == 5 + 3
    assert ("adults_stats", "sum", None, 6.0, "adults", "stats") in rows
    assert ("hotel_terms", "City Hotel", 1, None, "hotel", "terms") in rows
    mad = values(metrics.metric(hotels, "adults", "median_absolute_deviation"))
    assert mad == [("adults_median_absolute_deviation", None, None, 1.0, "adults", "median_absolute_deviation")]


def test_terms_of_several_columns_take_one_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, [{"hotel": f"h{i % 3}", "adults": i % 12, "country": None} for i in range(60)]).write.parquet(path)
    df = spark.read.parquet(path)
    got = metrics.aggregate(df, [("hotel", "terms"), ("adults", "terms"), ("country", "terms")])
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    rows = values(got, "agg", "key", "doc_count")
    assert [r for r in rows if r[0] == "hotel_terms"] == [("hotel_terms", f"h{i}", 20) for i in range(3)]
    assert sorted(int(r[1]) for r in rows if r[0] == "adults_terms") == list(range(10))
    assert not [r for r in rows if r[0] == "country_terms"]
