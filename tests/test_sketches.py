import random

import pytest
from pyspark.sql import functions as F

from lodgeframe.operators import profiling, quantiles, sketches
from lodgeframe.operators.quantiles import order_statistics, sort_key, value_counts


def numbers(n, seed):
    dice = random.Random(seed)
    return [(k, dice.gauss(0, 10.0 ** dice.randrange(-3, 4)) if k % 7 else None, f"t{dice.randrange(500)}") for k in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(numbers(20_000, 1), "id long, x double, t string").cache()


def test_merged_sketches_are_within_their_error_for_any_batches(spark, frame):
    stored = sketches.sketch_rows(frame, ["x", "t"], F.col("id") % 5)
    for keep in ("true", "batch <> 2", "batch = 3"):
        rows = [r.x for r in frame.where(keep.replace("batch", "id % 5")).collect() if r.x is not None]
        rows.sort()
        for r in sketches.sketched_percentiles(stored.where(keep), [0.01, 0.3, 0.5, 0.99]).collect():
            below = sum(v < r.value for v in rows) / len(rows)
            upto = sum(v <= r.value for v in rows) / len(rows)
            assert below - sketches.RANK_ERROR <= r.p <= upto + sketches.RANK_ERROR
        found = {r.column: (r.n_rows, r.n_unique) for r in sketches.sketched_distinct(stored.where(keep)).collect()}
        assert abs(found["x"][1] / len(set(rows)) - 1) < sketches.DISTINCT_ERROR
        assert found["x"][0] == found["t"][0] == frame.where(keep.replace("batch", "id % 5")).count()


def test_classes_from_sketches_equal_those_from_rows(spark):
    rows = [(k, k % 3, f"c{k % 4}", f"name{k}", 1.5 * k) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, few int, kind string, name string, price double")
    stored = sketches.sketch_rows(df, df.columns, F.lit(0))
    got = {r.column: r["class"] for r in sketches.classify_sketched(stored, dict(df.dtypes)).collect()}
    assert got == {r.column: r["class"] for r in profiling.classify_columns(df).collect()}


def test_sketches_of_nothing_nulls_and_nan(spark):
    df = spark.sql("SELECT * FROM VALUES (1, double('NaN'), CAST(NULL AS string)), (2, NULL, NULL) AS t(id, x, t)")
    stored = sketches.sketch_rows(df, ["x", "t"], F.lit(0))
    assert sketches.sketched_percentiles(stored, [0.5]).count() == 0
    assert {(r.column, r.n_rows, r.n_unique) for r in sketches.sketched_distinct(stored).collect()} == {("x", 2, 0), ("t", 2, 0)}
    assert sketches.merged(sketches.sketch_rows(df.where("false"), ["x", "t"], F.lit(0))).count() == 0


EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, -1.0, 2.0, 1.9999999999999998, 4.0, 0.1]
EDGES += [1.7976931348623157e308, float("inf"), float("-inf"), 1e22, 8.0, 7.999999999999999, 2.0**-1022, 2.0**1023, 2.0**52 + 1, 1e-300]


def test_sort_keys_order_like_their_numbers(spark):
    dice = random.Random(4)
    values = EDGES + [dice.uniform(-1, 1) * 10.0 ** dice.randrange(-320, 309) for _ in range(3000)]
    values += [2.0**k for k in range(-1074, 1024)] + [-(2.0**k) * (1 + 2**-52) for k in range(-1000, 1023)]
    got = spark.createDataFrame([(v,) for v in values], "x double").selectExpr("x + 0D AS x", f"{sort_key('(x + 0D)')} AS k").collect()
    import struct

    for r in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.x)))[0]
        assert r.k == (bits if r.x >= 0 else -bits), r.x


@pytest.mark.parametrize(
    "sql",
    [
        "pow(10, -9 + 6 * rand(1))",  # over decades
        "1 + id * pow(2, -52)",  # within a few units in the last place
        "IF(id % 3 = 0, 7, IF(id % 3 = 1, -7, 1e300 * rand(2)))",
        "CAST(NULL AS double)",
        "5",
    ],
)
def test_exact_percentiles_of_hard_columns(spark, sql):
    df = spark.range(20_000).selectExpr(f"double({sql}) AS x").cache()
    ps = [0.0, 0.01, 0.25, 0.5, 0.977, 1.0]
    got = order_statistics(value_counts(df, ["x"]), ps).collect()
    want = df.selectExpr(f"percentile(x, array({', '.join(map(str, ps))})) AS q", "median(x) AS m").first()
    if want.q is None:
        assert got == []
    else:
        assert got[0].quantiles == pytest.approx(want.q, rel=1e-15) and got[0].median == pytest.approx(want.m, rel=1e-15)


def test_no_pass_orders_more_than_a_digit():
    assert sum(quantiles.DIGITS) == 64 and max(quantiles.DIGITS) <= 22
