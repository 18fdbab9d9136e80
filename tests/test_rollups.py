import random

import numpy as np
import pytest
from rows import table

from lodgeframe.operators.profiling import correlation_matrix
from lodgeframe.plans import rollups
from lodgeframe.plans.reports import BASES, REPORTS, all_reports, report_values


def booking(k, dice):
    return {
        "id": k,
        "hotel": dice.choice(["City Hotel", "Resort Hotel"]),
        "is_canceled": dice.randrange(2),
        "lead_time": dice.randrange(60),
        "adr": dice.randrange(40) / 4,
        "country": dice.choice(["Spain", "Italy", "", "France"]),
        "market_segment": dice.choice(["A", "B", "C"]),
        "reserved_room_type": dice.choice("ABCDEFGHIJKLM"),
        "is_repeated_guest": dice.randrange(2),
        "stays_in_week_nights": dice.randrange(5),
        "total_of_special_requests": dice.randrange(4),
        "adults": 1 + dice.randrange(3),
    }


def plain(reports):
    rows = report_values(reports).collect()
    return sorted((r.report, r.labels, r.metric, None if r.value is None else round(r.value, 6)) for r in rows if True)


def test_three_batches_equal_a_full_recomputation(spark, tmp_path):
    dice, path = random.Random(3), str(tmp_path / "sums")
    rows = {k: booking(k, dice) for k in range(120)}
    rollups.start(table(spark, list(rows.values())), path)
    for batch in (1, 2, 3):
        updates = {k: booking(k, dice) for k in [*dice.sample(sorted(rows), 25), *range(1000 * batch, 1000 * batch + 10)]}
        current = table(spark, list(rows.values()))
        changed = rollups.changed_rows(current, table(spark, list(updates.values())))
        for _ in range(2):  # a repeated batch changes nothing
            rollups.apply(*changed, path, batch)
        rows.update(updates)
    # Some bookings go altogether, so groups may lose their last row.
    gone = [rows.pop(k) for k in list(rows)[:40]]
    rollups.apply(table(spark, gone), table(spark, [booking(0, dice)]).where("false"), path, 4)
    rollups.compact(spark, path, str(tmp_path / "compact"))
    assert plain(rollups.reports(spark, str(tmp_path / "compact"))) == plain(all_reports(table(spark, list(rows.values()))))


def test_every_report_has_a_base_and_bases_are_few():
    assert all(set(spec.keys) <= set(spec.base()) for spec in REPORTS.values()) and len(BASES) < len(REPORTS) / 2


def test_correlations_far_from_zero_with_nulls_are_stable(spark):
    dice = np.random.default_rng(1)
    x = 1e6 + dice.normal(size=4000)
    y, z = x + dice.normal(size=4000), 1e9 + dice.normal(size=4000)
    rows = [(float(a), None if k % 5 == 0 else float(b), float(c) if k % 3 else float("nan")) for k, (a, b, c) in enumerate(zip(x, y, z))]
    df = spark.createDataFrame(rows, "x double, y double, z double").repartition(7)
    got = {(r.col_a, r.col_b): r.r for r in correlation_matrix(df, ["x", "y", "z"]).collect()}
    columns = {c: np.array([np.nan if r[i] is None else r[i] for r in rows]) for i, c in enumerate("xyz")}
    for (a, b), r in got.items():
        both = ~np.isnan(columns[a]) & ~np.isnan(columns[b])
        u, v = (columns[c][both] - columns[c][both].mean() for c in (a, b))
        assert r == pytest.approx((u @ v) / np.sqrt((u @ u) * (v @ v)), abs=1e-9), (a, b)
    assert len(got) == 9


def test_correlations_read_the_table_once(spark, tmp_path):
    spark.range(100).selectExpr("double(id) AS x", "double(id % 7) AS y").write.parquet(str(tmp_path / "t"))
    plan = correlation_matrix(spark.read.parquet(str(tmp_path / "t")), ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
