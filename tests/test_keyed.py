import os

import pytest
from rows import table, values

from lodgeframe.schema import TABLE_SCHEMA
from lodgeframe.sources import keyed


def files_of(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_sync_rewrites_touched_buckets_only(spark, tmp_path):
    path, rows = str(tmp_path / "copy"), [{"id": k, "adr": float(k)} for k in range(200)]
    with pytest.raises(ValueError, match="no copy"):
        keyed.read_copy(spark, path, TABLE_SCHEMA)
    assert len(keyed.sync_copy(table(spark, rows), path, buckets=16)) == 16
    before = files_of(f"{path}/rows")
    assert keyed.sync_copy(table(spark, rows).repartition(3), path) == [] and files_of(f"{path}/rows") == before
    # One row changes (a value becomes null), one is new, ten are gone from the table.
    changed = [{**r, "country": None} if r["id"] == 7 else r for r in rows[:190]] + [{"id": 500, "adr": 1.0}]
    touched = keyed.sync_copy(table(spark, changed), path)
    after = files_of(f"{path}/rows")
    assert {k: v for k, v in after.items() if k in before} == before
    new = {int(k.split("bucket=")[1].split("/")[0]) for k in after if k not in before}
    assert new == set(touched) and 0 < len(touched) <= 12
    want = {r["id"]: (r["adr"], "PRT") for r in rows} | {500: (1.0, "PRT")}
    want[7] = (7.0, None)
    copy = keyed.read_copy(spark, path, TABLE_SCHEMA)
    assert {i: (a, c) for i, a, c in values(copy, "id", "adr", "country")} == want
    assert copy.count() == len(want) and keyed.sync_copy(table(spark, changed), path) == []


def test_an_unlisted_version_is_not_read(spark, tmp_path):
    path = str(tmp_path / "copy")
    keyed.sync_copy(table(spark, [{"id": 1}, {"id": 2}]), path)
    table(spark, [{"id": 99}]).selectExpr("*", "5 AS bucket").write.partitionBy("bucket").parquet(f"{path}/rows/version=1")
    assert sorted(values(keyed.read_copy(spark, path, TABLE_SCHEMA), "id")) == [1, 2]
    keyed.sync_copy(table(spark, [{"id": 1, "adr": 5.0}, {"id": 3}]), path)
    assert sorted(values(keyed.read_copy(spark, path, TABLE_SCHEMA), "id", "adr")) == [(1, 5.0), (2, 100.0), (3, 100.0)]
    assert keyed.sync_copy(table(spark, [{"id": 1}]).where("false"), path) == []


def test_few_updates_do_not_shuffle_the_base(spark, tmp_path):
    table(spark, [{"id": k} for k in range(50)]).write.parquet(str(tmp_path / "base"))
    updates = table(spark, [{"id": 3, "adr": 1.0}])
    plan = keyed.merged_rows(spark.read.schema(TABLE_SCHEMA).parquet(str(tmp_path / "base")), updates)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text and plan.count() == 50
