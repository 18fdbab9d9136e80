import os
import time

import pytest
from pyspark.sql import functions as F
from rows import raw, table, values

from lodgeframe.operators.upsert import latest, upsert
from lodgeframe.schema import RAW_COLUMNS, TABLE_COLUMNS
from lodgeframe.sources import files
from lodgeframe.sources import table as store
from lodgeframe.streaming import uploads


def test_upsert_overwrites_with_null_and_keeps_missing_columns(spark):
    base = spark.sql("SELECT id, 'a' AS x, 1 AS y FROM range(1, 4)")
    updates = spark.sql("SELECT 2L AS id, CAST(NULL AS string) AS x UNION ALL SELECT 4L, 'new'")
    want = [(1, "a", 1), (2, None, 1), (3, "a", 1), (4, "new", None)]
    once = upsert(base, updates)
    assert sorted(values(once)) == want
    assert sorted(values(upsert(once, updates))) == want


def test_upsert_takes_the_last_version_of_a_hot_key(spark):
    base = spark.sql("SELECT 1L AS id, 'a' AS x")
    updates = spark.range(1000).selectExpr("1L AS id", "id AS v", "string(id) AS x")
    got = upsert(base, updates, order_by="v")
    assert values(got, "id", "x") == [(1, "999")]


def test_null_tokens_of_an_upload(spark, tmp_path):
    path = tmp_path / "up.csv"
    header = ",".join(RAW_COLUMNS)
    row = values(raw(spark, [{}]))[0]
    lines = [header]
    for meal, company in (("NULL", "NA"), ("", "5.0"), ("Undefined", "110")):
        cells = dict(zip(RAW_COLUMNS, map(str, row)))
        cells.update(meal=meal, company=company, children="0")
        lines.append(",".join(cells.values()))
    path.write_text("\n".join(lines) + "\n")
    df = files.read_bookings_csv(spark, str(path))
    assert values(df, "meal", "company") == [(None, None), (None, 5.0), ("Undefined", 110.0)]
    assert df.dtypes == list(RAW_COLUMNS.items())


def test_etl_numbers_rows_and_repeated_upload_duplicates(spark, tmp_path):
    up, base, target = (str(tmp_path / n) for n in ("up", "base", "table"))
    raw(spark, [{"country": c} for c in ("PRT", "XXX", None)]).repartition(3).write.option(
        "header", True
    ).csv(up)
    store.run_etl(spark, up, base, "1", target)
    store.run_etl(spark, up, base, "2", target)
    stored = store.read_bookings(spark, target)
    assert sorted(values(stored, "id")) == [1, 2, 3, 4, 5, 6]
    assert sorted(values(stored, "country")) == ["", "", "Portugal", "Portugal", "Unknown", "Unknown"]
    assert not store.bootstrap_if_empty(spark, target, f"{base}/hotel_bookings_clean_1")
    assert files.read_latest(spark, base).count() == 3


def test_latest_upload_prefers_the_newest_file(spark, tmp_path):
    for i, name in enumerate(("b.csv", "a.csv")):
        (tmp_path / name).write_text("hotel\nx\n")
        now = time.time() + i * 10
        os.utime(tmp_path / name, (now, now))
    assert files.latest_upload(spark, str(tmp_path)).endswith("a.csv")


def test_sync_keeps_one_row_per_booking(spark, tmp_path):
    source, first, second = (str(tmp_path / n) for n in ("t", "1", "2"))
    table(spark, [{}, {}]).write.parquet(source)
    store.sync(spark, source, None, first)
    table(spark, [{"id": 9}]).write.mode("append").parquet(source)
    assert sorted(values(store.sync(spark, source, first, second), "id")) == [1, 2, 9]


def test_documents_carry_completion_fields(spark):
    docs = store.to_documents(table(spark, [{"country": "Spain"}]))
    assert values(docs, "country_suggest.input") == [["Spain"]]


def test_streamed_uploads_equal_the_batch_and_restart_changes_nothing(spark, tmp_path):
    folder = tmp_path / "uploads"
    folder.mkdir()
    for i in range(3):
        df = raw(spark, [{"adr": float(i)}]).selectExpr(f"{i % 2} AS id", "*")
        header, row = df.columns, values(df)[0]
        (folder / f"{i}.csv").write_text(",".join(header) + "\n" + ",".join(map(str, row)) + "\n")
        os.utime(folder / f"{i}.csv", (1000 + i, 1000 + i))

    def run():
        target, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
        uploads.start_upload_sync(spark, str(folder), target, checkpoint, every=None).awaitTermination()
        return uploads.read_synced(spark, target)

    first = run()
    assert first.columns == list(TABLE_COLUMNS)
    assert sorted(values(first, "id", "adr")) == [(0, 2.0), (1, 1.0)]
    assert sorted(values(run(), "id", "adr")) == [(0, 2.0), (1, 1.0)]
    compacted = uploads.compact(spark, str(tmp_path / "table"), str(tmp_path / "compact"))
    assert compacted.count() == 2


def test_bad_cells_fail_and_are_reported(spark, tmp_path):
    header = list(RAW_COLUMNS)
    row = dict(zip(header, map(str, values(raw(spark, [{}]))[0])))
    for column, cell in (("children", "abc"), ("lead_time", "1.5"), ("agent", "x1")):
        path = tmp_path / f"{column}.csv"
        path.write_text(",".join(header) + "\n" + ",".join({**row, column: cell}.values()) + "\n")
        with pytest.raises(Exception):
            files.read_bookings_csv(spark, str(path)).collect()
        cells = files.read_cells(spark, str(path), header)
        assert values(files.cell_rejects(cells), "bad_columns") == [[column]]


def test_quotes_and_headers_in_any_order(spark, tmp_path):
    header = list(RAW_COLUMNS)[::-1]
    row = dict(zip(RAW_COLUMNS, map(str, values(raw(spark, [{}]))[0])))
    row["hotel"] = '"The ""City"" Hotel, old"'
    path = tmp_path / "up.csv"
    path.write_text(",".join(header) + "\n" + ",".join(row[c] for c in header) + "\n")
    got = files.read_bookings_csv(spark, str(path))
    assert values(got, "hotel") == ['The "City" Hotel, old'] and got.columns == list(RAW_COLUMNS)
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text(path.read_text())
    (folder / "b.csv").write_text(",".join(RAW_COLUMNS) + "\n" + ",".join(row[c] for c in RAW_COLUMNS) + "\n")
    with pytest.raises(Exception):
        files.read_bookings_csv(spark, str(folder)).collect()
    clean = table(spark, [{"hotel": 'A "quoted", name', "country": ""}])
    copy = files.write_clean_csv(clean, str(tmp_path / "clean"), "1")
    assert values(files.read_clean_csv(spark, copy), "hotel", "country") == [('A "quoted", name', "")]


def test_an_empty_number_in_a_clean_file_fails(spark, tmp_path):
    (tmp_path / "c.csv").write_text("hotel,lead_time\nx,\n")
    with pytest.raises(Exception):
        files.read_clean_csv(spark, str(tmp_path / "c.csv")).collect()


def _write_csv(spark, path, rows, ids=None):
    df = raw(spark, rows)
    lines = [",".join([*(["id"] if ids else []), *df.columns])]
    for k, row in enumerate(values(df)):
        lines.append(",".join([*([ids[k]] if ids else []), *map(str, row)]))
    path.write_text("\n".join(lines) + "\n")


def _sync(spark, tmp_path, **options):
    uploads.start_upload_sync(
        spark, str(tmp_path / "up"), str(tmp_path / "table"), str(tmp_path / "checkpoint"), every=None, **options
    ).awaitTermination()
    return uploads.read_synced(spark, str(tmp_path / "table"))


def test_three_batches_with_updates_and_inserts_then_compaction(spark, tmp_path):
    (tmp_path / "up").mkdir()
    batches = [(["1", "2", "2"], [5.0, 6.0, 7.0]), (["2", "3"], [8.0, 9.0]), (["4", "1"], [1.0, 2.0])]
    for n, (ids, prices) in enumerate(batches):
        _write_csv(spark, tmp_path / "up" / f"{n}.csv", [{"adr": p} for p in prices], ids)
        got = _sync(spark, tmp_path)
    assert sorted(values(got, "id", "adr")) == [(1, 2.0), (2, 8.0), (3, 9.0), (4, 1.0)]
    compacted = uploads.compact(spark, str(tmp_path / "table"), str(tmp_path / "compact"))
    table(spark, [{"id": 3, "adr": 99.0}]).write.parquet(str(tmp_path / "compact" / "batch_id=7"))
    again = uploads.read_synced(spark, str(tmp_path / "compact"))
    assert sorted(values(again, "id", "adr")) == [(1, 2.0), (2, 8.0), (3, 99.0), (4, 1.0)]
    assert compacted.columns == list(TABLE_COLUMNS)


def test_uploads_without_ids_get_the_next_ones(spark, tmp_path):
    (tmp_path / "up").mkdir()
    for n in range(2):
        _write_csv(spark, tmp_path / "up" / f"{n}.csv", [{"adr": float(n)}, {"adr": float(n)}])
        got = _sync(spark, tmp_path, with_ids=False)
    assert sorted(values(got, "id", "adr")) == [(1, 0.0), (2, 0.0), (3, 1.0), (4, 1.0)]


def test_a_row_without_an_id_fails_its_batch(spark, tmp_path):
    (tmp_path / "up").mkdir()
    _write_csv(spark, tmp_path / "up" / "0.csv", [{}, {}], ["1", ""])
    with pytest.raises(Exception, match="no id"):
        _sync(spark, tmp_path)


def test_sync_updates_inserts_and_keeps(spark, tmp_path):
    source, first, second = (str(tmp_path / n) for n in ("t", "1", "2"))
    table(spark, [{"id": 1, "adr": 1.0}, {"id": 2, "adr": 2.0}]).write.parquet(first)
    table(spark, [{"id": 2, "adr": 9.0}, {"id": 3, "adr": 3.0}]).write.parquet(source)
    got = store.sync(spark, source, first, second)
    assert sorted(values(got, "id", "adr")) == [(1, 1.0), (2, 9.0), (3, 3.0)]


def test_cells_with_line_feeds_quotes_and_blanks_at_their_ends_come_back(spark, tmp_path):
    cells = ["a\nb", ' "x", y\n', "\n", "  ", 'say "hi"\n\n,', "plain"]
    rows = table(spark, [{"id": k, "hotel": c} for k, c in enumerate(cells)])
    copy = files.write_clean_csv(rows, str(tmp_path / "clean"), "1")
    assert [h for _, h in sorted(values(files.read_clean_csv(spark, copy), "id", "hotel"))] == cells
    first = files.read_clean_csv(spark, copy)
    again = files.write_clean_csv(first, str(tmp_path / "clean"), "2")
    assert sorted(values(files.read_clean_csv(spark, again))) == sorted(values(first))


def test_torn_rows_fail_or_go_to_quarantine_with_their_place(spark, tmp_path):
    header = list(RAW_COLUMNS)
    row = dict(zip(header, map(str, values(raw(spark, [{}]))[0])))
    good = ",".join({**row, "hotel": '"two\nlines"'}.values())
    lines = [",".join(header), good, "torn,row", ",".join({**row, "adults": "x", "adr": "1,5"}.values()), ",".join({**row, "adults": "many"}.values()), good]
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "up" / "b.csv").write_text("\n".join([lines[0], good, good]) + "\n")
    path = str(tmp_path / "up")
    for used in (lambda df: df.count(), lambda df: df.select("hotel").collect()):
        with pytest.raises(Exception, match="torn row"):
            used(files.read_bookings_csv(spark, path))
    kept, rejects = files.quarantine_bookings_csv(spark, path)
    assert values(kept, "hotel") == ["two\nlines"] * 4 and kept.columns == header
    got = sorted((r.file.rsplit("/", 1)[1], r.place, r.reason, r.bad_columns) for r in rejects.collect())
    assert got == [("a.csv", 1, "torn", ""), ("a.csv", 2, "torn", ""), ("a.csv", 3, "type", "adults")]
    files.write_rejects(rejects, str(tmp_path / "rejects"))
    assert spark.read.parquet(str(tmp_path / "rejects")).where("row LIKE 'torn,row%'").count() == 1


def test_an_old_file_that_comes_late_wins_nothing(spark, tmp_path):
    (tmp_path / "up").mkdir()
    for name, price, written in (("new", 9.0, 3000), ("old", 1.0, 1000), ("middle", 5.0, 2000)):
        path = tmp_path / "up" / f"{name}.csv"
        ids = {"new": ["1"], "old": ["1", "2", "3", "3"], "middle": ["1", "2"]}[name]
        _write_csv(spark, path, [{"adr": price + k / 10} for k in range(len(ids))], ids)
        os.utime(path, (written, written))
        got = _sync(spark, tmp_path)
    assert sorted(values(got, "id", "adr")) == [(1, 9.0), (2, 5.1), (3, 1.3)]
    together = tmp_path / "together"
    together.mkdir()
    (tmp_path / "up").rename(together / "up")
    assert sorted(values(_sync(spark, together, files_per_batch=None), "id", "adr")) == [(1, 9.0), (2, 5.1), (3, 1.3)]
    compacted = uploads.compact(spark, str(together / "table"), str(together / "compact"))
    assert sorted(values(compacted, "id", "adr")) == [(1, 9.0), (2, 5.1), (3, 1.3)]


def test_a_sync_sends_bad_rows_to_their_table(spark, tmp_path):
    (tmp_path / "up").mkdir()
    _write_csv(spark, tmp_path / "up" / "0.csv", [{"adr": 1.0}, {"adr": 2.0}], ["1", "x"])
    got = _sync(spark, tmp_path, rejects=str(tmp_path / "rejects"))
    assert values(got, "id", "adr") == [(1, 1.0)]
    assert values(spark.read.parquet(str(tmp_path / "rejects")), "reason", "bad_columns") == [("type", "id")]


def _partitions(spark, path, header):
    return files.read_cells(spark, path, header).rdd.getNumPartitions()


def test_tasks_share_a_file_unless_a_row_has_several_lines(spark, tmp_path):
    header = ["id", "a", "b"]
    odd = ['"say ""hi"""', '""', 'x"y', '"a,b"', '"a" b"c', '""""', " \"x"]
    lines = [f"{k},{odd[k % len(odd)]},{k % 7}" for k in range(300)]
    kinds = {
        "plain": ("\n".join(["id,a,b", *lines]) + "\n", True),
        "returns": ("\r\n".join(["id,a,b", *lines]) + "\r\n", True),
        "feed": ("\n".join(["id,a,b", *lines, '300,"two\nlines",1', "301,x,2"]) + "\n", False),
        "escaped": ("\n".join(["id,a,b", *lines, '300,"""two\nlines""",1']) + "\n", False),
        "inner": ("\n".join(["id,a,b", *lines, '300,x\ry,1']) + "\n", False),
        "blank": ("\n".join(["id,a,b", *lines, "   "]) + "\n", False),
    }
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for name, (text, shared) in kinds.items():
            (tmp_path / name).mkdir()
            (tmp_path / name / "a.csv").write_bytes(text.encode())
            path = str(tmp_path / name)
            assert files.one_line_rows(spark, path) == shared, name
            assert (_partitions(spark, path, header) > 1) == shared, name
            want = files.csv_reader(spark.read, header).csv(path)
            assert sorted(map(repr, values(files.read_cells(spark, path, header)))) == sorted(map(repr, values(want))), name
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_an_upload_of_odd_name_is_synced(spark, tmp_path):
    (tmp_path / "up").mkdir()
    _write_csv(spark, tmp_path / "up" / "a [1]{x} b%20.csv", [{"adr": 3.0}], ["1"])
    assert values(_sync(spark, tmp_path), "id", "adr") == [(1, 3.0)]


def test_files_of_built_uploads_can_be_shared_out(spark, tmp_path):
    from lodgeframe.plans import catalog

    spark.range(20_000).selectExpr(
        "id AS o_orderkey", "id % 50 AS o_custkey", "DATE'2020-01-01' AS o_orderdate", "100D AS o_totalprice", "'1-URGENT' AS o_orderpriority"
    ).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(50).selectExpr("id AS c_custkey", "id % 25 AS c_nationkey", "'AUTOMOBILE' AS c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    path = catalog._upload_with_bad_rows(spark, str(tmp_path))
    assert len(spark.read.text(path).inputFiles()) > 2
    good, bad = files.quarantine_bookings_csv(spark, path)
    bad_ids = [k for k in range(20_000) if k % 97 == 5 or k % 89 == 7]
    assert good.count() == 20_000 - len(bad_ids) and bad.count() == len(bad_ids)


def test_a_sync_leaves_only_its_table(spark, tmp_path):
    from lodgeframe.sources.workspace import shared_folder, tidy_session

    folder = shared_folder(spark).removeprefix("file:")
    before = {f for f in os.listdir(folder) if f.startswith("batch-")}
    rows = raw(spark, [{"lead_time": k} for k in range(4)]).withColumn("id", F.monotonically_increasing_id())
    rows.select("id", *[c for c in rows.columns if c != "id"]).coalesce(1).write.options(**files.CSV_OPTIONS).csv(f"{tmp_path}/up")
    uploads.start_upload_sync(spark, f"{tmp_path}/up", f"{tmp_path}/table", f"{tmp_path}/check", every=None).awaitTermination()
    assert uploads.read_synced(spark, f"{tmp_path}/table").count() == 4
    assert {f for f in os.listdir(folder) if f.startswith("batch-")} == before
    own, name = tidy_session(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert own.conf.get(name) == "true" and own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")


def test_the_last_version_moves_every_column_once(spark):
    rows = spark.createDataFrame(
        [(1, "a", 2, None), (1, "b", 2, 0.5), (1, "z", 1, 9.0), (1, "y", None, 9.0), (2, None, None, None), (2, "a", None, None), (3, "c", 7, -1.0)],
        "id int, name string, v int, x double",
    )
    out = latest(rows, "id", "v")
    assert sorted(values(out)) == [(1, "b", 2, 0.5), (2, "a", None, None), (3, "c", 7, -1.0)]
    assert sorted(values(latest(rows, "id"))) == [(1, "z", 1, 9.0), (2, "a", None, None), (3, "c", 7, -1.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    moved = next(line for line in plan.splitlines() if "partial_max" in line)
    assert moved.split("partial_max", 1)[1].split("]")[0].count("name#") == 1
