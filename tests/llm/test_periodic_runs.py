import random
import zlib

import numpy as np
from corpus_rows import awkward, frame, prose

from lodgeframe.llm import periodic_runs


def brute(words):
    """Every longest stretch, period by period; a smaller period of the same stretch comes first."""
    out, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        start = 0
        while start + q < n:
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - start >= max(6, 4 * q):
                out.setdefault((start, end - start), q)
            start = max(start + 1, end - q + 1) if end - start > q else start + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def samples():
    dice = random.Random(5)
    rows = []
    for k in range(120):
        words = []
        while len(words) < dice.randrange(1, 400):
            kind = dice.randrange(4)
            if kind == 0:
                words += [dice.choice("abc") for _ in range(dice.randrange(30))]
            elif kind == 1:
                unit = [dice.choice("abcdefgh") for _ in range(dice.randrange(1, 40))]
                words += (unit * dice.randrange(1, 9))[: dice.randrange(1, 300)]
            elif kind == 2:
                words += ["x"] * dice.randrange(1, 60)
            else:
                inner = (["p", "q"] * dice.randrange(4, 9) + ["r"]) * dice.randrange(1, 7)
                words += inner
        rows.append(words)
    return rows


def runs_of(spark, rows):
    out = periodic_runs.find_runs(frame(spark, rows)).collect()
    return [(r.doc_id, [(x.start, x.length, x.period) for x in r._runs]) for r in out]


def test_equals_brute_force(spark):
    rows = samples()
    got = dict(runs_of(spark, [(k, dice_joined(words, k)) for k, words in enumerate(rows)]))
    for k, words in enumerate(rows):
        assert got[k] == brute(words), (k, words)
    assert sum(map(len, got.values())) > 200


def dice_joined(words, seed):
    dice = random.Random(seed)
    return "".join(dice.choice([" ", "\n", "\t ", "\x0b"]) + w for w in words)


def test_runs_across_many_tiles_are_stitched(spark):
    unit = prose(37, 1).split()
    words = prose(501, 2).split() + unit * 400 + prose(20, 3).split() + ["z"] * 5000 + ["a", "b", "c"] * 2000 + ["a"]
    (got,) = [found for _, found in runs_of(spark, [(1, " ".join(words))])]
    assert got == [(501, 400 * 37, 37), (501 + 400 * 37 + 20, 5000, 1), (501 + 400 * 37 + 5020, 6001, 3)]


def test_tiles_overlap_by_what_stitching_needs():
    ids = np.array([5] * 3 + [1, 2, 3] * 200, np.int32)
    tiles = list(periodic_runs.open_tiles(ids))
    own = [at for octave, at in tiles if octave == 1]
    assert own == list(range(0, own[-1] + 1, 2 * periodic_runs.CORE)) and len(own) > 5
    for at in own:
        (found,) = periodic_runs.fragments(ids[at : at + 2 * (periodic_runs.CORE + periodic_runs.OVERLAP)], 1)
        assert found[2] == 3
    assert not [1 for octave, at in tiles if octave == 2 for f in periodic_runs.fragments(ids[at : at + 128], 2)]  # 6 is no smallest period


def test_collapsed_texts_keep_the_first_period(spark):
    text = "start " + "ab cd " * 6 + "end\n\n" + "x " * 4
    out = periodic_runs.collapse(periodic_runs.find_runs(frame(spark, [(1, text)]))).first()
    assert (out._n, out._collapsed) == (18, "start ab cd end x x x x")


def test_awkward_rows_copies_names_and_empty_tables(spark):
    rows = awkward() + [(20, "la " * 9), (20, "la\n" * 9), (21, "la " * 9), (21, "other words"), (None, "la " * 9)]
    docs = frame(spark, rows).withColumnRenamed("lang", "_runs").withColumnRenamed("source", "_mark")
    found = periodic_runs.find_runs(docs)
    assert found.columns == [*docs.columns, "__runs"]
    out = periodic_runs.collapse(found, runs="__runs").collect()
    assert len(out) == len(rows) and {r["_runs"] for r in out} == {"en"}
    for r in out:
        words = (r.text or "").encode().split()
        assert [tuple(x) for x in r["__runs"]] == brute(words) and r._n == len(words)
    assert periodic_runs.collapse(periodic_runs.find_runs(frame(spark, []))).count() == 0


def test_tiles_stay_spread_and_runs_do_not_go_through_the_driver(spark, monkeypatch):
    rows = [(k, dice_joined(words, k)) for k, words in enumerate(samples())]
    spread, solve = [], periodic_runs.solved

    def counted(tiles):
        spread.append((tiles.rdd.getNumPartitions(), tiles.count()))
        return solve(tiles)

    monkeypatch.setattr(periodic_runs, "solved", counted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        out = periodic_runs.find_runs(frame(spark, rows))
        plan = out._jdf.queryExecution().executedPlan().toString()
        copies = frame(spark, [*rows, *rows]).coalesce(1).selectExpr("unhex(sha2(text, 256)) AS mark", "text")
        sent = periodic_runs.tiles(copies).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert spread[0][0] == 7  # small once compressed, so Spark would have joined them
    assert sent == spread[0][1]  # one task sends the tiles of one copy
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert joins and all("_block" in line for line in joins)


def test_planted_texts_without_words(spark, tmp_path):
    from lodgeframe.llm.queries import op12_periodic_runs

    planted = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0]
    texts = {k: (None, "", " \n", "one", "a b c d e f g h i j k l m n o p")[i % 5] for i, k in enumerate(planted)}
    rows = [(k, texts.get(k, "x y z")) for k in range(400)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = op12_periodic_runs(spark, str(tmp_path))
    out.write.parquet(f"{tmp_path}/out")  # all columns, so that Spark moves its filters as in a whole run
    got = {r.doc_id: r.n_runs for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert sorted(got) == list(range(400))
    assert all(got[k] == 0 for k in got if not (texts.get(k, "x") or "").strip())
