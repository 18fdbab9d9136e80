import random

import pytest
from rows import values

from lodgeframe.functions.text import deletions, edit_distance
from lodgeframe.operators import fulltext, textindex

WORDS = "alpha beta gamma delta epsilon zeta theta lambda omega sigma the a of to".split()


def texts(n, seed):
    dice = random.Random(seed)

    def word():
        w = dice.choice(WORDS)
        return w if dice.random() < 0.7 or len(w) < 4 else w[:2] + dice.choice("xyz") + w[3:]

    return [(k, " ".join(word() for _ in range(dice.randrange(0, 30))) if k % 9 else None, dice.choice(WORDS)) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, body string, title string")


def scores(df, query, fields):
    return {r.id: round(r.score, 9) for r in fulltext.full_text_search(df, query, fields, size=10_000).collect()}


def indexed(spark, path, query, fields):
    return {r.key: round(r.score, 9) for r in textindex.search(spark, path, query, fields, size=None).collect()}


QUERIES = [("gama", ["body"]), ("gamma deltt", ["body", "title"]), ("the", ["title"]), ("aplha omega-sigma", ["body"]), ("nothingnear", ["body"])]


def test_an_index_finds_and_scores_like_the_text(spark, tmp_path):
    path, df = str(tmp_path / "i"), frame(spark, texts(150, 1)).cache()
    textindex.build(df, ["body", "title"], path)
    hits = 0
    for query, fields in QUERIES:
        want = scores(df, query, fields)
        assert indexed(spark, path, query, fields) == want, query
        hits += len(want)
    assert hits > 50
    assert indexed(spark, path, "two  blanks", ["body"]) == {}
    top = textindex.search(spark, path, "gamma", ["body"], size=3).collect()
    assert [r.key for r in top] == values(fulltext.full_text_search(df, "gamma", ["body"], size=3), "id")


def test_changes_are_signed_differences(spark, tmp_path):
    path, rows = str(tmp_path / "i"), texts(80, 2)
    textindex.build(frame(spark, rows), ["body", "title"], path)
    other = {k: (b, t) for k, b, t in texts(80, 3)}
    # Every third row changes, every tenth goes, ten are new; a repeated batch changes nothing.
    gone = [r for r in rows if r[0] % 3 == 0 or r[0] % 10 == 0]
    new = [(k, *other[k]) for k, _, _ in gone if k % 10] + [(k, "omega the " * 3, "sigma") for k in range(500, 510)]
    for _ in range(2):
        textindex.update(spark, path, frame(spark, gone), frame(spark, new), ["body", "title"], 1)
    now = frame(spark, [r for r in rows if r not in gone] + new).cache()
    # Two more batches that undo each other.
    some = frame(spark, new[:5])
    textindex.update(spark, path, some, some.where("false"), ["body", "title"], 2)
    textindex.update(spark, path, some.where("false"), some, ["body", "title"], 3)
    textindex.compact(spark, path, str(tmp_path / "c"))
    fresh = str(tmp_path / "fresh")
    textindex.build(now, ["body", "title"], fresh)
    for at in (path, str(tmp_path / "c")):
        for query, fields in QUERIES:
            assert indexed(spark, at, query, fields) == scores(now, query, fields), query
        for got, want in zip(textindex.statistics(spark, at), textindex.statistics(spark, fresh)):
            assert sorted(values(got)) == sorted(values(want))


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    path = str(tmp_path / "i")
    with pytest.raises(ValueError, match="no token index"):
        textindex.search(spark, path, "x", ["body"])
    textindex.build(frame(spark, texts(10, 4)), ["body"], path)
    before = indexed(spark, path, "gamma", ["body"])
    frame(spark, texts(5, 5)).selectExpr("'body' AS field", "'gamma' AS token", "id AS key", "1 AS length", "1 AS tf", "1 AS sign", "0L AS part").write.partitionBy(
        "part"
    ).parquet(f"{path}/postings/batch=1")
    assert indexed(spark, path, "gamma", ["body"]) == before
    empty = str(tmp_path / "empty")
    textindex.build(frame(spark, []), ["body"], empty)
    assert indexed(spark, empty, "gamma", ["body"]) == {}


def near(spark, tokens, words):
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    return {(r.token, r.word, r.distance) for r in fulltext.near_tokens(fulltext.token_variants(df), words).collect()}


def test_words_and_tokens_meet_on_what_deletions_leave(spark):
    dice = random.Random(7)
    tokens = sorted({"".join(dice.choices("abc", k=dice.randrange(1, 9))) for _ in range(400)})
    words = ["ab", "abc", "abcab", "abcabc", "cabbac", "bacabcab"]
    pairs = spark.createDataFrame([(t, w, fulltext.allowed_edits(w)) for t in tokens for w in words], "t string, w string, e int")
    want = pairs.selectExpr("t", "w", f"{edit_distance('t', 'w')} AS d", "e").where("d <= e").collect()
    assert near(spark, tokens, words) == {(r.t, r.w, r.d) for r in want} and len(want) > 60
    assert spark.sql(f"SELECT {deletions(repr('aab'), 2)} AS v").first().v == ["aab", "ab", "aa", "b", "a"]


def test_the_expansion_is_an_equi_join(spark, capsys):
    vocab = frame(spark, texts(20, 1)).selectExpr("'body' AS field", "explode(split(body, ' ')) AS token", "1L AS doc_freq")
    fulltext.expand_terms(vocab, ["gamma", "deltas"]).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan and ("HashJoin [variant" in plan or "SortMergeJoin [variant" in plan)


def test_the_index_grows_with_the_letters_of_its_tokens(spark, tmp_path):
    # Of a token of 300 letters, deletions of two leave some 45,000 strings of 298: none is stored.
    path = tmp_path / "i"
    words = ["".join(random.Random(k).choices("abcdefgh", k=300)) for k in range(10)]
    textindex.build(frame(spark, [(k, w, None) for k, w in enumerate(words)]), ["body"], str(path))
    assert sum(f.stat().st_size for f in path.rglob("*.parquet")) < 300_000
    assert set(indexed(spark, str(path), words[3][:100] + words[3][102:], ["body"])) == {3}


def test_text_is_analysed_once_and_dealt_once(spark, tmp_path, capsys):
    rows = frame(spark, texts(20, 1))
    textindex._counted(textindex._dealt(textindex._occurrences(rows, ["body"], "id", 1))).explain()
    assert capsys.readouterr().out.count("Exchange") == 1
