import random
import zlib

from pyspark.sql import functions as F
from corpus_rows import awkward, frame, prose

from lodgeframe.llm import toxicity
from lodgeframe.llm.queries import op3_nb_toxicity

BAD = ["vilest", "grimyfool", "rotbrain"]


def corpus(n, seed):
    dice = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words, toxic = prose(60, seed * 1000 + k).split(), int(k % 4 == 0)
        for _ in range(3 * toxic):
            words.insert(dice.randrange(len(words)), dice.choice(BAD) + dice.choice(["", "s", "ish"]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, toxic))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus(240, 1)
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks, toxicity.fold() != 0)
    want = {i: t for i, _, t in labels}
    for r in toxicity.score(docs, model).collect():
        assert 0 <= r._score <= 1
        assert (r._score >= 0.5) == bool(want[r.doc_id]), (r.doc_id, r._score)


def test_nothing_of_held_out_rows_is_learnt(spark):
    rows, labels = corpus(80, 2)
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    flipped = [(i, q, 1 - t if i in held else t) for i, q, t in labels]
    changed = [(i, "other words" if i in held else t) for i, t in rows]
    scores = []
    for texts, marks in ((rows, labels), (changed, flipped)):
        model = toxicity.train(frame(spark, texts), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), toxicity.fold() != 0)
        scores.append({r.doc_id: r._score for r in toxicity.score(frame(spark, rows), model).collect()})
    assert all(abs(scores[0][i] - scores[1][i]) < 1e-9 for i in scores[0])


def test_awkward_rows_null_labels_and_one_class(spark):
    docs = frame(spark, awkward())
    schema = "doc_id long, quality int, toxic int"
    none = toxicity.train(docs, spark.createDataFrame([], schema), F.lit(True))
    assert {round(r._score, 6) for r in toxicity.score(docs, none).collect()} == {0.5}
    clean = toxicity.train(docs, spark.createDataFrame([(5, 1, 0), (8, None, None), (None, 1, 1)], schema), F.lit(True))
    assert all(r._score < 0.5 for r in toxicity.score(docs, clean).collect())
    both = toxicity.train(docs, spark.createDataFrame([(5, 1, 0), (2, 1, 1), (2, 1, 1), (7, 1, 1)], schema), F.lit(True))
    scored = toxicity.score(docs.withColumnRenamed("lang", "label"), both)
    assert scored.count() == len(awkward()) and scored.columns[-1] == "_score"
    assert toxicity.score(frame(spark, []), both).count() == 0


def test_features_are_the_distinct_character_ngrams():
    (found,) = toxicity.features(["Ab  AB"])
    text = " ab ab "
    want = {text[k : k + n] for n in toxicity.NGRAMS for k in range(len(text) - n + 1)}
    assert len(found) == len(set(found.tolist())) == len(want)
    assert [len(x) for x in toxicity.features([None, "", " "])] == [0, 0, 0]


def test_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    scored = op3_nb_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert len(scored) == 399
    held = scored[scored.held_out]
    assert ((held.predicted == held.toxic).mean() > 0.95) and (held[held.toxic == 0].predicted == 0).all()
