import random

from corpus_rows import awkward, frame
from pyspark.sql import functions as F

from lodgeframe.llm import language_id
from lodgeframe.llm.queries import op11_family_language

# Syllables that languages of one family share in part.
PARTS = {
    "de": "sch ung ein ich der zu",
    "nl": "sch ing een ij de zu",
    "en": "th ing one ly the to",
    "fr": "eau oir le ette un qu",
    "es": "ción ar lo ita un qu",
    "xx": "qwa zix vro umbo kli",
}


def sentence(lang, seed, size=30):
    dice = random.Random(f"{lang}{seed}")
    parts = PARTS[lang].split()
    return " ".join("".join(dice.choices(parts, k=dice.randrange(1, 4))) for _ in range(size)).capitalize() + "."


def corpus(n, begin=0):
    return [(begin + k, sentence(lang, begin + k), lang) for k in range(n) for lang in PARTS]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_families_then_languages_on_held_out_texts(spark):
    model = language_id.train(docs(spark, corpus(30)))
    assert [f for f, _ in model.families] == ["germanic", "romance", "xx"]
    assert dict(model.families)["germanic"] == ("de", "en", "nl")
    assert len(model.weights) == 3 + 3 + 1  # a machine for each family, and for each two languages of one
    out = language_id.predict(docs(spark, corpus(20, 1000)), model).collect()
    assert sum(r._lang == r.lang for r in out) >= 0.98 * len(out)
    assert all(0 <= r._score <= 1 and r._lang in dict(model.families)[r._family] for r in out)


def test_fit_does_not_depend_on_the_order_of_rows_nor_on_unlabelled_ones(spark):
    rows = corpus(15)
    a = language_id.train(docs(spark, rows))
    b = language_id.train(docs(spark, [*reversed(rows), (1, "neither counts", None), (2, None, "de"), (3, "12 34", "de")]).repartition(5))
    assert a.families == b.families and (a.weights == b.weights).all() and (a.intercepts == b.intercepts).all()


def test_awkward_rows_one_language_none_and_names(spark):
    rows = frame(spark, awkward() + [(30, "12 + 34 = 46 !!"), (31, "²½"), (32, "漢")]).withColumn("_score", F.lit(1))
    none = language_id.train(rows.where("false"))
    assert {(r["__lang"], r["__score"]) for r in language_id.predict(rows, none).collect()} == {("und", 0.0)}
    one = language_id.train(rows)  # all of them "en"
    for r in language_id.predict(rows, one).collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r["__lang"], r["__score"], r["__family"]) == (("en", 1.0, "germanic") if letters else ("und", 0.0, None)), r
    model = language_id.train(docs(spark, corpus(5)))
    assert language_id.predict(frame(spark, []), model).count() == 0


def test_names_of_families():
    assert [language_id.family_of(c) for c in ("pt-BR", "EN_us", "xx")] == ["romance", "germanic", "xx"]
    every = [c for members in language_id.FAMILIES.values() for c in members]
    assert len(every) == len(set(every))


def test_query_on_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    out = op11_family_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert len(out) == 1000
    plain = out[out.held_out & out.lang.notna() & (out.lang_pred != "und")]
    assert len(plain) > 100 and (plain.lang == plain.lang_pred).mean() > 0.98
    assert out.score.between(0, 1).all()
