import random

import pytest
from rows import table, values

from lodgeframe.functions.text import clean_markdown, edit_distance, tokens_of
from lodgeframe.operators import fulltext


def brute_distance(a: str, b: str) -> int:
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(
                d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1])
            )
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edit_distance_equals_brute_force(spark):
    rng = random.Random(7)
    pairs = [("portugal", "portgual"), ("ab", "ba"), ("ca", "abc"), ("é", "e")]
    pairs += [
        ("".join(rng.choices("abé", k=rng.randint(1, 7))), "".join(rng.choices("abé", k=rng.randint(1, 7))))
        for _ in range(60)
    ]
    df = spark.createDataFrame(pairs, "a string, b string")
    for a, b, d in values(df.selectExpr("a", "b", f"{edit_distance('a', 'b')} AS d")):
        assert d == brute_distance(a, b), (a, b)


def test_fuzzy_search_tolerates_a_swap_and_needs_every_term(spark):
    df = table(spark, [{"country": "Portugal"}, {"country": "Poland"}, {"country": "ab"}, {"country": None}])
    ids = lambda q, fields=("country",): sorted(values(fulltext.full_text_search(df, q, fields), "id"))
    assert ids("portgual") == [1]
    assert ids("ba") == []
    assert ids("portugal poland") == []
    assert ids("portugal city", ("country", "hotel")) == [1]
    assert ids("portugal  city", ("country", "hotel")) == []
    assert ids("") == []
    with pytest.raises(ValueError):
        fulltext.full_text_search(df, "2", ["adults"])


def test_matches_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["hotel", "hostel", "motel", "hotels", "resort", "resorts", "city", "cite", "of", "off", "fo"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for query in ("hotel", "hotle of", "resrot city", "off"):
        want = []
        for i, text in enumerate(texts):
            if all(
                any(
                    brute_distance(t, q) <= fulltext.allowed_edits(q) for t in tokens_of(text)
                )
                for q in query.split(" ")
            ):
                want.append(i)
        assert sorted(values(fulltext.full_text_matches(df, query, ["text"]), "id")) == want
        assert values(fulltext.full_text_total(df, query, ["text"])) == [len(want)]


def test_suggestions(spark):
    df = table(spark, [{"country": c} for c in ("Spain", "Sweden", "spam", "Spain", "Italy", None)])
    assert values(fulltext.suggest(df, "sp", "country_suggest")) == ["Spain", "spam"]
    assert values(fulltext.suggest(df, "S", "country_suggest", size=1)) == ["Spain"]
    with pytest.raises(ValueError):
        fulltext.suggest(df, "x", "country")


def test_clean_markdown(spark):
    df = spark.createDataFrame([("```markdown\n# A\n## B\n```",)], "text string")
    assert values(df.select(clean_markdown("text"))) == ["\n### A\n###### B\n"]


def test_more_than_fifty_near_tokens_are_all_found(spark):
    words = [a + b + "otel" for a in "abcdefgh" for b in "abcdefghij"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(999, "hotel inn")], "id long, text string")
    near = [i for i, w in enumerate(words) if brute_distance(w, "hotel") <= 1]
    far = [i for i, w in enumerate(words) if brute_distance(w, "aaotel") <= 2]
    assert len(far) > 10 and values(fulltext.full_text_total(df, "hotel", ["text"])) == [len(near) + 1]
    many = [f"{a}{b}tel" for a in "bcdfghjk" for b in "abcdefghijk"]
    df = spark.createDataFrame(list(enumerate(many)), "id long, text string")
    want = [i for i, w in enumerate(many) if brute_distance(w, "hotelx") <= 2]
    assert len(want) > 8
    assert sorted(values(fulltext.full_text_matches(df, "hotelx", ["text"]), "id")) == want
    vocab = fulltext.vocabulary(df, ["text"], ["aotel"])
    assert fulltext.expand_terms(vocab, ["aotel"]).count() == sum(brute_distance(w, "aotel") <= 1 for w in many)
    scored = values(fulltext.full_text_search(df, "hotelx", ["text"], size=500), "id")
    assert sorted(scored) == want
