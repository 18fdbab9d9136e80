import pyarrow as pa
from corpus_rows import awkward, frame, prose

from lodgeframe.llm import decontamination as d
from lodgeframe.llm.queries import op9_template_decontamination

ITEMS = "item_id long, text string"
QUESTION = "A train leaves with 120 passengers and Maria counts 35 km before the driver tells Maria that 120 riders are too many."


def items(spark, rows):
    return spark.createDataFrame(rows, ITEMS)


def answers(df):
    return {r.doc_id: (r["items"], r.reparameterised) for r in df.collect() if r.contaminated}


def test_copies_reparameterised_and_inconsistent(spark):
    changed = QUESTION.replace("120", "4,250.5").replace("35 km", "7 miles").replace("Maria", "Pedro")
    mixed = QUESTION.replace("Maria", "Pedro", 1).replace("120", "99", 1)
    rows = [
        (1, f"{prose(30, 1)} {QUESTION} {prose(30, 2)}"),
        (2, f"{prose(30, 3)} {QUESTION.upper() if False else QUESTION.lower()} {prose(9, 2)}"),
        (3, f"{prose(30, 4)}. {changed} {prose(30, 5)}"),
        (4, f"{prose(30, 6)}. {mixed} {prose(30, 7)}"),
        (5, prose(400, 8)),
        (6, " ".join(QUESTION.split()[:7])),
    ]
    found = answers(d.report(frame(spark, rows), items(spark, [(7, QUESTION), (8, prose(30, 99))])))
    assert found[1] == ([7], False) and found[3] == ([7], True)
    # Row 4 changes one place each of two repeated values; the fourteen tokens after them are as they were.
    assert found[4] == ([7], False)
    assert 5 not in found and 6 not in found


def test_one_changed_place_of_a_repeated_value(spark):
    first = QUESTION.replace("120", "121", 1)
    frame_only = QUESTION.replace("120", "121", 1).replace("35", "36").replace("Maria that", "Pedro that")
    rows = [(1, f"{prose(30, 1)}. {first} {prose(9, 2)}"), (2, f"{prose(30, 3)}. {frame_only} {prose(9, 4)}")]
    found = answers(d.report(frame(spark, rows), items(spark, [(7, QUESTION)])))
    # In row 2 no twelve tokens in a row are unchanged, and its values fit no single change.
    assert found == {1: ([7], False)}


def test_plain_copies_in_any_case_and_of_few_words(spark):
    marks = [(1, QUESTION), (2, "What is 12 + 35 - 7 * 4?"), (3, "Anna Berta Carla Dora Emma Frida Greta Hanna Irma Julia Karla Lena Maria")]
    rows = [
        (1, f"{prose(30, 1)} {QUESTION.lower()} {prose(9, 2)}"),
        (2, f"{prose(30, 3)} {QUESTION.upper()} {prose(9, 4)}"),
        (3, f"{prose(30, 5)} {QUESTION.title()} {prose(9, 6)}"),
        (4, f"{prose(30, 7)}. What is 12 + 35 - 7 * 4? {prose(9, 8)}"),
        (5, f"{prose(30, 9)} {marks[2][1]} {prose(9, 10)}"),
        (6, f"{prose(30, 11)}. What is 13 + 35 - 7 * 4? {prose(9, 12)}"),
        (7, f"{prose(30, 13)} {QUESTION.replace(' Maria', chr(10) + 'Maria')} {prose(9, 14)}"),
    ]
    found = answers(d.report(frame(spark, rows), items(spark, marks)))
    assert found == {1: ([1], False), 2: ([1], False), 3: ([1], False), 4: ([2], False), 5: ([3], False), 7: ([1], False)}


def test_values_that_become_equal_and_inserted_or_dropped_words(spark):
    fruit = "There are 3 apples and 5 pears in a basket that someone left near the old wooden door yesterday."
    edited = "Which of the wooden boats crossed this narrow river before any other boat reached the far shore tonight?"
    words = edited.split()
    rows = [
        (1, f"{prose(30, 1)}. {fruit.replace('3', '4').replace('5', '4')} {prose(9, 2)}"),
        (2, f"{prose(30, 3)}. {' '.join([*words[:9], 'very', *words[9:]])} {prose(9, 4)}"),
        (3, f"{prose(30, 5)}. {' '.join(words[:8] + words[9:])} {prose(9, 6)}"),
        (4, f"{prose(30, 7)}. {' '.join(words[:9])} {prose(60, 8)} {' '.join(words[9:])}"),
    ]
    found = answers(d.report(frame(spark, rows), items(spark, [(1, fruit), (2, edited)])))
    assert found == {1: ([1], True), 2: ([2], False), 3: ([2], False)}


def test_short_items_awkward_rows_and_empty_tables(spark):
    short = "Which harbor keeps seven lanterns?"
    rows = awkward() + [(30, f"{prose(20, 1)}. {short} {prose(5, 2)}"), (31, None), (31, short)]
    docs = frame(spark, rows)
    marks = items(spark, [(1, short), (2, None), (3, ""), (4, "too short"), (None, prose(40, 5))])
    report = d.report(docs, marks)
    assert report.count() == len(rows)
    found = answers(report)
    assert found[30][0] == [1] and found[31][0] == [1]
    kept = d.decontaminate(docs, marks)
    assert kept.columns == docs.columns
    assert (31, None) in [(r.doc_id, r.text) for r in kept.collect()]
    assert d.report(frame(spark, []), marks).count() == 0
    assert answers(d.report(docs, items(spark, []))) == {}
    assert d.decontaminate(docs.withColumnRenamed("lang", "h"), items(spark, [])).count() == len(rows)


def test_tokens_have_types():
    found = d.tokens(pa.array(["He paid 1,250.50 dollars to Anna. Then 3 km", None, "ÉCOLE école"]))
    kinds = found.kind.tolist()
    assert kinds == [d.WORD, d.WORD, d.NUMBER, d.UNIT, d.WORD, d.NAME, d.WORD, d.NUMBER, d.UNIT, d.WORD, d.WORD]
    assert found.row.tolist() == [0] * 9 + [2] * 2
    assert found.code[-1] == found.code[-2]


def test_query_equals_a_search_for_eight_words(spark):
    import re

    sf = "/root/testdata/sf0.001"
    word = re.compile(r"\w+")
    known = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        words = word.findall(r.text.lower())
        for k in range(len(words) - 7):
            known.setdefault(tuple(words[k : k + 8]), set()).add(r.item_id)
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = word.findall(r.text.lower())
        held = set().union(*(known.get(tuple(words[k : k + 8]), set()) for k in range(len(words) - 7)))
        if held:
            want[r.doc_id] = sorted(held)
    assert want and {i: x[0] for i, x in answers(op9_template_decontamination(spark, sf)).items()} == want
