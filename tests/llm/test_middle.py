import random
from hashlib import sha256

import pytest
from corpus_rows import awkward, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from lodgeframe.llm import middle

MARKS = [x.encode() for x in middle.SENTINELS]


def expected(i, text):
    text, digest = text or "", sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not n or h3 % 100 >= 90 or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_equals_string_slices_and_restores(spark):
    dice = random.Random(3)
    rows = awkward() + [(100 + k, prose(dice.randrange(1, 40), k)) for k in range(200)]
    rows += [(400, "a <S> b"), (401, "<P><M>"), (402, "<<P"), (403, "<" * 50), (404, "S>M>P>" * 9), (405, "\x00\x01é")]
    out = middle.restore(middle.fill_in_middle(frame(spark, rows)))
    got = sorted(((r.doc_id, r._n, r._form, r._prefix_chars, r._middle_chars, r._output, r._restored) for r in out.collect()), key=repr)
    want = sorted(((i, *expected(i, t), t or "") for i, t in rows), key=repr)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


@settings(deadline=None, max_examples=200)
@given(st.text(st.sampled_from("ab<>PSMé漢🙂"), min_size=1), st.integers(0, 99), st.integers(0, 99), st.sampled_from(["psm", "spm"]))
def test_rotations_bring_the_text_back(text, x, y, form):
    if any(s in text for s in middle.SENTINELS):
        return
    a, b = sorted((x % (len(text) + 1), y % (len(text) + 1)))
    buffer = bytearray(text.encode())
    middle.rearrange(buffer, a, b, form, MARKS)
    p, m, s = text[:a], text[a:b], text[b:]
    assert buffer.decode() == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")
    middle.arrange_back(buffer, form, MARKS)
    assert buffer.decode() == text


def test_rotation_of_blocks_longer_than_the_swap():
    data = random.Random(1).randbytes(5 * middle.BLOCK + 7)
    buffer = bytearray(data)
    middle.rotate(buffer, 3, 2 * middle.BLOCK + 1, len(data) - 2)
    assert buffer == data[:3] + data[2 * middle.BLOCK + 1 : -2] + data[3 : 2 * middle.BLOCK + 1] + data[-2:]


def test_names_own_sentinels_and_empty_tables(spark):
    docs = frame(spark, [(1, "one two three"), (2, None)]).withColumnRenamed("lang", "_form").withColumnRenamed("source", "__digest")
    out = middle.fill_in_middle(docs, sentinels=("⟨p⟩", "⟨s⟩", "⟨m⟩"))
    assert out.columns == [*docs.columns, *(f"___{c}" for c in ("n", "form", "prefix_chars", "middle_chars", "output"))]
    back = middle.restore(out, "___output", "___form", ("⟨p⟩", "⟨s⟩", "⟨m⟩")).orderBy("doc_id").collect()
    assert [r._restored for r in back] == ["one two three", ""] and back[0]["_form"] == "en"
    assert middle.restore(middle.fill_in_middle(frame(spark, []))).count() == 0
    with pytest.raises(ValueError):
        middle.fill_in_middle(docs, sentinels=("ab", "ba", "c"))
