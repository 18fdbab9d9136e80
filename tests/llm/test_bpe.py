import random
from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken
from corpus_rows import awkward, frame, prose

from lodgeframe.llm import bpe
from lodgeframe.llm.queries import PATTERN, RANKS, op4_byte_bpe


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def odd_texts(n):
    dice = random.Random(4)
    letters = [chr(c) for c in [*range(0x20, 0x250), 0x301, 0x3000, 0x200B, 0x85, 0xA0, 0x2028, 0x1F600, 0x4E2D]]
    pool = letters + [" "] * 150 + ["\n"] * 40 + list("'s't're'LL  12 aab")
    return ["".join(dice.choice(pool) for _ in range(dice.randrange(50))) for _ in range(n)]


def test_ids_equal_the_other_library(library):
    texts = odd_texts(3000) + ["", "a" * 9000 + " " * 3000 + "é" * 3000, " lead", "trail ", "a  b\n\nc", "<|endoftext|>"]
    encoder = bpe.PieceEncoder(RANKS, PATTERN, remembered=200)
    assert [encoder.ids(t) for t in texts] == [library.encode_ordinary(t) for t in texts]
    assert [e.ids for e in bpe.encode_texts(texts, RANKS, PATTERN)] == [library.encode_ordinary(t) for t in texts]


def test_runs_beside_other_white_space(library):
    texts = ["a\tb\tc d\n\n", "foo\u00a0bar\u00a0baz qux\n\n\nnext line", "a\r\nb c  d\n\ne\r", "\n\na\x1cb\x1fc", " a\tb", "a\u2028b ", "a\tb  c"]
    dice = random.Random(5)
    pool = list("ab1.'") + [" ", "\n"] * 3 + list("\t\r\u00a0\x0b\x1c\x1d\x1e\x1f\x85\u2028\u3000")
    texts += ["".join(dice.choice(pool) for _ in range(dice.randrange(12))) for _ in range(20000)]
    encoder = bpe.PieceEncoder(RANKS, PATTERN)
    assert [encoder.ids(t) for t in texts] == [library.encode_ordinary(t) for t in texts]


def test_round_trip_offsets_and_split_characters(spark, library):
    docs = frame(spark, awkward())
    encoded = bpe.encode(docs, RANKS, PATTERN)
    back = bpe.decode(encoded, RANKS, pieces=True).collect()
    assert len(back) == len(awkward())
    for r in back:
        text = r.text or ""
        assert r._ids == library.encode_ordinary(text)
        assert r._text == text and r._bytes == text.encode() and "".join(r._pieces) == text
        covered = [text[a:b] for a, b in zip(r._starts, r._ends)]
        assert not text or "".join(covered) >= text[:1] and r._ends[-1] == len(text)
    smile = library.encode_ordinary("🙂")
    assert len(smile) > 1 and bpe.token_texts(smile, RANKS)[-1] == "🙂" and bpe.token_texts(smile, RANKS)[0] == ""
    assert bpe.decode_ids(smile[:1], RANKS).decode("utf-8", "replace") == "�"
    with pytest.raises(ValueError):
        bpe.decode_ids([10**9], RANKS)


def test_other_ranks_and_empty_tables(spark):
    many = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    text = "Straße " + prose(30, 1)
    assert bpe.decode_ids(bpe.PieceEncoder(many, PATTERN).ids(text), many).decode() == text
    assert bpe.encode_ids(frame(spark, []), RANKS, PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode_ids(frame(spark, []).withColumnRenamed("lang", "_ids"), RANKS, PATTERN)


def test_query_equals_brute_force(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op4_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(texts[r.doc_id].encode()).hexdigest()
