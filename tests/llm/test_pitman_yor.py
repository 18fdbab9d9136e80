import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from corpus_rows import awkward, frame, prose

from lodgeframe.llm import pitman_yor as p

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def test_base_scores_equal_brute_force(spark, tmp_path):
    rows = awkward() + [(200 + k, prose(50, k % 30)) for k in range(60)]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    trained = [(i, t) for i, t in rows if i is None or i % 3]
    counts = Counter(w for _, t in trained for w in words(t))
    n, v = sum(counts.values()), len(counts)
    found = p.score(docs, F.col("doc_id") % 3 != 0).collect()
    assert len(found) == len(rows)
    want = sorted((i or -1, len(words(t)), sum(counts[w] > 0 for w in words(t)), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows)
    got = sorted((r.doc_id or -1, r._n_tokens, r._n_known, r._base_score) for r in found)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(a[3] - b[3]) < 1e-6 * abs(b[3]) for a, b in zip(got, want))
    assert {r._train_tokens for r in found} == {n} and all(r._score < 0 for r in found)
    assert sum(r._score for r in found) > sum(r._base_score for r in found)


def test_parts_packs_and_splits_change_nothing(spark, tmp_path, monkeypatch):
    rows = [(k, f"the of {prose(30, k)} the of the of") for k in range(120)]
    frame(spark, rows).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(p, "PARTITION_BYTES", 900)
    whole = {r.doc_id: r for r in p.score(docs, F.col("doc_id") < 100).collect()}
    monkeypatch.setattr(p, "PACKED_TOKENS", 200)
    monkeypatch.setattr(p, "SPLIT_MOST", 1 << 30)
    parts = {r.doc_id: r for r in p.score(docs, F.col("doc_id") < 100).collect()}
    assert whole.keys() == parts.keys()
    for i, r in whole.items():
        assert (r._n_tokens, r._n_known) == (parts[i]._n_tokens, parts[i]._n_known)
        assert abs(r._score - parts[i]._score) < 1e-6 and abs(r._base_score - parts[i]._base_score) < 1e-6


def test_predictive_probabilities_sum_to_one():
    keys, _ = p.text_tokens(pa.array([f"{prose(40, 1)} {prose(40, 2)}", prose(60, 1)]))
    keys, counts = np.unique(keys, return_counts=True)
    vocabulary = len(np.unique(keys >> np.uint64(16)))
    own = p.Partition(keys, counts, vocabulary)
    customers = np.bincount((keys & np.uint64(0xFFFF)).astype(np.int64), counts, 1 << 16)
    sums = [p.Tables(int(a[0]), b, c) for a, b, c in [own.sums()]]
    for k in range(4):
        own.sweep(sums[-1], np.random.default_rng(k))
        a, b, c = own.sums()
        sums.append(p.Tables(int(a[0]), b, c))
        at_root, at_coarse = own._children()
        assert (own.tables[2] >= 1).all() and (own.tables[2] <= own.counts).all()
        assert (own.tables[1] >= 1).all() and (own.tables[1] <= at_coarse).all() and (own.tables[0] <= at_root).all()
    now = sums[-1]
    root = own.root(now, at_root, own.tables[0])
    unknown = own.root(now, 0, 0)
    assert abs(root.sum() + unknown - 1) < 1e-9
    context = int(own.fine[0])
    coarse = context >> p.FINE_BITS
    _, totals = now.customers
    c1, t1 = np.zeros(len(own.words)), np.zeros(len(own.words))
    here = own.coarse == coarse
    c1[own.to_word[here]], t1[own.to_word[here]] = at_coarse[here], own.tables[1][here]
    middle = p.given(1, c1, t1, totals[coarse], now.coarse[coarse], root)
    rest = p.given(1, 0, 0, totals[coarse], now.coarse[coarse], unknown)
    assert abs(middle.sum() + rest - 1) < 1e-9
    c2, t2 = np.zeros(len(own.words)), np.zeros(len(own.words))
    fine = own.fine == context
    c2[own.to_word[own.to_coarse[fine]]], t2[own.to_word[own.to_coarse[fine]]] = own.counts[fine], own.tables[2][fine]
    last = p.given(2, c2, t2, customers[context], now.fine[context], middle)
    assert abs(last.sum() + p.given(2, 0, 0, customers[context], now.fine[context], rest) - 1) < 1e-9


def test_no_training_rows_and_empty_tables(spark, tmp_path):
    frame(spark, [(1, "a b"), (2, None)]).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    found = {r.doc_id: (r._n_tokens, r._n_known, r._train_tokens, r._base_score, r._score) for r in p.score(docs, F.lit(False)).collect()}
    assert found == {1: (3, 0, 0, 0.0, 0.0), 2: (1, 0, 0, 0.0, 0.0)}
    assert p.score(frame(spark, []), F.lit(True)).count() == 0


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    sf = "/root/testdata/sf0.001"
    from lodgeframe.llm.queries import op1_pitman_yor

    out = op1_pitman_yor(spark, sf).toPandas()
    held = out[out.held_out]
    assert len(out) == 200 and held.score.sum() > held.base_score.sum()
