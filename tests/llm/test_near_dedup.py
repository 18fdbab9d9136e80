import random
from itertools import combinations

import numpy as np
import pyarrow as pa
from corpus_rows import awkward, frame, prose

from lodgeframe.llm import near_dedup
from lodgeframe.llm.components import components


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").split(" ")
    words = [w for part in words for w in part.replace("\n", " ").split(" ") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def answer(df):
    return {r._id: (r._shingles, r._component) for r in df.collect()}


def altered(text, changes, seed):
    words, dice = text.split(" "), random.Random(seed)
    for at in dice.sample(range(len(words)), changes):
        words[at] = f"new{seed}x{at}"
    return " ".join(words)


def test_links_equal_brute_force(spark):
    rows = [(100 + k, prose(60, k)) for k in range(40)]
    rows += [(1000 + 10 * k + j, altered(prose(150, k), j, 7 * k + j)) for k in range(12) for j in range(6)]
    rows += [(i, t) for i, t in awkward() if i not in (None, 7)] + [(11, "one TWO"), (12, prose(40, 5))]
    assert answer(near_dedup.near_duplicates(frame(spark, rows))) == brute(rows)


def test_a_crowd_of_near_copies_with_links_away_from_the_hub(spark, monkeypatch):
    """Large buckets, several components in one bucket, and blocks that meet: no link is lost."""
    monkeypatch.setattr(near_dedup, "CROWD", 3)
    monkeypatch.setattr(near_dedup, "DEEP_BLOCK", 8)
    base = prose(150, 3)
    rows = [(k, altered(base, k % 12, k)) for k in range(60)]
    far = altered(base, 25, 999)
    rows += [(500 + k, altered(far, k % 3, 2000 + k)) for k in range(30)]
    assert answer(near_dedup.near_duplicates(frame(spark, rows))) == brute(rows)


def test_repeated_null_and_empty(spark):
    found = near_dedup.near_duplicates(frame(spark, awkward()))
    rows = found.collect()
    assert len(rows) == len(awkward())
    assert [(r._component, r._kept) for r in rows if r._id is None] == [(None, True)]
    assert all(r._component == r._id and r._kept for r in rows if r._id in (1, 2, 3))
    assert {r._component for r in rows if r._id in (5, 6, 7)} == {5}
    assert {r._component for r in rows if r._id in (8, 9)} == {8}
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    kept = near_dedup.deduplicate(frame(spark, awkward()).withColumnRenamed("lang", "h"))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 5, 8, 10]


def test_signature_estimates_similarity():
    a, b = (np.unique(np.array([hash((s, k)) & (1 << 63) - 1 for k in range(800)], np.uint64)) for s in (1, 2))
    both = np.concatenate([a[:600], b[:200]])
    want = len(np.intersect1d(a, both)) / len(np.union1d(a, both))
    got = (near_dedup.signature(a, 1022) == near_dedup.signature(np.sort(both), 1022)).mean()
    assert abs(got - want) < 0.06
    assert len(list(near_dedup.shingle_sets(pa.array([None, "", "a b", "a b c d e f"])))[3]) == 2


def test_components_of_chains_stars_and_nothing(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 299)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 140)} | {299: 299, 300: 299}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
