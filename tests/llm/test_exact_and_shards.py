import hashlib
import heapq
import zlib
from collections import defaultdict

import pytest
from corpus_rows import awkward, frame, prose

from lodgeframe.llm import exact_dedup, sharding
from lodgeframe.llm.queries import op2_lpt_shards, op7_bloom_exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_text(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    return groups


def test_duplicates_equal_brute_force(spark):
    rows = awkward() + [(20 + k, "Same text") for k in range(50)] + [(90, "same Text"), (91, "SAMÉ"), (92, "samÉ"), (93, "samé")]
    groups = by_text(rows)
    found = exact_dedup.duplicates(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = (r.text or "").translate(LOWER)
        ids = [i for i in groups[text] if i is not None]
        assert r._keep_id == (max(ids) if ids else None)
        assert r._group_size == len(groups[text])
        assert r._kept == (r.doc_id == r._keep_id)
        assert r._text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    kept = exact_dedup.deduplicate(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((r.text or "").translate(LOWER) for r in kept.collect()) == sorted(groups)


def test_duplicates_of_an_empty_table_and_clashing_names(spark):
    assert exact_dedup.duplicates(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.duplicates(frame(spark, awkward()).withColumnRenamed("lang", "_kept"))
    odd = frame(spark, awkward()).withColumnRenamed("lang", "count").withColumnRenamed("source", "cell")
    assert exact_dedup.duplicates(odd).count() == len(awkward())


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "filter_blocks", lambda rows: 1)
    rows = [(k, f"text {k // 2 if k % 3 else k}") for k in range(600)]
    groups = by_text(rows)
    for r in exact_dedup.duplicates(frame(spark, rows)).collect():
        assert (r._keep_id, r._group_size) == (max(groups[r.text]), len(groups[r.text]))


def test_schedule_is_longest_first_to_the_least_loaded():
    items = [(7, "a"), (5, "b"), (5, "c"), (4, "d"), (3, "e"), (3, "f"), (3, "g")]
    heap, want = [(0, s) for s in range(3)], {}
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        want[item] = s
        heapq.heappush(heap, (load + size, s))
    assert sharding.schedule(items, 3) == want


def check_shards(rows, shards):
    sizes, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        sizes[r._shard] += r._size
        slots[r._shard].append(r._slot)
        homes[r.text or ""].add(r._shard)
        assert 0 <= r._shard < shards
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_shards_keep_groups_and_balance_bytes(spark):
    rows = [(k, prose(20 + k % 60, k)) for k in range(900)] + [(2000 + k, "a copied text") for k in range(300)]
    found = sharding.shard(frame(spark, rows), 6).collect()
    sizes = check_shards(found, 6)
    assert len(found) == len(rows)
    assert max(sizes.values()) - min(sizes.values()) <= 700  # one item
    for r in found:
        assert r._size == len(r.text.encode()) + 8
        assert r._crc32 == zlib.crc32(r.text.encode())


def test_shards_in_coarse_bundles_and_many_slot_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 7)
    rows = [(k, prose(30, k)) for k in range(500)]
    docs = frame(spark, rows)
    assigned = sharding.assign(docs, 4, docs.text, sharding.text_size(), grain=3)
    sizes = defaultdict(int)
    for r in assigned.collect():
        sizes[r._shard] += r._size
    assert max(sizes.values()) < 1.5 * min(sizes.values())
    check_shards(sharding.shard(docs, 4).collect(), 4)


def test_shards_of_awkward_and_empty_tables(spark, tmp_path):
    found = sharding.shard(frame(spark, awkward()), 24).collect()
    assert len(found) == len(awkward())
    check_shards(found, 24)
    assert {r.doc_id: r._size for r in found}[1] == 8
    assert sharding.shard(frame(spark, []), 24).count() == 0
    sharding.write_shards(frame(spark, awkward()), str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(awkward())


def test_queries_over_documents(spark):
    sf = "/root/testdata/sf0.001"
    a, b = op2_lpt_shards(spark, sf).toPandas(), op7_bloom_exact_dedup(spark, sf).toPandas()
    assert len(a) == len(b) == 200
    sizes = a.groupby("shard")["size"].sum()
    assert set(a.shard) == set(range(24)) and (a.law == "bytes").all()
    assert sizes.max() <= max(a["size"].max(), 1.34 * a["size"].sum() / 24)
    assert b.kept.sum() == b.text_sha256.nunique()
