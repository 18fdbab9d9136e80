from corpus_rows import awkward, frame, prose
from test_near_dedup import altered

import corpus_pipeline
from lodgeframe.llm.bpe import decode_ids
from lodgeframe.llm.queries import RANKS


def write(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_each_stage_does_its_work(spark, tmp_path):
    clean = [(k, prose(80, k)) for k in range(60)]
    toxic = [(100 + k, f"{prose(60, 500 + k)} vilest grimyfool rotbrain vilest") for k in range(30)]
    copies = [(200 + k, clean[k][1].upper()) for k in range(5)]
    near = [(300 + k, altered(clean[10 + k][1], 1, k)) for k in range(5)]
    item = prose(25, 9000)
    leaks = [(400, f"{prose(30, 9001)}. {item} {prose(30, 9002)}")]
    odd = [(i, t) for i, t in awkward() if i in (1, 2)]
    odd = [(600 + i, t) for i, t in odd]
    rows = clean + toxic + copies + near + leaks + odd
    labels = [(i, 1, 0) for i, _ in clean[:40]] + [(i, 1, 1) for i, _ in toxic[:20]] + [(599, 1, None)]
    folder = str(tmp_path / "sf")
    write(spark, folder, frame(spark, rows), labels, [(1, item)])
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    # Exact copies keep the largest id, near copies the smallest; one of the two empty texts stays.
    want = {i for i, _ in clean[5:]} | {200 + k for k in range(5)} | {602}
    assert set(out) == want
    texts = {i: t or "" for i, t in rows}
    assert all(decode_ids(r.ids, RANKS).decode() == texts[i] for i, r in out.items())


def test_an_empty_table_passes(spark, tmp_path):
    folder = str(tmp_path / "sf")
    write(spark, folder, frame(spark, []), [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages_in_order():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "byte_bpe"]
