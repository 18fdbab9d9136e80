"""One query for each operator over the whole documents table, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeframe.llm import bpe, decontamination, exact_dedup, language_id, licence_scan, middle, near_dedup, periodic_runs, pitman_yor
from lodgeframe.llm import secrets_scan, sharding, surrogates, toxicity

SHARDS = 24
#: The key of this query's surrogates; users pass their own.
SECRET = b"surrogates of the documents table"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    held_out = F.coalesce(remainder == 2, F.lit(False))
    out = pitman_yor.score(documents(spark, sf_dir).select("doc_id", "text"), ~held_out)
    return out.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("_n_tokens").alias("n_tokens"),
        F.col("_n_known").alias("n_known"),
        F.col("_train_tokens").alias("train_tokens"),
        F.col("_base_score").alias("base_score"),
        F.col("_score").alias("score"),
    )


def op2_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(documents(spark, sf_dir).select("doc_id", "text"), SHARDS)
    return out.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_crc32").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op3_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, labels(spark, sf_dir), toxicity.fold() != 0)
    scored = toxicity.score(docs, model).drop("text")
    return scored.select(
        "doc_id",
        F.coalesce(toxicity.fold() == 0, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), RANKS, PATTERN)
    return out.select(
        "doc_id",
        F.col("_n_tokens").alias("n_tokens"),
        F.col("_ids_sha256").alias("ids_sha256"),
        F.col("_decoded_sha256").alias("decoded_sha256"),
    )


def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        F.col("_id").alias("doc_id"),
        F.col("_shingles").alias("n_shingles"),
        F.col("_component").alias("component_id"),
        F.col("_kept").alias("kept"),
    )


def op6_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.scan(documents(spark, sf_dir).select("doc_id", "text"))

    def of(*kinds: str):
        return F.filter("_secrets", lambda s: s["kind"].isin(*kinds))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(of("assign", "access", "hex")), 256).alias("base_sha256"),
        joined(F.col("_secrets")).alias("spans"),
    )


def op7_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("_keep_id").alias("keep_id"),
        F.col("_group_size").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.col("_text_sha256").alias("text_sha256"),
    )


def op8_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = licence_scan.scan(licence_scan.phrase_places(docs.withColumn("n_words", licence_scan.word_count())))
    base = F.array_sort(F.array_distinct(F.transform("_places", lambda p: p["label"])))
    labels = F.array_sort(F.array_union(base, F.transform("_detections", lambda d: d["label"])))
    score = F.greatest(
        F.when(F.size("_places") > 0, 0.6).otherwise(0.0), F.coalesce(F.array_max(F.transform("_detections", lambda d: d["weight"])), F.lit(0.0))
    )
    return found.select(
        "doc_id",
        "n_words",
        F.size("_places").cast("long").alias("n_base"),
        F.array_min(F.transform("_places", lambda p: p["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_places", lambda p: p["at"])).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
        F.array_join(F.transform("_detections", lambda d: F.concat_ws(":", d["label"], d["start"], d["end"])), ",").alias("detections"),
    )


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(documents(spark, sf_dir).select("doc_id", "text"), benchmark(spark, sf_dir))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), SECRET)
    kinds = F.transform("_entities", lambda e: e["kind"])

    def count(*names: str):
        return F.size(F.filter(kinds, lambda k: k.isin(*names))).cast("long")

    return out.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("mail", "phone", "ip", "card")),
        count("given-f", "given-m", "family").alias("n_name"),
        F.array_join(F.transform("_entities", lambda e: F.concat_ws(":", e["kind"], e["start"], e["end"])), ",").alias("spans"),
        "text",
    )


def op11_family_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    fold = toxicity.fold()
    model = language_id.train(docs.where(F.coalesce(fold != 0, F.lit(False))))
    out = language_id.predict(docs.drop("lang"), model)
    return out.select(
        "doc_id",
        F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
        F.col("_lang").alias("lang_pred"),
        F.col("_score").alias("score"),
        F.col("_family").alias("family"),
    )


def _planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of every tenth row, by the CRC of its id, the words from one place on repeat the first of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    some = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n, a, p = F.col("n"), F.col("a").cast("int"), F.col("p").cast("int")
    split = docs.where(some).select("doc_id", words.alias("words")).withColumn("n", F.size("words")).where("n > 0")
    # Later filters may be moved before this one, so what is made of a text without words must not fail.
    split = split.withColumn("a", g % F.greatest(n, F.lit(1))).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    repeated = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), a), F.slice(repeated, F.lit(1), n - a)), " ")
    empty = some & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return docs.where(~some | empty).select("doc_id", "text").unionByName(split.select("doc_id", made.alias("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _planted_period(documents(spark, sf_dir).select("doc_id", "text"))
    out = periodic_runs.collapse(periodic_runs.find_runs(docs))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    # Runs come by start and period, so a later one must be stronger to count; products compare length / period exactly.
    best = F.aggregate(
        "_runs",
        none,
        lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a),
    )
    lines = F.transform("_runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = out.select("doc_id", "_n", "_runs", "_collapsed", best.alias("best"), F.array_join(lines, "").alias("lines"))
    return out.select(
        "doc_id",
        F.size("_runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("_collapsed", 256).alias("collapsed_sha256"),
    )


def op13_block_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = middle.restore(middle.fill_in_middle(documents(spark, sf_dir).select("doc_id", "text")))
    return out.select(
        "doc_id",
        F.col("_n").alias("n"),
        F.col("_form").alias("form"),
        F.col("_prefix_chars").alias("prefix_chars"),
        F.col("_middle_chars").alias("middle_chars"),
        F.sha2("_output", 256).alias("output_sha256"),
        F.sha2("_restored", 256).alias("restored_sha256"),
    )


QUERIES = {
    "op1_pitman_yor": op1_pitman_yor,
    "op2_lpt_shards": op2_lpt_shards,
    "op3_nb_toxicity": op3_nb_toxicity,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_circulant_minhash": op5_circulant_minhash,
    "op6_trigram_secrets": op6_trigram_secrets,
    "op7_bloom_exact_dedup": op7_bloom_exact_dedup,
    "op8_licence_rules": op8_licence_rules,
    "op9_template_decontamination": op9_template_decontamination,
    "op10_surrogates": op10_surrogates,
    "op11_family_language": op11_family_language,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_block_rotation": op13_block_rotation,
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op5_circulant_minhash": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex({LOWERED}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w
            FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
            FROM w),
        e AS (SELECT doc_id, md5_number_lower(unnest(s)) AS h FROM s),
        n AS (SELECT doc_id, len(s) AS n FROM s),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id
            GROUP BY 1, 2),
        l AS (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
        r(doc_id, seen) AS (
            SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
        SELECT doc_id, any_value(n.n) AS n_shingles, min(seen) AS component_id, doc_id = min(seen) AS kept
        FROM r JOIN n USING (doc_id) GROUP BY doc_id""",
    "op7_bloom_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op12_periodic_runs": """
        WITH b AS (  -- CRC-32 of the decimal id, bit by bit
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w,
                   list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT) AS c
            FROM documents),
        k AS (
            SELECT doc_id, w, len(w) AS n, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, c), lambda s, x:
                   list_reduce(list_prepend(xor(s, x), [1, 2, 3, 4, 5, 6, 7, 8]::UBIGINT[]),
                               lambda v, bit: xor(v >> 1, 3988292384::UBIGINT * (v & 1))))) AS h FROM b),
        a AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM k),
        p AS (SELECT *, CASE WHEN a IS NOT NULL THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
        t AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n::BIGINT), lambda i:
                   w[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END)::BIGINT + 1]) END AS w FROM p),
        u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
        e AS (  -- equal words a period apart, and stretches of such places
            SELECT x.doc_id, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
            FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i JOIN t ON t.doc_id = x.doc_id AND 4 * (y.i - x.i) <= t.n),
        f AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM e GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
        r AS (SELECT doc_id, s, l, min(q) AS q FROM f GROUP BY doc_id, s, l),
        o AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id),
        best AS (
            SELECT * FROM r x WHERE NOT EXISTS (
                FROM r y WHERE y.doc_id = x.doc_id
                AND (y.l * x.q > x.l * y.q OR (y.l * x.q = x.l * y.q AND (y.s < x.s OR (y.s = x.s AND y.q < x.q)))))),
        d AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
        c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN d USING (doc_id, i) GROUP BY doc_id)
        SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM t LEFT JOIN o USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op13_block_rotation": """
        WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS x FROM documents),
        k AS (
            SELECT doc_id, t, length(t) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2,
                   ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM h),
        f AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
        c AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1, n - b) AS s FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                           ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM c""",
}
