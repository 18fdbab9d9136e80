"""A stored token index: text is analysed once, when it is loaded or changed, and searched without reading it again.

Three tables lie under one folder, each in numbered batches that are only ever added to:

- ``postings``: (field, token, key, tf, length, sign), by a hash of the token, so that a search reads the parts of its tokens only;
  part -1 holds a row without token for each text;
- ``tokens``: (field, token, diff): by how many rows a token's frequency rises or falls;
- ``fields``: (field, rows, length): by how much a field's rows and total length rise or fall.

A batch is the difference that a change of rows makes: what the rows held before counts -1, what they hold now +1, and
what is equal on both sides cancels out. So an update costs what changed, and sums over all batches are always the state of the
table. Batches are written whole before they are listed in ``done``; an interrupted one leaves no trace. Repeating a batch number changes nothing.
``compact`` writes the sums as one batch of a new index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeframe.functions.text import tokens
from lodgeframe.operators.fulltext import DEFAULT_HITS, best_fields, bm25, expand_terms, near_condition, query_terms, text_fields
from lodgeframe.sources.workspace import stored

#: Parts that postings are dealt to by token.
PARTS = 64
_TABLES = {
    "postings": "field string, token string, key {key}, length int, tf int, sign int, part bigint",
    "tokens": "field string, token string, diff bigint",
    "fields": "field string, rows bigint, length bigint",
}
_PART = f"pmod(xxhash64(token), {PARTS})"
#: The part of the rows without token.
_TEXTS = -1
#: Files that a part is dealt over by key, for tokens that most rows have.
_SPREAD = 16


def _occurrences(df: DataFrame, fields: Sequence[str], key: str, sign: int) -> DataFrame:
    """(field, token, key, length, sign) of each token in all texts; a row without token for each text, null ones have none."""
    lists = df.select(F.col(f"`{key}`").alias("key"), *[tokens(f).alias(f) for f in fields])
    long = lists.unpivot(["key"], list(fields), "field", "list").where("list IS NOT NULL")
    each = long.selectExpr("key", "field", "size(list) AS length", "explode(concat(list, array(CAST(NULL AS string)))) AS token")
    return each.withColumn("sign", F.lit(sign))


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` by the part of its tokens and by key: all that is grouped by token and key lies in one task."""
    parts = {"part": F.expr(f"IF(token IS NULL, {_TEXTS}L, {_PART})"), "spread": F.pmod(F.xxhash64("key"), F.lit(_SPREAD))}
    return df.withColumns(parts).repartition("part", "spread")


def _counted(dealt: DataFrame) -> DataFrame:
    """Dealt occurrences as postings, still dealt."""
    grouped = dealt.groupBy("part", "spread", "field", "token", "key", "length", "sign")
    return grouped.agg(F.count(F.lit(1)).cast("int").alias("tf"))


def _net(dealt: DataFrame) -> DataFrame:
    """Dealt postings of which those that cancel out are gone."""
    grouped = dealt.groupBy("part", "spread", "field", "token", "key", "length", "tf")
    return grouped.agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")


def _finished(spark: SparkSession, path: str) -> dict[int, str]:
    """The finished batches, and the type of the index's key."""
    try:
        return {r.batch: r.key_type for r in spark.read.parquet(f"{path}/done").distinct().collect()}
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            return {}
        raise


def _read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table's finished batches."""
    done = _finished(spark, path)
    if not done:
        raise ValueError(f"no token index in {path}")
    schema = _TABLES[table].format(key=next(iter(done.values()))) + ", batch bigint"
    folders = [f"{path}/{table}/batch={b}" for b in sorted(done)]
    return spark.read.schema(schema).option("basePath", f"{path}/{table}").parquet(*folders)


def _write(net: DataFrame, path: str, batch: int, sizes: DataFrame | None = None) -> None:
    """One batch from net postings, dealt. ``sizes``: the fields' rows and lengths, if not those of the batch's texts."""
    spark, key_type = net.sparkSession, dict(net.dtypes)["key"]
    to = f"{path}/postings/batch={batch}"
    rows = net.select("field", "token", "key", "length", "tf", "sign", "part").sortWithinPartitions("part", "token")
    rows.write.mode("overwrite").partitionBy("part").parquet(to)
    # Texts are read for the postings alone; these say all that the texts said.
    held = spark.read.schema(_TABLES["postings"].format(key=key_type)).parquet(to)
    diffs = held.where(f"part <> {_TEXTS}").groupBy("field", "token").agg(F.sum("sign").alias("diff")).where("diff <> 0")
    diffs.write.mode("overwrite").parquet(f"{path}/tokens/batch={batch}")
    if sizes is None:
        sizes = held.where(f"part = {_TEXTS}").groupBy("field")
        sizes = sizes.agg(F.sum("sign").alias("rows"), F.sum(F.col("sign") * F.col("length")).alias("length"))
    sizes.write.mode("overwrite").parquet(f"{path}/fields/batch={batch}")
    spark.range(1).selectExpr(f"{batch}L AS batch", f"'{key_type}' AS key_type").write.mode("append").parquet(f"{path}/done")


def build(df: DataFrame, fields: Sequence[str], path: str, key: str = "id") -> None:
    """Index the text fields of ``df``, whose ``key`` tells rows apart, as batch 0 of a new folder."""
    _write(_counted(_dealt(_occurrences(df, text_fields(df, fields), key, 1))), path, 0)


def update(spark: SparkSession, path: str, before: DataFrame, after: DataFrame, fields: Sequence[str], batch: int, key: str = "id") -> None:
    """Replace rows: ``before`` as they were indexed, ``after`` as they are now; either may hold keys that the other lacks.

    ``batch`` is the change's number, 1 or more; a number that is there already changes nothing.
    """
    if batch in _finished(spark, path):
        return
    changes = _occurrences(before, fields, key, -1).unionByName(_occurrences(after, fields, key, 1))
    _write(_net(_counted(_dealt(changes))), path, batch)


def _found(spark: SparkSession, path: str, query: str, fields: Sequence[str]) -> tuple[DataFrame, int]:
    """(key, term, field, token, distance, letters, doc_freq, tf, length) of the query's tokens in all rows, and the number of terms."""
    terms = query_terms(query)
    words = [(i, w) for i, term in enumerate(terms) for w in dict.fromkeys(term)]
    listed = ", ".join(f"({i}, '{w}', {len(w)})" for i, w in words)
    # Only tokens that a cheap condition leaves are compared by what deletions leave of them.
    near_any = " OR ".join(near_condition("token", w) for _, w in words)
    changes = _read(spark, path, "tokens").where(near_any).groupBy("field", "token").agg(F.sum("diff").alias("doc_freq"))
    near = expand_terms(changes, [w for _, w in words])
    near = near.join(F.broadcast(spark.sql(f"SELECT * FROM VALUES {listed} AS t(term, word, letters)")), "word")
    # The parts that hold the tokens found, PARTS at most, are all that is read of the postings.
    near = stored(near.withColumn("part", F.expr(_PART)), "near")
    parts = [r.part for r in near.select("part").distinct().collect()]
    postings = _read(spark, path, "postings").where(F.col("part").isin(parts) & F.col("field").isin(list(fields)))
    hits = postings.drop("part").join(near.drop("part"), ["field", "token"])
    net = hits.groupBy("key", "term", "field", "token", "word", "distance", "letters", "doc_freq", "tf", "length").agg(F.sum("sign").alias("sign"))
    return net.where("sign > 0"), len(terms)


def search(spark: SparkSession, path: str, query: str, fields: Sequence[str], size: int | None = DEFAULT_HITS) -> DataFrame:
    """(key, score) of the rows in which every term of the query occurs, as ``fulltext.full_text_search`` finds them.

    The best ``size``, or all of them unordered with ``size=None``.
    """
    if not all(query_terms(query)) or not fields:
        return _read(spark, path, "postings").selectExpr("key", "0D AS score").where("false")
    found, terms = _found(spark, path, query, fields)
    sizes = _read(spark, path, "fields").groupBy("field").agg(F.sum("rows").alias("n_rows"), F.sum("length").alias("total_length"))
    # One row for each field.
    parts = found.join(F.broadcast(sizes), "field")
    scores = best_fields(parts.withColumn("part", F.expr(bm25("n_rows", "total_length", "doc_freq"))), terms)
    out = scores.where("matched").select("key", "score")
    return out if size is None else out.orderBy(F.desc("score"), F.asc("key")).limit(size)


def statistics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(field, token, doc_freq) and (field, n_rows, total_length) as they are now."""
    held = _read(spark, path, "tokens").groupBy("field", "token").agg(F.sum("diff").alias("doc_freq")).where("doc_freq > 0")
    sizes = _read(spark, path, "fields").groupBy("field").agg(F.sum("rows").alias("n_rows"), F.sum("length").alias("total_length"))
    return held, sizes


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the index as it is now, as batch 0 of a new folder: postings that cancelled out are gone."""
    rows = _read(spark, path, "postings").select("field", "token", "key", "length", "tf", "sign")
    # Texts of an index written without part -1 are known to ``fields`` alone.
    sizes = _read(spark, path, "fields").groupBy("field").agg(F.sum("rows").alias("rows"), F.sum("length").alias("length"))
    _write(_net(_dealt(rows)), target, 0, sizes)
