"""Fuzzy full-text search and prefix suggestions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeframe.functions.text import deletions, edit_distance, tokens, tokens_of
from lodgeframe.operators.search import B, K1
from lodgeframe.schema import SUGGEST_FIELDS
from lodgeframe.sources.workspace import stored

# The k of an explicit top-k: best rows, and suggestions.
DEFAULT_HITS = 10
DEFAULT_SUGGESTIONS = 5
#: Keys and scores of so many winners are broadcast; more join as Spark's size checks say.
MOST_BROADCAST = 10_000


def allowed_edits(word: str) -> int:
    """Edits a query word tolerates: none up to 2 characters, one up to 5, then two."""
    return 0 if len(word) <= 2 else 1 if len(word) <= 5 else 2


def text_fields(df: DataFrame, fields: Sequence[str]) -> list[str]:
    types = dict(df.dtypes)
    for field in fields:
        if types.get(field) != "string":
            raise ValueError(f"{field} is not a text field")
    return list(dict.fromkeys(fields))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def near_condition(column: str, word: str) -> str:
    """Cheap necessary condition for being within the allowed edits of ``word``.

    The built-in distance counts a swap as two edits, so twice the edits bound it.
    """
    edits = allowed_edits(word)
    if not edits:
        return f"{column} = {_quoted(word)}"
    return (
        f"(length({column}) BETWEEN {len(word) - edits} AND {len(word) + edits}"
        f" AND levenshtein({column}, {_quoted(word)}, {2 * edits}) >= 0)"
    )


def vocabulary(
    df: DataFrame, fields: Sequence[str], words: Sequence[str] | None = None
) -> DataFrame:
    """(field, token, doc_freq) of the text fields, optionally only tokens near ``words``.

    The nearness test runs before the shuffle, so only candidate tokens travel.
    """
    fields = text_fields(df, fields)
    occurring = (
        df.select(*[F.array_distinct(tokens(f)).alias(f) for f in fields])
        .unpivot([], fields, "field", "_tokens")
        .select("field", F.explode("_tokens").alias("token"))
    )
    if words is not None:
        occurring = occurring.where(" OR ".join(near_condition("token", w) for w in words) or "false")
    return occurring.groupBy("field", "token").agg(F.count(F.lit(1)).alias("doc_freq"))


def _wanted(words: Sequence[str]) -> str:
    """SQL for an array of the distinct words with the edits each tolerates."""
    return ", ".join(f"struct({_quoted(w)} AS word, {allowed_edits(w)} AS edits)" for w in dict.fromkeys(words))


def word_variants(spark: SparkSession, words: Sequence[str]) -> DataFrame:
    """(variant, word, edits): what is left of every query word when as many letters as it tolerates edits are deleted."""
    rows = spark.sql(f"SELECT inline(array({_wanted(words)}))")
    return rows.selectExpr(
        f"""inline(transform(CASE edits WHEN 0 THEN {deletions('word', 0)} WHEN 1 THEN {deletions('word', 1)}
              ELSE {deletions('word', 2)} END, v -> struct(v AS variant, word, edits)))"""
    )


def token_variants(tokens: DataFrame, edits: int = 2) -> DataFrame:
    """``tokens`` (with ``token``), a row for each string that is left of a token when up to ``edits`` letters are deleted."""
    return tokens.selectExpr("*", f"explode({deletions('token', edits)}) AS variant")


def near_tokens(variants: DataFrame, words: Sequence[str]) -> DataFrame:
    """(token, word, distance): the tokens within the allowed edits of each word.

    ``variants`` is :func:`token_variants` of the tokens: words and tokens meet on equal strings, and only what meets
    is measured.
    """
    met = variants.join(word_variants(variants.sparkSession, words), "variant").select("token", "word", "edits").distinct()
    return met.withColumn("distance", F.expr(edit_distance("token", "word"))).where("distance <= edits").drop("edits")


def expand_terms(vocab: DataFrame, words: Sequence[str]) -> DataFrame:
    """For every query word all rows of the vocabulary within the allowed edits, with word and distance.

    Tokens too long or short for any word are left out before their variants are made.
    """
    words = list(dict.fromkeys(words))
    if not words:
        return vocab.selectExpr("*", "'' AS word", "0 AS distance").where("false")
    fits = " OR ".join(f"length(token) BETWEEN {len(w) - allowed_edits(w)} AND {len(w) + allowed_edits(w)}" for w in words)
    possible = vocab.where(fits)
    variants = token_variants(possible.select("token").distinct(), max(map(allowed_edits, words)))
    return possible.join(near_tokens(variants, words), "token")


def query_terms(query: str) -> list[list[str]]:
    """The words of each blank-separated query term; a term without words is empty."""
    return [tokens_of(term.strip()) for term in query.split(" ")]


def _found(term: Sequence[str], j: int, lists: str = "t") -> str:
    """SQL: the distinct tokens of field ``j`` within the allowed edits of a word of the term, each with its distance.

    Every candidate is measured once.
    """
    parts = []
    for w in dict.fromkeys(term):
        measured = f"""transform(filter({lists}.d{j}, x -> {near_condition('x', w)}),
              x -> struct(x AS token, {edit_distance('x', _quoted(w))} AS distance, {len(w)} AS letters))"""
        parts.append(f"filter({measured}, x -> x.distance <= {allowed_edits(w)})")
    return f"concat({', '.join(parts)})"


def _matched(df: DataFrame, query: str, fields: Sequence[str]) -> DataFrame:
    """``df`` with ``_lists`` (per field f its tokens and d the distinct ones) and ``_terms``: per term and field the tokens found.

    Whether a token is near a word follows from the two alone, so this is a plain projection.
    """
    # The text is analysed once per row.
    lists = ", ".join(f"{_token_list(f)} AS f{j}" for j, f in enumerate(fields))
    distinct = ", ".join(f"l.f{j} AS f{j}, array_distinct(l.f{j}) AS d{j}" for j in range(len(fields)))
    found = ", ".join(
        "array(" + ", ".join(f"coalesce({_found(term, j)}, array())" for j in range(len(fields))) + ")"
        for term in query_terms(query)
    )
    bound = f"transform(transform(array(struct({lists})), l -> struct({distinct})), t -> struct(t AS lists, array({found}) AS terms))"
    analysed = df.withColumn("_analysed", F.expr(f"element_at({bound}, 1)"))
    return analysed.select(*[f"`{c}`" for c in df.columns], "_analysed.lists", "_analysed.terms").withColumnsRenamed(
        {"lists": "_lists", "terms": "_terms"}
    )


_EVERY_TERM = "forall(_terms, by_field -> exists(by_field, tokens -> size(tokens) > 0))"


def _matching(df: DataFrame, query: str, fields: Sequence[str]) -> DataFrame:
    """All rows in which every term matches some field."""
    fields = text_fields(df, fields)
    if not all(query_terms(query)) or not fields:
        return df.where("false")
    return _matched(df, query, fields).where(_EVERY_TERM).select(*[f"`{c}`" for c in df.columns])


def _candidates(df: DataFrame, query: str, fields: Sequence[str], key: str) -> DataFrame:
    """(key, field, token, distance, letters, term, matches, tf, length), stored: all that scoring needs, from one reading of the text.

    A row for every token found in any text, whether all terms match there or not, and for every field of every text one
    without token, with its length.
    """
    looked = _matched(df, query, fields).selectExpr(f"`{key}` AS key", "_lists", "_terms", f"{_EVERY_TERM} AS matches")
    rows = []
    for j in range(len(fields)):
        token = "CAST(NULL AS string) AS token, CAST(NULL AS int) AS distance, CAST(NULL AS int) AS letters, CAST(NULL AS int) AS term"
        rows.append(
            f"IF(_lists.f{j} IS NULL, array(), array(struct({j} AS field, {token}, CAST(NULL AS int) AS tf, size(_lists.f{j}) AS length)))"
        )
        for i in range(len(query_terms(query))):
            rows.append(
                f"""transform(_terms[{i}][{j}], x -> struct({j} AS field, x.token, x.distance, x.letters, {i} AS term,
                      size(filter(_lists.f{j}, y -> y = x.token)) AS tf, size(_lists.f{j}) AS length))"""
            )
    long = looked.selectExpr("key", "matches", f"inline(concat({', '.join(rows)}))")
    return stored(long, "candidates")


def bm25(n_rows: str, total_length: str, doc_freq: str) -> str:
    """SQL for a found token's share of the score (columns distance, token, letters, tf, length)."""
    return f"""{K1 + 1} * (1 - distance / least(length(token), letters))
        * ln(1 + ({n_rows} - {doc_freq} + 0.5D) / ({doc_freq} + 0.5D))
        * tf / (tf + {K1} * ({1 - B} + {B} * length * {n_rows} / {total_length}))"""


def best_fields(parts: DataFrame, terms: int) -> DataFrame:
    """(key, score, matched) from (key, term, field, part): per term the best field counts, scores add up over terms."""
    by_field = parts.groupBy("key", "term", "field").agg(F.sum("part").alias("part"))
    by_term = by_field.groupBy("key", "term").agg(F.max("part").alias("part"))
    return by_term.groupBy("key").agg(F.sum("part").alias("score"), (F.count(F.lit(1)) == terms).alias("matched"))


def _scored(df: DataFrame, query: str, fields: Sequence[str], key: str) -> DataFrame:
    """(key, score) of the matching rows, from one reading of the text. Only keys and counts move, no texts."""
    found = _candidates(df, query, fields, key)
    lengths = found.where("token IS NULL").groupBy("field").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("length").alias("total_length")
    )
    held = found.where("token IS NOT NULL").select("key", "field", "token").distinct()
    held = held.groupBy("field", "token").agg(F.count(F.lit(1)).alias("doc_freq"))
    # One row for each field.
    parts = found.where("matches AND token IS NOT NULL").join(held, ["field", "token"]).join(F.broadcast(lengths), "field")
    parts = parts.withColumn("part", F.expr(bm25("n_rows", "total_length", "doc_freq")))
    return best_fields(parts, len(query_terms(query))).select("key", "score")


def _token_list(field: str) -> str:
    return rf"regexp_extract_all(lower(`{field}`), r'[\p{{L}}\p{{N}}_]+', 0)"


def full_text_search(
    df: DataFrame, query: str, fields: Sequence[str], size: int = DEFAULT_HITS, key: str = "id"
) -> DataFrame:
    """The best ``size`` rows in which every query term occurs, give or take a few typos. ``key`` tells rows apart.

    Terms are split at single blanks; an empty term (two blanks in a row) matches
    nothing. Per term the best field counts, scores add up over terms. For many searches over one table, see ``textindex``.
    """
    fields = text_fields(df, fields)
    if not all(query_terms(query)) or not fields:
        return df.withColumn("score", F.lit(0.0)).where("false")
    best = _scored(df, query, fields, key).orderBy(F.desc("score"), F.asc("key")).limit(size)
    # As many rows as were asked for: only they are read whole.
    winners = stored(best, "winners").withColumnRenamed("key", key)
    hits = df.join(F.broadcast(winners) if size <= MOST_BROADCAST else winners, key)
    return hits.select(*[f"`{c}`" for c in df.columns], "score").orderBy(F.desc("score"), F.asc(key))


def full_text_matches(df: DataFrame, query: str, fields: Sequence[str]) -> DataFrame:
    """All matching rows, unordered: one pass, no shuffle."""
    return _matching(df, query, fields)


def full_text_total(df: DataFrame, query: str, fields: Sequence[str]) -> DataFrame:
    """One row: the number of matching rows."""
    return _matching(df, query, fields).agg(F.count(F.lit(1)).alias("total"))


def suggest(df: DataFrame, text: str, field: str, size: int = DEFAULT_SUGGESTIONS) -> DataFrame:
    """Distinct values of a completion field that start with ``text``, ignoring case."""
    if field not in SUGGEST_FIELDS:
        raise ValueError(f"{field} has no suggestions")
    column = F.col(SUGGEST_FIELDS[field])
    return (
        df.where(F.startswith(F.lower(column), F.lit(text.lower())))
        .select(column.alias("text"))
        .distinct()
        .orderBy("text")
        .limit(size)
    )
