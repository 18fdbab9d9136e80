"""Structured search: must / must-not / should / range conditions, score and totals."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeframe.functions.text import tokens, tokens_of
from lodgeframe.schema import SUGGEST_FIELDS, resolve_field

K1, B = 1.2, 0.75

_RANGE_OPS = {
    "gte": lambda c, v: c >= v,
    "gt": lambda c, v: c > v,
    "lte": lambda c, v: c <= v,
    "lt": lambda c, v: c < v,
}


def _literal(field: str, kind: str, value: object) -> Column:
    try:
        if kind == "number":
            return F.lit(float(value) if not isinstance(value, int) else value)
        if isinstance(value, dt.date):
            return F.lit(value)
        return F.lit(dt.date.fromisoformat(str(value)))
    except (TypeError, ValueError):
        raise ValueError(f"{value!r} is not a {kind} value for {field}") from None


def match(field: str, value: object) -> Column:
    """Condition on one field: equality for numbers and dates, any shared token for text."""
    column, kind = resolve_field(field)
    if kind == "suggest":
        raise ValueError(f"{field} cannot be matched")
    if kind != "text":
        return F.col(column) == _literal(field, kind, value)
    words = tokens_of(str(value))
    if not words:
        return F.lit(False)
    return F.arrays_overlap(tokens(column), F.array(*[F.lit(w) for w in words]))


def in_range(field: str, bounds: Mapping[str, object]) -> Column:
    """Condition ``lower <= field < upper`` and the like; text compares as a whole string."""
    column, kind = resolve_field(field)
    unknown = set(bounds) - set(_RANGE_OPS)
    if unknown:
        raise ValueError(f"unknown range operator: {', '.join(sorted(unknown))}")
    if kind == "suggest":
        raise ValueError(f"{field} has no range")
    parts = [
        _RANGE_OPS[op](
            F.col(column), F.lit(str(v)) if kind == "text" else _literal(field, kind, v)
        )
        for op, v in bounds.items()
    ]
    return reduce(Column.__and__, parts, F.lit(True))


def _given(fields: Mapping[str, object] | None) -> dict[str, object]:
    return {f: v for f, v in (fields or {}).items() if v is not None}


def condition(
    must: Mapping[str, object] | None = None,
    must_not: Mapping[str, object] | None = None,
    should: Mapping[str, object] | None = None,
    ranges: Mapping[str, Mapping[str, object]] | None = None,
) -> Column:
    """The filter of a search. A row whose excluded field is null is kept."""
    parts = [match(f, v) for f, v in _given(must).items()]
    parts += [~F.coalesce(match(f, v), F.lit(False)) for f, v in _given(must_not).items()]
    either = [F.coalesce(match(f, v), F.lit(False)) for f, v in _given(should).items()]
    if either:
        parts.append(reduce(Column.__or__, either))
    parts += [in_range(f, b) for f, b in _given(ranges).items()]
    return reduce(Column.__and__, parts, F.lit(True))


def _bm25(words: Mapping[str, list[str]]) -> list[str]:
    """What relevance needs of the unfiltered table: per field its rows and length, per word its rows."""
    needs = []
    for field, terms in words.items():
        needs.append(f"count(`{field}`) AS n_{field}")
        needs.append(f"sum(size({_token_sql(field)})) AS len_{field}")
        for i, word in enumerate(terms):
            needs.append(
                f"count_if(array_contains({_token_sql(field)}, '{word}')) AS df_{field}_{i}"
            )
    return needs


def _relevance(field: str, word: str, i: int) -> str:
    """BM25 of one word in one field; ``i`` is the word's place among the field's words."""
    found = f"size(filter({_token_sql(field)}, t -> t = '{word}'))"
    return f"""{K1 + 1} * ln(1 + (_stats.n_{field} - _stats.df_{field}_{i} + 0.5D) / (_stats.df_{field}_{i} + 0.5D))
        * {found} / ({found} + {K1} * ({1 - B}
          + {B} * size({_token_sql(field)}) * _stats.n_{field} / _stats.len_{field}))"""


def _token_sql(field: str) -> str:
    return rf"regexp_extract_all(lower(`{field}`), r'[\p{{L}}\p{{N}}_]+', 0)"


def with_score(
    df: DataFrame,
    must: Mapping[str, object] | None = None,
    should: Mapping[str, object] | None = None,
    ranges: Mapping[str, object] | None = None,
    must_not: Mapping[str, object] | None = None,
) -> DataFrame:
    """Add ``score``: one per number, date or range clause, BM25 per text clause.

    Without any clause every row scores 1; with exclusions only, 0.
    """
    clauses = [*_given(must).items(), *_given(should).items()]
    words: dict[str, list[str]] = {}
    for field, value in clauses:
        column, kind = resolve_field(field)
        if kind == "text":
            known = words.setdefault(column, [])
            known += [w for w in tokens_of(str(value)) if w not in known]
    needs = _bm25(words)
    scored = df.withColumn("_stats", df.selectExpr(*needs).select(F.struct("*")).scalar()) if needs else df
    parts = [F.lit(float(len(_given(ranges))))]
    # A sum over clauses: a field that is asked for twice counts twice.
    for field, value in clauses:
        column, kind = resolve_field(field)
        if kind == "text":
            asked = [_relevance(column, w, words[column].index(w)) for w in dict.fromkeys(tokens_of(str(value)))]
            parts.append(F.expr(f"coalesce({' + '.join(asked)}, 0D)") if asked else F.lit(0.0))
        else:
            parts.append(F.coalesce(match(field, value), F.lit(False)).cast("double"))
    if not clauses and not _given(ranges):
        parts = [F.lit(0.0 if _given(must_not) else 1.0)]
    return scored.withColumn("score", reduce(Column.__add__, parts)).drop("_stats")


def search(
    df: DataFrame,
    must: Mapping[str, object] | None = None,
    must_not: Mapping[str, object] | None = None,
    should: Mapping[str, object] | None = None,
    ranges: Mapping[str, Mapping[str, object]] | None = None,
    size: int | None = None,
    scored: bool = True,
) -> DataFrame:
    """The matching rows with their ``score``.

    Without ``size`` these are all of them, in no order. With it, the ``size`` best ones, ties by the lowest id;
    ``scored=False`` spares the scores and takes the lowest ids.
    """
    wanted = condition(must, must_not, should, ranges)
    hits = (with_score(df, must, should, ranges, must_not) if scored else df).where(wanted)
    if size is None:
        return hits
    return hits.orderBy(*[F.desc("score")] * scored, F.asc("id")).limit(size)


def search_total(df: DataFrame, **conditions) -> DataFrame:
    """One row: the number of matching rows."""
    return df.where(condition(**conditions)).agg(F.count(F.lit(1)).alias("total"))


def search_arrival_day(df: DataFrame, day: object | None = None, **conditions) -> DataFrame:
    """A search on one arrival day, by default the earliest one.

    Conditions with an empty or zero value are dropped, as a form left unset.
    """
    must = {f: v for f, v in _given(conditions).items() if v}
    if day is not None:
        return search(df, must={**must, "arrival_date": day})
    earliest = df.agg(F.min("arrival_date")).scalar()
    return search(df.where(F.col("arrival_date") == earliest), must=must)


def project_hits(df: DataFrame) -> DataFrame:
    """Hits for display: without the key, the score and the completion fields."""
    return df.drop("id", "score", *SUGGEST_FIELDS)
