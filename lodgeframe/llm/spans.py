"""Places of regex matches in code points, with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_spans(text: Column, regex: Column, matches: Column | None = None) -> Column:
    """array<struct<start:int,end:int>> of the leftmost non-overlapping matches, end exclusive; none may be empty.

    The text between matches and the matches themselves give the places by their lengths.
    """
    found = F.regexp_extract_all(text, regex, F.lit(0)) if matches is None else matches
    between = F.split(text, regex, F.lit(-1)) if isinstance(regex, Column) else F.split(text, regex, -1)
    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("match"))
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["match"])
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    return F.aggregate(pairs, begun, step, lambda state: state["out"])
