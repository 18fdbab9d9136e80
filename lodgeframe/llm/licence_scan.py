"""Licence scans by ordered signature rules.

Hundreds of regexes (licences.py) are tried on a text only where their keyword occurs in it. Texts may be wrapped and stand in
comments: a blank of a regex or keyword is any gap between words. Detections are sorted by
place; one that lies inside another of the same or a higher priority is suppressed, whichever stand between them. All is done within the
row by SQL functions: nothing shuffles, and texts without any keyword stem cost a few substring searches.

Cases: a null text counts as empty and has no detection. Texts of any length are scanned whole; offsets are code
points of the whole text. Of detections with the same interval the one of the higher priority stays, of equal ones the first by label.
Repeated rows get the same answer; empty tables give empty results. Further columns are kept; where one has the name
of an added column, the added ones get more underscores.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.columns import free_prefix
from lodgeframe.llm.licences import GAP, Rule, rules, spaced
from lodgeframe.llm.spans import match_spans
from lodgeframe.llm.textarrays import ascii_lower

def _stems(keywords: set[str]) -> list[str]:
    """A small set of literals such that each keyword contains one, without those that contain another.

    Of a keyword it is a common part or its longest word, as a gap may be no blank; or all of it, if its words are short.
    """
    common = ("licen", "public", "general", "software")

    def stem(keyword: str) -> str:
        longest = max(keyword.split(), key=lambda w: (len(w), w))
        return next((c for c in common if c in keyword), longest if len(longest) > 4 else keyword)

    stems = sorted({stem(k) for k in keywords}, key=lambda w: (len(w), w))
    return [s for n, s in enumerate(stems) if not any(t in s for t in stems[:n])]


def _holds(text: Column, stem: str) -> Column:
    return F.rlike(text, F.lit(spaced(re.escape(stem).replace("\\ ", " ")))) if " " in stem else F.contains(text, F.lit(stem))


def _constant(entries: list[Rule]) -> Column:
    return F.array(
        *(
            F.struct(
                F.lit(r.rank).alias("rank"),
                F.lit(r.label).alias("label"),
                F.lit(r.keyword).alias("keyword"),
                F.lit(spaced(r.regex)).alias("regex"),
                F.lit(r.weight).alias("weight"),
            )
            for r in entries
        )
    )


_DETECTIONS = "array<struct<start:int,end:int,rank:int,label:string,weight:double>>"


def unsuppressed(found: Column, ranks: list[int]) -> Column:
    """Of detections ordered by start, longest first, those that lie inside no other of the same or a higher priority.

    For each priority it is enough to know how far detections have reached: one that began no later and ends no earlier contains.
    """
    order = F.array(*(F.lit(r) for r in ranks))
    begun = F.struct(
        F.array(*(F.lit(-1) for _ in ranks)).alias("reached"), F.array().cast(_DETECTIONS).alias("out")
    )

    def step(state: Column, one: Column) -> Column:
        end, place = -one["_end"], F.array_position(order, one["rank"]).cast("int")
        inside = F.exists(F.slice(state["reached"], F.lit(1), place), lambda reach: reach >= end)
        kept = F.struct(one["start"].alias("start"), end.alias("end"), one["rank"].alias("rank"), one["label"].alias("label"), one["weight"].alias("weight"))
        return F.struct(
            F.transform(state["reached"], lambda reach, k: F.when(k == place - 1, F.greatest(reach, end)).otherwise(reach)).alias("reached"),
            F.when(inside, state["out"]).otherwise(F.concat(state["out"], F.array(kept))).alias("out"),
        )

    return F.aggregate(found, begun, step, lambda state: state["out"])


def scan(df: DataFrame, text: str = "text", entries: list[Rule] | None = None) -> DataFrame:
    """``df`` with _detections array<struct<start,end,rank,label,weight>>, in order, after suppression."""
    entries = rules() if entries is None else entries
    own = [f"`{c}`" for c in df.columns]
    prefix = free_prefix(df, "quick", "lower", "tried", "detections")
    quick, lower, tried = (prefix + name for name in ("quick", "lower", "tried"))
    # Full lower case is quick and never loses an ASCII literal.
    stems = _stems({r.keyword for r in entries})
    possible = reduce(or_, (_holds(F.col(quick), s) for s in stems), F.lit(False))
    lowered = df.withColumn(quick, F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    lowered = lowered.select(*own, F.when(possible, ascii_lower(F.col(f"`{text}`"))).alias(lower))
    # Bound by a transform over one element, the text with single blanks is made once, not again for every keyword; a
    # keyword that many rules share is looked for once.
    single = F.array(F.regexp_replace(F.col(lower), GAP, " "))
    keywords = F.array(*(F.lit(k) for k in sorted({r.keyword for r in entries}))).cast("array<string>")
    present = F.transform(single, lambda gate: F.filter(keywords, lambda k: F.contains(gate, k)))
    here = F.transform(
        present,
        lambda found: F.filter(_constant(entries), lambda r: F.array_contains(found, r["keyword"]) & F.rlike(F.col(lower), r["regex"])),
    )
    lowered = lowered.withColumn(tried, F.when(F.col(lower).isNotNull(), F.element_at(here, 1)))

    def detections(rule: Column) -> Column:
        return F.transform(
            match_spans(F.col(lower), rule["regex"]),
            lambda s: F.struct(
                s["start"].alias("start"),
                (-s["end"]).alias("_end"),
                rule["rank"].alias("rank"),
                rule["label"].alias("label"),
                rule["weight"].alias("weight"),
            ),
        )

    found = F.sort_array(F.flatten(F.transform(tried, detections)))
    resolved = unsuppressed(found, sorted({r.rank for r in entries}) or [0])
    empty = F.array().cast(_DETECTIONS)
    return lowered.select(*own, F.when(F.size(tried) > 0, resolved).otherwise(empty).alias(prefix + "detections"))


#: Runs of ASCII letters and digits and of all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


def word_count(text: str = "text") -> Column:
    """Words of the text (null: none)."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def phrase_places(df: DataFrame, text: str = "text", phrases: dict[str, str] | None = None) -> DataFrame:
    """``df`` with _places array<struct<at:int,label:string>>: the word at which a phrase begins, for every phrase."""
    phrases = PHRASES if phrases is None else phrases
    own = [f"`{c}`" for c in df.columns]
    prefix = free_prefix(df, "quick", "words", "places")
    quick, listed = prefix + "quick", prefix + "words"
    # A text must have the last word of a phrase, and the longer ones are rare.
    possible = reduce(or_, (_all_words(F.col(quick), p) for p in phrases), F.lit(False))
    words = F.regexp_extract_all(ascii_lower(F.col(f"`{text}`")), F.lit(WORD), F.lit(0))
    split = df.withColumn(quick, F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    split = split.select(*own, F.when(possible, words).alias(listed))

    def places(phrase: str, label: str) -> Column:
        parts = phrase.split()
        last = F.greatest(F.size(listed) - len(parts), F.lit(0))

        def here(at: Column) -> Column:
            return reduce(lambda a, b: a & b, (F.get(listed, at + k) == w for k, w in enumerate(parts)))

        return F.transform(F.filter(F.sequence(F.lit(0), last), here), lambda at: F.struct(at.alias("at"), F.lit(label).alias("label")))

    found = F.sort_array(F.concat(*(places(p, label) for p, label in phrases.items())))
    empty = F.array().cast("array<struct<at:int,label:string>>")
    return split.select(*own, F.when(F.col(listed).isNotNull(), found).otherwise(empty).alias(prefix + "places"))


def _all_words(text: Column, phrase: str) -> Column:
    """Whether the words of the phrase all occur, the last ones next to each other but for other characters."""
    parts = phrase.split()
    literal = reduce(lambda a, b: a & b, (F.contains(text, F.lit(w)) for w in sorted(parts, key=len, reverse=True)))
    return literal & F.rlike(text, F.lit(rf"{parts[-2]}[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+{parts[-1]}"))
