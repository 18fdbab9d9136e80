"""Text expressions: analysis, edit distance, clean-up of generated text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a run of letters, digits and underscores, in lower case.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"


def tokens(column: str | Column) -> Column:
    """All tokens of a text, in order; null for null."""
    text = F.col(column) if isinstance(column, str) else column
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def tokens_of(value: str) -> list[str]:
    """The tokens of a query string, by the same rule as :func:`tokens`."""
    return re.findall(r"\w+", value.lower())


def deletions(text: str, edits: int) -> str:
    """SQL for the distinct strings that are left of ``text`` when up to ``edits`` (0 to 2) letters are deleted.

    Two texts within that many edits of each other have one of these strings in common: the letters that an edit
    changes, inserts, drops or swaps are deleted on either side.
    """
    less = "transform(sequence(1, length({t})), i{n} -> concat(substr({t}, 1, i{n} - 1), substr({t}, i{n} + 1)))"
    none = f"array({text})"
    if not edits:
        return none
    once = f"IF(length({text}) > 0, {less.format(t=text, n=1)}, array())"
    if edits == 1:
        return f"array_distinct(concat({none}, {once}))"
    twice = f"flatten(transform({once}, o -> IF(length(o) > 0, {less.format(t='o', n=2)}, array())))"
    return f"array_distinct(concat({none}, {once}, {twice}))"


def edit_distance(left: str, right: str) -> str:
    """SQL for the edit distance in which swapping two neighbours is one edit.

    Row by row over the characters of two non-empty texts; a swapped pair is not
    edited again (optimal string alignment).
    """
    return f"""
    aggregate(
      sequence(1, length({left})),
      named_struct('two', cast(array() AS array<int>), 'one', sequence(0, length({right}))),
      (past, i) -> named_struct(
        'two', past.one,
        'one', aggregate(
          sequence(1, length({right})),
          array(i),
          (row, j) -> array_append(row, least(
            get(past.one, j) + 1,
            get(row, j - 1) + 1,
            get(past.one, j - 1) + if(substr({left}, i, 1) = substr({right}, j, 1), 0, 1),
            if(i > 1 AND j > 1
                 AND substr({left}, i, 1) = substr({right}, j - 1, 1)
                 AND substr({left}, i - 1, 1) = substr({right}, j, 1),
               get(past.two, j - 2) + 1, NULL))))),
      past -> element_at(past.one, -1))
    """


def clean_markdown(column: str) -> Column:
    """Generated text for display: code fences dropped, every heading mark tripled."""
    text = F.col(column)
    for old, new in (("```markdown", ""), ("```", ""), ("#", "##"), ("##", "###")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text
