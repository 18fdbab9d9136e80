"""Boolean trigram queries that follow from a regex.

A query is a set of alternatives, each a set of trigrams (of the text in lower case) that must all occur in any text
with a match. The query with one empty alternative says nothing: such a regex needs a full scan.
"""

from __future__ import annotations

import re._constants as parts
import re._parser as parser
from dataclasses import dataclass

Query = frozenset[frozenset[str]]
ALL: Query = frozenset([frozenset()])
#: Strings and alternatives that are followed before a query gives up and says less.
MOST_STRINGS = 64
MOST_ALTERNATIVES = 64
MOST_LETTERS = 8


@dataclass(frozen=True)
class Known:
    """What is known of a part: all strings it can match, or (None) a query and perhaps strings at both its edges."""

    strings: frozenset[str] | None
    query: Query = ALL
    edge: frozenset[str] | None = None


NOTHING = Known(None)
EMPTY = Known(frozenset([""]))


def _either(a: Query, b: Query) -> Query:
    """Alternatives of both, without those that another one implies."""
    both = a | b
    least = frozenset(x for x in both if not any(y < x for y in both))
    return least if len(least) <= MOST_ALTERNATIVES else ALL


def _both(a: Query, b: Query) -> Query:
    out: Query = frozenset()
    for x in a:
        out = _either(out, frozenset(x | y for y in b)) if out else frozenset(x | y for y in b)
    return out if len(out) <= MOST_ALTERNATIVES else a


def _of_strings(strings: frozenset[str]) -> Query:
    out: Query = frozenset()
    for s in strings:
        if len(s) < 3:
            return ALL
        one = frozenset([frozenset(s[k : k + 3] for k in range(len(s) - 2))])
        out = _either(out, one) if out else one
    return out or ALL


def _query(known: Known) -> Query:
    return known.query if known.strings is None else _of_strings(known.strings)


def _letters(items: list) -> Known:
    found: set[str] = set()
    for kind, value in items:
        if kind is parts.LITERAL:
            found.add(chr(value).lower())
        elif kind is parts.RANGE and value[1] - value[0] < MOST_LETTERS:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return NOTHING
    return Known(frozenset(found)) if 0 < len(found) <= MOST_LETTERS else NOTHING


def _part(kind, value) -> Known:
    if kind is parts.LITERAL:
        return Known(frozenset([chr(value).lower()]))
    if kind is parts.IN:
        return _letters(value)
    if kind is parts.SUBPATTERN:
        return _sequence(value[-1])
    if kind is parts.AT:
        return EMPTY
    if kind is parts.BRANCH:
        branches = [_sequence(b) for b in value[1]]
        if all(b.strings is not None for b in branches):
            strings = frozenset().union(*(b.strings for b in branches))
            if len(strings) <= MOST_STRINGS:
                return Known(strings)
        query = _query(branches[0])
        for b in branches[1:]:
            query = _either(query, _query(b))
        return Known(None, query)
    if kind in (parts.MAX_REPEAT, parts.MIN_REPEAT):
        least, most, inner = value
        known = _sequence(inner)
        if known.strings is not None and (least, most) == (0, 1):
            return Known(known.strings | {""})
        if known.strings is not None and least == most == 1:
            return known
        return Known(None, _query(known), known.strings) if least else NOTHING
    return NOTHING  # classes of letters, any character, look-around: nothing is known


def _sequence(sequence) -> Known:
    strings, query, whole = frozenset([""]), ALL, True
    for kind, value in sequence:
        known = _part(kind, value)
        if known.strings is not None and len(known.strings) * len(strings) <= MOST_STRINGS:
            strings = frozenset(a + b for a in strings for b in known.strings)
            continue
        if known.edge and len(known.edge) * len(strings) <= MOST_STRINGS:
            joined = frozenset(a + b for a in strings for b in known.edge)
            query, strings, whole = _both(query, _of_strings(joined)), known.edge, False
            continue
        query = _both(query, _of_strings(strings))
        if known.strings is None:
            query, strings = _both(query, known.query), frozenset([""])
        else:
            strings = known.strings
        whole = False
    return Known(strings) if whole else Known(None, _both(query, _of_strings(strings)))


def trigram_query(regex: str) -> Query:
    """The alternatives of trigrams for a regex."""
    return _query(_sequence(parser.parse(regex)))
