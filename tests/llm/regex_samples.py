"""Random texts that a regex may match: parsed by Python, without looking at its assertions."""

from re import _constants as c
from re import _parser

POOL = "abzABZ0189 .-_/+()@\"'éЖдΩω"
TESTS = {c.CATEGORY_DIGIT: str.isdigit, c.CATEGORY_SPACE: str.isspace, c.CATEGORY_WORD: lambda x: x.isalnum() or x == "_"}
NEGATED = {c.CATEGORY_NOT_DIGIT: c.CATEGORY_DIGIT, c.CATEGORY_NOT_SPACE: c.CATEGORY_SPACE, c.CATEGORY_NOT_WORD: c.CATEGORY_WORD}


def _has(entry, char):
    op, value = entry
    if op is c.LITERAL:
        return ord(char) == value
    if op is c.RANGE:
        return value[0] <= ord(char) <= value[1]
    return not TESTS[NEGATED[value]](char) if value in NEGATED else TESTS[value](char)


def _draw(parsed, dice):
    out = []
    for op, value in parsed:
        if op is c.LITERAL:
            out.append(chr(value))
        elif op is c.NOT_LITERAL:
            out.append(dice.choice([x for x in POOL if ord(x) != value]))
        elif op is c.ANY:
            out.append(dice.choice(POOL))
        elif op is c.IN:
            negate = value[0][0] is c.NEGATE
            literals = "".join(chr(v) for o, v in value if o is c.LITERAL)
            out.append(dice.choice([x for x in POOL + literals if any(_has(e, x) for e in value[negate:]) != negate]))
        elif op is c.BRANCH:
            out.append(_draw(dice.choice(value[1]), dice))
        elif op is c.SUBPATTERN:
            out.append(_draw(value[3], dice))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            low, high, inner = value
            out.extend(_draw(inner, dice) for _ in range(dice.randint(low, min(high, low + 3))))
    return "".join(out)


def samples(regex, dice, n):
    parsed = _parser.parse(regex)
    return [_draw(parsed, dice) for _ in range(n)]
