"""Small documents tables with the awkward cases every operator must handle."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "river stone lantern orchard quiet marble winter copper violet meadow harbor timber signal candle anchor".split()


def prose(n: int, seed: int) -> str:
    dice = random.Random(seed)
    return " ".join(f"{dice.choice(WORDS)}{dice.randrange(200)}" for _ in range(n))


def frame(spark, texts, schema: str = SCHEMA):
    """Rows (doc_id, text) with the other columns of documents."""
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in texts], schema)


def awkward() -> list[tuple[int | None, str | None]]:
    long = prose(30_000, 1)
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "One two"),
        (5, prose(40, 5)),
        (6, prose(40, 5).upper()),
        (7, prose(40, 5)),
        (7, prose(40, 5)),
        (8, long),
        (9, long + " tail"),
        (None, prose(12, 9)),
        (10, "Ünïcode ßtraße 漢字 🙂 é  x  y"),
    ]
