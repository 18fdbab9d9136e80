"""Fill-in-middle transformation by in-place block rotation.

A hash of the row's id cuts a text into prefix, middle and suffix, counted in code points. The text's bytes lie in one
bytearray: the cuts are found by a scan over its lead bytes, the three sentinels are inserted, which makes
``<P>prefix<M>middle<S>suffix``, and neighbouring blocks are exchanged by a rotation made of three reversals:
``<M>middle`` with ``<S>suffix`` for prefix-suffix-middle (psm), ``<P>prefix<M>middle`` with ``<S>suffix`` for
suffix-prefix-middle (spm). ``restore`` finds the sentinels, rotates back and takes them out. Reversals swap blocks of
BLOCK bytes from both ends, so that a text of any length is needed once only.

Cases: a null text counts as empty; an empty text, and one that holds a sentinel already, stays as it is (form plain), so
the sentinels of every other output are its own and restoring is exact. A null id is hashed as the empty word, so such
rows are cut by their lengths alone. Very long texts are cut whole. Equal texts under different ids are cut apart,
repeated rows alike. An empty table gives an empty result. Further columns are kept; where one has the name
of an added column, the added ones get more underscores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from lodgeframe.llm.columns import free_prefix, widened
from lodgeframe.llm.textarrays import slices

SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are rearranged, and of 100 of these so many begin with the suffix.
REARRANGED, SUFFIX_FIRST = 90, 20
#: Bytes that a reversal swaps at once.
BLOCK = 1 << 16


def reverse(view: np.ndarray, begin: int, end: int) -> None:
    """The bytes from begin to end in the other order, in place."""
    while end - begin > 1:
        size = min(BLOCK, (end - begin) // 2)
        left = view[begin : begin + size].copy()
        view[begin : begin + size] = view[end - size : end][::-1]
        view[end - size : end] = left[::-1]
        begin, end = begin + size, end - size


def rotate(buffer: bytearray, begin: int, middle: int, end: int) -> None:
    """Exchange the neighbouring blocks [begin, middle) and [middle, end) of the buffer, in place."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, begin, middle)
    reverse(view, middle, end)
    reverse(view, begin, end)


def scan_cuts(buffer: bytearray, first: int, second: int) -> tuple[int, int]:
    """The byte places of two cuts given in code points, first <= second."""
    leads = np.flatnonzero((np.frombuffer(buffer, np.uint8) & 0xC0) != 0x80)
    return tuple(int(leads[k]) if k < len(leads) else len(buffer) for k in (first, second))


def rearrange(buffer: bytearray, first: int, second: int, form: str, marks: list[bytes]) -> None:
    """Cut the text in the buffer at two code points and bring its parts into the order of ``form``."""
    p, s, m = marks
    first, second = scan_cuts(buffer, first, second)
    buffer[second:second] = s
    buffer[first:first] = m
    buffer[0:0] = p
    at_m = first + len(p)
    at_s = second + len(p) + len(m)
    rotate(buffer, at_m if form == "psm" else 0, at_s, len(buffer))


def arrange_back(buffer: bytearray, form: str, marks: list[bytes]) -> None:
    """The inverse of ``rearrange``."""
    p, s, m = marks
    if form == "psm":
        at_s = buffer.index(s, len(p))
        rotate(buffer, at_s, buffer.index(m, at_s), len(buffer))
    else:
        rotate(buffer, 0, buffer.index(p, len(s)), len(buffer))
    at_m = buffer.index(m, len(p))
    at_s = buffer.index(s, at_m)
    del buffer[at_s : at_s + len(s)]
    del buffer[at_m : at_m + len(m)]
    del buffer[: len(p)]


def _numbers(digest: str) -> list[int]:
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def _arranged(text: str, digest: str, marks: list[bytes], words: tuple[str, ...]) -> tuple[int, str, int | None, int | None, str]:
    n, (h1, h2, h3, h4) = len(text), _numbers(digest)
    if not n or h3 % 100 >= REARRANGED or any(word in text for word in words):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
    buffer = bytearray(text.encode())
    rearrange(buffer, first, second, form, marks)
    return n, form, first, second - first, buffer.decode()


def _distinct_sentinels(sentinels: tuple[str, str, str]) -> list[bytes]:
    """Their bytes; sentinels must be such that none begins inside another, so that the text beside one cannot fake one."""
    for a in sentinels:
        for b in sentinels:
            if not a or any(a[k:].startswith(b[: len(a) - k]) for k in range(0 if a != b else 1, len(a))):
                raise ValueError(f"sentinels {a!r} and {b!r} may overlap")
    return [x.encode() for x in sentinels]


def fill_in_middle(
    df: DataFrame, text: str = "text", key: str = "doc_id", sentinels: tuple[str, str, str] = SENTINELS, salt: str = "1:"
) -> DataFrame:
    """``df`` with _n, _form, _prefix_chars, _middle_chars and _output: the text, its parts in the order of the form."""
    marks, words = _distinct_sentinels(sentinels), sentinels
    prefix = free_prefix(df, "n", "form", "prefix_chars", "middle_chars", "output", "digest")
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    kinds = {"n": LongType(), "form": StringType(), "prefix_chars": LongType(), "middle_chars": LongType(), "output": StringType()}
    schema = widened(df, *(StructField(prefix + name, kind) for name, kind in kinds.items()))
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                found = [_arranged(t or "", d, marks, words) for t, d in zip(texts, part.columns[-1].to_pylist())]
                added = [pa.array(c, t) for c, t in zip(zip(*found), types)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *added], schema.names)

    return df.withColumn(prefix + "digest", digest).mapInArrow(run, schema)


def restore(df: DataFrame, output: str = "_output", form: str = "_form", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``df`` with _restored: the exact text, rebuilt from output and form alone. A null output stays null."""
    marks = _distinct_sentinels(sentinels)
    schema = widened(df, StructField(free_prefix(df, "restored") + "restored", StringType()))

    def rebuilt(value: str | None, name: str) -> str | None:
        if value is None or name == "plain":
            return value
        buffer = bytearray(value.encode())
        arrange_back(buffer, name, marks)
        return buffer.decode()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, output):
                values, names = (part.column(part.schema.get_field_index(c)).to_pylist() for c in (output, form))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(map(rebuilt, values, names), pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def sha256_text(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)
