"""Benchmark decontamination by templates: also finds questions whose numbers, names or units were changed.

Every text becomes a sequence of tokens: words in lower case, and typed placeholders for numbers (1,250.5 is one),
for names (a capital and a small letter, not at the start of a sentence) and for units right after a number.
Windows of WINDOW tokens (a shorter item: all of it) with LITERALS words or more that are no placeholders are
hash-joined between documents and benchmark items, and so are all plain windows, of words and numbers as they are in lower
case, which find copies in another case and items of numbers or names. Windows that continue each other form an
alignment; its placeholders must map each of the item's values to one value of the document's, else the
texts only share a frame (different values may become equal); plain windows alone count whatever the placeholders say. A document is contaminated by an item if one alignment and those
that begin at most WINDOW tokens later, as after dropped or inserted words, cover COVER tokens, or all
but two of a shorter item's.

Before the join a bit table of FILTER_BITS bits, made from the benchmark, drops nearly all windows of the
documents inside the pass that makes them; its size is fixed, and a full one only lets more rows reach the join.

Cases: null texts count as empty; items with fewer than LEAST tokens or too few words are not looked for. Rows of equal id
and text are one document in the grouping and each gets the answer; null ids are answered by their text. Texts are
read whole. Empty tables give no contamination or an empty result. Further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgeframe.llm.bloom import without
from lodgeframe.llm.storage import stored
from lodgeframe.llm.textarrays import LOWER, mixed, releasing, slices, span_hashes, utf8

WINDOW, LEAST, LITERALS, COVER = 8, 5, 4, 12
FILTER_BITS = 24
UNITS = """% percent dollar dollars cent cents euro euros pound pounds yen kg kilogram kilograms g gram grams mg ton tons
tonne tonnes oz ounce ounces lb lbs km kilometer kilometers kilometre kilometres m meter meters metre metres cm mm mile
miles foot feet inch inches yard yards l liter liters litre litres ml gallon gallons second seconds sec minute minutes
min hour hours h day days week weeks month months year years mph kmh degree degrees volt volts watt watts kb mb gb
stunden stunde tage tag jahre jahr meilen heures jours ans horas dias""".split()

WORD, NUMBER, NAME, UNIT = range(4)

_KIND = np.zeros(256, np.uint8)  # 1: belongs to a word, 3: a digit, which does so too
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 3
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?\n:;\"(")] = True
_JOINS = np.zeros(256, bool)
_JOINS[list(b".,:/")] = True
_PLACEHOLDERS = mixed(np.array([0, 11, 22, 33], np.uint64))


@dataclass
class Tokens:
    """Tokens of several texts: what they compare by, their own value, kind and text."""

    code: np.ndarray
    value: np.ndarray
    kind: np.ndarray
    row: np.ndarray


def _unit_hashes() -> np.ndarray:
    data, begins = utf8(pa.array(UNITS))
    return np.sort(span_hashes(data, begins[:-1], begins[1:]))


def tokens(column: pa.Array) -> Tokens:
    """The template tokens of the texts."""
    data, begins = utf8(column)
    n = len(data)
    lower = LOWER[data]
    accented = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    lower[accented] += 0x20
    inside = _KIND[data] > 0
    filled = begins[:-1] < begins[1:]
    edge_first, edge_last = begins[:-1][filled], begins[1:][filled] - 1
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[edge_first], last[edge_last] = inside[edge_first], inside[edge_last]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return Tokens(none, none, none.astype(np.uint8), none.astype(np.int64))
    row = np.searchsorted(begins, starts, "right") - 1
    hashes = span_hashes(lower, starts, ends)
    digits = np.concatenate([[0], np.cumsum(_KIND[data] == 3)])
    number = digits[ends] - digits[starts] == ends - starts
    stops = np.concatenate([[0], np.cumsum(_STOPS[data])])
    before = np.concatenate([[0], ends[:-1]])  # where the word before ended
    opens = np.concatenate([[True], row[1:] != row[:-1]])
    begins_sentence = opens | (stops[starts] > stops[np.minimum(before, starts)])
    second = np.minimum(starts + 1, n - 1)
    capital = (data[starts] >= 65) & (data[starts] <= 90) & (data[second] >= 97) & (data[second] <= 122)
    wide = np.zeros(n + 1, bool)
    wide[accented] = True
    capital |= wide[second]
    name = capital & (ends - starts > 1) & ~begins_sentence & ~number
    # A number that goes on after one joining character belongs to the number before.
    joined = np.zeros(len(starts), bool)
    joined[1:] = number[1:] & number[:-1] & ~opens[1:] & (starts[1:] - ends[:-1] == 1) & _JOINS[data[ends[:-1].clip(max=n - 1)]]
    heads = np.flatnonzero(~joined)
    value = hashes.copy()
    if joined.any():
        value = np.add.reduceat(np.where(joined, hashes * np.uint64(0x9E3779B97F4A7C15), hashes), heads)
    else:
        value = value[heads]
    number, name, row, opens, hashes = number[heads], name[heads], row[heads], opens[heads], hashes[heads]
    units = _unit_hashes()
    unit = units[np.searchsorted(units, hashes).clip(max=len(units) - 1)] == hashes
    unit[1:] &= number[:-1] & ~opens[1:]
    unit[0] = False
    kind = np.select([number, unit, name], [NUMBER, UNIT, NAME], WORD).astype(np.uint8)
    return Tokens(np.where(kind == WORD, hashes, _PLACEHOLDERS[kind]), value, kind, row)


def windows(found: Tokens, length: int, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first token of every window with enough words; of every window by its tokens' own values if ``plain``."""
    n = len(found.code) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factors = mixed(np.arange(1, length + 1, dtype=np.uint64)) | np.uint64(1)
    code = found.value if plain else found.code
    salt = np.uint64(length + 256 * plain)
    hashes = mixed(reduce(np.add, (code[k : k + n] * factors[k] for k in range(length))) + salt)
    fits = found.row[:n] == found.row[length - 1 :]
    if not plain:
        words = np.concatenate([[0], np.cumsum(found.kind == WORD)])
        fits &= words[length:] - words[:n] >= min(LITERALS, length)
    at = np.flatnonzero(fits)
    return hashes[at], at


def _slots(found: Tokens, at: np.ndarray, length: int) -> pa.Array:
    """For each window the placeholders as (offset, kind, value)."""
    grid = found.kind[at[:, None] + np.arange(length)] != WORD
    which, offset = np.nonzero(grid)
    where = at[which] + offset
    ends = np.concatenate([[0], np.cumsum(grid.sum(axis=1))]).astype(np.int32)
    entries = pa.StructArray.from_arrays(
        [
            pa.array(offset.astype(np.int32)),
            pa.array(found.kind[where].astype(np.int32)),
            pa.array(found.value[where].astype(np.int64)),
        ],
        ["offset", "kind", "value"],
    )
    return pa.ListArray.from_arrays(pa.array(ends), entries)


_SLOT = "array<struct<offset:int,kind:int,value:bigint>>"


def item_windows(items: DataFrame, key: str, text: str) -> DataFrame:
    """(h, plain, length, item, tokens, at, slots) of every window of the benchmark."""

    @releasing
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                found = tokens(part.column(1))
                sizes = np.bincount(found.row, minlength=part.num_rows)
                firsts = np.cumsum(sizes) - sizes
                for length, plain in product(range(LEAST, WINDOW + 1), (False, True)):
                    hashes, at = windows(found, length, plain)
                    row = found.row[at] if len(at) else np.zeros(0, np.int64)
                    fits = (sizes[row] == length) | ((sizes[row] > length) & (length == WINDOW))
                    hashes, at, row = hashes[fits], at[fits], row[fits]
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(hashes.astype(np.int64)),
                                pa.array(np.full(len(at), plain)),
                                pa.array(np.full(len(at), length, np.int32)),
                                part.column(0).take(pa.array(row)),
                                pa.array(sizes[row].astype(np.int32)),
                                pa.array((at - firsts[row]).astype(np.int32)),
                                _slots(found, at, length),
                            ],
                            ["h", "plain", "length", "item", "tokens", "at", "slots"],
                        )

    rows = items.select(F.col(f"`{key}`").cast("long").alias("item"), F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, f"h long, plain boolean, length int, item long, tokens int, at int, slots {_SLOT}")


def _filter(benchmark: DataFrame) -> np.ndarray:
    """The bit table of the benchmark's window hashes: 2**FILTER_BITS bits."""
    places = benchmark.select(
        F.explode(F.array(F.shiftrightunsigned("h", 64 - FILTER_BITS), F.col("h").bitwiseAND((1 << FILTER_BITS) - 1))).alias("p")
    )
    block = F.shiftright("p", 15).cast("int")
    maps = places.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("bits"))
    table = np.zeros((1 << (FILTER_BITS - 15), 4096), np.uint8)
    for row in maps.collect():
        table[row.block] = np.frombuffer(bytes(row.bits), np.uint8)
    return table.reshape(-1)


def row_hash(key: str, text: str) -> Column:
    """What tells documents apart: id and text."""
    return F.xxhash64(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")))


def document_windows(df: DataFrame, benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, h, place, own) of the documents' windows that may be in the benchmark; plain ones need no slots."""
    lengths = sorted(r.length for r in benchmark.select("length").distinct().collect())
    table = df.sparkSession.sparkContext.broadcast(_filter(benchmark))

    @releasing
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, slot_type = table.value, _slots(tokens(pa.array(["none"])), np.zeros(0, np.int64), 1).type

        def isset(places: np.ndarray) -> np.ndarray:
            return (bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for batch in batches:
            for part in slices(batch, "_text"):
                found = tokens(part.column(1))
                firsts = np.searchsorted(found.row, np.arange(part.num_rows))
                for length, plain in product(lengths, (False, True)):
                    hashes, at = windows(found, length, plain)
                    possible = isset(hashes >> np.uint64(64 - FILTER_BITS))
                    possible[possible] = isset(hashes[possible] & np.uint64((1 << FILTER_BITS) - 1))
                    hashes, at = hashes[possible], at[possible]
                    if len(at):
                        row = found.row[at]
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column(0).take(pa.array(row)),
                                pa.array(hashes.astype(np.int64)),
                                pa.array(at - firsts[row]),
                                pa.nulls(len(at), slot_type) if plain else _slots(found, at, length),
                            ],
                            ["doc", "h", "place", "own"],
                        )

    rows = df.select(row_hash(key, text).alias("doc"), F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, f"doc long, h long, place long, own {_SLOT}").distinct()


def leaks(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", question: str = "text") -> DataFrame:
    """(doc, item, covered, share, changed): which documents (by ``row_hash``) hold which items."""
    benchmark = stored(item_windows(items, item, question), "benchmark")
    found = document_windows(df, benchmark, key, text)
    # An item that repeats itself: one alignment for each place in the document that the item would begin at.
    slot = lambda a, g: F.struct(a["kind"].alias("kind"), a["value"].alias("asked"), g.alias("given"))
    hits = found.join(benchmark, "h").select(
        "doc", "item", (F.col("place") - F.col("at")).alias("begin"), "plain", "tokens",
        F.sequence("at", F.col("at") + F.col("length") - 1).alias("places"),
        F.when(F.col("plain"), F.transform("slots", lambda s: slot(s, s["value"])))
        .otherwise(F.zip_with("slots", F.transform("own", lambda s: s["value"]), slot)).alias("slots"),
    )

    def union(name: str, only: Column) -> Column:
        return F.array_distinct(F.flatten(F.collect_list(F.when(only, F.col(name)))))

    # Plain windows join the template ones, but what either says alone stays: plain ones may lie beyond template ones, and a
    # stretch that is unchanged counts whatever the values elsewhere in the alignment became.
    aligned = hits.groupBy("doc", "item", "begin").agg(
        F.max("tokens").alias("tokens"),
        F.array(
            *(
                F.struct(union("places", c).alias("places"), union("slots", c).alias("slots"))
                for c in (F.lit(True), ~F.col("plain"), F.col("plain"))
            )
        ).alias("ways"),
    ).select("doc", "item", "begin", "tokens", F.explode("ways").alias("way")).select("doc", "item", "begin", "tokens", "way.*")
    asked = F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["asked"]))))
    consistent = asked == F.size("slots")
    # Each inserted or dropped word shifts what follows to another alignment near by.
    near = Window.partitionBy("doc", "item").orderBy("begin").rangeBetween(0, WINDOW)
    whole = F.size(F.array_distinct(F.flatten(F.collect_list("places").over(near))))
    held = aligned.where(consistent).select(
        "doc", "item", "tokens", whole.alias("covered"),
        F.exists(F.flatten(F.collect_list("slots").over(near)), lambda s: s["asked"] != s["given"]).alias("changed"),
    )
    enough = F.col("covered") >= F.least(F.lit(COVER), F.greatest(F.lit(LEAST), F.col("tokens") - 2))
    return (
        held.where(enough)
        .groupBy("doc", "item")
        .agg(
            F.max("covered").alias("covered"),
            F.max(F.col("covered") / F.col("tokens")).alias("share"),
            F.min("changed").alias("changed"),
        )
    )


def report(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """One row for each row of ``df``: its key, contaminated, the items it holds, tokens covered and whether values differ."""
    held = leaks(df, items, key, text, **names).groupBy("doc").agg(
        F.sort_array(F.collect_set("item")).alias("items"), F.max("covered").alias("covered"), F.max("changed").alias("changed")
    )
    rows = df.select(F.col(f"`{key}`"), row_hash(key, text).alias("doc"))
    return rows.join(held, "doc", "left").select(
        f"`{key}`",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("covered", F.lit(0)).cast("long").alias("covered_tokens"),
        F.coalesce("changed", F.lit(False)).alias("reparameterised"),
    )


def decontaminate(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """The rows of ``df`` that hold no item; only rows that a filter cannot clear shuffle."""
    found = stored(leaks(df, items, key, text, **names).select(F.col("doc").alias("h")).distinct(), "leaks")
    return without(df, row_hash(key, text), found)
