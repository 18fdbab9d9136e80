"""Runs of words that repeat with a period, by scale-tiled distribution.

A run is a longest possible stretch of words with a smallest period q (words q apart are identical) of at least
max(LEAST, TIMES * q) words. Periods are taken by octaves [b, 2b), b a power of two, and work goes in these steps:

1. Every text's words become numbers, and for each octave a stretch's first boundary (a multiple of b) must see the 2b words that
   follow it again at a distance in the octave; block hashes made by doubling test all boundaries and distances
   at once. The document explodes into overlapping tiles per octave, CORE * b words and OVERLAP * b more; those that
   hold such a boundary go on. The test only ever passes too much, never too little.
2. Tiles are spread over all tasks, so a very long document is not one task's work, and equal tiles of equal texts meet
   and are solved once. In a tile, Z-functions from a boundary, forwards and backwards, say how far each period of
   the octave reaches; stretches that a smaller period explains (it divides) belong to another octave.
3. Fragments are shuffled by text and period and stitched: two that overlap by a period are one run.

As the overlap is at least TIMES periods, each run is seen at its full least length by the tile it begins in, and
neighbouring fragments overlap by more than a period. Work is n log n for n words.

Texts are told apart by their SHA-256, so equal texts share their runs, and rows with the same id may have different texts.

Cases: a null text and one without words have no runs. Texts of any length are worked on whole. Runs of equal strength are all
returned, ordered by start and period. Repeated rows get the same runs. An empty table gives an empty result. Further columns
are kept; where one has the name of an added column, the added ones get more underscores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from lodgeframe.llm.bloom import split
from lodgeframe.llm.columns import free_prefix, widened
from lodgeframe.llm.storage import stored, unsent
from lodgeframe.llm.textarrays import mixed, slices, utf8

#: A run has at least so many words, and at least so many periods.
LEAST, TIMES = 6, 4
#: Words of a tile's own and of its overlap with the next, in multiples of the octave's first period.
CORE, OVERLAP = 24, 8
RUN = "array<struct<start:long,length:long,period:long>>"


def numbered(text: bytes) -> np.ndarray:
    """A number for every word of the text, equal for identical words only."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int32)
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)


def open_tiles(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """(octave, first word) of the tiles that may hold a part of a run."""
    n, octave = len(ids), 0
    blocks = mixed(ids.astype(np.uint64) + np.uint64(1))  # of the b words from each place
    while max(LEAST, TIMES << octave) <= n:
        b = 1 << octave
        twice = mixed(blocks[: n - 2 * b + 1] * np.uint64(0x9E3779B97F4A7C15) + blocks[b:])  # of 2b words
        boundaries = np.arange(0, len(twice) - b, b)
        # The hash at each boundary against those b to 2b - 1 words on; beyond the end nothing is equal.
        ahead = np.zeros(len(boundaries) * b, twice.dtype)
        following = twice[b : b + len(ahead)]
        ahead[: len(following)] = following
        same = ahead.reshape(len(boundaries), b) == twice[boundaries, None]
        same.reshape(-1)[len(following) :] = False
        if same.any():
            at = boundaries[same.any(axis=1)]
            first = np.unique(np.concatenate([at // (CORE * b), (at[at % (CORE * b) < OVERLAP * b] // (CORE * b)) - 1]))
            for tile in first[first >= 0].tolist():
                yield octave, tile * CORE * b
        blocks, octave = twice, octave + 1


def z_function(values: list[int]) -> list[int]:
    """For each place, how many values from there on equal those from the beginning on."""
    n = len(values)
    z = [n] + [0] * (n - 1)
    left = right = 0
    for k in range(1, n):
        reach = min(right - k, z[k - left]) if k < right else 0
        while k + reach < n and values[reach] == values[k + reach]:
            reach += 1
        z[k] = reach
        if k + reach > right:
            left, right = k, k + reach
    return z


def _prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def fragments(ids: np.ndarray, octave: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the runs of one octave within a tile, clipped at its ends."""
    b, n = 1 << octave, len(ids)
    covered: dict[int, int] = {}
    for c in range(0, n - 3 * b + 1, b):
        most = min(2 * b - 1, n - c - 2 * b)  # the largest period whose 2b words lie in the tile
        if most < b:
            break
        near, far = ids[c + b : c + most + 1], ids[c + 2 * b : c + b + most + 1]
        periods = (np.flatnonzero((near == ids[c]) & (far == ids[c + b])) + b).tolist()
        periods = [q for q in periods if covered.get(q, 0) < c + q]
        if not periods:
            continue
        forward = z_function(ids[c:].tolist())
        periods = [q for q in periods if forward[q] >= 2 * b]
        if not periods:
            continue
        before, reach = ids[:c][::-1].tolist(), c + periods[-1]
        backward = z_function([*before, -1, *ids[:reach][::-1].tolist()])
        for q in periods:
            start = c - (min(c, backward[c + 1 + reach - c - q]) if c else 0)
            end = c + q + forward[q]
            covered[q] = end
            smaller = any(forward[q // r] >= end - c - q // r for r in _prime_factors(q))
            if not smaller and end - start >= max(LEAST, TIMES * q):
                yield start, end, q


def _mark(text: str):
    return F.unhex(F.sha2(F.col(f"`{text}`").cast("binary"), 256))


def tiles(texts: DataFrame) -> DataFrame:
    """(mark, octave, at, ids) of every tile worth solving. ``texts``: mark, text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.binary(), pa.int32(), pa.int64(), pa.binary()]
            columns = list(zip(*rows)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["mark", "octave", "at", "ids"])

        known = set()  # of the texts with tiles that this task has had
        for batch in batches:
            for part in slices(batch, "text"):
                data, begins = utf8(part.column(1))
                rows, size = [], 0
                for mark, a, e in zip(part.column(0).to_pylist(), begins[:-1], begins[1:]):
                    if mark in known:
                        continue
                    ids = numbered(data[a:e].tobytes())
                    for octave, at in open_tiles(ids):
                        known.add(mark)
                        rows.append((mark, octave, at, ids[at : at + (CORE + OVERLAP << octave)].tobytes()))
                        if (size := size + len(rows[-1][3])) > 1 << 22:
                            yield out(rows)
                            rows, size = [], 0
                yield out(rows)

    return texts.mapInArrow(run, "mark binary, octave int, at long, ids binary")


def solved(tiles: DataFrame) -> DataFrame:
    """(mark, period, start, end) of the fragments in all tiles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for mark, octave, at, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
                rows += [(mark, q, at + s, at + e) for s, e, q in fragments(np.frombuffer(ids, np.int32), octave)]
            columns = list(zip(*rows)) or [[]] * 4
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["mark", "period", "start", "end"])

    return tiles.mapInArrow(run, "mark binary, period long, start long, end long")


def stitched(fragments: DataFrame) -> DataFrame:
    """(mark, runs): the runs of each text that has any, by start and period."""
    along = Window.partitionBy("mark", "period").orderBy("start", "end")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    joined = F.coalesce(F.col("start") + F.col("period") <= before, F.lit(False))
    cut = fragments.withColumn("new", (~joined).cast("int"))
    cut = cut.withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = cut.groupBy("mark", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    run = F.struct("start", (F.col("end") - F.col("start")).alias("length"), "period")
    return whole.groupBy("mark").agg(F.sort_array(F.collect_list(run)).alias("runs"))


def find_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with _runs: array of (start, length, period) in words, ordered by start and period; empty without runs.

    Texts without runs do not shuffle: a filter of the marks of texts with runs lets the others pass.
    """
    texts = df.select(_mark(text).alias("mark"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    # Copies of a text bring the same tiles: a task sends those of one copy. Tiles are small once compressed and long to solve, so Spark,
    # which would join partitions by their size until one task had them all, is given a number.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = tiles(texts).repartition(parts, "mark", "octave", "at").groupBy("mark", "octave", "at").agg(F.first("ids").alias("ids"))
    found = stored(stitched(solved(spread).distinct()), "runs")

    prefix = free_prefix(df, "runs", "mark")
    name, mark = prefix + "runs", prefix + "mark"
    marked = df.withColumn(mark, _mark(text))
    none = F.array().cast(RUN)
    open_rows, closed = split(marked, mark, found.select(F.col("mark").alias(mark)))
    joined = open_rows.join(unsent(found.select(F.col("mark").alias(mark), F.col("runs").alias(name))), mark, "left")
    kept = [f"`{c}`" for c in df.columns]
    return closed.select(*kept, none.alias(name)).unionByName(joined.select(*kept, F.coalesce(name, none).cast(RUN).alias(name)))


def collapse(df: DataFrame, text: str = "text", runs: str = "_runs") -> DataFrame:
    """``df`` with _n (words) and _collapsed: its words, of each run only the first period, joined by one space."""
    prefix = free_prefix(df, "n", "collapsed")
    schema = widened(df, StructField(prefix + "n", LongType()), StructField(prefix + "collapsed", StringType()))

    def short(value: bytes, found: list[dict]) -> tuple[int, bytes]:
        words = value.split()
        if found:
            edges = np.zeros(len(words) + 1, np.int64)
            for r in found:
                edges[r["start"] + r["period"]] += 1
                edges[r["start"] + r["length"]] -= 1
            kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()
            return len(words), b" ".join(map(words.__getitem__, kept))
        return len(words), b" ".join(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                at, of = (part.schema.get_field_index(c) for c in (text, runs))
                data, begins = utf8(part.column(at))
                done = [
                    short(data[a:e].tobytes(), found or [])
                    for a, e, found in zip(begins[:-1], begins[1:], part.column(of).to_pylist())
                ]
                added = [pa.array([n for n, _ in done], pa.int64()), pa.array([x for _, x in done], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], schema.names)

    return df.mapInArrow(run, schema)
