"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct 5-word shingles. Two permutations make the whole signature: the first
scatters the shingles over a circle of places, and the second, a fixed list of ranks around the
circle, is shifted by one place for each further coordinate; a coordinate is the least rank that the shingles meet.

1. One pass makes for each row the size of its set, a fingerprint of its words and its band keys. Rows of equal
   words are one class and only the row with the smallest id goes on.
2. Classes that share a band are candidates. A band's bucket of CROWD classes at most yields all its
   pairs. A larger one yields one pair for each member, with the member that meets most others; its members go on.
3. Candidates are verified on the full sets; components follow from the links.
4. Members of large buckets get longer bands (DEEP), in whose buckets only members of different components
   are compared, by many more signature coordinates, inside the task; what may be similar enough is
   verified on the full sets as well. So a group of thousands of near copies costs work in proportion to its size
   plus the pairs that really are close, and no link between texts is given up.

A pair at the threshold of 0.85 misses all bands of step 2 with a probability of 1e-7, and those of step 4 with 4e-4.

Cases: A-Z count as a-z. Fewer than five words are one shingle; without words the set is empty and linked with
nothing. A null text counts as empty. A row with a null id is linked with nothing; rows that share an id
count as one document. Very long texts are worked on whole. An empty table gives an empty result. Equal
texts are linked through their class.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.bloom import matching, without
from lodgeframe.llm.components import components
from lodgeframe.llm.storage import stored
from lodgeframe.llm.textarrays import LOWER_BYTES, mixed, releasing, slices, utf8, word_hashes

WORDS = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Places of the circle.
PLACES = 1 << 22
#: Coordinates in a band, and bands.
ROWS, BANDS = 5, 28
#: Classes of a bucket whose pairs are all verified.
CROWD = 24
#: The same of longer bands, for members of larger buckets; such buckets are compared in blocks of so many.
DEEP_ROWS, DEEP_BANDS = 14, 73
DEEP_BLOCK = 512
#: Four standard errors of the similarity estimated from one bit of each coordinate.
SLACK = 0.066


def permuted(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed permutation of the numbers below PLACES, computed for each number by itself."""
    x, mask = x.astype(np.uint32), np.uint32(PLACES - 1)
    for odd in (mixed(np.arange(1, 5, dtype=np.uint64) + np.uint64(1000 * key)) | np.uint64(1)).astype(np.uint32):
        x = (x * odd + (odd >> np.uint32(7))) & mask
        x ^= x >> np.uint32(11)
    return x


class Circle:
    """The ranks around the circle. One is made for a task and goes with it: 16 MB that no worker keeps."""

    def __init__(self, coordinates: int):
        ranks = permuted(np.arange(PLACES + coordinates - 1, dtype=np.uint32) & np.uint32(PLACES - 1), 2)
        self.coordinates = coordinates
        self.windows = np.lib.stride_tricks.sliding_window_view(ranks, coordinates)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The coordinates of a non-empty set of shingle hashes: the least ranks that the shifts bring to its places."""
        places = permuted(shingles & np.uint64(PLACES - 1), 1)
        step = max(1, (1 << 20) // self.coordinates)
        return reduce(np.minimum, (self.windows[places[k : k + step]].min(axis=0) for k in range(0, len(places), step)))


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The coordinates of one non-empty set of shingle hashes."""
    return Circle(coordinates).signature(shingles)


_FACTORS = mixed(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    hashes, rows = word_hashes(column)
    ends = np.searchsorted(rows, np.arange(len(column)), "right")
    begin = 0
    for end in ends:
        own = hashes[begin:end]
        begin = end
        if len(own) >= WORDS:
            n = len(own) - WORDS + 1
            yield np.unique(mixed(reduce(np.add, (own[k : k + n] * _FACTORS[k] for k in range(WORDS)))))
        elif len(own):
            yield mixed(np.array([len(own) + sum(int(h) * (2 * k + 3) for k, h in enumerate(own)) & (1 << 64) - 1], np.uint64))
        else:
            yield own


def fingerprints(column: pa.Array) -> list[bytes]:
    """16 bytes for the sequence of words of each text."""
    data, begins = utf8(column)
    whole = data.tobytes().translate(LOWER_BYTES)
    return [blake2b(b" ".join(whole[a:b].split()), digest_size=16).digest() for a, b in zip(begins[:-1], begins[1:])]


def _band_keys(coordinates: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key for each band."""
    factors = mixed(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    grid = mixed(coordinates.astype(np.uint64) + np.uint64(1)).reshape(bands, rows)
    return mixed((grid * factors).sum(axis=1, dtype=np.uint64) + mixed(np.arange(bands, dtype=np.uint64) + np.uint64(77)))


def _text(part: pa.RecordBatch, name: str = "_text") -> pa.Array:
    return part.column(part.schema.get_field_index(name))


def profiles(df: DataFrame, text: str, key: str) -> DataFrame:
    """(_id, _shingles, _words, _bands): set size, fingerprint of the words and band keys (none without words)."""

    @releasing
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circle = Circle(ROWS * BANDS)
        for batch in batches:
            for part in slices(batch, "_text"):
                sizes, bands = [], []
                for shingles in shingle_sets(_text(part)):
                    sizes.append(len(shingles))
                    keys = _band_keys(circle.signature(shingles), ROWS, BANDS) if len(shingles) else []
                    bands.append(np.asarray(keys, np.uint64).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(fingerprints(_text(part)), pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    ["_id", "_shingles", "_words", "_bands"],
                )

    rows = df.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, "_id long, _shingles long, _words binary, _bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (u, v) of ``pairs`` whose full sets are similar enough. ``texts``: _id, _text, _words; pairs also wu, wv.

    A text must have the fingerprint that the pair was made for. Two joins on ids; Spark splits the
    partitions of a document that is in very many pairs.
    """

    @releasing
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "tv"):
                keep = []
                left, right = _text(part, "tu"), shingle_sets(_text(part, "tv"))
                for k, (u, other) in enumerate(zip(part.column(0).to_pylist(), right)):
                    if u != last:
                        last, one = u, next(shingle_sets(left.slice(k, 1)))
                    shared = len(np.intersect1d(one, other, assume_unique=True))
                    keep.append(100 * shared >= PERCENT * (len(one) + len(other) - shared))
                yield pa.RecordBatch.from_arrays(
                    [c.filter(pa.array(keep, pa.bool_())) for c in part.columns[:2]], ["u", "v"]
                )

    second = texts.select(F.col("_id").alias("v"), F.col("_text").alias("tv"), F.col("_words").alias("wv"))
    first = texts.select(F.col("_id").alias("u"), F.col("_text").alias("tu"), F.col("_words").alias("wu"))
    both = pairs.join(second, ["v", "wv"]).join(first, ["u", "wu"]).select("u", "v", "tu", "tv")
    return both.mapInArrow(run, "u long, v long").distinct()


def _deep_rows(members: DataFrame) -> DataFrame:
    """(key, _id, _words, component, place, bits, keys): the rows of every long band of ``members`` (with _text)."""

    @releasing
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circle = Circle(DEEP_ROWS * DEEP_BANDS)
        for batch in batches:
            for part in slices(batch, "_text", 1 << 18):
                keys, bits, low = [], [], []
                for shingles in shingle_sets(_text(part)):
                    whole = circle.signature(shingles)
                    long = _band_keys(whole, DEEP_ROWS, DEEP_BANDS)
                    keys.append(long.astype(np.int64))
                    low.append(long.astype(np.uint32).tobytes())
                    bits.append(np.packbits((mixed(whole.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).tobytes())
                each = np.repeat(np.arange(part.num_rows), DEEP_BANDS)
                at = pa.array(each)
                columns = [_text(part, c).take(at) for c in ("_id", "_words", "component")]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys)),
                        *columns,
                        pa.array(np.tile(np.arange(DEEP_BANDS, dtype=np.int32), part.num_rows)),
                        pa.array(bits, pa.binary()).take(at),
                        pa.array(low, pa.binary()).take(at),
                    ],
                    ["key", "_id", "_words", "component", "place", "bits", "keys"],
                )

    return members.mapInArrow(
        run, "key long, _id long, _words binary, component long, place int, bits binary, keys binary"
    )


def _near(rows: list[dict]) -> Iterator[tuple]:
    """Pairs of one bucket that lie in different components, may be similar enough and meet here first."""
    bits = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1), axis=1)
    bits = bits[:, : DEEP_ROWS * DEEP_BANDS].astype(np.float32)
    keys = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint32).reshape(len(rows), -1)
    component = np.array([r["component"] for r in rows])
    side = np.array([r["side"] for r in rows])
    total, place = bits.shape[1], rows[0]["place"]
    least = (PERCENT / 100 - SLACK + 1) / 2 * total
    ones = bits.sum(axis=1)
    for k in range(len(rows)):
        agree = total - (ones[k] + ones[k + 1 :] - 2 * (bits[k + 1 :] @ bits[k]))
        close = np.flatnonzero((agree >= least) & (component[k + 1 :] != component[k])) + k + 1
        if side[k] < 2:  # two blocks meet: only pairs between them
            close = close[side[close] != side[k]]
        if place and len(close):
            close = close[~(keys[close, :place] == keys[k, :place]).any(axis=1)]
        for j in close:
            a, b = (rows[k], rows[j]) if rows[k]["_id"] > rows[j]["_id"] else (rows[j], rows[k])
            yield a["_id"], a["_words"], b["_id"], b["_words"]


def _near_pairs(deep: DataFrame) -> DataFrame:
    """Candidates (u, wu, v, wv) from long-band buckets that hold several components."""
    buckets = deep.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("a"), F.max("component").alias("b")
    )
    mixed_buckets = buckets.where("a <> b").select("key", F.ceil(F.col("n") / DEEP_BLOCK).cast("int").alias("blocks"))
    # A bucket of several blocks: each block with itself (side 2) and each two blocks (sides 0 and 1).
    placed = deep.join(mixed_buckets, "key").withColumn("block", F.pmod(F.xxhash64("_id"), F.col("blocks")).cast("int"))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(
            F.least("block", other).alias("low"),
            F.greatest("block", other).alias("high"),
            F.when(other == F.col("block"), 2).when(F.col("block") < other, 0).otherwise(1).alias("side"),
        ),
    )
    rows = placed.select("*", F.explode(meets).alias("meet")).select(
        "key", "_id", "_words", "component", "place", "bits", "keys", "meet.low", "meet.high", "meet.side"
    )
    group = ["key", "low", "high"]

    @releasing
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary()]
            columns = list(zip(*found)) or [[]] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["u", "wu", "v", "wv"]
            )

        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (at := tuple(row[g] for g in group)) != now:
                    if len(held) > 1:
                        yield out(list(_near(held)))
                    now, held = at, []
                held.append(row)
        yield out(list(_near(held)) if len(held) > 1 else [])

    return (
        rows.repartition(*group)
        .sortWithinPartitions(*group, "_id")
        .mapInArrow(run, "u long, wu binary, v long, wv binary")
        .distinct()
    )


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(_id, _shingles, _component, _kept) for every row: its set size and the smallest id it is linked to."""
    rows = stored(profiles(df, text, key), "profiles")
    usable = rows.where("_id IS NOT NULL AND _shingles > 0")
    heads = usable.groupBy("_words").agg(
        F.min("_id").alias("_id"), F.first("_shingles").alias("_shingles"), F.first("_bands").alias("_bands")
    )
    # Stored, as it is used twice, and as Spark splits a hot class's partition only where a join reads plain exchanges.
    heads = stored(heads, "heads")

    band_rows = heads.select(F.explode("_bands").alias("band"), "_id", "_words", "_shingles")
    counts = band_rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(band_rows.join(counts, "band"), "bands")

    member = F.struct("_id", "_words", "_shingles")
    small = shared.where(F.col("n") <= CROWD).groupBy("band").agg(F.sort_array(F.collect_list(member)).alias("m"))
    pairs = small.select(F.expr("""inline(flatten(transform(m, (x, i) -> transform(slice(m, 1, i), y ->
        struct(x._id AS u, x._words AS wu, y._id AS v, y._words AS wv,
               x._shingles AS nu, y._shingles AS nv)))))"""))
    crowded = shared.where(F.col("n") > CROWD)
    standing = crowded.groupBy("_id").agg(F.sum("n").alias("standing"))
    ranked = crowded.join(standing, "_id")
    hubs = ranked.groupBy("band").agg(F.max(F.struct("standing", -F.col("_id"), "_id", "_words", "_shingles")).alias("hub"))
    spokes = crowded.join(hubs, "band").select(
        F.col("hub._id").alias("u"), F.col("hub._words").alias("wu"), F.col("_id").alias("v"), F.col("_words").alias("wv"),
        F.col("hub._shingles").alias("nu"), F.col("_shingles").alias("nv"),
    )
    possible = f"u <> v AND 100 * least(nu, nv) >= {PERCENT} * greatest(nu, nv)"
    candidates = pairs.unionByName(spokes).where(possible).select("u", "wu", "v", "wv").distinct()

    candidates = stored(candidates, "candidates")
    members = stored(crowded.select("_id", "_words").distinct(), "members")
    wanted = candidates.select(F.explode(F.array("u", "v")).alias("_id")).unionByName(members.select("_id")).distinct()
    texts = stored(_with_fingerprints(df, text, key, stored(wanted, "wanted")), "texts")
    links = stored(verified(candidates, texts), "links")
    if not members.isEmpty():
        first = components(links)
        own = members.join(first.withColumnsRenamed({"node": "_id"}), "_id", "left")
        own = own.withColumn("component", F.coalesce("component", "_id"))
        deep = stored(_deep_rows(texts.join(own, ["_id", "_words"]).dropDuplicates(["_id", "_words"])), "deep")
        links = links.unionByName(verified(_near_pairs(deep), texts))
    found = components(links).withColumnsRenamed({"node": "rep"})
    classes = heads.select("_words", F.col("_id").alias("rep"))
    out = rows.join(classes, "_words", "left").join(found, "rep", "left")
    linked = F.when(F.col("_id").isNotNull() & (F.col("_shingles") > 0), F.coalesce("component", "rep"))
    out = out.withColumn("_component", F.coalesce(linked, "_id"))
    return out.select("_id", "_shingles", "_component", F.col("_id").eqNullSafe(F.col("_component")).alias("_kept"))


def _with_fingerprints(df: DataFrame, text: str, key: str, wanted: DataFrame) -> DataFrame:
    """(_id, _text, _words) of the rows whose id is in ``wanted``."""

    @releasing
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                marks = pa.array(fingerprints(_text(part)), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, marks], ["_id", "_text", "_words"])

    rows = df.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"))
    found = matching(rows.where("_id IS NOT NULL"), "_id", wanted)
    return found.mapInArrow(run, "_id long, _text string, _words binary")


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stay: of linked documents the one with the smallest id."""
    dropped = near_duplicates(df, text, key).where("NOT _kept").select(F.xxhash64("_id").alias("h")).distinct()
    return without(df, F.xxhash64(F.col(f"`{key}`").cast("long")), stored(dropped, "dropped"))
