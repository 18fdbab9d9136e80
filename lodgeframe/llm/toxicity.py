"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct character n-grams (orders NGRAMS) of its whole text, in lower case and with
every run of white space as one space, hashed to 2**BITS buckets. Over all labelled training rows Spark
counts in how many documents of either class each bucket occurs; the log ratio of the smoothed
shares scales the bucket, and every document's vector of scaled buckets is given length 1. A logistic regression
over these vectors is fitted on a sample of SAMPLE rows of each class at most, about, chosen by a hash of the id, and
of SAMPLE_FEATURES distinct features in total at most, the rows being taken in the order of that hash. Scores are
thus for equal shares of both classes.

Only texts and labels of training rows are learnt from; ids, languages and sources are never features.

Cases: a null text counts as empty; an empty text has no features and gets the score of the intercept.
Rows without label, or with a null label, are not learnt from. Where the training rows lack one class, every score
is the smoothed share of label 1 (0.5 where nothing is labelled). Repeated rows are scored alike; an empty
table gives an empty result. Further columns of the documents are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.bloom import likely
from lodgeframe.llm.storage import stored
from lodgeframe.llm.textarrays import mixed, releasing, slices

NGRAMS = (3, 4, 5)
BITS = 18
#: Bounds of the sample that the regression is fitted on.
SAMPLE = 1_500
SAMPLE_FEATURES = 12_000_000
#: Features of the sample that are worked on at once.
BLOCK_FEATURES = 1 << 19
STEPS = 200
PENALTY = 1e-5


@dataclass(frozen=True)
class Model:
    """Score = logistic(intercept + sum of weights / root of the sum of squares, over a text's distinct buckets)."""

    weights: np.ndarray
    squares: np.ndarray
    intercept: float

    def margin(self, found: np.ndarray) -> float:
        size = self.squares[found].sum()
        return self.intercept + (self.weights[found].sum() / math.sqrt(size) if size else 0.0)


def _buckets(texts: list[str]) -> Iterator[np.ndarray]:
    """The n-gram buckets of each text, with repeats."""
    plain = [" ".join(text.lower().split()) for text in texts]
    plain = [f" {text} " if text else "" for text in plain]
    sizes = np.array([len(text) for text in plain], np.int64)
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.cumsum(sizes) - sizes
    spread = mixed(codes.astype(np.uint64) + np.uint64(1))
    hashed, rolling = {}, None
    for n in range(1, max(NGRAMS) + 1):
        if n == 1:
            rolling = spread
        else:
            rolling = rolling[: max(0, len(codes) - n + 1)] * np.uint64(0x9E3779B97F4A7C15) + spread[n - 1 :]
        if n in NGRAMS:
            hashed[n] = (mixed(rolling) >> np.uint64(64 - BITS)).astype(np.int32)
    for begin, size in zip(begins, sizes):
        parts = [hashed[n][begin : begin + size - n + 1] for n in NGRAMS if size >= n]
        yield np.concatenate(parts) if parts else np.zeros(0, np.int32)


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The distinct buckets of each text."""
    stamp = np.zeros(1 << BITS, np.int64)
    for found in _buckets([text or "" for text in texts]):
        order = np.arange(len(found))
        stamp[found] = order
        yield found[stamp[found] == order]


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column(batch.schema.get_field_index("_text")).to_pylist()


def _counts(rows: DataFrame) -> DataFrame:
    """(bucket, toxic, clean): in how many documents of either class it occurs. ``rows``: _text, _label."""

    @releasing
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for part in slices(batch, "_text"):
                labels = part.column(part.schema.get_field_index("_label")).to_pylist()
                for label, found in zip(labels, features(_texts(part))):
                    seen[label, found] += 1
        used = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(seen[1, used]), pa.array(seen[0, used])], ["bucket", "toxic", "clean"]
        )

    each = rows.mapInArrow(run, "bucket int, toxic long, clean long")
    return each.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class Sample:
    """The sample's features as Arrow delivered them, worked on in blocks of whole rows, so that no temporary spans them all."""

    def __init__(self, ratios: np.ndarray):
        self.ratios = ratios.astype(np.float32)
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, labels: np.ndarray, found: pa.Array) -> None:
        """Rows: their labels, and their buckets as packed 32-bit numbers."""
        _, offsets, data = found.buffers()
        ends = np.frombuffer(offsets, np.int32)[found.offset : found.offset + len(found) + 1] // 4
        at = np.frombuffer(data, np.int32) if data else np.zeros(0, np.int32)
        filled = np.flatnonzero(np.diff(ends))
        for rows in np.split(filled, np.flatnonzero(np.diff(ends[filled] // BLOCK_FEATURES)) + 1):
            if len(rows):
                own, firsts = at[ends[rows[0]] : ends[rows[-1] + 1]], ends[rows] - ends[rows[0]]
                lengths = np.sqrt(np.add.reduceat(self.ratios[own] ** 2, firsts))
                self.blocks.append((own, firsts, np.where(lengths > 0, lengths, np.float32(1)), labels[rows].astype(np.float32)))

    def rows(self) -> int:
        return sum(len(labels) for *_, labels in self.blocks)

    def ones(self) -> int:
        return int(sum(labels.sum() for *_, labels in self.blocks))

    def slope(self, weights: np.ndarray, intercept: float) -> tuple[np.ndarray, float]:
        """The logistic loss's slope along the weights of the scaled buckets, and along the intercept."""
        scaled, slope, total, rows = (weights * self.ratios).astype(np.float32), np.zeros(len(weights)), 0.0, self.rows()
        for at, firsts, lengths, labels in self.blocks:
            margin = np.add.reduceat(scaled[at], firsts) / lengths + np.float32(intercept)
            wrong = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels) / rows
            sizes = np.diff(firsts, append=len(at))
            slope += np.bincount(at, np.repeat(wrong / lengths, sizes), minlength=len(weights))
            total += float(wrong.sum())
        return slope * self.ratios, total


def _regression(sample: Sample) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty by accelerated gradient steps; weights of the scaled buckets."""
    rate = 4.0
    weights, ahead = np.zeros(len(sample.ratios)), np.zeros(len(sample.ratios))
    intercept = ahead_intercept = 0.0
    momentum = 1.0
    for _ in range(STEPS):
        slope, wrong = sample.slope(ahead, ahead_intercept)
        new, new_intercept = ahead - rate * (slope + PENALTY * ahead), ahead_intercept - rate * wrong
        following = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        step = (momentum - 1) / following
        ahead = new + step * (new - weights)
        ahead_intercept = new_intercept + step * (new_intercept - intercept)
        weights, intercept, momentum = new, new_intercept, following
    return weights * sample.ratios, float(intercept)


def train(docs: DataFrame, labels: DataFrame, training: Column, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """A model from the rows of ``docs`` with a 0/1 ``label`` in ``labels`` for which ``training`` (of the key) holds."""
    marked = labels.select(F.col(f"`{key}`").alias(key), F.col(f"`{label}`").cast("int").alias("_label"))
    marked = marked.where(training & F.col("_label").isin(0, 1) & F.col(f"`{key}`").isNotNull()).dropDuplicates([key])
    texts = docs.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")).where(training)
    totals = {r._label: r["count"] for r in marked.groupBy("_label").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    smoothed = math.log((toxic + 0.5) / (clean + 0.5))
    none = Model(np.zeros(1 << BITS), np.zeros(1 << BITS), smoothed)
    if not toxic or not clean:
        return none

    counted = _counts(likely(texts, key, marked.select(key)).join(marked, key).select("_text", "_label")).toPandas()
    shares = np.ones((2, 1 << BITS))
    shares[1, counted["bucket"]] += counted["toxic"]
    shares[0, counted["bucket"]] += counted["clean"]
    ratios = np.log(shares[1] / (toxic + 2)) - np.log(shares[0] / (clean + 2))

    # A row's place within its class's share of all ids, by hash; the nearest to 0 are fitted on.
    share = F.when(F.col("_label") == 1, SAMPLE / toxic).otherwise(SAMPLE / clean)
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / (F.least(share, F.lit(1.0)) * (1 << 30))
    drawn = marked.withColumn("_place", place).where("_place < 1")
    sampled = likely(texts, key, drawn.select(key)).join(drawn, key).select("_text", "_label", "_place")

    @releasing
    def lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                found = [x.tobytes() for x in features(_texts(part))]
                columns = [*(part.column(part.schema.get_field_index(c)) for c in ("_label", "_place")), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["label", "place", "found"])

    vectors = stored(sampled.mapInArrow(lists, "label int, place double, found binary"), "vectors")
    sizes = vectors.select("place", (F.length("found") / 4).alias("n")).toPandas().sort_values(["place", "n"])
    beyond = sizes.place[sizes.n.cumsum() > SAMPLE_FEATURES]
    vectors = vectors.where(F.col("place") < (float(beyond.iloc[0]) if len(beyond) else 1.0)).select("label", "found")

    @releasing
    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Sample(ratios)
        for batch in batches:
            sample.add(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1))
        if 0 < sample.ones() < sample.rows():
            weights, intercept = _regression(sample)
        else:
            weights, intercept = np.zeros(len(ratios)), smoothed
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.tobytes()], pa.binary()), pa.array([intercept])], ["weights", "intercept"]
        )

    # In a fixed order, so that the fit does not depend on how rows arrive.
    fitted = vectors.repartition(1).sortWithinPartitions("label", F.xxhash64("found")).mapInArrow(fit, "weights binary, intercept double")
    row = fitted.first()
    return Model(np.frombuffer(row.weights), ratios * ratios, row.intercept) if row else none


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with _score: 0 to 1, higher where label 1 is likelier."""
    if "_score" in df.columns:
        raise ValueError("column _score is used by this operator")
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = df.columns.index(text)

    @releasing
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(at).to_pylist()
                margins = np.array([model.margin(x) for x in features(texts)])
                scores = pa.array(1 / (1 + np.exp(-np.clip(margins, -500, 500))))
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, "_score"])

    return df.mapInArrow(run, f"{fields}, _score double")


def fold(key: str = "doc_id", folds: int = 5) -> Column:
    """The fold of a row, from its id alone."""
    return F.pmod(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")), F.lit(folds))
