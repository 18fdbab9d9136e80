"""Language identification by hierarchical discrimination: first the family, then the language within it.

A text's features are its character n-grams (orders NGRAMS) over letters in lower case, everything else being one
space, hashed to 2**BITS buckets; the square roots of the counts make a vector of length 1. A linear support vector
machine for each family against all others gives the family; within it, one machine for each two languages votes, and
votes that are even are decided by the sum of margins, then by name.

FAMILIES groups languages that descend from one; a language that it does not name is a family by itself. Machines have
the squared hinge loss and an L2 penalty, and are fitted by accelerated gradient steps, each in a Spark task of its own, on a sample of
about ROWS texts of each language, or ALL_ROWS divided by the number of languages if that is less, drawn by a hash of the
text. Only texts and languages of training rows are learnt from.

Cases: a null text, and one without a letter, is "und" with score 0, as is everything if no language was learnt. With one language,
or one in a family, that step has nothing to decide and is sure. Null languages are not learnt from. Texts of any length are read
whole. Repeated rows are judged alike; a hot language is sampled as any other. An empty table gives an empty result.
Further columns are kept; where one has the name of an added column, the added ones get more underscores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from lodgeframe.llm.columns import free_prefix, widened
from lodgeframe.llm.textarrays import mixed, slices

NGRAMS = (1, 2, 3, 4)
BITS = 14
#: Bounds of the sample: texts of one language, and of all.
ROWS, ALL_ROWS = 400, 4_000
STEPS = 150
PENALTY = 1e-3
UNKNOWN = "und"

# Languages by family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
    "austronesian": ("id", "jv", "ms", "tl"),
}

_LETTER, _OTHER = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}]+")


def family_of(language: str, families: dict[str, tuple[str, ...]] = FAMILIES) -> str:
    """The family that names the language (its part before a hyphen, in lower case), else the language itself."""
    plain = language.lower().replace("_", "-").split("-")[0]
    return next((family for family, members in families.items() if plain in members), language)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their weights; the weights' squares add up to 1."""
    plain = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
    spread = mixed(codes.astype(np.uint64) + np.uint64(1))
    counts, rolling = np.zeros(1 << BITS, np.int64), spread
    for n in range(1, max(NGRAMS) + 1):
        if n > 1:
            rolling = rolling[: max(0, len(codes) - n + 1)] * np.uint64(0x9E3779B97F4A7C15) + spread[n - 1 :]
        if n in NGRAMS and len(rolling):
            counts += np.bincount((mixed(rolling) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    used = np.flatnonzero(counts)
    return used.astype(np.int32), np.sqrt(counts[used] / counts.sum()).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Machines as one matrix: a row for each family against the rest, then one for each two languages of a family."""

    families: tuple[tuple[str, tuple[str, ...]], ...] = ()
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 1 << BITS), np.float32))
    intercepts: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def judge(self, text: str | None) -> tuple[str, float, str | None]:
        """Language, score and family of a text."""
        if not self.families or not has_letter(text):
            return UNKNOWN, 0.0, None
        buckets, values = features(text)
        margins = (self.weights[:, buckets] @ values + self.intercepts).tolist() if len(self.weights) else []
        at, certain = len(self.families) if len(self.families) > 1 else 0, 1.0
        best = 0
        if at:
            best = max(range(at), key=lambda k: (margins[k], -k))
            certain = _sure(margins[best] - max(m for k, m in enumerate(margins[:at]) if k != best))
        for k, (_, languages) in enumerate(self.families):
            pairs = list(combinations(range(len(languages)), 2))
            if k == best:
                votes, totals, least = [0] * len(languages), [0.0] * len(languages), {}
                for (a, b), margin in zip(pairs, margins[at : at + len(pairs)]):
                    votes[a if margin > 0 else b] += 1
                    totals[a] += margin
                    totals[b] -= margin
                    least[a, b], least[b, a] = margin, -margin
                won = max(range(len(languages)), key=lambda x: (votes[x], totals[x], -x))
                if pairs:
                    certain *= _sure(min(least[won, x] for x in range(len(languages)) if x != won))
                return languages[won], certain, self.families[k][0]
            at += len(pairs)
        raise AssertionError("one family is always chosen")


def _sure(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(2 * margin, -50, 50))))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss; both signs weigh the same. One more feature, always 1, is the intercept."""
    x = np.zeros((len(rows), (1 << BITS) + 1), np.float32)
    x[:, -1] = 1
    for k, (buckets, values) in enumerate(rows):
        x[k, buckets] = values
    share = np.where(signs > 0, 0.5 / max(1, (signs > 0).sum()), 0.5 / max(1, (signs < 0).sum())).astype(np.float32)
    signs = signs.astype(np.float32)
    weights = ahead = np.zeros(x.shape[1], np.float32)
    rate, momentum = 1 / (4 + PENALTY), 1.0  # rows have length root 2 at most
    for _ in range(STEPS):
        short = np.maximum(0, 1 - signs * (x @ ahead))
        slope = PENALTY * ahead - 2 * (x.T @ (share * signs * short))
        new = ahead - np.float32(rate) * slope
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = new + np.float32((momentum - 1) / following) * (new - weights)
        weights, momentum = new, following
    return weights[:-1], float(weights[-1])


def train(df: DataFrame, text: str = "text", lang: str = "lang", families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    """A model of the languages that ``lang`` names."""
    rows = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model()
    grouped: dict[str, list[str]] = {}
    for language in sorted(counts):
        grouped.setdefault(family_of(language, families), []).append(language)
    known = tuple((name, tuple(members)) for name, members in sorted(grouped.items()))
    most = max(1, min(ROWS, ALL_ROWS // len(counts)))
    spark = df.sparkSession
    bounds = spark.createDataFrame([(c, min(1.0, most / n)) for c, n in counts.items()], "lang string, share double")
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    drawn = rows.join(F.broadcast(bounds), "lang").where(place < F.col("share") * (1 << 30)).select("text", "lang")
    # The machines: which languages stand on either side. A language's rows go to each machine that it is part of.
    machines = []
    if len(known) > 1:
        for _, members in known:
            machines.append((members, tuple(c for c in sorted(counts) if c not in members)))
    machines += [((a,), (b,)) for _, members in known for a, b in combinations(members, 2)]
    if not machines:
        return Model(known)
    sides: dict[str, list[tuple[int, int]]] = {c: [] for c in counts}
    for k, pair in enumerate(machines):
        for sign, side in zip((1, -1), pair):
            for language in side:
                sides[language].append((k, sign))

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for value, language in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    buckets, weights = features(value)
                    out += [(k, sign, buckets.tobytes(), weights.tobytes()) for k, sign in sides[language]]
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                columns = list(zip(*out)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], ["machine", "sign", "buckets", "weights"]
                )

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        # Sorted, so that a fit does not depend on the order in which rows arrive.
        table = table.sort_by([("sign", "ascending"), ("buckets", "ascending"), ("weights", "ascending")])
        packed = zip(table["buckets"].to_pylist(), table["weights"].to_pylist())
        rows = [(np.frombuffer(b, np.int32), np.frombuffer(w, np.float32)) for b, w in packed]
        weights, intercept = fit_machine(rows, table["sign"].to_numpy())
        return pa.table({"machine": pa.array([key[0].as_py()], pa.int32()), "weights": pa.array([weights.tobytes()], pa.binary()), "intercept": [intercept]})

    schema = "machine int, sign int, buckets binary, weights binary"
    fitted = drawn.mapInArrow(vectors, schema).groupBy("machine").applyInArrow(fit, "machine int, weights binary, intercept double").collect()
    weights, intercepts = np.zeros((len(machines), 1 << BITS), np.float32), np.zeros(len(machines))
    for r in fitted:
        weights[r.machine], intercepts[r.machine] = np.frombuffer(r.weights, np.float32), r.intercept
    return Model(known, weights, intercepts)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with _lang, _score (0 to 1) and _family."""
    prefix = free_prefix(df, "lang", "score", "family")
    added = (StructField(prefix + "lang", StringType()), StructField(prefix + "score", DoubleType()), StructField(prefix + "family", StringType()))
    schema, sent = widened(df, *added), df.sparkSession.sparkContext.broadcast(model)
    kinds = [pa.string(), pa.float64(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch, text):
                found = [model.judge(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                added = [pa.array(c, t) for c, t in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], schema.names)

    return df.mapInArrow(run, schema)
