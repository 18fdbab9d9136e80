"""Language-model scores by a hierarchical Pitman-Yor model, sampled and scored in partitions of the vocabulary.

Tokens are words (A-Z in lower case) and one end per text. There are three levels of restaurants: the root, one for each
class of the word before (2**CONTEXT_BITS classes by hash), and one for each of these and 2**FINE_BITS classes of the word
before that. A restaurant's tables are customers of its parent, which it shares with its siblings; the root's
parent gives each of V known words and all unknown ones 1 / (V + 1).

1. Training texts are counted: every task sums (word, context) pairs and sends them, packed, to the partition
   of the word. A partition holds all restaurants' customers of its words.
2. A Gibbs sweep seats the customers of every (word, restaurant) anew, given the tables of all others: partitions work by
   themselves on what they hold, and what they share, the tables and customers of each restaurant, is summed by Spark after
   every sweep. Sums have a fixed size. A customer joins a table or opens one by the Chinese-restaurant rule; from
   the SINGLY-th on, customers of one dish are seated in groups of an eighth of those seated. Seats follow from the seed and
   the sums of earlier sweeps, so a partition makes them again instead of storing them, also after a lost executor.
3. All texts' tokens go, packed, to the partitions of their words, where the predictive probabilities of the last KEPT
   sweeps are averaged; sums for each text go back to where it came from and are added. A word with a large
   share of all tokens makes its partition large: such a partition's tokens are split, and its counts copied to each part.

The counts and the tokens that move grow with the input; nothing is capped or pruned. Words are told apart by 48-bit hashes.

Cases: a null text counts as empty and has one token, the end. Words of any length and texts of any length are
read whole. A null id is a training row. Repeated rows are scored alike and each counted in training. Without training
rows every token has probability 1. An empty table gives an empty result. ``df`` must be stored (or otherwise
give the same rows in the same order when it is read again).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.storage import stored
from lodgeframe.llm.textarrays import mixed, slices, word_hashes

CONTEXT_BITS, FINE_BITS = 12, 4
DISCOUNTS, STRENGTHS = (0.6, 0.75, 0.85), (10.0, 5.0, 2.0)
BURNT, KEPT = 2, 3
SEED = 20_24
SINGLY = 16
#: Bytes of text for each partition of the vocabulary, about, and tokens that a task packs together.
PARTITION_BYTES = 12 << 20
PACKED_TOKENS = 1 << 20
#: A partition with this share of all tokens, or four times the mean, is split; so at most this many are.
SPLIT_MOST = 4_096

_BITS = CONTEXT_BITS + FINE_BITS
_START, _END = mixed(np.array([101, 102], np.uint64)) >> np.uint64(16)


def pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    one = zstandard.ZstdCompressor(level=1)
    return pickle.dumps([(a.dtype.str, one.compress(a.tobytes())) for a in arrays])


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    one = zstandard.ZstdDecompressor()
    return [np.frombuffer(one.decompress(data), kind) for kind, data in pickle.loads(blob)]


def text_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word << 16 | context) and row of every token of the texts, ends included."""
    hashes, rows = word_hashes(column)
    n = len(column)
    sizes = np.bincount(rows, minlength=n) + 1
    ends = np.cumsum(sizes)
    words = np.empty(len(hashes) + n, np.uint64)
    words[np.arange(len(hashes)) + rows] = hashes >> np.uint64(16)
    words[ends - 1] = _END
    before, second = np.full_like(words, _START), np.full_like(words, _START)
    before[1:], second[2:] = words[:-1], words[:-2]
    starts = ends - sizes
    before[starts] = _START
    second[starts] = _START
    follows = starts[sizes > 1] + 1
    second[follows] = _START
    coarse = mixed(before) >> np.uint64(64 - CONTEXT_BITS)
    fine = mixed(second + np.uint64(5)) >> np.uint64(64 - FINE_BITS)
    return (words << np.uint64(16)) | (coarse << np.uint64(FINE_BITS)) | fine, np.repeat(np.arange(n), sizes)


def _partition(keys: np.ndarray, partitions: int) -> np.ndarray:
    return ((keys >> np.uint64(16)) % np.uint64(partitions)).astype(np.int64)


def _packed_keys(keys: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted keys as distinct words, how often each, and contexts; with further arrays in the same order."""
    words = keys >> np.uint64(16)
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    sizes = np.diff(np.r_[first, len(words)]).astype(np.uint32)
    return pack(words[first], sizes, (keys & np.uint64(0xFFFF)).astype(np.uint16), *more)


def _unpacked_keys(blob: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    words, sizes, contexts, *more = unpack(blob)
    return (np.repeat(words, sizes) << np.uint64(16)) | contexts.astype(np.uint64), more


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _count(rows: DataFrame, partitions: int) -> DataFrame:
    """(pid, blob, tokens, words, customers) of training texts (_text): counts of every (word, context)."""

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            where = _partition(keys, partitions)
            used = np.unique(where)
            blobs = [_packed_keys(keys[at], counts[at].astype(np.uint32)) for at in (where == p for p in used)]
            return pa.RecordBatch.from_arrays([pa.array(used), pa.array(blobs, pa.binary())], ["pid", "blob"])

        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "_text"):
                keys, _ = text_tokens(part.column(0))
                held.append(keys)
                if (size := size + len(keys)) >= PACKED_TOKENS:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def merged(table: pa.Table) -> pa.Table:
        parts = [_unpacked_keys(blob) for blob in table["blob"].to_pylist()]
        keys, counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([m[0] for _, m in parts]).astype(np.int64))
        customers = np.bincount((keys & np.uint64(0xFFFF)).astype(np.int64), counts, 1 << _BITS).astype(np.int64)
        words = int((np.diff(keys >> np.uint64(16)) > 0).sum()) + 1
        return pa.table(
            {
                "pid": table["pid"][:1],
                "blob": pa.array([_packed_keys(keys, counts)], pa.binary()),
                "tokens": pa.array([int(counts.sum())]),
                "words": pa.array([words]),
                "customers": pa.array([pack(customers)], pa.binary()),
            }
        )

    sent = rows.mapInArrow(packed, "pid long, blob binary")
    return sent.groupBy("pid").applyInArrow(merged, "pid long, blob binary, tokens long, words long, customers binary")


def _total(rows: DataFrame, partitions: int) -> list[np.ndarray]:
    """The sum of the packed arrays of ``rows`` (pid, sums), in rounds of groups of 16, so that the driver gets 16 rows at most."""

    def merged(table: pa.Table) -> pa.Table:
        total = None
        for blob in table["sums"]:
            arrays = unpack(blob.as_py())
            total = arrays if total is None else [a + b for a, b in zip(total, arrays)]
        return pa.table({"pid": table["pid"][:1], "sums": pa.array([pack(*total)], pa.binary())})

    while partitions > 16:
        partitions = -(-partitions // 16)
        rows = rows.withColumn("pid", F.pmod("pid", F.lit(partitions))).groupBy("pid").applyInArrow(merged, "pid long, sums binary")
    last = [unpack(r.sums) for r in rows.select("sums").collect()]
    return [sum(arrays) for arrays in zip(*last)]


@dataclass
class Tables:
    """Sums over all partitions after a sweep: tables of each restaurant of the three levels."""

    root: int
    coarse: np.ndarray
    fine: np.ndarray

    @property
    def customers(self) -> tuple[int, np.ndarray]:
        """Of the root and of the coarse restaurants: the tables of their children."""
        return int(self.coarse.sum()), self.fine.reshape(-1, 1 << FINE_BITS).sum(axis=1)


@dataclass
class Model:
    tokens: int
    words: int
    customers: np.ndarray
    sweeps: list[Tables]


def _seat(customers: np.ndarray, opening: np.ndarray, discount: float, dice: np.random.Generator) -> np.ndarray:
    """Tables after seating so many customers of one dish each; ``opening``: weight of a new table."""
    tables = np.minimum(customers, 1)
    active = np.flatnonzero(customers > 1)
    seated = 1
    while len(active):
        step = 1 if seated < SINGLY else seated // 8
        new = opening[active]
        chance = new / (new + seated - discount * tables[active])
        if step == 1:
            opened = dice.random(len(active)) < chance
        else:
            opened = dice.binomial(np.minimum(step, customers[active] - seated), chance)
        tables[active] += opened
        seated += step
        active = active[customers[active] > seated]
    return tables


class Partition:
    """The restaurants' customers of the words of one partition, and their seats."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, words: int):
        self.keys, self.counts, self.base = keys, counts.astype(np.int64), 1.0 / (words + 1)
        self.coarse_keys, self.to_coarse = np.unique(keys >> np.uint64(FINE_BITS), return_inverse=True)
        self.words, self.to_word = np.unique(self.coarse_keys >> np.uint64(CONTEXT_BITS), return_inverse=True)
        self.fine = (keys & np.uint64(0xFFFF)).astype(np.int64)
        self.coarse = (self.coarse_keys & np.uint64((1 << CONTEXT_BITS) - 1)).astype(np.int64)
        self.word_counts = np.bincount(self.to_word[self.to_coarse], self.counts, len(self.words)).astype(np.int64)
        self.tables = [np.ones(len(x), np.int64) for x in (self.words, self.coarse_keys, keys)]

    def _children(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers of the root and of the coarse restaurants: tables of their children."""
        coarse = np.bincount(self.to_coarse, self.tables[2], len(self.coarse_keys)).astype(np.int64)
        return np.bincount(self.to_word, self.tables[1], len(self.words)).astype(np.int64), coarse

    def sums(self) -> list[np.ndarray]:
        coarse = np.bincount(self.coarse, self.tables[1], 1 << CONTEXT_BITS).astype(np.int64)
        fine = np.bincount(self.fine, self.tables[2], 1 << _BITS).astype(np.int64)
        return [np.array([self.tables[0].sum()]), coarse, fine]

    def root(self, all_tables: Tables, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        total, _ = all_tables.customers
        d, s = DISCOUNTS[0], STRENGTHS[0]
        return (customers - d * tables + (s + d * all_tables.root) * self.base) / (s + total)

    def sweep(self, all_tables: Tables, dice: np.random.Generator) -> None:
        """Seats all customers anew, from the finest level to the root, given the sums after the sweep before."""
        at_root, at_coarse = self._children()
        root = self.root(all_tables, at_root, self.tables[0])
        _, totals = all_tables.customers
        middle = given(1, at_coarse, self.tables[1], totals[self.coarse], all_tables.coarse[self.coarse], root[self.to_word])
        weight = (STRENGTHS[2] + DISCOUNTS[2] * all_tables.fine[self.fine]) * middle[self.to_coarse]
        self.tables[2] = _seat(self.counts, weight, DISCOUNTS[2], dice)
        _, at_coarse = self._children()
        weight = (STRENGTHS[1] + DISCOUNTS[1] * all_tables.coarse[self.coarse]) * root[self.to_word]
        self.tables[1] = _seat(at_coarse, weight, DISCOUNTS[1], dice)
        at_root, _ = self._children()
        weight = np.full(len(self.words), (STRENGTHS[0] + DISCOUNTS[0] * all_tables.root) * self.base)
        self.tables[0] = _seat(at_root, weight, DISCOUNTS[0], dice)

    def replay(self, pid: int, model: Model) -> Iterator[tuple[int, Tables]]:
        """The seats after each of the model's sweeps but the start, with the sums that go with them."""
        for k, before in enumerate(model.sweeps[:-1], 1):
            self.sweep(before, np.random.default_rng([SEED, pid, k]))
            yield k, model.sweeps[k]


def given(level: int, customers, tables, all_customers, all_tables, parent):
    """Predictive probability of a dish in a restaurant."""
    d, s = DISCOUNTS[level], STRENGTHS[level]
    return (customers - d * tables + (s + d * all_tables) * parent) / (s + all_customers)


def fit(rows: DataFrame, partitions: int) -> tuple[Model, DataFrame]:
    """The model of training texts (_text) and their stored counts."""
    counts = stored(_count(rows, partitions), "counts")
    n = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("words"), F.lit(0)).alias("w")).first()
    if not n.t:
        return Model(0, 0, np.zeros(1 << _BITS, np.int64), []), counts
    customers = _total(counts.select("pid", F.col("customers").alias("sums")), partitions)[0]
    model = Model(n.t, n.w, customers, [])
    spark = rows.sparkSession
    for done in range(BURNT + KEPT + 1):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for pid, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    keys, (each,) = _unpacked_keys(blob)
                    own, known = Partition(keys, each, sent.value.words), sent.value
                    for k, before in enumerate(known.sweeps, 1):
                        own.sweep(before, np.random.default_rng([SEED, pid, k]))
                    yield pa.RecordBatch.from_arrays([pa.array([pid]), pa.array([pack(*own.sums())], pa.binary())], ["pid", "sums"])

        root, coarse, fine = _total(counts.select("pid", "blob").mapInArrow(run, "pid long, sums binary"), partitions)
        model = Model(model.tokens, model.words, customers, [*model.sweeps, Tables(int(root[0]), coarse, fine)])
    return model, counts


def _found(sorted_keys: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The values at each key, 0 where it is not among the sorted keys."""
    if not len(sorted_keys):
        return tuple(np.zeros(len(keys), v.dtype) for v in values)
    at = np.searchsorted(sorted_keys, keys).clip(max=len(sorted_keys) - 1)
    there = sorted_keys[at] == keys
    return tuple(np.where(there, v[at], 0) for v in values)


def _uses(rows: DataFrame, partitions: int, split: dict[int, int]) -> DataFrame:
    """(pid, salt, flush, blob): tokens of all texts by partition, and for each flush a row about its texts (pid < 0)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(first: int, keys: list, docs: list, texts: list[pa.RecordBatch]) -> pa.RecordBatch:
            about = pa.Table.from_batches([t.drop_columns(["_text"]) for t in texts])
            keys, docs = np.concatenate(keys), np.concatenate(docs)
            order = np.argsort(keys, kind="stable")
            keys, docs = keys[order], docs[order].astype(np.uint16 if docs[-1] < 1 << 16 else np.uint32)
            where = _partition(keys, partitions)
            used = np.unique(where)
            blobs = [_packed_keys(keys[at], docs[at]) for at in (where == p for p in used)]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, about.schema) as writer:
                writer.write_table(about)
            turn = int(mixed(np.array([first], np.uint64))[0] >> np.uint64(8))
            pids = [*used.tolist(), -1 - turn % partitions]
            salts = [turn % split.get(p, 1) for p in pids]
            return pa.RecordBatch.from_arrays(
                [pa.array(pids, pa.int64()), pa.array(salts, pa.int64()), pa.array([first] * len(pids), pa.int64()), pa.array([*blobs, sink.getvalue().to_pybytes()], pa.binary())],
                ["pid", "salt", "flush", "blob"],
            )

        first, keys, docs, texts, size, count = 0, [], [], [], 0, 0
        for batch in batches:
            for part in slices(batch, "_text"):
                found, row = text_tokens(part.column(part.schema.get_field_index("_text")))
                if not texts:
                    first = part.column(part.schema.get_field_index("_row"))[0].as_py()
                keys.append(found)
                docs.append(row + count)
                texts.append(part)
                size, count = size + len(found), count + part.num_rows
                if size >= PACKED_TOKENS:
                    yield flush(first, keys, docs, texts)
                    keys, docs, texts, size, count = [], [], [], 0, 0
        if texts:
            yield flush(first, keys, docs, texts)

    return rows.mapInArrow(run, "pid long, salt long, flush long, blob binary")


def score(df: DataFrame, training: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, _n_tokens, _n_known, _train_tokens, _base_score, _score) for every row of ``df``."""
    total = df.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0)).alias("n")).first().n
    partitions = max(1, -(-total // PARTITION_BYTES))
    texts = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text"), training.alias("_train"))
    model, counts = fit(texts.where(F.coalesce("_train", F.lit(True))).select("_text"), partitions)

    heavy = max(4 * model.tokens / partitions, model.tokens / SPLIT_MOST)
    mean = max(1.0, model.tokens / partitions)
    split = {r.pid: int(-(-r.tokens // mean)) for r in counts.where(F.col("tokens") >= heavy).select("pid", "tokens").collect()} if model.tokens else {}
    rows = texts.select(key, "_text").withColumn("_row", F.monotonically_increasing_id())
    uses = _uses(rows, partitions, split)
    parts = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in split.items() for x in p)), F.col("pid")), F.lit(1)) if split else F.lit(1)
    copies = counts.select("pid", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long"))).alias("salt"), F.lit(-1).cast("long").alias("flush"), "blob")
    sent = df.sparkSession.sparkContext.broadcast(model)

    def scored(table: pa.Table) -> pa.Table:
        known: Model = sent.value
        pid = table["pid"][0].as_py()
        if pid < 0:
            return table.select(["flush", "blob"]).append_column("about", pa.array([True] * len(table), pa.bool_()))
        flushes, blobs = table["flush"].to_pylist(), table["blob"].to_pylist()
        own = Partition(np.zeros(0, np.uint64), np.zeros(0, np.int64), known.words)
        if -1 in flushes:
            keys, (each,) = _unpacked_keys(blobs[flushes.index(-1)])
            own = Partition(keys, each, known.words)
        seats = []
        for k, sums in own.replay(pid, known):
            if k > BURNT:
                seats.append((*own._children(), *(t.copy() for t in own.tables), sums))
        out_flush, out_blob = [], []
        for flush, blob in zip(flushes, blobs):
            if flush == -1:
                continue
            keys, (docs,) = _unpacked_keys(blob)
            docs = docs.astype(np.int64)
            words, coarse_keys = keys >> np.uint64(16), keys >> np.uint64(FINE_BITS)
            fine, coarse = (keys & np.uint64(0xFFFF)).astype(np.int64), ((keys >> np.uint64(FINE_BITS)) & np.uint64((1 << CONTEXT_BITS) - 1)).astype(np.int64)
            (seen,) = _found(own.words, words, own.word_counts)
            (c2,) = _found(own.keys, keys, own.counts)
            mean_p = np.zeros(len(keys))
            for c0, c1, t0, t1, t2, sums in seats:
                c0, t0 = _found(own.words, words, c0, t0)
                c1, t1 = _found(own.coarse_keys, coarse_keys, c1, t1)
                (t2,) = _found(own.keys, keys, t2)
                _, totals = sums.customers
                p = own.root(sums, c0, t0)
                p = given(1, c1, t1, totals[coarse], sums.coarse[coarse], p)
                mean_p += given(2, c2, t2, known.customers[fine], sums.fine[fine], p)
            logs = np.log10(mean_p / len(seats)) if seats else np.zeros(len(keys))
            base = np.log10((seen + 1) / (known.tokens + known.words + 1))
            n = int(docs.max()) + 1
            sums_of = [np.bincount(docs, x, n) for x in (np.ones(len(docs)), seen > 0, base, logs)]
            hit = np.flatnonzero(sums_of[0])
            out_flush.append(flush)
            out_blob.append(pack(hit.astype(np.uint32), sums_of[0][hit].astype(np.uint32), sums_of[1][hit].astype(np.uint32), sums_of[2][hit], sums_of[3][hit]))
        return pa.table({"flush": pa.array(out_flush, pa.int64()), "blob": pa.array(out_blob, pa.binary()), "about": pa.array([False] * len(out_blob), pa.bool_())})

    back = uses.unionByName(copies).groupBy("pid", "salt").applyInArrow(scored, "flush long, blob binary, about boolean")
    kind = df.schema[key].dataType.simpleString()

    def added(table: pa.Table) -> pa.Table:
        texts_of, sums = None, []
        for blob, about in zip(table["blob"].to_pylist(), table["about"].to_pylist()):
            if about:
                texts_of = pa.ipc.open_stream(blob).read_all()
            else:
                sums.append(unpack(blob))
        # The same order of adding whatever order the parts arrive in.
        sums.sort(key=lambda x: (len(x[0]), x[0].tobytes(), x[3].tobytes()))
        out = np.zeros((4, texts_of.num_rows))
        for at, *each in sums:
            for k, x in enumerate(each):
                out[k, at] += x
        return pa.table(
            {
                key: texts_of[key],
                "_n_tokens": pa.array(out[0].astype(np.int64)),
                "_n_known": pa.array(out[1].astype(np.int64)),
                "_train_tokens": pa.array(np.full(texts_of.num_rows, sent.value.tokens, np.int64)),
                "_base_score": pa.array(out[2]),
                "_score": pa.array(out[3]),
            }
        )

    fields = f"`{key}` {kind}, _n_tokens long, _n_known long, _train_tokens long, _base_score double, _score double"
    return back.groupBy("flush").applyInArrow(added, fields)


def perplexity(scored: DataFrame) -> DataFrame:
    """One row: tokens and the perplexity of the scored texts."""
    return scored.agg(
        F.sum("_n_tokens").alias("tokens"), F.pow(F.lit(10.0), -F.sum("_score") / F.sum("_n_tokens")).alias("perplexity")
    )
