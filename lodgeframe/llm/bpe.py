"""Byte-level BPE with the tokenizers library over Arrow batches.

A rank file (token bytes in base64 and rank, one per line) gives the vocabulary. The library works
on characters, so each byte stands for a printable character by a fixed rule; the merges
are every split of a token into two known tokens, in rank order, which is what the ranks mean.
A text is split by the pattern and every piece is encoded by itself, without special tokens.

``encode`` gives ids and the character offsets of every token; ``decode`` maps ids back to bytes, to text and to
the text of each token, where a character split over several tokens goes to the token that completes it.

Cases: a null text is encoded as the empty one: no ids. Null ids decode to nothing; an unknown id raises
ValueError; bytes that are no UTF-8 decode to U+FFFD in the text and unchanged in the bytes. Texts of any length
are encoded whole. Empty tables give empty results; repeated rows and further columns are kept as they are.
"""

from __future__ import annotations

import base64
import codecs
import os
from array import array
from functools import lru_cache, wraps
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodgeframe.llm.textarrays import map_slices, releasing, slices

#: Words that a task remembers; beyond that it forgets the older half.
REMEMBERED = 250_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable and no space, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, other = [], 0x100
    for byte in range(256):
        out.append(chr(byte) if byte in plain else chr(other))
        other += byte not in plain
    return out


@lru_cache(maxsize=1)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file) if token}


@lru_cache(maxsize=1)
def load_tokenizer(path: str, pattern: str):
    """The library's tokenizer for a rank file; one per worker process. Without a pattern it takes texts as one piece."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, characters = read_ranks(path), byte_characters()
    shown = lambda token: "".join(characters[b] for b in token)
    vocabulary = {shown(token): rank for token, rank in ranks.items()}
    merges = [
        (shown(token[:k]), shown(token[k:]))
        for token, _ in sorted(ranks.items(), key=lambda x: x[1])
        for k in range(1, len(token))
        if token[:k] in ranks and token[k:] in ranks
    ]
    tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
    steps = [pre_tokenizers.Split(Regex(pattern), behavior="isolated")] * bool(pattern)
    steps.append(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(steps)
    return tokenizer


@lru_cache(maxsize=1)
def _byte_table(path: str) -> list[bytes | None]:
    ranks = read_ranks(path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def encode_texts(texts: list[str | None], path: str, pattern: str) -> list:
    """The library's Encoding, with ids and character offsets, for each text."""
    return load_tokenizer(path, pattern).encode_batch([text or "" for text in texts], add_special_tokens=False)


class PieceEncoder:
    """Ids only: every distinct word goes through the library once while it is remembered. Ids are packed, 32 bits each.

    The pattern has a boundary before each single space and on both sides of each single line feed that stands
    between other characters, so where a text has no other white space (no runs, tabs, NBSP, ...), its words are encoded by
    themselves: each with the space or line feed before it. Any other text goes through the library as a whole.
    """

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        self.library = load_tokenizer(path, pattern)
        self.remembered = remembered
        self.feed = 4 * len(self.library.encode("\n", add_special_tokens=False).ids)
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > self.remembered:
            self.known = dict(islice(self.known.items(), len(self.known) // 2, None))
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        found = self.library.encode_batch_fast([w if w[:1] == "\n" else " " + w for w in new], add_special_tokens=False)
        for word, encoding in zip(new, found):
            self.known[word] = array("i", encoding.ids).tobytes()

    def packed(self, text: str | None) -> bytes:
        text = text or ""
        if text.split() != text.replace("\n", " ").split(" "):  # runs, white space at an end, or any other kind of it
            return array("i", self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()
        words = text.replace("\n", " \n").split(" ")
        words[0] = "\n" + words[0]
        try:
            out = b"".join(map(self.known.__getitem__, words))
        except KeyError:
            self._learn(words)
            out = b"".join(map(self.known.__getitem__, words))
        return out[self.feed :]

    def ids(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()


def _forgotten(run):
    """``run`` over batches; when it ends, the worker forgets the vocabulary and gives its memory back."""

    @releasing
    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            for cached in (load_tokenizer, read_ranks, _byte_table):
                cached.cache_clear()

    return whole


def decode_ids(ids: list[int], path: str) -> bytes:
    """The bytes that the tokens stand for."""
    table = _byte_table(path)
    try:
        return b"".join(map(table.__getitem__, ids))
    except (IndexError, TypeError) as error:
        raise ValueError("an id is not in the vocabulary") from error


def token_texts(ids: list[int], path: str) -> list[str]:
    """The text of each token; a character split over tokens belongs to the one that completes it."""
    table, decoder = _byte_table(path), codecs.getincrementaldecoder("utf-8")("replace")
    out = [decoder.decode(table[i]) for i in ids]
    if out and (rest := decoder.decode(b"", True)):
        out[-1] += rest
    return out


def _fields(df: DataFrame, *added: str) -> str:
    if clash := {a.split()[0] for a in added} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are used by this operator")
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *added])


def _appended(batch: pa.RecordBatch, *columns: pa.Array) -> pa.RecordBatch:
    names = [*batch.schema.names, *(f"_{k}" for k in range(len(columns)))]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names)


def _named(batch: pa.RecordBatch, schema_names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(batch.columns, schema_names)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with _ids array<int>, _starts and _ends array<int>: character offsets of each token."""
    schema = _fields(df, "_ids array<int>", "_starts array<int>", "_ends array<int>")
    names = [*df.columns, "_ids", "_starts", "_ends"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = encode_texts(batch.column(batch.schema.get_field_index(text)).to_pylist(), path, pattern)
        lists = pa.list_(pa.int32())
        spans = [e.offsets for e in found]
        return _named(
            _appended(
                batch,
                pa.array([e.ids for e in found], lists),
                pa.array([[a for a, _ in s] for s in spans], lists),
                pa.array([[b for _, b in s] for s in spans], lists),
            ),
            names,
        )

    return map_slices(df, text, run, schema)


def encode_ids(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with _ids array<int> only: without offsets equal words need the library once, which is quicker."""
    schema, names = _fields(df, "_ids array<int>"), [*df.columns, "_ids"]

    @_forgotten
    def run(batches):
        encoder = PieceEncoder(path, pattern)
        for batch in batches:
            for part in slices(batch, text):
                found = [encoder.packed(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                ends = pa.array(np.cumsum([0, *(len(x) // 4 for x in found)]), pa.int32())
                ids = pa.array(np.frombuffer(b"".join(found), np.int32))
                yield _named(_appended(part, pa.ListArray.from_arrays(ends, ids)), names)

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` without its text, with _n_tokens, and SHA-256 of the ids (_ids_sha256) and of what they decode to.

    As ``encode_ids`` and ``decode``, in one pass, so that the ids need not leave the task.
    """
    rest = df.drop(text)
    schema = _fields(rest, "_n_tokens long", "_ids_sha256 string", "_decoded_sha256 string")
    names = [*rest.columns, "_n_tokens", "_ids_sha256", "_decoded_sha256"]

    @_forgotten
    def run(batches):
        encoder, decimal = PieceEncoder(path, pattern), [str(i) for i in range(len(_byte_table(path)))]
        for batch in batches:
            for part in slices(batch, text):
                at = part.schema.get_field_index(text)
                counts, ids_sha, decoded_sha = [], [], []
                for value in part.column(at).to_pylist():
                    ids = encoder.ids(value)
                    counts.append(len(ids))
                    ids_sha.append(sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    decoded_sha.append(sha256(decode_ids(ids, path)).hexdigest())
                columns = [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
                kept = [c for k, c in enumerate(part.columns) if k != at]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "_ids", pieces: bool = False) -> DataFrame:
    """``df`` with _bytes binary and _text string; with ``pieces`` also _pieces array<string>, one for each token."""
    added = ["_bytes binary", "_text string", *["_pieces array<string>"] * pieces]
    schema, names = _fields(df, *added), [*df.columns, *(a.split()[0] for a in added)]

    @_forgotten
    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            whole = [decode_ids(x or [], path) for x in lists.to_pylist()]
            columns = [pa.array(whole, pa.binary()), pa.array([b.decode("utf-8", "replace") for b in whole], pa.string())]
            if pieces:
                columns.append(
                    pa.array([token_texts(x or [], path) for x in lists.to_pylist()], pa.list_(pa.string()))
                )
            yield _named(_appended(batch, *columns), names)

    return df.mapInArrow(run, schema)
