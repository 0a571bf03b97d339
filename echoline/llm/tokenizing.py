"""Encoding of a corpus with a public byte-level BPE tokenizer by merge replay.

Texts are cut into words (pre-tokens); the distinct words of a task's rows form its corpus. Over them an
inverted index from token pair to positions is kept, and every merge that occurs is applied in rank
order, at all its positions at once; only the neighbours of a merged pair enter the index anew. As the
result of a merge has a higher rank than its parts, one ascending pass is enough. Words are encoded once
and looked up afterwards, so no row is shuffled and the cost follows the distinct words.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.session import spread

#: The word pattern of the byte-level tokenizers (fixed value), and what it means for ASCII text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_WORDS = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Encoded words kept by a worker; beyond that it starts anew, which changes no result.
KEPT_WORDS = 1_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself where it can be seen, else the next free code point from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTable:
    """Byte ids and ranked merges of a tokenizer file, small enough for a broadcast (one entry a merge)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            text = f.read()
        self.digest = xxhash.xxh3_128_hexdigest(text)
        model = json.loads(text)["model"]
        vocab, letters = model["vocab"], byte_letters()
        self.byte_ids = [0] * 256
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: pair of ids, packed -> (rank, id of the result)
        self.merges = {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}


def replay(words: list[bytes], table: MergeTable) -> list[list[int]]:
    """The token ids of each word, all words at once."""
    flat = b"".join(words)
    if not flat:
        return [[] for _ in words]
    ids = np.array(table.byte_ids, np.int64)[np.frombuffer(flat, np.uint8)]
    ends = np.cumsum([len(w) for w in words])
    n = len(ids)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    filled = ends[ends > 0]
    after[filled - 1] = -1
    before[filled[filled < n]] = -1
    pairs = ids[:-1] << 32 | ids[1:]
    at = np.flatnonzero(after[:-1] >= 0)
    at = at[np.argsort(pairs[at], kind="stable")]
    merges = table.merges
    index: dict[int, list[int]] = {}
    if len(at):
        cuts = np.flatnonzero(np.diff(pairs[at])) + 1
        for group in np.split(at, cuts):
            if (pair := int(pairs[group[0]])) in merges:
                index[pair] = group.tolist()
    sym, nxt, prv = ids.tolist(), after.tolist(), before.tolist()
    heap = [(merges[p][0], p) for p in index]
    heapq.heapify(heap)

    def touch(left: int, right: int, place: int) -> None:
        pair = left << 32 | right
        if (found := index.get(pair)) is not None:
            found.append(place)
        elif pair in merges:
            index[pair] = [place]
            heapq.heappush(heap, (merges[pair][0], pair))

    while heap:
        _, pair = heapq.heappop(heap)
        a, b, new = pair >> 32, pair & 0xFFFFFFFF, merges[pair][1]
        for p in sorted(index.pop(pair)):
            q = nxt[p]
            if sym[p] != a or q < 0 or sym[q] != b:
                continue
            sym[p], sym[q], r = new, -1, nxt[q]
            nxt[p] = r
            if r >= 0:
                prv[r] = p
                touch(new, sym[r], p)
            if (left := prv[p]) >= 0:
                touch(sym[left], new, left)
    result, start = [], 0
    for end in ends.tolist():
        result.append([x for x in sym[start:end] if x >= 0])
        start = end
    return result


class Encoder:
    """Words of texts and their ids; one per worker process and tokenizer."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.known: dict[str, tuple[int, ...]] = {}
        self.words = regex.compile(WORDS).findall
        self.ascii_words = re.compile(ASCII_WORDS, re.ASCII).findall

    def split(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, all of them encoded."""
        cut = [[] if not t else self.ascii_words(t) if t.isascii() else self.words(t) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        new = list(set().union(*cut) - self.known.keys())
        self.known.update(zip(new, map(tuple, replay([w.encode("utf-8") for w in new], self.table)), strict=True))
        return cut


#: By digest of the table, so that another file at the same path is another tokenizer.
_ENCODERS: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    table = shared.value
    if table.digest not in _ENCODERS:
        _ENCODERS.clear()  # a worker keeps the words of one tokenizer
        _ENCODERS[table.digest] = Encoder(table)
    return _ENCODERS[table.digest]


def _slices(texts: list[str | None], most: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` characters, so that long texts don't add up in memory."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _over_texts(texts: DataFrame, path: str, schema: str, column: Callable[[Encoder, list[list[str]]], pa.Array]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(MergeTable(path))
    name = schema.split()[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            rows = batch.column("text").to_pylist()
            for a, b in _slices(rows):
                words = encoder.split(rows[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), column(encoder, words)], names=["id", name])

    return texts.mapInArrow(run, schema)


def _ids(encoder: Encoder, words: list[list[str]]) -> pa.Array:
    get = encoder.known.__getitem__
    per = [list(chain.from_iterable(map(get, w))) for w in words]
    ends = np.zeros(len(per) + 1, np.int32)
    np.cumsum([len(x) for x in per], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(per), np.int32, int(ends[-1]))))


def _counts(encoder: Encoder, words: list[list[str]]) -> pa.Array:
    get = encoder.known.__getitem__
    return pa.array([sum(map(len, map(get, w))) for w in words], pa.int64())


def _texts(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return spread(documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")))


def encode(documents: DataFrame, id_column: str, text_column: str, path: str) -> DataFrame:
    """id and ids of every row, without special tokens: their strings are ordinary text.

    Null and empty texts have an empty list. Repeated rows and ids give a row each.
    """
    return _over_texts(_texts(documents, id_column, text_column), path, "id bigint, ids array<int>", _ids)


def token_counts(documents: DataFrame, id_column: str, text_column: str, path: str) -> DataFrame:
    """id and tokens of every row: the length of encode's list, without building it."""
    return _over_texts(_texts(documents, id_column, text_column), path, "id bigint, tokens bigint", _counts)
