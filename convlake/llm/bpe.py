"""Byte-level BPE by replaying merges over all words of a block at once.

Texts are cut by the vocabulary's pattern, and each distinct match (word) of a block is encoded once. The
words lie end to end as one chain of byte tokens; an inverted index holds, for each token that two
neighbours can merge to, the places of such pairs. Ranks are replayed in ascending order: a rank
takes its places from the index, merges them, and looks up only the pairs of the two touched
neighbours. A merge that makes a pair of lower rank sends the later places of its word back to the
index until that rank has been replayed, so each word gets the merges that an encoder of single words
(least rank first, leftmost among equals) would make.

Blocks are bounded by characters, known words by their bytes; nothing is shuffled. ``ids_of`` and
``bytes_of`` are columns, so they go beside any other columns of a row; ``encoded`` does both in one pass.
"""

from __future__ import annotations

import base64
import functools
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 20  # characters of text whose words are encoded together
KNOWN = 1 << 22  # bytes of encoded words that a task keeps
SHIFT = 32  # of the left token in a pair's key
NONE = 1 << 40  # no token; above every rank
GONE = -2  # a place that has been merged into its left neighbour


class Vocabulary(NamedTuple):
    tokens: list[bytes]  # by id; empty where an id is not used
    ranks: dict[bytes, int]
    pairs: dict[int, int]  # left token and right token -> the token they merge to


@functools.lru_cache(maxsize=2)
def tokens_of(path: str) -> list[bytes]:
    """The tokens of a rank file by id: lines of a token in base64 and its rank, which is its id."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [found.get(rank, b"") for rank in range(max(found, default=-1) + 1)]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The tokens of a rank file, and which pairs merge."""
    tokens = tokens_of(path)
    ranks = {token: rank for rank, token in enumerate(tokens) if token}
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << SHIFT | right] = rank
    return Vocabulary(tokens, ranks, pairs)


def replay(words: list[bytes], known: Vocabulary) -> list[list[int]]:
    """The ids of each word (none empty); a word that is a token itself has that id."""
    return [np.frombuffer(ids, "<u4").tolist() for ids in spelled(words, known)]


def spelled(words: list[bytes], known: Vocabulary) -> list[bytes]:
    """The same as little-endian 32-bit ids, end to end."""
    ranks = known.ranks
    todo = [w for w in words if w not in ranks]
    made = iter(_merged(todo, known) if todo else ())
    return [ranks[w].to_bytes(4, "little") if w in ranks else next(made) for w in words]


def _merged(words: list[bytes], known: Vocabulary) -> list[bytes]:
    # bytes of all words, each word followed by an end that merges with nothing
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    chars = np.full(ends[-1] + 1, -1, np.int64)
    inside = np.ones(len(chars), bool)
    inside[ends] = False
    chars[inside] = np.frombuffer(b"".join(words), np.uint8)
    of_byte = [known.ranks[bytes([c])] for c in range(256)] + [-1]
    # of the bytes that occur, -1 (the last) being an end
    seen = np.unique(chars).tolist()
    byte_pairs = np.full((257, 257), NONE, np.int64)
    for a in seen[1:]:
        byte_pairs[a, seen[1:]] = [known.pairs.get(of_byte[a] << SHIFT | of_byte[b], NONE) for b in seen[1:]]
    of_byte = np.array(of_byte, np.int64)
    first = np.append(byte_pairs[chars[:-1], chars[1:]], NONE)

    # the inverted index: the token that neighbours merge to -> places of the left one
    found = np.flatnonzero(first != NONE)
    found = found[np.argsort(first[found], kind="stable")]
    waiting, cuts = np.unique(first[found], return_index=True)
    index = dict(zip(waiting.tolist(), [at.tolist() for at in np.split(found, cuts[1:])]))
    waiting = waiting.tolist()  # ascending, so a heap
    gives, token = first.tolist(), of_byte[chars].tolist()
    after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
    of_pair, ends = known.pairs.get, ends.tolist()
    while waiting:
        rank = heappop(waiting)
        until = -1  # the end of a word in which a lower rank has to be replayed first
        for place in sorted(index.pop(rank)):
            if gives[place] != rank:
                continue
            if place < until:
                if rank in index:
                    index[rank].append(place)
                else:
                    index[rank] = [place]
                    heappush(waiting, rank)
                continue
            right, left = after[place], before[place]
            beyond = after[right]
            token[place], token[right], gives[right] = rank, GONE, NONE
            after[place], before[beyond] = beyond, place
            # only the pairs with the two neighbours change
            for at, new in ((place, of_pair(rank << SHIFT | token[beyond], NONE)), (left, of_pair(token[left] << SHIFT | rank, NONE))):
                gives[at] = new
                if new != NONE:
                    if new in index:
                        index[new].append(at)
                    else:
                        index[new] = [at]
                        heappush(waiting, new)
                    if new < rank:
                        until = ends[bisect_right(ends, place)]
    left_over = np.array(token, np.int64)
    stays = left_over >= 0
    data = left_over[stays].astype("<u4").tobytes()
    to = 4 * np.cumsum(stays)[ends]
    return [data[a:b] for a, b in zip([0, *to[:-1].tolist()], to.tolist())]


class Encoder:
    """Encodes texts to little-endian 32-bit ids, and keeps the words it knows, also for the next task of its process."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.pattern = vocabulary(path), regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def words(self, text: str) -> list[str]:
        if len(text) <= BLOCK:
            return self.pattern.findall(text)
        same: dict[str, str] = {}  # a word of a very long text is held once
        return [same.setdefault(w, w) for w in map(itemgetter(0), self.pattern.finditer(text))]

    def block(self, texts: list[str]) -> Iterator[bytes]:
        cut = [self.words(text) for text in texts]
        if self.held > KNOWN:
            self.known, self.held = {}, 0
        new = list(dict.fromkeys(w for w in chain.from_iterable(cut) if w not in self.known))
        bare = [w.encode() for w in new]
        self.known.update(zip(new, spelled(bare, self.vocabulary)))
        self.held += sum(map(len, bare))
        for words in cut:
            yield b"".join(map(self.known.__getitem__, words))

    def texts(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= BLOCK:
                yield from self.block(held)
                held, size = [], 0
        yield from self.block(held)


@functools.lru_cache(maxsize=1)
def encoder_of(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _decoded(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def ids_of(text: Column, path: str, pattern: str) -> Column:
    """The ids of each text (little-endian 32-bit, end to end) by the rank file; a null text is empty.

    ``pattern`` cuts the text; its matches are encoded separately, what it does not match has no ids.
    """

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(path, pattern)
        for batch in batches:
            yield pd.Series(list(encoder.texts(batch)), dtype=object)

    return ids(text)


def bytes_of(ids: Column, path: str) -> Column:
    """The bytes that such ids stand for; null for null. An id beyond the vocabulary is an error."""

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = tokens_of(path)
        for batch in batches:
            yield pd.Series([None if one is None else _decoded(one, tokens) for one in batch], dtype=object)

    return decoded(ids)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text: its id, ids (as ``ids_of``) and decoded, the bytes that these ids stand for.

    One pass of one process a core, a block of texts at a time. Null texts are empty; null and repeated ids are
    rows like others. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = encoder_of(path, pattern), tokens_of(path)
        for batch in batches:
            first, texts, size = 0, [], 0
            for k, text in enumerate(batch.column(1), 1):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= BLOCK or k == batch.num_rows:
                    ids = list(encoder.block(texts))
                    back = [_decoded(one, tokens) for one in ids]
                    columns = [batch.column(0).slice(first, k - first), pa.array(ids, pa.binary()), pa.array(back, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"])
                    first, texts, size = k, [], 0

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids binary, decoded binary").withColumnRenamed("id", id_col)
