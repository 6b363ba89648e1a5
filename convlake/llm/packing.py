"""Bounded-space online packing of tokenised documents into sequences of a fixed width.

Every partition reads its documents once and keeps a fixed number of open windows. Whole widths of a
document go out at once; what is left of it goes into the fullest window that still has room for it.
When none has, and all windows are open, the fullest is emitted: it is filled with the first part of
the piece if its gap is worth a cut (``least_cut`` ids), and padded otherwise. The windows left open
are packed again in rounds by ever fewer tasks, FAN partitions to one, until one task closes the
last few: as full sequences, and a rest in sequences whose lengths are powers of two, which need no
padding.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.llm.common import staged

FAN = 32
#: Columns behind the id; open windows have a task and a window instead of a sequence.
OUT = [
    pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("ids", pa.binary()), pa.field("doc_tokens", pa.int64()),
    pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64()), pa.field("task", pa.int32()), pa.field("window", pa.int32()),
]
DDL = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, task int, window int"
OUT_ROWS = 2048  # rows of an output batch
#: Fixed values of the 50k vocabulary.
END_OF_TEXT = ("<|endoftext|>", 50256)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


SPACE = re.compile(r"\s+")
LONG_SPACE = 100_000  # characters of white space in a row that are not given to tiktoken


def _long_space(text: str) -> bool:
    return len(text) >= LONG_SPACE and any(m.end() - m.start() >= LONG_SPACE for m in SPACE.finditer(text))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text -> ids (uint32) for a vocabulary file: .json for tokenizers, .tiktoken (ranks) for tiktoken.

    tiktoken's pattern runs out of stack on very long white space; such texts, and any that it raises on,
    are encoded by the tokenizers file of the same name beside the ranks.
    """
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=dict([END_OF_TEXT]))
    beside = os.path.splitext(path)[0] + ".json"

    def encode(text: str) -> np.ndarray:
        if not _long_space(text):
            try:
                return ranked.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                if not os.path.exists(beside):
                    raise
        return encoder(beside)(text)

    return encode


class Windows:
    """The open windows of one task. A piece is (key, start, ids, doc_tokens)."""

    def __init__(self, width: int, most: int, least_cut: int):
        self.width, self.most, self.least_cut = width, most, least_cut
        self.fills: list[tuple[int, int]] = []  # (fill, window), ascending
        self.held: dict[int, list] = {}
        self.opened = 0

    def add(self, key, start: int, ids: np.ndarray, total: int) -> Iterator[list]:
        """Places a piece; yields the windows that go out, as lists of pieces."""
        while len(ids) >= self.width:
            yield [(key, start, ids[: self.width], total)]
            start, ids = start + self.width, ids[self.width :]
        while len(ids):
            # the fullest window with room; among equally full ones the newest
            at = bisect_right(self.fills, (self.width - len(ids), self.opened)) - 1
            if at < 0 and len(self.fills) < self.most:
                self.held[self.opened] = []
                self.fills.insert(0, (0, self.opened))
                self.opened, at = self.opened + 1, 0
            take = len(ids)
            if at < 0:
                fill, window = self.fills.pop()
                take = self.width - fill if self.width - fill >= self.least_cut else 0
            else:
                fill, window = self.fills.pop(at)
            if take:
                self.held[window].append((key, start, ids[:take], total))
            if at < 0 or fill + take == self.width:
                yield self.held.pop(window)
            else:
                insort(self.fills, (fill + take, window))
            start, ids = start + take, ids[take:]

    def rest(self) -> list[list]:
        return [self.held[window] for _, window in reversed(self.fills)]


def close(windows: list[list], width: int) -> Iterator[list]:
    """The last windows as full sequences and a rest whose lengths are powers of two."""
    pieces = [piece for window in windows for piece in window]
    left = sum(len(ids) for _, _, ids, _ in pieces)
    room, out = 0, []
    for key, start, ids, total in pieces:
        while len(ids):
            if not room:
                room = width if left >= width else 1 << left.bit_length() - 1
            take = min(room, len(ids))
            out.append((key, start, ids[:take], total))
            start, ids, room, left = start + take, ids[take:], room - take, left - take
            if not room:
                yield out
                out = []


class Rows:
    """Output columns: a row per piece; open windows carry no sequence but their task and place."""

    def __init__(self, first: int, task: int):
        self.next, self.task, self.window = first, task, 0
        self.clear()

    def clear(self) -> None:
        self.columns: list[list] = [[] for _ in range(9)]

    def take(self, schema: pa.Schema) -> pa.Table:
        """The rows so far, which then start anew."""
        out = pa.Table.from_arrays([pa.array(column, kind) for column, kind in zip(self.columns, schema.types)], schema=schema)
        self.clear()
        return out

    def put(self, pieces: list, is_open: bool) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            row = (key, start, len(ids), np.ascontiguousarray(ids, "<u4").tobytes(), total, None if is_open else self.next, offset, self.task, self.window)
            for column, value in zip(self.columns, row):
                column.append(value)
            offset += len(ids)
        if is_open:
            self.window += 1
        else:
            self.next += 1


def _first(turn: int, task: int) -> int:
    """First sequence number of a task: 2^6 rounds, 2^25 tasks, 2^32 sequences."""
    return turn << 57 | task << 32


def pack(docs: DataFrame, vocabulary: str, width: int = 2048, windows: int = 32, least_cut: int = 64, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are those of the vocabulary file and then ``end_id``; a null text is empty, so
    it has that id alone. Each id lies in one piece; the pieces of a sequence are gapless from offset
    0. Repeated rows and ids are packed like any others, and nothing else than id and text is read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, {DDL}"

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(vocabulary), TaskContext.get().partitionId()
        open_windows, rows = Windows(width, windows, least_cut), Rows(_first(0, task), task)
        schema = None
        for got in batches:
            schema = schema or pa.schema([pa.field("id", got.schema.types[0]), *OUT])
            for key, text in zip(got.column(0), got.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                for pieces in open_windows.add(key.as_py(), 0, ids, len(ids)):
                    rows.put(pieces, False)
                if len(rows.columns[0]) >= OUT_ROWS:
                    yield from rows.take(schema).to_batches()
        for pieces in open_windows.rest():
            rows.put(pieces, True)
        if schema:
            yield from rows.take(schema).to_batches()

    def merge(turn: int, last: bool):
        def again(key, held):
            held = held.sort_by([("task", "ascending"), ("window", "ascending"), ("offset", "ascending")])
            to = key[0].as_py()
            open_windows, rows = Windows(width, windows, least_cut), Rows(_first(turn, to), to)
            for name, start, ids, total in zip(*(held[c].to_pylist() for c in ("id", "start", "ids", "doc_tokens"))):
                for pieces in open_windows.add(name, start, np.frombuffer(ids, "<u4"), total):
                    rows.put(pieces, False)
            for pieces in close(open_windows.rest(), width) if last else open_windows.rest():
                rows.put(pieces, not last)
            return rows.take(held.schema)

        return again

    packed = staged(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(first_round, schema), "packed")
    parts, turn = [packed], 0
    tasks = packed.agg(F.max("task")).first()[0]
    while tasks is not None:
        turn += 1
        last = tasks < FAN
        left = parts[-1].where(F.col("sequence_id").isNull())
        parts.append(staged(left.groupBy(F.floor(F.col("task") / FAN).cast("int").alias("to")).applyInArrow(merge(turn, last), schema), "packed"))
        tasks = None if last else tasks // FAN
    every = functools.reduce(DataFrame.union, parts).where(F.col("sequence_id").isNotNull())
    return every.select(F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
