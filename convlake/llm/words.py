"""Words of UTF-8 texts as numpy arrays: their places, and 64-bit hashes of words and word runs."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

BLOCK = 1 << 20  # bytes hashed at a time; longer words go through XXH64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64's finalizer)."""
    h = h + np.uint64(salt * BASE & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.cache
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to BLOCK."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(BLOCK + 1, b, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the words."""
    inside = np.concatenate([[False], ~_SPACE[np.frombuffer(data, np.uint8)], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's bytes: a polynomial modulo 2^64, scrambled with the length."""
    up, down = _powers(BASE)
    values = np.frombuffer(data, np.uint8)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = int(np.searchsorted(ends, base + BLOCK, "right"))
        if to <= at:
            out[at] = xxhash.xxh64_intdigest(data[base : ends[at]])
            at += 1
            continue
        part = values[base : ends[to - 1]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def runs(word: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """Hash of each run of n consecutive words, by the same polynomial over the words' hashes."""
    count = len(word) - n + 1
    if count <= 0:
        return word[:0]
    up, down = _powers(base)
    out = np.empty(count, np.uint64)
    step = BLOCK - n
    for at in range(0, count, step):
        part = word[at : at + step + n - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)])])
        got = len(part) - n + 1
        out[at : at + got] = mix((sums[n : n + got] - sums[:got]) * down[:got])
    return out


@dataclass
class Batch:
    """Words of some texts, end to end: text k is row rows[k], its words are cuts[k] to cuts[k + 1]."""

    rows: np.ndarray
    cuts: np.ndarray
    word: np.ndarray

    def text_of(self) -> np.ndarray:
        """For each word its text (k)."""
        return np.repeat(np.arange(len(self.rows)), np.diff(self.cuts))

    def whole(self, n: int) -> np.ndarray:
        """Which runs of n words, by their first, lie in one text."""
        of = self.text_of()
        return of[: len(of) - n + 1] == of[n - 1 :] if len(of) >= n else np.zeros(0, bool)


def batches(texts: Iterable[bytes | None]) -> Iterator[Batch]:
    """The words of all texts, some BLOCK bytes at a time; a text is never cut."""
    rows, parts, held = [], [], 0
    for row, data in enumerate(texts):
        if data:
            rows.append(row)
            parts.append(data)
            held += len(data) + 1
        if held >= BLOCK:
            yield _batch(rows, parts)
            rows, parts, held = [], [], 0
    if rows:
        yield _batch(rows, parts)


def _batch(rows: list[int], parts: list[bytes]) -> Batch:
    data = b"\n".join(parts)
    starts, ends = places(data)
    ahead = np.cumsum([0, *(len(x) + 1 for x in parts)])
    return Batch(np.array(rows), np.searchsorted(starts, ahead), hashes(data, starts, ends))
