"""Substring dedup by relative Lempel-Ziv parsing of documents against each other's text.

A window is ``window`` consecutive words; it is repeated if the same words start anywhere else. Of
every window the run of ceil(window / 2) words with the least hash is an anchor, so equal windows have the same
anchor at the same place, and neighbouring anchors of a document touch. The reference of an anchor
that occurs more than once is its first occurrence (least document, then position); the text around
the first occurrences is what documents are factored against.

A document's anchors with one reference document at one distance, without a gap, form a factor: the
document and the reference agree on all its words. The windows inside factors are repeated, on both
sides. A window with a repeated anchor that no factor holds lies at a factor's boundary: it is
checked by its 128-bit hash together with the reference's window at the same place and all other
such windows. A repeated window is thus either inside a factor or equal to a checked one.

The parse is not greedy: a match is not extended against the reference's text, and a factor ends where the
first occurrence of the anchors changes document. What factors miss is left to the window hashes, so
the removed windows are the same, while only hashes and places are shuffled for the anchors.

Counts are pre-aggregated, and rows meet by joins on hashes, so a passage that a third of all
documents share is split over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.llm import words
from convlake.llm.common import staged

SECOND = 0xD6E8FEB86659FD93  # base of the second hash of a window (odd)


def _least_at(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of the least, the first if equal."""
    at, have = np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at, have = np.where(h[b] < h[a], b, a), have + step
    return at


def anchors(batch: words.Batch, window: int) -> tuple[np.ndarray, ...]:
    """Row, hash and place of the anchors of the batch's texts, and the first and last window of each."""
    run = (window + 1) // 2
    whole = np.flatnonzero(batch.whole(window))
    if not len(whole):
        return (np.zeros(0, np.int64),) * 5
    h = words.runs(batch.word, run)
    at, of = _least_at(h, window - run + 1)[whole], batch.text_of()[whole]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    ahead = batch.cuts[of[first]]
    return batch.rows[of[first]], h[at[first]], at[first] - ahead, whole[first] - ahead, whole[last] - ahead


def _inside(n: int, ranges: np.ndarray) -> np.ndarray:
    """Which of 0..n-1 lie in the ranges."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.clip(ranges[:, 0], 0, n), 1)
    np.add.at(steps, np.clip(ranges[:, 1], 0, n), -1)
    return np.cumsum(steps[:-1]) > 0


def _ranges_of(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


MESSAGE = "k1 long, k2 int, kind int, start long, end long"


def parse(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """Factors of documents, from all their repeated anchors sorted by document and place.

    Returns messages (k1, k2, kind, start, end) on windows; kind 1: repeated, 0: to be checked. Half of
    them go to the reference's document.
    """
    run = (window + 1) // 2
    k1, k2, r1, r2 = (rows[c].to_numpy() for c in ("k1", "k2", "r1", "r2"))
    at, first, last, ref_at = (rows[c].to_numpy().astype(np.int64) for c in ("at", "first", "last", "rat"))
    same = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
    new = np.concatenate([[True], ~same])
    doc = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    parts = []

    # rows equal in id and text share their keys, so each place occurs twice: all of them is repeated.
    # They are parsed once, for what they share with others
    once = np.concatenate([[True], ~same | (at[1:] != at[:-1])])
    copied = np.zeros(len(head), bool)
    copied[doc[~once]] = True
    if copied.any():
        ends = np.maximum.reduceat(last, head) + 1
        parts.append((k1[head][copied], k2[head][copied], 1, np.minimum.reduceat(first, head)[copied], ends[copied]))

    shift = ref_at - at
    other = once & ((r1 != k1) | (r2 != k2) | (shift != 0))
    k1, k2, r1, r2, at, first, last, shift, doc = (x[other] for x in (k1, k2, r1, r2, at, first, last, shift, doc))
    if len(at):
        # factors: anchors that touch, with one reference and one distance
        breaks = lambda gap: (doc[1:] != doc[:-1]) | (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1]) | (shift[1:] != shift[:-1]) | gap
        cut = np.flatnonzero(np.concatenate([[True], breaks(at[1:] - at[:-1] > run)]))
        start, end = at[cut], at[np.concatenate([cut[1:], [len(at)]]) - 1] + run - window + 1
        cut, start, end = (x[end > start] for x in (cut, start, end))
        parts += [(k1[cut], k2[cut], 1, start, end), (r1[cut], r2[cut], 1, start + shift[cut], end + shift[cut])]
        # the anchors' windows that no factor holds, in one row of windows for all documents
        base = np.zeros(doc[-1] + 2, np.int64)
        np.maximum.at(base, doc + 1, last + 1)
        np.maximum.at(base, doc[cut] + 1, end)
        base = np.cumsum(base)
        held = _inside(int(base[-1]), np.stack([base[doc[cut]] + start, base[doc[cut]] + end], axis=1))
        sizes = last - first + 1
        owner = np.repeat(np.arange(len(at)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner]
        free = ~held[base[doc[owner]] + place]
        owner, place = owner[free], place[free]
        if len(owner):
            a, b = owner[:-1], owner[1:]
            apart = (doc[a] != doc[b]) | (r1[a] != r1[b]) | (r2[a] != r2[b]) | (shift[a] != shift[b]) | (place[1:] != place[:-1] + 1)
            cut = np.flatnonzero(np.concatenate([[True], apart]))
            start, end = place[cut], place[np.concatenate([cut[1:], [len(place)]]) - 1] + 1
            cut = owner[cut]
            parts += [(k1[cut], k2[cut], 0, start, end), (r1[cut], r2[cut], 0, start + shift[cut], end + shift[cut])]
    names = [x.split()[0] for x in MESSAGE.split(", ")]
    return pd.concat([pd.DataFrame(dict(zip(names, p))) for p in parts]) if parts else pd.DataFrame({n: [] for n in names})


def _whole_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of sorted batches, cut between documents only."""
    held: list[pd.DataFrame] = []  # of the last document
    for batch in batches:
        if not len(batch):
            continue
        k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
        before = np.flatnonzero((k1 != k1[-1]) | (k2 != k2[-1]))
        start = int(before[-1]) + 1 if len(before) else 0
        if start:
            yield pd.concat([*held, batch.iloc[:start]])
            held = []
        elif held and (held[0]["k1"].iat[0], held[0]["k2"].iat[0]) != (k1[-1], k2[-1]):
            yield pd.concat(held)
            held = []
        held.append(batch.iloc[start:])
    if held:
        yield pd.concat(held)


def _keys(id_col: str, text_col: str) -> list[Column]:
    """Two hashes of id and text: documents are told apart by 96 bits; rows equal in both share them."""
    of, text = F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(F.lit(1), of, text).alias("k1"), F.hash(F.lit(2), text, of).alias("k2")]


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed and kept, the words outside repeated windows joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``; texts with fewer than ``window`` words (null: none) keep all.
    All occurrences of a repeated window go, the first included. Rows equal in id and text repeat each
    other. Other columns are not read.
    """
    keyed = docs.select(*_keys(id_col, text_col), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
            for texts in words.batches(batch["text"]):
                row, h, at, first, last = anchors(texts, window)
                yield pd.DataFrame({"h": h.view(np.int64), "k1": k1[row], "k2": k2[row], "at": at.astype(np.int32), "first": first.astype(np.int32), "last": last.astype(np.int32)})

    found = keyed.select("k1", "k2", "text").mapInPandas(anchor_rows, "h long, k1 long, k2 int, at int, first int, last int")
    seen = found.groupBy("h").agg(F.min(F.struct("k1", "k2", "at")).alias("ref"), F.count("*").alias("n")).where("n > 1")
    # stored, as below: so the join deals both sides anew, and the rows of a frequent anchor can be split
    seen = staged(seen.select("h", F.col("ref.k1").alias("r1"), F.col("ref.k2").alias("r2"), F.col("ref.at").alias("rat")), "seen")


    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_documents(batches):
            if len(rows):
                yield parse(rows, window)

    told = found.join(seen, "h").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "at").mapInPandas(parsed, MESSAGE)
    told = staged(told.distinct(), "factors")
    ranges = lambda kind: told.where(F.col("kind") == kind).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))

    def check_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
            asked = [np.array([(r["start"], r["end"]) for r in found]) for found in batch["ranges"]]
            for texts in words.batches(batch["text"]):
                # a reference may end before the window that it is asked for
                most = np.maximum(np.diff(texts.cuts) - window + 1, 0)
                ranges = np.concatenate([np.clip(asked[row], 0, n) + ahead for row, n, ahead in zip(texts.rows, most, texts.cuts)])
                pick = np.flatnonzero(_inside(len(texts.word), ranges))
                a, b = words.runs(texts.word, window)[pick], words.runs(words.mix(texts.word, 1), window, SECOND)[pick]
                of = texts.text_of()[pick]
                row = texts.rows[of]
                yield pd.DataFrame({"h1": a.view(np.int64), "h2": b.view(np.int64), "k1": k1[row], "k2": k2[row], "start": pick - texts.cuts[of]})

    # both joins below deal the texts by the same keys, so one exchange serves them
    checked = keyed.join(ranges(0), ["k1", "k2"]).mapInPandas(check_rows, "h1 long, h2 long, k1 long, k2 int, start long")
    checked = staged(checked, "checked")
    twice = checked.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    twice = staged(twice, "twice")
    hits = checked.join(twice, ["h1", "h2"]).select("k1", "k2", "start", (F.col("start") + 1).alias("end"))
    repeated = told.where("kind = 1").select("k1", "k2", "start", "end").union(hits)
    repeated = repeated.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, data, found in zip(batch["id"], batch["text"], batch["ranges"]):
                data = data or b""
                starts, ends = words.places(data)
                keep = np.ones(len(starts), bool)
                if found is not None and len(found):
                    ranges = np.array([(r["start"], r["end"]) for r in found]) + [0, window - 1]
                    keep = ~_inside(len(starts), ranges)
                out.append((key, len(starts), int((~keep).sum()), join_words(data, starts, ends, keep)))
            yield pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept"]).astype({"id": batch["id"].dtype})

    id_type = docs.schema[id_col].dataType.simpleString()
    out = keyed.join(repeated, ["k1", "k2"], "left").select("id", "text", "ranges")
    # the id goes around Python's numbers as text, which keeps large and null ids whole
    out = out.withColumn("id", F.col("id").cast("string")).mapInPandas(kept, "id string, n_words long, n_removed long, kept string")
    return out.withColumn("id", F.col("id").cast(id_type)).withColumnRenamed("id", id_col)


def join_words(data: bytes, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> str:
    """The kept words joined by one space."""
    if not keep.any():
        return ""
    if (starts[1:] - ends[:-1] == 1).all():  # single separators: whole runs can be cut out
        first, end = _ranges_of(keep)
        plain = data.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     "))
        return b" ".join(plain[starts[a] : ends[b - 1]] for a, b in zip(first, end)).decode()
    return b" ".join(data[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())).decode()
