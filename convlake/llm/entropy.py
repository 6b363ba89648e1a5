"""Cross-entropy difference: the loss per token under a background model less that under a target model.

Tokens are the bytes of a text; both models are n-gram models (``order`` = 4) over the same 256
tokens, smoothed alike: each order is mixed with the one below by ``weight`` pseudo-counts, down to
the uniform distribution. The target model counts the target documents, the background model all
documents. As both losses are sums over the n-grams of a text, one table (gram, two losses) made by
joins of the counts scores every document.

Counts cover all documents and are summed in the task before they are shuffled. The table is sent to
the tasks if it has at most ``sent_grams`` rows (counted first); otherwise the distinct grams of each
document are joined with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.llm.common import staged

ORDER = 4
CHUNK = 1 << 22  # bytes counted or scored at a time
PAD = bytes(ORDER - 1)  # stands before every text


def _grams(data: np.ndarray) -> np.ndarray:
    """The four bytes up to and with each byte from the fourth on, as uint32."""
    wide = data.astype(np.uint32)
    return (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]


def _pieces(texts: Iterator[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ends, grams): pieces of some CHUNK grams, made of whole texts or a part of a long one."""
    rows, sizes, parts, held = [], [], [], 0
    for row, text in enumerate(texts):
        text = text or b""
        for at in range(0, len(text), CHUNK):
            piece = (text[at - 3 : at] if at else PAD) + text[at : at + CHUNK]
            rows.append(row)
            sizes.append(len(piece) - 3)
            parts.append(_grams(np.frombuffer(piece, np.uint8)))
            held += sizes[-1]
            if held >= CHUNK:
                yield np.array(rows), np.cumsum(sizes), np.concatenate(parts)
                rows, sizes, parts, held = [], [], [], 0
    if parts:
        yield np.array(rows), np.cumsum(sizes), np.concatenate(parts)


class Tally:
    """Counts of grams, merged as they come."""

    def __init__(self) -> None:
        self.grams, self.counts, self.waiting = np.zeros(0, np.uint32), np.zeros(0, np.int64), []

    def add(self, grams: np.ndarray) -> None:
        self.waiting.append(np.unique(grams, return_counts=True))
        if sum(len(g) for g, _ in self.waiting) > max(1 << 20, len(self.grams)):
            self.merge()

    def merge(self) -> None:
        grams = np.concatenate([self.grams, *(g for g, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.grams, where = np.unique(grams, return_inverse=True)
        self.counts = np.bincount(where, counts, len(self.grams)).astype(np.int64)
        self.waiting = []


def counted(docs: DataFrame, text_col: str, target_col: str) -> DataFrame:
    """(gram, every, target): the grams of all texts and their numbers, in all and in target documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, target = Tally(), Tally()
        for batch in batches:
            chosen = batch["target"].to_numpy().astype(bool)
            for rows, ends, grams in _pieces(batch["text"]):
                every.add(grams)
                sizes = np.diff(np.concatenate([[0], ends]))
                if chosen[rows].any():
                    target.add(grams[np.repeat(chosen[rows], sizes)])
        every.merge()
        target.merge()
        out = np.zeros(len(every.grams), np.int64)
        out[np.searchsorted(every.grams, target.grams)] = target.counts
        for at in range(0, len(out), 1 << 17):
            part = slice(at, at + (1 << 17))
            yield pd.DataFrame({"gram": every.grams[part].astype(np.int64), "every": every.counts[part], "target": out[part]})

    rows = docs.select(F.col(text_col).cast("binary").alias("text"), F.coalesce(target_col, F.lit(False)).alias("target"))
    return rows.mapInPandas(count, "gram long, every long, target long").groupBy("gram").agg(F.sum("every").alias("every"), F.sum("target").alias("target"))


def losses(counts: DataFrame, weight: float = 4.0) -> DataFrame:
    """(gram, target_loss, background_loss) in nats, for every counted gram."""
    table = counts
    totals = counts.agg(F.sum("every"), F.sum("target")).first()
    shared = {"every": totals[0] or 0, "target": totals[1] or 0}
    for n in range(1, ORDER + 1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1))
        of = counts.groupBy(tail.alias(f"g{n}")).agg(*[F.sum(c).alias(f"{c}{n}") for c in shared])
        table = table.withColumn(f"g{n}", tail).join(of, f"g{n}")
        if n > 1:
            head = F.shiftright(tail, 8)
            above = counts.groupBy(head.alias(f"h{n}")).agg(*[F.sum(c).alias(f"{c}_h{n}") for c in shared])
            table = table.withColumn(f"h{n}", F.shiftright(F.col(f"g{n}"), 8)).join(above, f"h{n}")
    out = {}
    for c, total in shared.items():
        p = F.lit(1 / 256)
        for n in range(1, ORDER + 1):
            p = (F.col(f"{c}{n}") + weight * p) / ((F.col(f"{c}_h{n}") if n > 1 else F.lit(float(total))) + weight)
        out[c] = -F.log(p)
    return table.select("gram", out["target"].alias("target_loss"), out["every"].alias("background_loss"))


class Lookup:
    """A hash table in numpy arrays: rows of values by gram, with open addressing."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(grams)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint32)
        self.row = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(grams), np.arange(len(grams))
        while len(left):
            free = self.row[slot] < 0
            self.row[slot[free]] = left[free]  # of grams that meet in a slot the last one stays
            stays = self.row[slot] == left
            self.keys[slot[stays]] = grams[left[stays]]
            slot, left = (slot[~stays] + 1) & ((1 << self.bits) - 1), left[~stays]
        self.values = values

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def __getitem__(self, grams: np.ndarray) -> np.ndarray:
        """Values of grams that are all in the table."""
        slot = self._slot(grams)
        far = np.flatnonzero(self.keys[slot] != grams)
        while len(far):
            slot[far] = (slot[far] + 1) & ((1 << self.bits) - 1)
            far = far[self.keys[slot[far]] != grams[far]]
        return self.values[self.row[slot]]


def _by_sent_table(docs: DataFrame, table: DataFrame, text_col: str) -> DataFrame:
    got = table.toPandas()
    shared = docs.sparkSession.sparkContext.broadcast((got["gram"].to_numpy().astype(np.uint32), got[["target_loss", "background_loss"]].to_numpy()))

    @F.pandas_udf("tokens long, target double, background double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = Lookup(*shared.value) if len(shared.value[0]) else None
        for batch in batches:
            out = np.zeros((len(batch), 3))
            for rows, ends, grams in _pieces(batch):
                starts = np.concatenate([[0], ends[:-1]])
                out[:, 0] += np.bincount(rows, ends - starts, len(batch))
                summed = np.add.reduceat(table[grams], starts, axis=0)
                for k in (0, 1):
                    out[:, k + 1] += np.bincount(rows, summed[:, k], len(batch))
            yield pd.DataFrame({"tokens": out[:, 0].astype(np.int64), "target": out[:, 1], "background": out[:, 2]})

    return docs.withColumn("_sums", score(F.col(text_col).cast("binary")))


def _by_join(docs: DataFrame, table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text, of = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("string")
    keys = {"_k1": F.xxhash64(F.lit(1), of, text), "_k2": F.xxhash64(F.lit(2), text, of)}

    def grams_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            k1, k2 = batch["_k1"].to_numpy(), batch["_k2"].to_numpy()
            for row, text in enumerate(batch["text"]):
                tally = Tally()
                for _, _, grams in _pieces(iter([text])):
                    tally.add(grams)
                tally.merge()
                if len(tally.grams):
                    yield pd.DataFrame({"_k1": k1[row], "_k2": k2[row], "gram": tally.grams.astype(np.int64), "n": tally.counts})

    rows = docs.select(*[c.alias(k) for k, c in keys.items()], F.col(text_col).cast("binary").alias("text")).dropDuplicates(["_k1", "_k2"])
    held = rows.mapInPandas(grams_of, "_k1 long, _k2 long, gram long, n long").join(table, "gram")
    sums = held.groupBy("_k1", "_k2").agg(F.struct(F.sum("n").alias("tokens"), F.sum(F.col("n") * F.col("target_loss")).alias("target"), F.sum(F.col("n") * F.col("background_loss")).alias("background")).alias("_sums"))
    none = F.struct(F.lit(0).cast("long").alias("tokens"), F.lit(0.0).alias("target"), F.lit(0.0).alias("background"))
    out = docs.withColumns(keys).join(sums, ["_k1", "_k2"], "left").withColumn("_sums", F.coalesce("_sums", none))
    return out.drop("_k1", "_k2")


def scored(docs: DataFrame, targets: DataFrame, weight: float = 4.0, sent_grams: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, target_loss and background_loss per token, and score, background less target.

    ``targets`` holds the ids (column ``id_col``) of the target documents; other columns and repeated
    ids do not matter, and null ids are no targets. Null and empty texts have no tokens: losses and score are
    null. Without targets the target model is uniform. Repeated rows count as often as they occur.
    """
    chosen = targets.select(F.col(id_col).alias("_target")).distinct().withColumn("_is", F.lit(True))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # by sorting at every size: the targets grow with the documents, so they are never sent to all tasks
    marked = rows.join(chosen.hint("merge"), F.col("id") == F.col("_target"), "left")
    counts = staged(counted(marked, "text", "_is"), "grams")
    table = staged(losses(counts, weight), "losses")
    small = table.count() <= sent_grams
    out = _by_sent_table(rows, table, "text") if small else _by_join(rows, table, "id", "text")
    per = lambda c: F.when(F.col("_sums.tokens") > 0, F.col(f"_sums.{c}") / F.col("_sums.tokens"))
    out = out.select(F.col("id").alias(id_col), F.col("_sums.tokens").alias("n_tokens"), per("target").alias("target_loss"), per("background").alias("background_loss"))
    return out.withColumn("score", F.col("background_loss") - F.col("target_loss"))
