"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is cut into runs of letters; every run gives its character n-grams, with a mark at its ends.
Each n-gram is hashed to a row of an embedding table; the mean row goes through a linear layer and a
softmax. Training is stochastic gradient descent in numpy on snippets from a bounded sample of
labelled rows (``sample_rows``); prediction reads whole texts. A fifth of the sample is kept out of
the descent: it sets the temperature of the softmax and the score below which a text is rejected.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convlake.llm.common import unused

ORDERS = (1, 2, 3, 4)
BITS = 17  # embedding rows: 2^BITS
DIM = 16
SNIPPETS, SNIPPET = 4, 240  # training snippets of a document and their characters
MARK = 0x20
CLEAR = 0.3
BLOCK = 1 << 20  # characters hashed at a time


@functools.cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def letter_runs(text: str) -> np.ndarray:
    """Lower-cased code points with one mark before, between and after the runs of letters; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return points[:0]
    points = np.where(letter, points, MARK).astype(np.uint32)
    points = np.concatenate([[np.uint32(MARK)], points, [np.uint32(MARK)]])
    return points[np.concatenate([[True], (points[1:] != MARK) | (points[:-1] != MARK)])]


def features(points: np.ndarray) -> np.ndarray:
    """Embedding rows of the n-grams of marked letter runs."""
    out = []
    for n in ORDERS:
        if len(points) < n:
            break
        h = np.full(len(points) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        if n == 1:
            h = h[points != MARK]
        out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
    return np.concatenate(out)


@dataclass
class Model:
    """rows: the embedding table times the linear layer, one column per language (2^BITS rows)."""

    langs: list[str]
    rows: np.ndarray
    temperature: float
    least_score: float

    def logits(self, points: np.ndarray) -> np.ndarray:
        """Mean of the n-grams' rows; long texts a block at a time."""
        total, n = np.zeros(len(self.langs)), 0
        for at in range(0, len(points), BLOCK):
            got = features(points[at : at + BLOCK])
            total += self.rows[got].sum(axis=0, dtype=np.float64)
            n += len(got)
        return total / max(n, 1)

    def scores(self, points: np.ndarray) -> np.ndarray:
        return softmax(self.logits(points) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sample(docs: DataFrame, where: Column, label: str, id_col: str, text_col: str, rows: int) -> pd.DataFrame:
    """Snippets (text, lang) of at most ``rows`` labelled documents in all (one per label at least), equally many per label.

    The documents with the least hashes of id and text are taken, so the sample is the same in every run.
    Rows equal in id, text and label count as one. Labels are counted first; they are few (one column of the model each).
    """
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), F.col(id_col).cast("string"), F.lit(0), F.col(text_col)), 1)
    labelled = docs.where(where & F.col(label).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"))
    draws = labelled.select("lang", "draw").distinct()
    counts = {r[0]: r[1] for r in draws.groupBy("lang").count().collect()}
    if not counts:
        return pd.DataFrame({"snippet": [], "lang": []})
    each = max(1, rows // len(counts))
    by_label = lambda limits: F.coalesce(*[F.when(F.col("lang") == k, F.lit(x)) for k, x in sorted(limits.items())])
    # twice as many as wanted are ranked, so that a label with enough documents gets its share
    likely = {k: min((1 << 63) - 1, (1 << 63) * (2 * each + 16) // n) for k, n in counts.items()}
    ranked = draws.where(F.col("draw") <= by_label(likely)).withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("draw")))
    last = {r[0]: r[1] for r in ranked.where(F.col("n") <= each).groupBy("lang").agg(F.max("draw")).collect()}
    step = F.greatest(F.floor((F.length("text") - SNIPPET) / SNIPPETS), F.lit(SNIPPET)).cast("int")
    at = F.transform(F.sequence(F.lit(0), F.lit(SNIPPETS - 1)), lambda i: F.substring(F.col("text"), i * step + 1, F.lit(SNIPPET)))
    # snippets are cut before equal rows meet, so that no whole text is shuffled
    picked = labelled.where(F.col("draw") <= by_label(last)).select("lang", "draw", F.filter(at, lambda x: x != "").alias("snippets"))
    picked = picked.dropDuplicates(["lang", "draw"]).select("lang", F.explode("snippets").alias("snippet"))
    return picked.toPandas().sort_values(["lang", "snippet"], ignore_index=True)


def train(snippets: list[str], langs: list[str], steps: int = 800, rate: float = 0.5, batch: int = 32, seed: int = 7) -> Model | None:
    """Fits the model in ``steps`` steps of ``batch`` snippets; None without any snippet that has letters."""
    names = sorted(set(langs))
    known = {name: k for k, name in enumerate(names)}
    data = [(features(p), known[lang]) for p, lang in ((letter_runs(s), lang) for s, lang in zip(snippets, langs)) if len(p)]
    if not data:
        return None
    rng = np.random.default_rng(seed)
    data = [data[i] for i in rng.permutation(len(data))]
    kept_out = data[: len(data) // 5]
    fit = data[len(kept_out) :]
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer = np.zeros((len(names), DIM), np.float32)
    learned = np.zeros(len(table), bool)
    epoch = -(-len(fit) // batch)
    for step in range(steps):
        if step % epoch == 0:
            order = rng.permutation(len(fit))
        at = step % epoch * batch
        chosen = [fit[i] for i in order[at : at + batch]]
        sizes = np.array([len(f) for f, _ in chosen])
        rows = np.concatenate([f for f, _ in chosen])
        hidden = np.add.reduceat(table[rows], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None].astype(np.float32)
        error = softmax(hidden @ layer.T)
        error[np.arange(len(chosen)), [y for _, y in chosen]] -= 1
        pace = np.float32(rate * (1 - step / steps))
        back = (error @ layer) / sizes[:, None]
        layer -= pace * (error.T @ hidden).astype(np.float32)
        # the share of each distinct row in the batch's texts, so that a row is written once
        texts = np.repeat(np.arange(len(chosen)), sizes)
        distinct, where = np.unique(rows, return_inverse=True)
        change = np.stack([np.bincount(where, back[texts, d], len(distinct)) for d in range(DIM)], axis=1)
        learned[distinct] = True
        table[distinct] -= pace * np.float32(len(names)) * change.astype(np.float32)
    table[~learned] = 0  # n-grams never met speak for no language
    model = Model(names, (table @ layer.T).astype(np.float32), 1.0, 0.0)
    return calibrate(model, kept_out or fit)


def calibrate(model: Model, kept_out: list[tuple[np.ndarray, int]], lost: float = 0.002) -> Model:
    """Temperature of least log loss, and the score that all but ``lost`` of the right answers reach.

    That score is at most CLEAR above chance: a small or easy held-out part must not reject plain texts.
    """
    logits = np.array([model.rows[f].mean(axis=0) for f, _ in kept_out], np.float64)
    truth = np.array([y for _, y in kept_out])
    grid = np.geomspace(0.05, 8, 40)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    scores = softmax(logits / model.temperature)
    right = scores.argmax(axis=1) == truth
    if right.any():
        model.least_score = min(float(np.quantile(scores.max(axis=1)[right], lost)), 1 / len(model.langs) + CLEAR)
    return model


def fit(docs: DataFrame, where: Column, label: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000) -> Model | None:
    """Model from the labelled rows that ``where`` admits; ``sample_rows`` bounds the sample."""
    found = sample(docs, where, label, id_col, text_col, sample_rows)
    return train(found["snippet"].tolist(), found["lang"].tolist())


def _labelled(docs: DataFrame, model: Model | None, text_col: str, name: str) -> DataFrame:
    """``docs`` with the struct ``name``: lang_pred, score and rejected."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for batch in batches:
            out = []
            for text in batch:
                points = letter_runs(text or "")
                if held is None or not len(points):
                    out.append(("und", 0.0, True))
                    continue
                scores = held.scores(points)
                best = int(scores.argmax())
                out.append((held.langs[best], float(scores[best]), bool(scores[best] < held.least_score)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS rows, one column per language
    return docs.withColumn(name, label(F.col(text_col)))


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected, from whole texts.

    Null texts and texts without letters, and all texts if there is no model, get ``und``, score 0 and
    are rejected. Other texts get a learned language; they are rejected if its score is below the
    calibrated one. The three columns replace any of the same names. Repeated rows are predicted alike.
    """
    name = unused(docs, "_label")
    got = _labelled(docs, model, text_col, name)
    return got.withColumns({k: F.col(f"{name}.{k}") for k in ("lang_pred", "score", "rejected")}).drop(name)


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``predict`` does not reject, with their columns as they are."""
    name = unused(docs, "_label")
    return _labelled(docs, model, text_col, name).where(~F.col(f"{name}.rejected")).drop(name)


def remainder(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def identified(docs: DataFrame, sample_rows: int = 2000, id_col: str = "doc_id") -> DataFrame:
    """Predictions of a model fitted to the rows whose remainder is not 2 (rows without id are not fitted)."""
    return predict(docs, fit(docs, remainder(id_col) != 2, id_col=id_col, sample_rows=sample_rows))
