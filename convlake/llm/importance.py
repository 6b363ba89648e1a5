"""Quality selection by importance resampling.

Two generative models over hashed word n-grams (single words and pairs, ``buckets`` buckets) give each
document the log ratio of its likelihood under target text to that under the raw corpus. Adding a
Gumbel variate to the log ratio and keeping the k highest draws k documents without replacement,
with chances in proportion to the ratios. The variates come from a digest of id and text, so a rerun
draws the same documents.

The raw model counts all documents. The target model is fitted to at most ``target_rows`` labelled
documents, those with the least hashes of their ids. Bucket counts are summed in a task before they
are shuffled; the model is ``buckets`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.llm import words
from convlake.llm.common import numbered

BUCKETS = 10_000


def bucket_rows(batch: words.Batch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text of the batch) of all words and word pairs."""
    of = batch.text_of()
    pair = np.flatnonzero(batch.whole(2))
    both = words.runs(words.mix(batch.word, 4), 2)[pair]
    return (np.concatenate([words.mix(batch.word, 3), both]) % np.uint64(buckets)).astype(np.int64), np.concatenate([of, of[pair]])


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target) from rows (text as binary, target)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            chosen = batch["target"].to_numpy().astype(bool)
            for texts in words.batches(batch["text"]):
                bucket, of = bucket_rows(texts, buckets)
                total[0] += np.bincount(bucket, minlength=buckets)
                total[1] += np.bincount(bucket[chosen[texts.rows][of]], minlength=buckets)
        there = np.flatnonzero(total[0])
        yield pd.DataFrame({"bucket": there, "raw": total[0][there], "target": total[1][there]})

    return docs.mapInPandas(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log of target to raw probability of each bucket, one count added to each."""
    raw, target = np.ones(buckets), np.ones(buckets)
    for row in counts.collect():  # at most ``buckets`` rows
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None, target_rows: int = 20_000, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row: id, n_words, log_ratio, draw (log_ratio plus a Gumbel variate), rank (from 1) and selected.

    ``labels`` has ``label_col`` 1 for target documents. The ceil(share * rows) highest draws are selected, ties
    by id and text; ``share`` is by default the share of 1 among the labels (1 without labels). Texts without words,
    null included, have log_ratio 0. Repeated rows draw alike and are ranked apart.
    """
    label = F.col(label_col)
    if share is None:
        share = labels.agg(F.avg((label == 1).cast("double"))).first()[0]
        share = 1.0 if share is None else share
    target = labels.where(label == 1).select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct().orderBy(F.xxhash64(F.lit("target"), "_id"), "_id").limit(target_rows)
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    flagged = read.join(F.broadcast(target), F.col("id") == F.col("_id"), "left")  # at most target_rows ids
    counts = bucket_counts(flagged.select(F.col("text").cast("binary").alias("text"), F.col("_id").isNotNull().alias("target")), buckets)
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(counts, buckets))

    @F.pandas_udf("n_words long, log_ratio double")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ratios = shared.value
        for batch in batches:
            out = np.zeros((len(batch), 2))
            for texts in words.batches(batch):
                bucket, of = bucket_rows(texts, len(ratios))
                out[texts.rows, 0] = np.diff(texts.cuts)
                out[texts.rows, 1] = np.bincount(of, ratios[bucket], len(texts.rows))
            yield pd.DataFrame({"n_words": out[:, 0].astype(np.int64), "log_ratio": out[:, 1]})

    text, of = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("string")
    even = (F.pmod(F.xxhash64(F.lit("gumbel"), of, text), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text, of).alias("tie"), weigh(F.col(text_col).cast("binary")).alias("w"), (-F.log(-F.log(even))).alias("gumbel"))
    rows = rows.select("id", "tie", "w.n_words", "w.log_ratio", (F.col("w.log_ratio") + F.col("gumbel")).alias("draw"))
    ranked = numbered(rows, [F.col("draw").desc(), F.col("id").asc_nulls_last(), F.col("tie")], "place")
    n = F.lit(share) * F.lit(float(docs.count()))
    return ranked.select(F.col("id").alias(id_col), "n_words", "log_ratio", "draw", (F.col("place") + 1).alias("rank"), (F.col("place") < F.ceil(n)).alias("selected"))
