"""Embeddings: feature hashing, normalisation, exact top-k search, rule-based re-ranking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from convlake.functions import text as T

TILE_BYTES = 64 << 20  # queries that meet a block of vectors in one task
QUERY_BYTES, BLOCK_BYTES = 4 << 20, 8 << 20  # queries and vectors in a row of pairs
QUERY_ROWS, SCORES = 2048, 2 << 20  # queries scored at a time, and their scores
SALTS = 64  # pairs of a tile and a salt, at least
KEPT_TOKENS = 500_000  # whose features a task holds


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def hash_embedding(dim: int):
    """Column function text -> vector by signed feature hashing of its tokens (BLAKE2b).

    Bytes of the token digest give index (0-3), sign (4) and weight (5); the vector has length
    one. Digests are kept per batch, so frequent tokens are hashed once.
    """

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        seen: dict[str, tuple[int, float]] = {}

        def feature(tok: str) -> tuple[int, float]:
            if tok not in seen:
                h = hashlib.blake2b(tok.encode("utf-8"), digest_size=16).digest()
                seen[tok] = (int.from_bytes(h[:4], "little") % dim, (1 - 2 * (h[4] % 2)) * (1.0 + h[5] / 255.0))
            return seen[tok]

        def one(text: str) -> np.ndarray:
            feats = [feature(t) for t in (text or "").split()]
            vec = np.bincount([i for i, _ in feats], [w for _, w in feats], dim) if feats else np.zeros(dim)
            norm = np.linalg.norm(vec)
            return (vec / norm if norm > 0 else vec).astype(np.float32)

        return texts.map(one)

    return embed


class _Features(dict):
    """Features of tokens by their MD5, kept while they are few: index times 1024 + signed weight times 255 + 512."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, tok: str) -> int:
        if len(self) >= KEPT_TOKENS:
            self.clear()
        h = hashlib.md5(tok.encode("utf-8"), usedforsecurity=False).digest()
        self[tok] = out = (int.from_bytes(h[:4]) >> 4) % self.dim << 10 | 512 + (-255 - h[5] if h[4] % 2 else 255 + h[5])
        return out


def _feature_sums(dim: int):
    """Whole sums of 255 times the signed weights of a text's tokens, null at places that no token has."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features(dim)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            for text in batch.column(1):
                toks = (text.as_py() or "").split()
                found.append(np.fromiter(map(features.__getitem__, toks), np.int64, len(toks)))
            coded, size = np.concatenate(found), len(found) * dim
            place = np.repeat(np.arange(len(found)) * dim, [len(x) for x in found]) + (coded >> 10)
            held = np.bincount(place, (coded & 1023) - 512, size).astype(np.int64)
            rows = pa.ListArray.from_arrays(np.arange(0, size + 1, dim, dtype=np.int32), pa.array(held, mask=np.bincount(place, minlength=size) == 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["id", "sums"])

    return sums


def _unit_sums(df: DataFrame, id: str, text: str, dim: int) -> DataFrame:
    """(id, sums, norm): the feature sums of an id's texts, which are whole numbers and so the same in any order.

    A text is summed where it lies; only ``dim`` sums a row are shuffled, to add up texts of one id.
    """
    kind = df.schema[id].dataType.simpleString()
    rows = df.select(id, text).mapInArrow(_feature_sums(dim), f"`{id}` {kind}, sums array<bigint>")
    held = rows.groupBy(id).agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(dim)]).alias("sums"))
    held = held.filter(F.exists("sums", lambda x: x.isNotNull()))
    square = F.aggregate("sums", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0)).cast("double") * F.coalesce(x, F.lit(0)).cast("double"))
    return held.withColumn("norm", F.greatest(F.sqrt(square), F.lit(255e-12)))


def hashed_features(df: DataFrame, id: str, text: str, dim: int) -> DataFrame:
    """Sparse unit vectors (id, idx, value) from MD5 digests of tokens: index, sign and weight of a feature."""
    rows = _unit_sums(df, id, text, dim).select(id, "norm", F.posexplode("sums").alias("idx", "w")).filter("w IS NOT NULL")
    return rows.select(id, F.col("idx").cast("long").alias("idx"), (F.col("w") / F.col("norm")).alias("value"))


def hashed_vectors(df: DataFrame, id: str, text: str, dim: int) -> DataFrame:
    """The same as dense vectors (id, embedding), for ids that have a token."""
    return _unit_sums(df, id, text, dim).select(id, F.transform("sums", lambda x: F.coalesce(x, F.lit(0)) / F.col("norm")).alias("embedding"))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of a batch as rows; one that is null or not finite is an error."""
    values = vectors.flatten()
    if vectors.null_count or values.null_count:
        raise ValueError("a vector has null or non-finite components")
    if pc.count_distinct(pc.list_value_length(vectors)).as_py() > 1:
        raise ValueError("vectors have different lengths")
    m = values.to_numpy().astype(np.float64).reshape(len(vectors), -1)
    if not np.isfinite(m).all():
        raise ValueError("a vector has null or non-finite components")
    return m


def _pack(block_bytes: int):
    """Rows (ids, matrix bytes) of at most so many bytes from Arrow batches of vectors."""

    def block(ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        held = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), pa.array([np.concatenate(parts).tobytes()])], ["ids", "mat"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(1))
            step = max(1, block_bytes // max(8, 8 * m.shape[1]))
            for at in range(0, len(m), step):
                part = m[at : at + step]
                if parts and held + part.nbytes > block_bytes:
                    yield block(ids, parts)
                    ids, parts, held = [], [], 0
                ids.append(batch.column(0).slice(at, step))
                parts.append(part)
                held += part.nbytes
        if parts:
            yield block(ids, parts)

    return pack


def _score(k: int, exclude_same: bool, cosine: bool):
    """Scores of every (query block, vector block) pair; the best ``k`` per query leave the task."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_mat, v_ids, v_mat in zip(*(batch.column(n) for n in ("q_ids", "q_mat", "v_ids", "v_mat"))):
                q_ids, v_ids = q_ids.values, v_ids.values
                q, v = (np.frombuffer(m.as_buffer()).reshape(len(ids), -1) for m, ids in ((q_mat, q_ids), (v_mat, v_ids)))
                if cosine:
                    q, v = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (q, v))
                if exclude_same:
                    both = pa.chunked_array([q_ids, v_ids.cast(q_ids.type)]).combine_chunks().dictionary_encode().indices.to_numpy()
                    q_code, v_code = both[: len(q)], both[len(q) :]
                n, step, best = min(k, len(v)), min(QUERY_ROWS, max(1, SCORES // len(v))), []
                for at in range(0, len(q), step):
                    s = q[at : at + step] @ v.T
                    if exclude_same:
                        s[q_code[at : at + step, None] == v_code[None, :]] = -np.inf
                    # ties at the cut must not depend on the partition: keep all rows at the k-th score
                    kth = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
                    qi, vi = np.nonzero((s >= kth[:, None]) & (s > -np.inf))
                    best.append((qi + at, vi, s[qi, vi]))
                qi, vi, s = (np.concatenate(x) for x in zip(*best))
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(qi)), v_ids.take(pa.array(vi)), pa.array(s)], ["query_id", "vec_id", "score"])

    return score


def vector_topk(
    queries: DataFrame, vectors: DataFrame, k: int, exclude_same: bool = False, cosine: bool = False
) -> DataFrame:
    """Exact search: (query_id, rank, vec_id, score), ties by the smaller id.

    ``queries``: (query_id, embedding); ``vectors``: (vec_id, embedding); ids of any one type. Vectors
    are packed into blocks of BLOCK_BYTES and queries into ones of QUERY_BYTES, and of a pair of blocks
    SCORES scores are held at a time, so a task's memory does not grow with the tables. Queries are cut into tiles of TILE_BYTES. One tile is
    broadcast, and the vectors stay where they are. With several, the blocks are copied once per
    tile, and a tile once per salt, so the pairs spread over tiles times salts tasks (SALTS or more). Only the best
    ``k`` per query and vector block leave a task, and Spark's window group limit cuts them again.
    """
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    tiles = max(1, -(-size["n"] * (size["d"] or 0) * 8 // TILE_BYTES))
    q_type, v_type = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, "vec_id")))
    packed = vectors.select("vec_id", "embedding").mapInArrow(_pack(BLOCK_BYTES), f"ids array<{v_type}>, mat binary").toDF("v_ids", "v_mat")
    asked = queries.select("query_id", "embedding")
    asked = asked.repartition(tiles, "query_id") if tiles > 1 else asked
    asked = asked.mapInArrow(_pack(QUERY_BYTES), f"ids array<{q_type}>, mat binary").toDF("q_ids", "q_mat").withColumn("tile", F.spark_partition_id() % tiles if tiles > 1 else F.lit(0))
    if tiles == 1:
        pairs = packed.withColumn("tile", F.lit(0)).join(F.broadcast(asked), "tile")
    else:
        salts = -(-SALTS // tiles)
        packed = packed.select("*", F.pmod(F.xxhash64("v_mat"), F.lit(salts)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
        pairs = packed.join(asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["tile", "salt"])
    best = pairs.select("q_ids", "q_mat", "v_ids", "v_mat").mapInArrow(
        _score(k, exclude_same, cosine), f"query_id {q_type}, vec_id {v_type}, score double"
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def topk_per_query(scored: DataFrame, k: int, text: str | None = None, preview: int = 280) -> DataFrame:
    """Keep the best ``k`` rows per query; ties by id; long texts cut to a preview."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out if text is None else out.withColumn("preview", F.left(text, F.lit(preview))).drop(text)


def score_pool(pool: DataFrame) -> DataFrame:
    """Add the rule bonus to a dense pool: ``dense_score``, ``intent_bonus``, and the new ``score``."""
    bonus = T.intent_bonus(F.col("question"), F.col("item_type"), F.col("source_field"), T.answer_field_hints(F.col("answer_field")))
    scored = pool.withColumn("dense_score", F.col("score")).withColumn("intent_bonus", bonus)
    return scored.withColumn("score", F.col("dense_score") + F.col("intent_bonus"))


def rerank_order():
    return Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("dense_score"), "vec_id")


def rerank(pool: DataFrame, k: int) -> DataFrame:
    """Re-sort a dense pool by dense score plus rule bonus and keep ``k``.

    ``pool``: query_id, vec_id, score, question, item_type, answer_field, source_field; the pool
    is the dense top max(k, pool size) of each query.
    """
    return score_pool(pool).withColumn("rank", F.row_number().over(rerank_order())).filter(F.col("rank") <= k)
