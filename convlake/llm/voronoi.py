"""Exact top-k inner products by a Voronoi kNN join.

Vectors are lifted by one coordinate, sqrt(M^2 - |x|^2) for data (M the largest norm) and 0 for
queries, so the highest inner product is the least distance. Queries and data are grouped by their
nearest pivot. Summaries per group (the farthest query of a group; the farthest vector and the k
least distances of a cell) bound, through the triangle inequality, the distance theta at which a
query group is sure of k neighbours: only vectors whose distances reach theta are sent to the group.
Groups share tiles of at most TILE queries, a larger group has several, and vectors are dealt to shards
by hash, so a cell that holds a third of all vectors lies in all shards. A task scores the queries of a tile against
the vectors of a shard that their groups need, ``block`` at a time, and keeps the best of the shard; the last
step merges those. So what is shuffled and merged follows queries times shards, not queries times
blocks. The pivots (``pivots`` rows) and their summaries are all that meets in one place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convlake.llm.common import staged

PLAIN = 1 << 52  # inner products below this are exact in doubles
SINGLE = 1 << 24  # and below this in single precision
TILE = 4096  # queries of a tile
SHARD = 32768  # vectors of a shard
SHARD_BYTES = 1 << 24  # and their bytes, as 64-bit integers
SCORES = 1 << 21  # held at a time
SPLIT = 32  # scores of which the largest stands for all


def integers(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or holds null or non-finite components.

    Raises an error where one does not fit 64 bits.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: _floor(x.cast("double"), scale)))


def _floor(x: Column, scale: float) -> Column:
    large = (F.abs(x) < float("inf")) & (F.abs(x * scale) >= float(1 << 63))
    return F.when(large, F.raise_error(F.lit("a component does not fit 64 bits")).cast("long")).otherwise(F.floor(x * scale).cast("long"))


def _matrix(rows: list, width: int) -> np.ndarray:
    """Rows of integers, the shorter ones filled up with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def _unpacked(packed: pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), kind).reshape(len(packed), width)


def _products(a: np.ndarray, b: np.ndarray, unused: Callable[[], np.ndarray] | None = None) -> np.ndarray:
    """Exact inner products of all rows: whole numbers, held in floats where these are exact.

    Raises where one does not fit 64 bits, other than the ``unused`` ones (it gives a mask).
    """
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(a.shape[1], 1)
    if most < PLAIN:
        kind = np.float32 if most < SINGLE else np.float64
        return a.astype(kind) @ b.T.astype(kind)
    if most < 1 << 62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    if unused is not None:
        exact[unused()] = 0
    if exact.size and not -(1 << 63) <= exact.min() <= exact.max() < 1 << 63:
        raise ValueError("an inner product does not fit 64 bits")
    return exact.astype(np.int64)


def _highest(scores: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values (64-bit integers) of the ``count`` highest scores of each row, ties to the first columns."""
    n = scores.shape[1]
    if n > SPLIT * count:
        # so many of these are no less, so none of the highest is
        some = scores[:, : n // SPLIT * SPLIT].reshape(len(scores), SPLIT, -1).max(axis=1)
        at_least = np.partition(some, -count, axis=1)[:, -count]
    else:
        at_least = np.partition(scores, max(0, n - count), axis=1)[:, max(0, n - count)]
    row, col = np.divmod(np.flatnonzero(scores >= at_least[:, None]), n)
    value = scores[row, col].astype(np.int64)
    order = np.lexsort([col, ~value, row])
    row, col, value = row[order], col[order], value[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < count], col[rank < count], value[rank < count]


def _nearest(pivots: np.ndarray, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (lifted**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * lifted @ pivots.T
    at = square.argmin(axis=1)
    return at, np.sqrt(((lifted - pivots[at]) ** 2).sum(axis=1))


def thetas(pivots: np.ndarray, query_far: dict[int, float], cells: dict[int, list[float]], k: int) -> dict[int, float]:
    """For each query group a distance within which each of its queries has k vectors besides itself."""
    out = {}
    for i, far in query_far.items():
        near = sorted(far + np.linalg.norm(pivots[i] - pivots[j]) + r for j, least in cells.items() for r in least)
        out[i] = near[k] if len(near) > k else float("inf")
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 16, block: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The k highest scores of each query row among all other rows: query_id, rank, id, score.

    Ties go to the smaller id. Vectors that are null or hold null or non-finite components take no part.
    A shorter vector counts as filled up with zeros. Rows that share an id are different rows: only
    the query's own row is left out, and each query row has its own result. Null ids come last.
    Scores and components beyond 64 bits raise an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), integers(F.col(vector_col), scale).alias("v")).where("v IS NOT NULL")
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double"))))
    width, far, most = rows.agg(F.max(F.size("v")), F.max(norm), F.max(size)).first()
    chosen = [r["v"] for r in rows.select("v").distinct().orderBy(F.xxhash64("v")).limit(pivots).collect()]
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"query_id {kind}, rank int, id {kind}, score long"
    if not chosen:
        return spark.createDataFrame([], schema)
    plain = _matrix(chosen, width).astype(np.float64)
    centres = np.hstack([plain, np.sqrt(np.maximum(far**2 - (plain**2).sum(axis=1), 0))[:, None]])
    held = next((x for x in ("<i2", "<i4") if most < 1 << 8 * int(x[2]) - 1), "<i8")  # the least integers that hold all components

    @F.pandas_udf("q_cell int, q_far double, d_cell int, d_far double, packed binary")
    def cells_of(batch: pd.Series) -> pd.DataFrame:
        whole = _matrix(batch.tolist(), width)
        x = whole.astype(np.float64)
        lift = np.sqrt(np.maximum(far**2 - (x**2).sum(axis=1), 0))
        a, b = _nearest(centres, np.hstack([x, np.zeros((len(x), 1))])), _nearest(centres, np.hstack([x, lift[:, None]]))
        return pd.DataFrame({"q_cell": a[0], "q_far": a[1], "d_cell": b[0], "d_far": b[1], "packed": [r.tobytes() for r in whole.astype(held)]})

    placed = staged(rows.withColumn("c", cells_of("v")).select("id", "query", "row", "c.*"), "cells")
    # summaries: at most ``pivots`` rows each, with k + 1 distances
    groups = {r[0]: (r[1], r[2]) for r in placed.where("query").groupBy("q_cell").agg(F.max("q_far"), F.count("*")).collect()}
    sizes = {r[0]: (r[1], r[2]) for r in placed.groupBy("d_cell").agg(F.max("d_far"), F.count("*")).collect()}
    nearest = F.row_number().over(W.partitionBy("d_cell").orderBy("d_far"))
    least: dict[int, list[float]] = {}
    for cell, distance in placed.withColumn("n", nearest).where(F.col("n") <= k + 1).select("d_cell", "d_far").collect():
        least.setdefault(cell, []).append(distance)
    bound = thetas(centres, {i: f for i, (f, _) in groups.items()}, least, k)
    slack = 1e-6 * (float(far) + 1)  # of the doubles that distances are computed in
    # for each group and cell, the least distance to the cell's pivot that matters to the group
    matters = {i: np.array([np.linalg.norm(centres[i] - c) - wide - bound[i] - slack for c in centres]) for i, (wide, _) in groups.items()}

    tiles: list[list[int]] = []  # the groups of each
    first, parts, room = {}, {}, 0
    for i, (_, n) in sorted(groups.items()):
        parts[i] = -(-n // TILE)
        if parts[i] > 1 or n > room:
            first[i], room = len(tiles), TILE - n
            tiles += [[i] for _ in range(parts[i])]
        else:
            first[i], room = len(tiles) - 1, room - n
            tiles[-1].append(i)
    # at most pivots * tiles rows
    sent = [(j, t, float(f)) for t, of in enumerate(tiles) for j, (edge, _) in sizes.items() if edge >= (f := min(matters[i][j] for i in of))]
    sent = spark.createDataFrame(sent or [(-1, -1, 0.0)], "d_cell int, tile int, least_far double")
    total, cores = sum(n for _, n in sizes.values()), spark.sparkContext.defaultParallelism
    shards = max(-(-total // max(1, min(SHARD, SHARD_BYTES // (8 * max(width, 1))))), min(2 * cores, -(-total // 1024)))
    data = placed.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).join(F.broadcast(sent), "d_cell").where("d_far >= least_far")
    of = lambda found: F.coalesce(*[F.when(F.col("q_cell") == c, F.lit(n)) for c, n in found.items()], F.lit(0))
    tile = of(first) + F.pmod(F.xxhash64("row"), F.greatest(of(parts), F.lit(1))).cast("int")
    queries = placed.where("query").withColumns({"tile": tile, "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})

    def solve(key: tuple, vectors: pa.Table, asked: pa.Table) -> pa.Table:
        vectors = vectors.take(pc.sort_indices(vectors, [("id", "ascending"), ("row", "ascending")], null_placement="at_end"))
        b, rows, cell, far = _unpacked(vectors["packed"], held, width), *(vectors[c].to_numpy() for c in ("row", "d_cell", "d_far"))
        a, q_rows, q_cell = _unpacked(asked["q_packed"], held, width), *(asked[c].to_numpy() for c in ("q_row", "q_cell"))
        best = [(np.zeros(0, np.int64),) * 3]
        for i in np.unique(q_cell):
            wanted = np.flatnonzero(far >= matters[i][cell])
            near, own = b if len(wanted) == len(b) else b[wanted], np.flatnonzero(q_cell == i)
            step = max(1, min(block, SCORES // max(1, len(wanted))))
            for at in range(0, len(own) if len(wanted) else 0, step):
                q = own[at : at + step]
                row, col, value = _highest(_products(a[q], near, lambda: q_rows[q][:, None] == rows[wanted]), k + 1)  # noqa: B023
                best.append((q[row], wanted[col], value))
        q, at, value = map(np.concatenate, zip(*best))
        other = q_rows[q] != rows[at]
        q, at, value = q[other], at[other], value[other]
        columns = [pa.array(q_rows[q], pa.int64()), asked["query_id"].take(pa.array(q)), pa.array(rows[at], pa.int64()), vectors["id"].take(pa.array(at)), pa.array(value, pa.int64())]
        return pa.table(columns, names=["q_row", "query_id", "row", "id", "score"])

    vectors = data.select("tile", "shard", "id", "row", "d_cell", "d_far", "packed")
    asked = queries.select("tile", "shard", F.col("id").alias("query_id"), F.col("row").alias("q_row"), "q_cell", F.col("packed").alias("q_packed"))
    best = vectors.groupBy("tile", "shard").cogroup(asked.groupBy("tile", "shard")).applyInArrow(solve, f"q_row long, query_id {kind}, row long, id {kind}, score long")
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("q_row").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
