"""Hard negatives by slot-decomposed selection.

Each positive of an anchor asks for the best rows of other labels whose score lies in a window below
its own. The windows of an anchor overlap, but their upper limits cut the scores into disjoint slots:
a slot holds the scores up to one limit and above the next lower one. In one pass over all rows,
every task keeps the best k of each slot (a combiner), the best k per slot of all tasks follow, and a
positive's answer is the head of the slots from its own limit downwards, merged in descending order and
cut at its lower limit.

Rows and anchors meet in a grid: anchors in tiles, rows in shards, both dealt by hash of a row
number, so neither a common label nor a common vector makes a large cell. A cell is scored by matrix
products, some rows at a time. Per cell at most positives * k rows of an anchor leave the task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from convlake.llm.common import staged

PLAIN = 1 << 52  # sums of products below this are exact in doubles
TILE = 1024  # anchors of a cell
SHARD_BYTES = 32 << 20  # vectors of a cell
STRIP = 4096  # rows scored at a time


def whole(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, as double; null where the vector or a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # floor() gives a long; doubles from PLAIN on are whole already
    floor = lambda x: F.when(F.abs(x) < PLAIN, F.floor(x).cast("double")).otherwise(x)
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: floor(x.cast("double") * scale)))


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones are filled up with zeros."""
    out = np.zeros((len(vectors), width))
    sizes = np.diff(vectors.offsets.to_numpy())
    out[np.arange(width)[None, :] < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held in doubles, as 64-bit integers; raises where one does not fit."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < PLAIN:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T
    if exact.size and max(abs(exact.min()), abs(exact.max())) >= 1 << 63:
        raise ValueError("an inner product does not fit 64 bits")
    return exact.astype(np.int64)


def _best(found: np.ndarray, by_id: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``at``, those of the k highest scores; ties go to the smaller id."""
    if len(at) > k:
        least = np.partition(found[at], len(at) - k)[len(at) - k]
        at = at[found[at] >= least]
    return at[np.lexsort((by_id[at], -found[at]))[:k]]


def _order(ids: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Place of each row in the order of ids, nulls last, equal ids by row."""
    table = pa.table({"id": ids, "row": rows})
    order = pc.sort_indices(table, [("id", "ascending"), ("row", "ascending")], null_placement="at_end").to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _met(anchors: DataFrame, rows: DataFrame, tiles: int, shards: int, pick: Callable, schema: str, width: int) -> DataFrame:
    """The rows that ``pick(anchor, scores, labels, rows, by_id)`` yields as (slot, place) in each cell, for each anchor."""
    cell = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    anchors = anchors.withColumn("tile", cell(tiles)).withColumn("shard", every(shards))
    # own columns: both sides come from one table, and a grouped pair takes columns by their identity
    rows = rows.select(*[F.col(c).alias(c) for c in ("id", "label", "v", "row")]).withColumn("shard", cell(shards)).withColumn("tile", every(tiles))
    id_type = to_arrow_type(rows.schema["id"].dataType)

    def solve(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ["anchor", "slot", "score", "id", "row"]
        types = [pa.int64(), pa.int32(), pa.int64(), id_type, pa.int64()]
        columns: list[list] = [[] for _ in names]
        if asked.num_rows and held.num_rows:
            asked, held = asked.combine_chunks(), held.combine_chunks()
            a = _matrix(asked.column("v").chunk(0), width)
            number, label = held.column("row").to_numpy(), held.column("label").to_numpy()
            ids, by_id = held.column("id"), _order(held.column("id"), held.column("row").to_numpy())
            vectors = held.column("v").chunk(0)
            table = [_matrix(vectors.slice(at, STRIP), width) for at in range(0, len(vectors), STRIP)]
            asking = asked.to_pylist()
            step = max(1, (STRIP * TILE) // max(len(number), 1))  # anchors scored at a time
            for at in range(0, len(asking), step):
                found = np.hstack([scores(a[at : at + step], b) for b in table])
                for anchor, row in zip(asking[at : at + step], found):
                    for slot, places in pick(anchor, row, label, number, by_id):
                        for place in places:
                            for column, value in zip(columns, (anchor["row"], slot, int(row[place]), ids[int(place)].as_py(), int(number[place]))):
                                column.append(value)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return anchors.groupBy("tile", "shard").cogroup(rows.groupBy("tile", "shard")).applyInArrow(solve, schema)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0) -> DataFrame:
    """For each anchor and each of its positives the best rows of other labels with a score between ``low`` and ``high`` percent of the positive's.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score; a positive without
    such rows has none. Scores are inner products of floor(scale * x), exact; ties go to the smaller id,
    null ids last. An anchor's positives are the ``positives`` best other rows of its label.

    Rows with a null label, a null vector, or a null or non-finite component take no part. A shorter
    vector counts as filled up with zeros. Rows that share an id are different rows, also as anchors;
    a null ``is_anchor`` is no. Other columns are not read, whatever their names. Scores beyond 64 bits
    raise an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.col(label_col).alias("name"), whole(F.col(vector_col), scale).alias("v"))
    rows = rows.where("name IS NOT NULL AND v IS NOT NULL").withColumn("label", F.xxhash64("name"))
    rows = staged(rows.select("id", "asks", "label", "v").withColumn("row", F.monotonically_increasing_id()), "vectors")
    kind = rows.schema["id"].dataType.simpleString()
    n, asking, width = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v"))).first()
    width = max(width or 0, 1)
    tiles, shards = max(1, -(-asking // TILE)), max(1, -(-n * width * 8 // SHARD_BYTES))
    anchors = rows.where("asks")
    schema = f"anchor long, slot int, score long, id {kind}, row long"
    best_first = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]

    def nearest(anchor, found, label, number, by_id):
        yield 0, _best(found, by_id, np.flatnonzero((label == anchor["label"]) & (number != anchor["row"])), positives)

    near = _met(anchors, rows, tiles, shards, nearest, schema, width)
    near = near.withColumn("n", F.row_number().over(W.partitionBy("anchor").orderBy(*best_first))).where(F.col("n") <= positives)
    near = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("n", "score", "id"))).alias("near"))  # at most ``positives``
    limited = staged(rows.where("asks").join(near, rows["row"] == near["anchor"]).drop("anchor"), "anchors")

    def by_slot(anchor, found, label, number, by_id):
        asked = [p["score"] for p in anchor["near"]]
        limits = sorted({high * s // 100 for s in asked})
        least = min(-(-low * s // 100) for s in asked)  # below every window
        at = np.flatnonzero((label != anchor["label"]) & (found <= limits[-1]) & (found >= least))
        slot = np.searchsorted(np.array(limits, np.int64), found[at], "left")
        for k in range(len(limits)):
            yield k, _best(found, by_id, at[slot == k], negatives)

    kept = _met(limited, rows, tiles, shards, by_slot, schema, width)
    kept = kept.withColumn("n", F.row_number().over(W.partitionBy("anchor", "slot").orderBy(*best_first))).where(F.col("n") <= negatives)
    # the slots of an anchor, merged in descending order: at most positives * negatives rows
    entry = F.struct((-F.col("slot")).alias("down"), F.col("n"), F.col("score"), F.col("id"))
    merged = kept.groupBy("anchor").agg(F.sort_array(F.collect_list(entry)).alias("kept"))
    pairs = limited.select("row", F.col("id").alias("anchor_id"), F.explode("near").alias("p")).join(merged, F.col("row") == F.col("anchor"))
    wide = lambda score, share: score.cast("decimal(25,0)") * share
    inside = lambda s: wide(s["score"], 100).between(wide(F.col("p.score"), low), wide(F.col("p.score"), high))
    chosen = pairs.select("anchor_id", "p", F.posexplode(F.slice(F.filter("kept", inside), 1, negatives)).alias("at", "negative"))
    return chosen.select(
        "anchor_id",
        F.col("p.id").alias("positive_id"),
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("negative.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"),
        F.col("negative.score").alias("negative_score"),
    )
