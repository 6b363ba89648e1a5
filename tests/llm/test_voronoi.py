"""The Voronoi kNN join against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from convlake.llm import voronoi


def plain(rows, k, every):
    fine = [(n, key, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (key, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, key, q in fine:
        if key is not None and key % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), other is None, other or 0, m) for m, other, v in fine if m != n)
            out += [(key, rank, None if none else other, -s) for rank, (s, none, other, _) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def check(spark, rows, k=5, every=50, **kw):
    df = spark.createDataFrame([(key, v, "x") for key, v in rows], "vec_id long, embedding array<float>, score string")
    got = voronoi.top_k(df, F.col("vec_id") % every == 0, k, **kw).collect()
    assert sorted(((r.query_id, r["rank"], r.id, r.score) for r in got), key=str) == plain(rows, k, every)


def test_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(spark, rows)


@pytest.mark.parametrize("pivots,block", [(1, 1000), (8, 16)])
def test_clusters_are_pruned_rightly(spark, pivots, block):
    rng = np.random.default_rng(pivots)
    centres = rng.normal(size=(6, 4)) * 20
    rows = [(k, (centres[k % 6] + rng.normal(size=4) * 0.01).astype(np.float32).tolist()) for k in range(240)]
    rows += [(240 + k, rows[0][1]) for k in range(150)]  # a common vector
    check(spark, rows, every=7, pivots=pivots, block=block)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [-0.001, 3.0]), (None, [9.0, 9.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (100, []), (7, [2.0]), (2**60, [0.5, 0.25, 8.0]), (150, [3e7, 1.0])]
    check(spark, rows)
    check(spark, rows[:1])
    check(spark, [])


def test_large_components_stay_exact():
    a = np.array([[2**31 + 1, 3]])
    assert voronoi._products(a, a)[0, 0] == (2**31 + 1) ** 2 + 9
    b = np.array([[2**62, 5]])
    assert voronoi._products(b, np.array([[1, 2], [-2, 0]])).tolist() == [[2**62 + 10, -(2**63)]]
    with pytest.raises(ValueError):
        voronoi._products(b, np.array([[2, 0]]))


@pytest.mark.parametrize("large", [1e10, 1e30])
def test_scores_beyond_64_bits_raise(spark, large):
    df = spark.createDataFrame([(0, [large]), (1, [large])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        voronoi.top_k(df, F.col("vec_id") == 0).collect()


@pytest.mark.parametrize("n", [1, 5, 6, 200, 1000])
def test_highest_scores_and_ties(n):
    rng = np.random.default_rng(n)
    for scores in (rng.integers(-3, 3, (7, n)), rng.integers(-(1 << 23), 1 << 23, (7, n)).astype(np.float32), np.full((2, n), -(1 << 63))):
        row, col, value = voronoi._highest(scores, 6)
        want = [(i, j, int(s[j])) for i, s in enumerate(scores) for j in sorted(range(n), key=lambda j: (-int(s[j]), j))[:6]]
        assert list(zip(row.tolist(), col.tolist(), value.tolist())) == want


def shuffled(spark):
    sc, none = spark.sparkContext, spark._jvm.java.util.ArrayList()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(spark._jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_vectors_move_once_per_tile_and_shard(spark, monkeypatch):
    """Without clusters all groups need all vectors, which must not move once per group."""
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=64).astype(np.float32).tolist()) for k in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    was, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = voronoi.top_k(df, F.col("vec_id") % 50 == 0).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(got) == 600 and shuffled(spark) - before < 6000 * 64 * 8
    want = {(r.query_id, r["rank"]): (r.id, r.score) for r in got}
    monkeypatch.setattr(voronoi, "TILE", 7)  # groups in several tiles, and many shards
    monkeypatch.setattr(voronoi, "SHARD", 500)
    monkeypatch.setattr(voronoi, "SCORES", 900)
    assert {(r.query_id, r["rank"]): (r.id, r.score) for r in voronoi.top_k(df, F.col("vec_id") % 50 == 0).collect()} == want
