"""Hard negatives against all products."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from convlake.llm import negatives, queries


def plain(rows, every, positives=5, k=3, low=50, high=95):
    """(id, vector, label) rows; the answer of each anchor and positive as a bag."""
    fine = [(n, key, [math.floor(256 * float(np.float32(x))) for x in v], label) for n, (key, v, label) in enumerate(rows) if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for n, key, q, label in fine:
        if key is None or key % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), other is None, other or 0, m, name) for m, other, v, name in fine if m != n)
        for p in [s for s in scored if s[4] == label][:positives]:
            inside = [s for s in scored if s[4] != label and -low * p[0] <= -100 * s[0] <= -high * p[0]]
            for rank, s in enumerate(inside[:k], 1):
                out[key, None if p[1] else p[2], rank, None if s[1] else s[2], -p[0], -s[0]] += 1
    return out


def check(spark, rows, every=50, **kw):
    df = spark.createDataFrame([(key, v, label, "x", "y") for key, v, label in rows], "vec_id long, embedding array<float>, label int, row string, score string")
    got = negatives.hard_negatives(df, F.col("vec_id") % every == 0, **kw).collect()
    want = plain(rows, every, kw.get("positives", 5), kw.get("negatives", 3), kw.get("low", 50), kw.get("high", 95))
    assert Counter(tuple(r) for r in got) == want
    return want


def test_query(spark):
    rows = [(r.vec_id, r.embedding, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = queries.op12_hard_negatives(spark, "/root/testdata/sf0.001").collect()
    assert Counter(tuple(r) for r in got) == plain(rows, 50) and got


@pytest.mark.parametrize("tile,shard,strip", [(1024, 32 << 20, 4096), (3, 2000, 7)])
def test_windows_overlap(spark, monkeypatch, tile, shard, strip):
    """Positives of different scores, a common label, ties, and cells of few rows."""
    monkeypatch.setattr(negatives, "TILE", tile)
    monkeypatch.setattr(negatives, "SHARD_BYTES", shard)
    monkeypatch.setattr(negatives, "STRIP", strip)
    rng = np.random.default_rng(tile)
    rows = [(k, (rng.integers(-3, 8, 4) / 4).astype(np.float32).tolist(), int(rng.choice(4, p=[0.7, 0.1, 0.1, 0.1]))) for k in range(300)]
    assert len(check(spark, rows, every=13)) > 50
    assert check(spark, rows, every=13, positives=2, negatives=1, low=10, high=100)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (50, [-1e-30, 3.0], 1), (None, [0.5, 1.5], 2), (None, [1.0, 2.0], 1), (3, None, 1), (4, [1.0, None], 2), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2)]
    rows += [(100, [], 2), (7, [1.5], 2), (2**60, [0.5, 0.25, 8.0], 2), (8, [0.9, 1.2], 3), (9, [0.9, 1.2], 3), (9, [0.9, 1.2], 3), (10, [1.0, 1.0], None), (150, [-1.0, -2.0], 9), (151, [1.0, 2.0], 9)]
    assert check(spark, rows)
    for few in (rows[:1], rows[:2], []):
        assert not check(spark, few)


def test_equal_vectors_of_one_label(spark):
    check(spark, [(k, [1.0, 1.0], int(k % 40 == 0)) for k in range(200)] + [(900 + k, [0.7, 1.0], 1) for k in range(5)], every=40)


def test_large_components():
    a = np.array([[2.0**31 + 1, 3.0]])
    assert negatives.scores(a, a)[0, 0] == (2**31 + 1) ** 2 + 9
    with pytest.raises(ValueError):
        negatives.scores(np.array([[2.56e12]]), np.array([[2.56e12]]))
