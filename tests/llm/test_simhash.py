"""SimHash near-dedup against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from convlake.llm import common, simhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    n = max(1, len(w) - 3)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


def plain_components(prints, radius=4):
    """(id, print) -> least id reachable."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(prints))]


def check(rows, got):
    prints = [(k, plain_print(t)) for k, t in rows]
    want = sorted((str(k), f"{p:016x}", str(c)) for (k, p), c in zip(prints, plain_components(prints)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], simhash.near_copies(docs).collect())


def test_odd_rows(spark):
    long = "word " * 70000 + "end"
    rows = [(5, None), (3, ""), (4, " \t\n"), (9, "One two"), (9, "one TWO"), (None, "a b c d e"), (None, None), (7, long), (6, long), (8, "É b c d")]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, code string, root int")
    check(rows, simhash.near_copies(docs).collect())
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "6", "8", "9", "None"]
    assert simhash.near_copies(docs.limit(0)).count() == 0 == simhash.keep_first(docs.limit(0)).count()


@pytest.mark.parametrize("n", [1, 7, 300, 3000])
def test_index_finds_every_link(n):
    rng = np.random.default_rng(n)
    codes = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    codes[n // 2 :] = codes[: n - n // 2] ^ (np.uint64(1) << rng.integers(0, 64, n - n // 2, dtype=np.uint64)) ^ np.uint64(6)
    codes = np.unique(codes)
    index = simhash.GrayIndex(codes)
    want = np.bitwise_count(index.codes[:, None] ^ index.codes[None, :]) <= 4
    got = np.zeros_like(want)
    for a, b in index.search(index.codes, 4, later=True):
        got[a, b] = True
    assert (got == np.triu(want, 1)).all()
    got[:] = False
    for a, b in index.search(index.codes, 4):
        got[a, b] = True
    assert (got == want).all()


def test_split_buckets_give_the_same(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 40)
    rows = [(int(i), int(base[i % 40] ^ (1 << int(rng.integers(0, 60))) ^ (1 << int(rng.integers(0, 60))))) for i in range(600)]
    prints = common.staged(spark.createDataFrame(rows, "id long, code long"))
    want = plain_components(rows)
    for size in (3, 50, 8192):
        got = {r.id: r.first for r in simhash.with_components(prints, "code", prints["id"], 4, size, 2 * size).select("id", "first").collect()}
        assert [got[i] for i, _ in rows] == want


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5), (2000, 1999)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(1000, 1300)} == {1000} and got[2000] == 1999


def similar_pairs(texts, size=5, least=0.8):
    """Pairs of places whose sets of word runs have that Jaccard similarity, by comparing all."""
    sets = []
    for t in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]


def edited(rng, text, edits):
    w = text.split()
    for at in rng.choice(len(w), edits, replace=False):
        w[at] = f"edit{rng.integers(1 << 30)}"
    return " ".join(w)


def test_near_copies_beyond_one_fingerprint(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 150)) for _ in range(60)]
    texts += [edited(rng, t, 2 + k % 2) for k, t in enumerate(texts)]
    pairs = similar_pairs(texts)
    far = [p for p in pairs if (plain_print(texts[p[0]]) ^ plain_print(texts[p[1]])).bit_count() > 8]
    assert pairs and far  # one fingerprint of four-word shingles loses some
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} == set(range(len(texts))) - {j for _, j in pairs}


def test_near_fingerprints_of_unlike_texts_stay(spark):
    rows = [(0, "alpha beta gamma delta epsilon zeta eta"), (1, "alpha beta gamma delta epsilon zeta theta")]  # two of four shingles
    base = " ".join(f"v{i}" for i in range(200))
    rng = np.random.default_rng(6)
    rows += [(10 + k, edited(rng, base, 6)) for k in range(60)]  # near in bits, some similar and some not
    texts = [t for _, t in rows]
    near = [(i, j) for j in range(len(texts)) for i in range(j) if (plain_print(texts[i]) ^ plain_print(texts[j])).bit_count() <= 8]
    assert set(near) - set(similar_pairs(texts))  # eight bits alone would remove some
    first = list(range(len(texts)))
    for _ in texts:
        for i, j in similar_pairs(texts):
            first[i] = first[j] = min(first[i], first[j])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} == {rows[i][0] for i in first}


def plain_roots(n, pairs):
    root = list(range(n))
    for _ in range(n):
        before = root[:]
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
        if before == root:
            return root


def test_forest_of_near_pairs():
    rng = np.random.default_rng(7)
    codes = (rng.integers(0, 1 << 62, 5)[rng.integers(0, 5, 300)].astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 2
    for cut in (None, 100):
        a, b = simhash.near_pairs(codes[:cut], None if cut is None else codes[cut:], 2)
        pairs = [(i, j) for i, j in np.argwhere(np.triu(near, 1)).tolist() if cut is None or i < cut <= j]
        assert len(a) < 300 and plain_roots(300, list(zip(a.tolist(), b.tolist()))) == plain_roots(300, pairs)


@pytest.mark.parametrize("split", [False, True])
def test_forest_of_similar_sets(split):
    rng = np.random.default_rng(8)
    bases = [rng.choice(10000, int(n), replace=False) for n in (1, 4, 5, 40, 200)]
    sets = [np.zeros(0, np.uint64)] * 2
    for k in range(150):
        base = bases[k % 5].copy()
        base[rng.random(len(base)) < 0.1] += 20000 + 100000 * k
        sets.append(np.unique(base[rng.random(len(base)) < 0.98]).astype(np.uint64))
    late = rng.random(len(sets)) < 0.5 if split else None
    label = np.where(rng.random(len(sets)) < 0.1, 1000, np.arange(len(sets)))
    given = [(i, j) for j in range(len(sets)) for i in range(j) if label[i] == label[j]]
    alike = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    plain = [set(s.tolist()) for s in sets]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if alike(plain[i], plain[j]) and (late is None or late[i] != late[j])]
    a, b = simhash.similar_forest(sets, label, late, 0.8)
    found = list(zip(a.tolist(), b.tolist()))
    assert len(found) < len(sets) and all(alike(plain[i], plain[j]) and label[i] != label[j] for i, j in found)
    assert plain_roots(len(sets), given + found) == plain_roots(len(sets), given + pairs)


def test_groups_cut_into_chunks(spark):
    rng = np.random.default_rng(9)
    base = [" ".join(f"u{x}" for x in rng.integers(0, 5000, 200)) for _ in range(2)]
    texts = [t for b in base for t in [edited(rng, b, 4 + k % 4) for k in range(40)]] + ["", " ", "A b", "a B"]
    first = plain_roots(len(texts), similar_pairs(texts))
    assert 2 < len(set(first)) < len(texts)
    docs = common.staged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for size in (1 << 22, 20000, 4000):
        assert {r.doc_id for r in simhash.keep_first(docs, chunk_bytes=size).collect()} == set(first), size


def shuffled_bytes(spark):
    sc, none = spark.sparkContext, spark._jvm.java.util.ArrayList()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(spark._jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_only_candidates_are_dealt(spark):
    """Of texts without near copies a join may move none but to return them, however it is planned."""
    rng = np.random.default_rng(10)
    texts = [" ".join(f"{x:x}" for x in rng.integers(0, 1 << 62, 1500)) for _ in range(150)]
    texts += [edited(rng, texts[0], 3), edited(rng, texts[1], 3)]
    docs = common.staged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    once = docs.repartition(4, "doc_id")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = shuffled_bytes(spark)
        once.write.format("noop").mode("overwrite").save()
        b = shuffled_bytes(spark)
        kept = {r.doc_id for r in common.staged(simhash.keep_first(docs)).select("doc_id").collect()}
        c = shuffled_bytes(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert kept == set(range(150)) and c - b < 1.5 * (b - a)


def test_rows_perhaps_among_keys(spark):
    rows = spark.range(200000).select("id", F.xxhash64("id").alias("k"))
    for wanted in (0, 1, 3000):
        keys = common.staged(rows.where(F.col("id") < wanted))
        found = {r.id for r in common.perhaps_among(rows, F.col("k"), keys.select("k"), "k").collect()}
        assert set(range(wanted)) <= found and len(found) <= wanted + 200000 // 16


def test_near_pairs_without_comparing_all(monkeypatch):
    """Codes that are not near are hardly compared, so a bucket's work does not follow the square of its codes."""
    rng = np.random.default_rng(11)
    codes = rng.integers(0, 1 << 64, 12000, dtype=np.uint64)
    copied = codes[:300].copy()
    for _ in range(8):
        copied ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    codes = np.concatenate([codes, copied])
    count, compared = np.bitwise_count, []
    monkeypatch.setattr(np, "bitwise_count", lambda x, **kw: compared.append(x.size) or count(x, **kw))
    a, b = simhash.near_pairs(codes, None, 8)
    found = {tuple(sorted(x)) for x in zip(a.tolist(), b.tolist())}
    assert {(i, 12000 + i) for i in range(300)} <= found and len(found) < 310
    assert sum(compared) < len(codes) ** 2 / 20


def test_large_groups_and_chunks_of_candidates(spark):
    """Groups beyond the rows that are all compared, buckets by some bits and chunks join what all pairs join."""
    rng = np.random.default_rng(12)
    codes = rng.integers(0, 1 << 64, (900, 2), dtype=np.uint64)
    for which, size in ((0, 400), (1, 300)):  # chains and dense groups in one of two fingerprints
        for i in range(size):
            step = np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, 1 + i % 5, dtype=np.uint64))
            codes[which * 450 + i, which] = codes[which * 450 + (0 if i % 3 else max(0, i - 1)), which] ^ (step if i else np.uint64(0))
    near = (np.bitwise_count(codes[:, None] ^ codes[None]) <= 8).any(axis=2)
    want = plain_roots(900, np.argwhere(np.triu(near, 1)).tolist())
    assert 2 < len(set(want)) < 700
    rows = [(i, c.tolist()) for i, c in enumerate(codes.view(np.int64))]
    nodes = common.staged(spark.createDataFrame(rows, "node long, codes array<long>"))
    for sizes in ((8192, 1 << 18), (8192, 300), (20, 300)):
        found = simhash.candidates(nodes, 2, 8, *sizes).collect()
        assert plain_roots(900, [(r.a, r.b) for r in found]) == want, sizes
