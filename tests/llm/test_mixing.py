"""Mixing against a plain computation, and properties of the schedule."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from convlake.llm import mixing


def plain(rows, weights=(1, 2, 3), most=3.0):
    size = Counter()
    for _, source, text in rows:
        size[source] += len((text or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if most * size[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: most * size[s] for s in full}
        left -= sum(most * size[s] for s in full)
        free -= full
    digest = lambda k: hashlib.md5(f"mix:{'null' if k is None else k}".encode()).hexdigest()[:15]
    out = []
    for s in names:
        at, words = 0, int(target[s] + 1e-9)
        for k, _, t in sorted((r for r in rows if r[1] == s), key=lambda r: (digest(r[0]), len((r[2] or "").split()))):
            n = len((t or "").split())
            taken = words // size[s] * n + max(0, min(n, words % size[s] - at)) if n else 0
            out.append((str(k), n, size[s], round(target[s], 6), taken))
            at += n
    return sorted(out)


ROWS = [
    (1, "a", "one two three"), (2, "a", None), (3, "a", ""), (4, None, "x " * 700), (5, "b", "y " * 11), (6, "b", "z"), (6, "b", "z"), (None, "c", "p q r s"),
    (8, "\U0001f600", "w " * 333), (9, "zz", "v " * 5000), (10, "empty", " \n"),
]


def check(docs, rows, block):
    got = mixing.mixed_sizes(docs, block=block).collect()
    assert sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == plain(rows)


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_sizes(spark, block):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, source string, text string, size string, no int")
    check(docs, ROWS, block)
    sources = mixing.source_table(docs, block=block)
    names = {r.no: r for r in sources.collect()}
    slots = mixing.schedule(sources).collect()
    assert len({r.slot for r in slots}) == len(slots) == sum(r.slots for r in names.values())
    ranks = defaultdict(list)
    for r in sorted(slots, key=lambda r: r.slot):
        ranks[r.no].append(r["rank"])
    assert all(ranks[no] == list(range(r.slots)) for no, r in names.items() if r.slots)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs, [(r.doc_id, r.source, r.text) for r in docs.collect()], 256)


def test_sources_are_spread_over_the_schedule(spark):
    docs = spark.createDataFrame([(k, f"s{k % 4}", "w " * 1000) for k in range(80)], "doc_id long, source string, text string")
    sources = mixing.source_table(docs, block=10)
    share = {r.no: r.slots for r in sources.collect()}
    total = sum(share.values())
    seen = Counter()
    for n, r in enumerate(sorted(mixing.schedule(sources).collect(), key=lambda r: r.slot), 1):
        seen[r.no] += 1
        assert all(abs(seen[s] - n * share[s] / total) < 8 for s in share)


def test_points(spark):
    numbers = [1, 2, 3, 2**31 - 1, 2**31, 2**40 + 12345, 2**61 + 2**33 + 7, 2**62 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    got = {r.n: r.p for r in df.select("n", mixing.point(F.col("n")).alias("p")).collect()}
    assert got == {n: n * mixing.GOLDEN % 2**62 for n in numbers}
    assert mixing.GOLDEN % 2 and abs(mixing.GOLDEN / 2**62 - (5**0.5 - 1) / 2) < 1e-15


def test_mix_holds_what_it_takes(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, source string, text string, length string, pass int")
    out = mixing.mixed(docs, block=7)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[str(r.doc_id)] += len(r.text.split())
    want = Counter()
    for k, _, _, _, taken in plain(ROWS):
        want[k] += taken
    assert words == Counter({k: n for k, n in want.items() if n})


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mixed_sizes(docs).count() == 0 == mixing.mixed(docs).count()
    docs = spark.createDataFrame([(1, "a", None)], "doc_id long, source string, text string")
    assert [tuple(r) for r in mixing.mixed_sizes(docs).collect()] == [(1, 0, 0, 0.0, 0)] and mixing.mixed(docs).count() == 0


def test_mix_of_rows_with_private_names(spark):
    """Columns named like the operator's own, maps, nulls, and rows equal in all columns or in all but one."""
    names = ["_no", "_at", "_size", "_target", "_source", "_taken", "_pass", "k1", "k2", "row", "part", "copies", "id"]
    rows = []
    for k in range(60):
        text = " ".join(f"w{k}x{j}" for j in range(k % 17 * 10))
        rows += [(k % 50 if k % 9 else None, text if k % 11 else None, ["a", "b", None][k % 3], {"m": k}, *[f"{k}{n}" for n in names])] * (1 + k % 3)
    rows.append((*rows[-1][:4], *["other"] * len(names)))
    schema = "doc_id long, text string, source string, extra map<string,int>, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    got = mixing.mixed(docs, block=64)
    assert got.columns == docs.columns
    words = lambda t: len((t or "").split())
    want, seen = Counter(), Counter()
    for k, _, _, _, taken in plain([(r[0], r[2], r[1]) for r in rows]):
        want[k] += taken
    for r in got.collect():
        assert any(tuple(r)[:1] + tuple(r)[2:] == x[:1] + x[2:] and (x[1] or "").startswith(r.text) for x in rows)
        seen[str(r.doc_id)] += words(r.text)
    assert +want == seen
