"""Substring dedup against counting every window."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from convlake.llm import factors, words

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(rows, window):
    split = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((str(key), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def got(docs, window):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in factors.remove_repeats(docs, window).collect())


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(docs, 35) == plain([(r.doc_id, r.text) for r in docs.collect()], 35)


@pytest.mark.parametrize("window,letters", [(5, "ab"), (6, "abcdefgh"), (4, "abcdefghijklmnopqrstuvwxyz"), (1, "abcd")])
def test_many_repeats(spark, window, letters):
    rng = random.Random(window)
    rows = []
    for k in range(40):
        if rows and rng.random() < 0.5:  # a copy with edits, or with other surroundings
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(letters)
            w = w[rng.randrange(4) :] + rng.choices(letters, k=rng.randrange(6))
        else:
            w = rng.choices(letters, k=rng.randrange(30))
        rows.append((k, rng.choice([" ", "\n", " \t"]).join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, window) == plain(rows, window)


def test_odd_rows(spark):
    part = " ".join(f"w{i}" for i in range(60))
    rows = [(None, part), (1, None), (2, ""), (3, " \n "), (4, "é " * 40), (5, f"a {part} b"), (5, f"x  {part}\ty"), (6, "same " + part), (6, "same " + part), (2**60 + 1, "z " * 50000 + part)]
    docs = spark.createDataFrame([(k, t, "h", 1) for k, t in rows], "doc_id long, text string, ranges string, k1 int")
    assert got(docs, 35) == plain(rows, 35)
    assert factors.remove_repeats(docs.limit(0)).count() == 0


def test_passages_shared_with_doubled_rows_only(spark):
    rows = []
    for k in range(40):
        w = [f"p{k}_{i}" for i in range(7)]
        doubled = (1000 + 7 * k, f"c{k} d{k} " + " ".join(w) + f" e{k}")
        rows += [doubled, doubled, (2000 + 3 * k, " ".join(w) + f" f{k} g{k}")]
        # a window in one row and a doubled one, its runs of three words apart in a third row
        w = [f"q{k}_{i}" for i in range(5)]
        doubled = (3000 + 7 * k, f"c{k} " + " ".join(w) + f" h{k}")
        rows += [doubled, doubled, (4000 + 3 * k, f"i{k} " + " ".join(w)), (5000 + 5 * k, " ".join(f"{' '.join(w[i : i + 3])} j{k}_{i}" for i in range(3)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, 5) == plain(rows, 5)


def test_word_hashes_follow_the_words():
    text = ("a bb  ccc\ta bb\x0bé é " + "x" * (words.BLOCK + 5) + " a bb ccc").encode()
    starts, ends = words.places(text)
    w = [text[a:b] for a, b in zip(starts, ends)]
    assert w == [x.encode() for x in WORD.findall(text.decode())]
    h = words.hashes(text, starts, ends)
    assert len(set(h.tolist())) == len(set(w)) and all((h[i] == h[j]) == (w[i] == w[j]) for i in range(len(w)) for j in range(i))
    runs = words.runs(h, 2)
    assert runs[0] == runs[-2] and runs[1] == runs[-1] and len(set(runs.tolist())) == len(runs) - 3
    long = np.tile(h, words.BLOCK // 4)
    runs = words.runs(long, 3)
    assert (runs[: len(h)] == runs[len(long) - 2 * len(h) : len(long) - len(h)]).all()
