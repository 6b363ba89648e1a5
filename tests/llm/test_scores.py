"""Cross-entropy difference and importance resampling against plain computations."""

import math
from collections import Counter

import numpy as np
import pytest

from convlake.llm import entropy, importance, words

DOCS = [(1, "the good words are here"), (2, "the good words"), (3, "zq zq zq"), (4, None), (5, ""), (6, "é the good"), (6, "é the good"), (None, "the bad")]


def model(texts, weight=4.0):
    counts = [Counter() for _ in range(5)]
    for t in texts:
        data = bytes(3) + (t or "").encode()
        for i in range(3, len(data)):
            for n in range(1, 5):
                counts[n][data[i - n + 1 : i + 1]] += 1
                counts[n - 1]["", data[i - n + 1 : i]] += 1  # contexts of length n - 1, apart from grams

    def loss(text):
        data, total = bytes(3) + (text or "").encode(), 0.0
        for i in range(3, len(data)):
            p = 1 / 256
            for n in range(1, 5):
                p = (counts[n][data[i - n + 1 : i + 1]] + weight * p) / (counts[n - 1]["", data[i - n + 1 : i]] + weight)
            total -= math.log(p)
        return total

    return loss


@pytest.mark.parametrize("sent", [1 << 22, 0])
def test_entropy(spark, sent):
    docs = spark.createDataFrame([(*r, "x", 1) for r in DOCS], "doc_id long, text string, gram string, tokens int")
    good = spark.createDataFrame([(1, 5), (2, 5), (2, 5), (None, 1), (77, 1)], "doc_id long, text int")
    got = entropy.scored(docs, good, sent_grams=sent).collect()
    target, every = model([t for k, t in DOCS if k in (1, 2)]), model([t for _, t in DOCS])
    want = []
    for k, t in DOCS:
        n = len((t or "").encode())
        want.append((str(k), n, *((round(target(t) / n, 6), round(every(t) / n, 6), round((every(t) - target(t)) / n, 6)) if n else (None,) * 3)))
    near = lambda x: None if x is None else round(x, 6)
    rows = [(str(r.doc_id), r.n_tokens, near(r.target_loss), near(r.background_loss), near(r.score)) for r in got]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert entropy.scored(docs.limit(0), good, sent_grams=sent).count() == 0
    assert entropy.scored(docs, good.limit(0), sent_grams=sent).where("abs(target_loss - ln(256)) > 1e-9").count() == 0


def test_gram_pieces_of_long_texts():
    text = bytes(range(256)) * (entropy.CHUNK // 100)
    grams = np.concatenate([g for _, _, g in entropy._pieces(iter([b"ab", None, text]))])
    assert len(grams) == 2 + len(text) and grams[0] == ord("a") and grams[1] == ord("a") << 8 | ord("b")
    data = np.frombuffer(bytes(3) + text, np.uint8).astype(np.uint32)
    assert (grams[2:] == (data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:])).all()
    keys = np.unique(grams)
    assert (entropy.Lookup(keys, keys.astype(float))[grams] == grams).all()


def test_importance(spark):
    rows = [(k, f"good fine text number{k % 7} of the kind") for k in range(40)] + [(k, f"junk ### %%% {k} ###") for k in range(40, 50)]
    rows += [(50, None), (51, " "), (52, "good " * 50000), (None, "good text"), (None, None), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rank int")
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(50)] + [(1, 1), (None, 1), (45, None)], "doc_id long, quality int")
    got = importance.resampled(docs, labels).collect()
    # the model by plain counts
    raw, target = np.ones(importance.BUCKETS), np.ones(importance.BUCKETS)
    held = []
    for k, t in rows:
        got_words = [x for x in words.batches([(t or "").encode()])]
        held.append(importance.bucket_rows(got_words[0], importance.BUCKETS)[0] if got_words else np.zeros(0, int))
        np.add.at(raw, held[-1], 1)
        if k is not None and k < 40:
            np.add.at(target, held[-1], 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    want = sorted((str(k), len((t or "").split()), round(float(ratio[b].sum()), 3)) for (k, t), b in zip(rows, held))
    assert sorted((str(r.doc_id), r.n_words, round(r.log_ratio, 3)) for r in got) == want
    share = 42 / 52  # of the labels that are 0 or 1
    assert sum(r.selected for r in got) == math.ceil(share * len(rows))
    ranked = sorted(got, key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(rows) + 1)) and all(a.draw >= b.draw for a, b in zip(ranked, ranked[1:]))
    assert {r.doc_id for r in got if not r.selected} & set(range(40, 50)) and sum(r.selected for r in got if r.doc_id is not None and r.doc_id < 40) >= 39
    again = importance.resampled(docs.repartition(3), labels).collect()
    assert {(r.doc_id, r.draw, r.selected) for r in again} == {(r.doc_id, r.draw, r.selected) for r in got}
    assert importance.resampled(docs.limit(0), labels).count() == 0
    assert importance.resampled(docs, labels.limit(0)).where("selected").count() == len(rows)


def test_draws_follow_the_gumbel_distribution(spark):
    docs = spark.createDataFrame([(k, None) for k in range(4000)], "doc_id long, text string")
    draws = np.array([r.draw for r in importance.resampled(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()])
    assert abs(draws.mean() - 0.5772) < 0.08 and abs(draws.std() - 1.2825) < 0.08
