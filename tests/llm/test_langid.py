"""Language ID: held-out accuracy, rejection, odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from convlake.llm import langid, queries


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    got = queries.op9_language_id(spark, path).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in lang if zlib.crc32(str(k).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.98
    assert np.mean([r.rejected for r in got]) <= 0.01
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(k, t, lang) for k in range(60) for t, lang in ((f"the cat and the dog number {k} were here with them", "xx"), (f"der hund und die katze {k} waren nicht mit ihnen", "yy"))]
    rows += [(None, "the dog", "xx"), (200, None, "xx"), (201, "", None), (202, "123 ... 456!", "yy"), (203, "你好世界" * 9, None), (204, "the dog with them " * 60000, None)]
    docs = spark.createDataFrame([(*r, 0.5, "no") for r in rows], "doc_id long, text string, lang string, score double, rejected string")
    got = {(r.doc_id, r.text): r for r in langid.identified(docs).collect()}
    assert len(got) == len(rows)
    for key, text, lang in rows:
        r = got[key, text]
        if key in (200, 201, 202):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in ("xx", "yy") and (lang is None or r.lang_pred == lang)
    assert got[203, rows[-2][1]].rejected and not got[204, rows[-1][1]].rejected
    model = langid.fit(docs, langid.remainder() != 2)
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.where("rejected = 'no'").count() == sum(not r.rejected for r in got.values())


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.identified(docs).select("lang_pred", "score", "rejected").collect()] == [("und", 0.0, True)]
    assert langid.identified(docs.limit(0)).count() == 0


def test_repeated_ids_are_learned_and_bounded(spark):
    text = F.concat(F.when(F.col("id") % 3 == 0, "der hund und die katze ").otherwise("the cat and the dog "), F.col("id").cast("string"), F.lit(" were"))
    docs = spark.range(3000).select(F.lit(0).cast("long").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 3 == 0, "yy").otherwise("xx").alias("lang"))
    docs = docs.union(docs)
    found = langid.sample(docs, F.lit(True), "lang", "doc_id", "text", 200)
    assert found["lang"].value_counts().to_dict() == {"xx": 100, "yy": 100}
    same = docs.withColumn("text", F.concat(F.lit("only this text "), "lang"))
    assert len(langid.sample(same, F.lit(True), "lang", "doc_id", "text", 200)) == 2
    got = langid.identified(docs.withColumn("doc_id", F.lit(1).cast("long")))
    assert got.where("rejected OR lang_pred = 'und'").count() == 0


def test_predictions_are_the_models(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs, langid.remainder() != 2)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.predict(docs, model).collect():
        points = langid.letter_runs(text[r.doc_id] or "")
        if not len(points):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        mean = np.mean([model.rows[f].astype(float) for f in langid.features(points)], axis=0) / model.temperature
        odds = np.exp(mean - mean.max())
        assert r.lang_pred == model.langs[int(odds.argmax())] and abs(r.score - odds.max() / odds.sum()) < 1e-6


def test_long_texts_are_read_in_blocks():
    model = langid.train(["aaa bbb"] * 30 + ["ccc ddd"] * 30, ["x"] * 30 + ["y"] * 30)
    text = langid.letter_runs("aaa bbb " * (langid.BLOCK // 4))
    assert np.allclose(model.logits(text), model.rows[langid.features(text)].mean(axis=0, dtype=float), atol=1e-3)
    assert model.langs[int(model.scores(text).argmax())] == "x"


def test_runs_of_letters():
    runs = "".join(map(chr, langid.letter_runs("  Ab1cD!!\nÉ ")))
    assert runs == " ab cd é " and not len(langid.letter_runs("12 \n"))
