"""Threshold-scaled sketches against Python's sets."""

import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from convlake.llm import queries, sketches

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text, scale=8, n=5):
    w = WORD.findall(text or "")
    h = {xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), seed=42) for i in range(max(1, len(w) - n + 1))} if w else set()
    return {x for x in h if x < (1 << 64) // scale} or ({min(h)} if h else set())


def hexed(hashes):
    return "".join(f"{h:016x}" for h in sorted(hashes))


def share(a, b):
    return len(a & b) / len(a) if a else float(not b)


def check(rows, got):
    left = sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got)
    want = []
    for k, (key, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        a, b, c = plain(text), plain(edited), plain(after)
        want.append((str(key), len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), round(share(a, b), 9), round(share(a, c), 9)))
    assert left == sorted(want)


def run(spark, folder, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
    return queries.op7_document_fingerprints(spark, str(folder)).collect()


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    check(rows, queries.op7_document_fingerprints(spark, "/root/testdata/sf0.001").collect())


def test_odd_rows(spark, tmp_path):
    rows = [(9, "one two \U0001f600 four five six seven"), (8, ""), (7, None), (6, "a"), (5, "tie tie"), (5, "tie tie"), (4, "wörd " * 30000), (None, "last words here now and then")]
    check(rows, run(spark, tmp_path, [(k, t, "x", 1) for k, t in rows], "doc_id long, text string, sketch string, place int"))


def test_one_row_and_none(spark, tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    check([(1, "only one of them is here")], run(spark, tmp_path / "a", [(1, "only one of them is here")]))
    assert run(spark, tmp_path / "b", []) == []


def test_many_equal_rows(spark, tmp_path):
    """Copies are made one row at a time: no row holds an array of all of them."""
    rows = [(9, "first words of a text"), *[(5, "one two three four five six seven eight")] * 300, (2, "the last words are here")]
    check(rows, run(spark, tmp_path, rows))
    plan = sketches.with_next(spark.read.parquet(str(tmp_path / "documents.parquet")))._jdf.queryExecution().analyzed().toString()
    assert "explode" in plan and "array_repeat" not in plan


def test_merged_sketch_is_that_of_the_union(spark):
    a, b = "a b c d e f g h i j k l m n o p", "x y z a b c d e f g u v w"
    row = spark.createDataFrame([(a, b)], "a string, b string").select(*[sketches.sketch(F.col(c), scale=s).alias(f"{c}{s}") for c in "ab" for s in (2, 64)])
    for s in (2, 64):
        got = row.select(sketches.as_text(sketches.merged(F.col(f"a{s}"), F.col(f"b{s}"), s))).first()[0]
        hashes = {xxhash.xxh64_intdigest(" ".join(t.split()[i : i + 5]).encode(), seed=42) for t in (a, b) for i in range(len(t.split()) - 4)}
        assert got == hexed({h for h in hashes if h < (1 << 64) // s} or {min(hashes)})
