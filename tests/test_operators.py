"""Operators against small plain-Python models and hand-made cases."""

import hashlib
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from convlake.functions import text as T
from convlake.operators import chunks as C
from convlake.operators import evaluation as EV
from convlake.operators import frames as FR
from convlake.operators import graph as G
from convlake.operators import traces as TC
from convlake.operators import turns as U
from convlake.operators import vectors as V
from convlake.plans import slices as S


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).first()[0]


# --- text ------------------------------------------------------------------------------------------


def test_tokens_split_at_unicode_space(spark):
    assert one(spark, " a b c\x1cd\n ", T.tokens) == ["a", "b", "c", "d"]
    assert one(spark, " \n", T.tokens) == []


def test_canonical_forms(spark):
    assert one(spark, "  Ěščř-ﬁ_x, (Ž)! ", T.canonicalize_text) == "escr-fi_x z"
    assert one(spark, "Černý_Pavel,_doc._Ing.", T.canonicalize_person) == "cerny pavel"
    assert one(spark, "prof. Ing. Jan Novák", T.canonicalize_person) == "jan novak"


def test_person_takes_two_python_passes(spark):
    """Each pass is a Python process for every task; composing a part of a composed text again would change nothing."""
    odd = ["Ěščř_\u0301a", "ﬁ＿x，y", "A\u1bf2Σ b_\u0344c", "İ\u0307_Σ", "\u00b4_\u1100\u1161\u11a8", "_\u0323\u0301e", "ſ\u0323\u0307, z"]
    df = spark.createDataFrame([(x,) for x in odd], "t string")
    again = df.select("t", T.canonicalize_person(F.col("t")).alias("one"), T.canonicalize_person(T.nfkc(F.replace(T.nfkc(F.col("t")), F.lit("_"), F.lit(" ")))).alias("two"))
    assert all(r.one == r.two for r in again.collect())
    plan = df.select(T.canonicalize_person(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


def test_normalise_text_keeps_lines(spark):
    assert one(spark, " a  b\r\n\r\n\r\n\r\nc​d \t", T.normalise_text) == "a b\n\ncd"


def test_hints_split_before_parentheses(spark):
    assert one(spark, "a.*.b[]/c(x/y)+..d*,a.*.b", T.answer_field_hints) == ["a.b", "c(x", "y)", "d"]


def test_grades(spark):
    rows = [("abc", " "), ("It is Oslo.", "oslo"), ("nothing here", "alpha beta gamma"), ("alpha x", "alpha beta gamma delta epsi")]
    df = spark.createDataFrame(rows, "a string, r string")
    assert [r[0] for r in df.select(T.lexical_grade(F.col("a"), F.col("r"))).collect()] == [3.0, 5.0, 1.0, 2.0]
    assert one(spark, "Well [Result] 0 done", T.parse_score) == 1
    assert one(spark, "no score", T.parse_score) is None
    assert one(spark, "TRUE!.", T.binary_form) == "yes"


def test_clean_preview(spark):
    text = "[CONTEXT] entity_type=Person | entity_id=x | email=a@b.c [FIELD=contact.details.room]\nC 12"
    assert one(spark, text, T.clean_preview) == "email=a@b.c | room: C 12"
    assert one(spark, "plain", T.clean_preview) == "plain"


# --- chunks ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size,overlap", [(5, 2), (4, 0), (7, 6)])
def test_windows_equal_model(spark, size, overlap):
    df = spark.createDataFrame([(n, [str(i) for i in range(n)]) for n in range(0, 30)], "n int, t array<string>")
    got = {}
    for r in C.token_windows(df, "t", size, overlap).collect():
        got.setdefault(r.n, {})[r.chunk_index] = r.window
    for n in range(0, 30):
        toks, want, start = [str(i) for i in range(n)], [], 0
        while n and (not want or start - (size - overlap) + size < n):
            want.append(toks[start : start + size])
            start += size - overlap
        assert [got.get(n, {})[i] for i in range(len(got.get(n, {})))] == want


def test_chunk_config_is_checked():
    for bad in ({"chunk_size": 0}, {"chunk_overlap": -1}, {"chunk_size": 5, "chunk_overlap": 5}, {"chunk_impl": "x"}):
        with pytest.raises(ValueError):
            C.ChunkingConfig(**bad)


def test_short_facts_and_last_window(spark):
    recs = [("Course", "x", "p", "metadata.code", "IDS", ""), ("Course", "x", "p", "content.text", "a b", ""), ("Course", "x", "p", "publicationresults[3].citation", " ".join("abcdefghijklmnopqrstuvwxyz"), "")]
    df = spark.createDataFrame(recs, "entity_type string, entity_id string, source_path string, source_field string, text string, entity_context string")
    assert [r.source_field for r in C.build_chunks(df, C.ChunkingConfig("basic_v2")).collect()] == ["metadata.code"]
    assert {r.token_count for r in C.build_chunks(df, C.ChunkingConfig(chunk_size=20, chunk_overlap=4)).collect()} == {20, 10}


# --- vectors -----------------------------------------------------------------------------------------


def test_hash_embedding_bits(spark):
    text, dim = "to be or not to be", 16
    want = np.zeros(dim)
    for tok in text.split():
        h = hashlib.blake2b(tok.encode(), digest_size=16).digest()
        want[int.from_bytes(h[:4], "little") % dim] += (1 if h[4] % 2 == 0 else -1) * (1 + h[5] / 255)
    got = spark.createDataFrame([(text,), ("",)], "t string").select(V.hash_embedding(dim)("t")).collect()
    assert np.allclose(got[0][0], want / np.linalg.norm(want), atol=1e-6) and not np.any(got[1][0])


def test_hashed_features_by_id(spark):
    """Texts of one id are one text; sums are whole numbers until the norm; a place where tokens cancel stays."""
    want = {}
    for id, text in (texts := [(1, "to be or\u2003not"), (1, "to \x1c be"), (2, "x"), (3, " "), (4, None)]):
        for tok in (text or "").split():
            h = hashlib.md5(tok.encode()).hexdigest()
            at = want.setdefault(id, {})
            at[int(h[:7], 16) % 4] = at.get(int(h[:7], 16) % 4, 0) + (1 if int(h[8:10], 16) % 2 == 0 else -1) * (255 + int(h[10:12], 16))
    df = spark.createDataFrame(texts, "id long, text string")
    got = V.hashed_features(df, "id", "text", 4)
    assert got.dtypes == [("id", "bigint"), ("idx", "bigint"), ("value", "double")]
    norm = {id: sum(w * w for w in at.values()) ** 0.5 for id, at in want.items()}
    assert {(r.id, r.idx): r.value for r in got.collect()} == {(id, i): w / norm[id] for id, at in want.items() for i, w in at.items()}
    dense = {r.id: list(r.embedding) for r in V.hashed_vectors(df, "id", "text", 4).collect()}
    assert dense == {id: [at.get(i, 0) / norm[id] for i in range(4)] for id, at in want.items()}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_topk_memory_is_bounded():
    """Blocks hold a fixed number of bytes, however many rows a batch has, and so do scores."""
    import tracemalloc

    import pyarrow as pa

    m = np.random.default_rng(1).normal(size=(20_000, 8)).astype(np.float32)
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(m))), pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), 8).cast(pa.list_(pa.float32()))], ["id", "v"])
    blocks = list(V._pack(256 << 10)(iter([rows, rows.slice(0, 5)])))
    assert max(b.column(1)[0].as_buffer().size for b in blocks) == 256 << 10 and sum(len(b.column(0)[0]) for b in blocks) == 20_005
    whole = next(V._pack(8 << 20)(iter([rows])))
    pair = pa.RecordBatch.from_arrays([*whole.columns, *whole.columns], ["q_ids", "q_mat", "v_ids", "v_mat"])
    tracemalloc.start()
    best = list(V._score(3, True, False)(iter([pair])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in best) == 60_000 and peak < 100 << 20


@pytest.mark.parametrize("broadcast", [True, False])
def test_topk_equals_brute_force(spark, monkeypatch, broadcast):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8)).round(1)  # ties happen
    monkeypatch.setattr(V, "QUERY_ROWS", 16)
    if not broadcast:
        monkeypatch.setattr(V, "TILE_BYTES", 4096)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
    v32 = v.astype(np.float32).astype(float)
    got = {}
    for r in V.vector_topk(df.select(F.col("vec_id").alias("query_id"), "embedding"), df, 4, exclude_same=True).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    scores = v32 @ v32.T
    for q in range(300):
        order = sorted((j for j in range(300) if j != q), key=lambda j: (-scores[q, j], j))[:4]
        assert [round(scores[q, got[q][i + 1]], 9) for i in range(4)] == [round(scores[q, j], 9) for j in order]
    named = df.select(F.concat(F.lit("doc:"), F.lpad(F.col("vec_id").cast("string"), 4, "0")).alias("vec_id"), "embedding")
    rows = V.vector_topk(named.withColumnRenamed("vec_id", "query_id"), named, 4, exclude_same=True).collect()
    assert {(int(r.query_id[4:]), r["rank"], int(r.vec_id[4:])) for r in rows} == {(q, n, j) for q, found in got.items() for n, j in found.items()}
    with pytest.raises(Exception, match="not finite|non-finite"):
        V.vector_topk(df.withColumnRenamed("vec_id", "query_id"), df.withColumn("embedding", F.array(F.lit(float("nan")).cast("float"))), 1).collect()


# --- turns -------------------------------------------------------------------------------------------


def test_overlap_cases():
    u, s = U.USER, U.SYSTEM
    fold = U.resolve_segments
    assert fold([(0, s, 0, 5, ""), (1, u, 3, 8, "")]) == [(0, s, 0, 3, ""), (1, u, 3, 8, "")]
    assert fold([(0, u, 0, 5, ""), (1, s, 3, 8, "")]) == [(0, u, 0, 5, ""), (1, s, 5, 8, "")]
    assert fold([(0, u, 0, 5, ""), (1, s, 3, 4, "")]) == [(0, u, 0, 5, "")]
    assert fold([(0, s, 2, 5, ""), (1, u, 2, 8, "")]) == [(1, u, 2, 8, "")]
    assert fold([(0, s, 2, 5, ""), (1, u, 2, 8, "")], keep_current=False) == []
    assert fold([(0, u, 1, 1, "")])[0][3] == pytest.approx(1.001)


def test_resolved_timelines_are_gap_free(spark):
    rng = random.Random(5)
    rows = []
    for c in range(12):
        at = rng.choice([0.0, 1.5])
        for i in range(40 if c else 300):
            at += rng.random() * 2
            rows.append((c, i, rng.choice([U.USER, U.SYSTEM]), round(at, 2), round(at + rng.random() * 5 - 0.2, 2), "t"))
    df = spark.createDataFrame(rows, "conv int, seg long, turn string, start_s double, end_s double, text string")
    flat = U.resolve_overlaps(df, ["conv"])
    want = []
    for c in range(12):
        want += [(c, *r) for r in U.resolve_segments([r[1:] for r in rows if r[0] == c])]
    got = sorted((r.conv, r.seg, r.turn, r.start_s, r.end_s, r.text) for r in flat.collect())
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert all(abs(g[3] - w[3]) < 1e-9 and abs(g[4] - w[4]) < 1e-9 for g, w in zip(got, sorted(want)))
    line = {}
    for r in U.fill_gaps(flat, ["conv"]).orderBy("conv", "seg", "part").collect():
        assert abs(r.start_s - line.get(r.conv, 0.0)) < 1e-6 and r.end_s > r.start_s
        line[r.conv] = r.end_s
    frames = U.frames_from_turns(U.fill_gaps(flat, ["conv"]), ["conv"], 12.5)
    for r in frames.groupBy("conv").agg(F.count("*").alias("n"), F.max("idx").alias("m")).collect():
        assert r.n == r.m + 1 == round(line[r.conv] * 12.5)


def test_merge_gap_of_exactly_one_second(spark):
    df = spark.createDataFrame([("A", 0, 0.0, 1.0, "a"), ("A", 1, 2.0, 5.0, "b"), ("A", 2, 2.5, 3.0, "c"), ("A", 3, 4.5, 6.0, "d")], "spk string, seg long, start_s double, end_s double, text string")
    got = U.merge_close_segments(df, ["spk"], ["seg"], S.by_index("seg", 2), 1.0).orderBy("segment").collect()
    assert [(r.start_s, r.end_s, r.text, len(r.originals)) for r in got] == [(0.0, 3.0, "a b c", 3), (4.5, 6.0, "d", 1)]


def test_messages_for_model(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "assistant", "—"), (1, 2, "assistant", "hi"), (1, 3, "assistant", "you"), (1, 4, "user", "yo")]
    df = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string")
    got = [(r.role, r.content) for r in U.merge_same_role(df).orderBy("pos").collect()]
    assert got == [("system", "s"), ("user", "Hello."), ("assistant", "hi you"), ("user", "yo")]


def test_rechunk_words_prefix(spark):
    rows = [(1, 0, "fo"), (1, 1, "o b"), (1, 2, ""), (1, 3, "ar  "), (1, 4, " "), (1, 5, "baz"), (2, 0, "  x"), (2, 1, "y")]
    df = spark.createDataFrame(rows, "c int, i long, text string")
    got = {}
    for r in U.rechunk_words(df, "c", ["i"], S.by_index("i", 2)).orderBy("c", "word_idx").collect():
        got.setdefault(r.c, []).append(r.word)
    assert got == {1: ["foo", " bar", " baz"], 2: [" xy"]}


# --- frames -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("fold", [2, 512])
def test_cooldown_equals_model(spark, monkeypatch, fold):
    monkeypatch.setattr(FR, "FOLD", fold)
    rng = random.Random(2)
    data = {k: sorted(rng.sample(range(400), m)) for k, m in (("dense", 380), ("mid", 60), (None, 250), ("one", 1))}
    df = spark.createDataFrame([(k, i) for k, v in data.items() for i in v], "k string, idx long")
    got = {}
    for r in FR.greedy_cooldown(df, ["k"], 7, piece=16).collect():
        got.setdefault(r.k, []).append(r.idx)
    for k, v in data.items():
        keep, nxt = [], -1
        for i in v:
            if i >= nxt:
                keep.append(i)
                nxt = i + 7
        assert sorted(got[k]) == keep


def test_turn_metrics_equal_model(spark):
    rng = random.Random(4)
    labels = [0] * 3 + [3] * 90 + [1] * 4 + [3] * 5 + [1] * 2 + [3] * 30
    probs = [rng.random() for _ in labels]
    frames = spark.createDataFrame([("s", i, l) for i, l in enumerate(labels)], "k string, idx long, label int")
    scores = spark.createDataFrame([("s", i, h, p) for i, p in enumerate(probs) for h in (4, 8)], "k string, idx long, horizon int, prob double")
    grid = [0.2, 0.5, 0.9]
    got = {(r.run_start, r.horizon, r.th_idx): r for r in FR.turn_metrics(FR.turn_scores(scores, frames, ["k"], 10.0, 1.0), ["k"], grid, piece=16).collect()}
    assert {k[0] for k in got} == {3, 104}
    for (a, h, ti), r in got.items():
        b = r.run_end
        lead = next((b - i + 1 for i in range(max(a, b - h + 1), b + 1) if probs[i] > grid[ti]), 0)
        early, nxt = 0, a
        for i in range(a, b - h + 1):
            if probs[i] > grid[ti] and i >= nxt:
                early, nxt = early + 1, i + h
        assert (r.lead, r.early) == (lead, early)


def test_forecast_labels_cover_h_plus_one(spark):
    labels = [3, 3, 3, 1, 1, 3, 1, 3, 3]
    df = spark.createDataFrame([("s", i, l) for i, l in enumerate(labels)], "k string, idx long, label int")
    rows = FR.forecast_labels(df, ["k"], [2], 1).orderBy("idx").collect()
    assert [r.target for r in rows] == [0, 1, 1, 1, 0, 0, 0, 0, 0]
    ramp = FR.ramp_weights(FR.forecast_labels(df, ["k"], [2], 1), ["k"], 2.0, 1.0).orderBy("idx").collect()
    assert [r.weight for r in ramp] == [1.0, 2.0, 1.0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0]


# --- traces -------------------------------------------------------------------------------------------


def test_nearest_and_fifo(spark):
    a = spark.createDataFrame([("x", 10, 1), ("x", 14, 2), ("x", 90, 3)], "k string, ts long, id long")
    b = spark.createDataFrame([("x", 12, 7), ("x", 15, 8), ("y", 10, 9)], "k string, ts long, id long")
    got = TC.nearest_in_time(a, b, ["k"], "ts", "id", 5, F.floor(F.col("ts") / 8).cast("long")).collect()
    assert sorted((r.id, r.matched_id) for r in got) == [(1, 7), (2, 8)]
    ev = [("ready", 1), ("ready", 2), ("delivered", 3), ("reset", 4), ("ready", 5), ("delivered", 6)]
    df = spark.createDataFrame([("x", i, k, n) for i, (k, n) in enumerate(ev)], "k string, o long, kind string, id long")
    got = TC.fifo_match(df, ["k"], ["o"], S.by_index("o", 2)).collect()
    assert sorted((r.ready_id, r.delivered_id) for r in got) == [(1, 3), (5, 6)]


def test_drain_splits_blocks(spark):
    df = spark.createDataFrame([("x", 0, 2, 3), ("x", 1, 3, 1), ("x", 2, 20, 2)], "k string, o long, arrival long, n_samples long")
    got = sorted((r.o, r.piece, r.step) for r in TC.drain_steps(df, ["k"], "o", 1).collect())
    assert got == [(0, 0, 2), (0, 1, 3), (0, 2, 4), (1, 0, 5), (2, 0, 20), (2, 1, 21)]


def test_place_regions_equals_model(spark):
    rng = random.Random(8)
    rows = [("x", r, i, rng.randrange(200), rng.randrange(1, 20), rng.choice([0, 3])) for r in range(9) for i in range(rng.randrange(1, 5))]
    first = {r: min(x[3] for x in rows if x[1] == r) for r in range(9)}
    df = spark.createDataFrame(rows, "k string, region long, i long, first_ts long, dur_s long, wait_s long")
    got = {(r.region, r.i): r.start_s for r in TC.place_regions(df, ["k"], ["i"], S.by_index("region", 2), S.by_index("i", 2)).collect()}
    end = -1
    for r in range(9):
        cur = max(first[r], end)
        for _, _, i, _, d, w in sorted(x for x in rows if x[1] == r):
            assert got[(r, i)] == cur + w
            cur += w + d
        end = cur


# --- graph --------------------------------------------------------------------------------------------


def test_containment_equals_brute_force(spark):
    rng = random.Random(6)
    left = {"".join(rng.choice("ab ") for _ in range(rng.randrange(1, 25))).strip() or "a" for _ in range(60)}
    right = {"".join(rng.choice("ab ") for _ in range(rng.randrange(1, 14))).strip() or "b" for _ in range(60)}
    a, b = spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string")
    got = {(r.l, r.r) for r in G.containment_pairs(a, b).collect()}
    assert got == {(x, y) for x in left for y in right if x in y or y in x}


def test_first_candidate_beats_better_match(spark):
    texts = spark.createDataFrame([(1, "Alpha Beta Gamma; Delta"), (2, "Delta")], "k int, v string")
    ents = spark.createDataFrame([("e1", "Delta", 1), ("e2", "Alpha Beta", 2), ("e3", "", 0)], "id string, name string, ord int")
    got = {r.k: r.id for r in G.fuzzy_link(texts, ents, "k", "v").collect()}
    assert got == {1: "e1", 2: "e1"}  # the whole value holds both names; the first entity wins


def test_negative_sample_is_never_held(spark):
    rows = [("a", v) for v in "uvwx"] + [("b", "u"), ("c", "v"), ("c", "x"), ("full", "u"), ("full", "v"), ("full", "w"), ("full", "x"), ("full", "y")]
    got = {r.e: r.v for r in G.negative_sample(spark.createDataFrame(rows, "e string, v string"), "e", "v", "s").collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] == "y" and all((e, v) not in rows for e, v in got.items())


def test_evidence_order(spark):
    rows = [("R", "a", "b", "free_text_fallback", "p1", "f", 0.75, 1), ("R", "a", "b", "anchored_identity", "p2", "f", 0.97, 2), ("R", "a", "b", "anchored_identity", "p3", "f", 0.97, 3)]
    df = spark.createDataFrame(rows, "rel_type string, src string, dst string, source string, evidence_path string, evidence_field string, confidence double, ord long")
    assert [r.evidence_path for r in G.merge_edge_evidence(df).collect()] == ["p2"]


def test_benchmark_items_keep_last_file(spark):
    body = lambda q: json.dumps({"items": [{"id": "i1", "question": q, "expected_answer": "x"}]})
    df = spark.createDataFrame([("d/a.json", body("old")), ("d/b.json", body("new"))], "path string, body string")
    assert [(r.question, r.topic) for r in EV.explode_items(df, "struct<id:string,question:string,expected_answer:string,type:string>").collect()] == [("new", "b")]


def test_coverage_of_empty_and_repeated_units(spark):
    rows = [(1, "a|b|a", "a|b"), (2, "", "x"), (3, None, None), (4, "a|a|c", "a|a|d"), (5, "x y|z", "x y z")]
    got = {r.doc: (r.total, r.matched, round(r.coverage, 6)) for r in TC.multiset_coverage(spark.createDataFrame(rows, "doc int, s string, c string"), "doc", "s", "c").collect()}
    assert got == {1: (3, 2, 0.666667), 2: (0, 0, 1.0), 3: (0, 0, 1.0), 4: (3, 2, 0.666667), 5: (2, 2, 1.0)}


@pytest.mark.parametrize("keep_current", [True, False])
def test_overlaps_of_any_kind(spark, keep_current):
    """Nested, equal and backward overlaps, starts out of order, turns without length; slices of a few turns."""
    rng = random.Random(11)
    rows = []
    for c in [None, *range(60)]:
        for i in range(rng.choice([1, 2, 5, 30]) if c else 9000 if c == 0 else 12):
            start = rng.randrange(12) / 2 if c else i / 4 + rng.randrange(40)
            rows.append((c, i, rng.choice([U.USER, U.SYSTEM, U.SYSTEM]), start, start + rng.randrange(-1, 9) / 2, str(i)))
    df = spark.createDataFrame(rows, "conv int, seg long, turn string, start_s double, end_s double, text string")
    got = sorted(((r.conv, r.seg, r.turn, round(r.start_s, 6), round(r.end_s, 6), r.text) for r in U.resolve_overlaps(df, ["conv"], keep_current).collect()), key=str)
    want = []
    for c in [None, *range(60)]:
        want += [(c, *r) for r in U.resolve_segments([r[1:] for r in rows if r[0] == c], keep_current)]
    assert got == sorted(((c, s, t, round(a, 6), round(b, 6), x) for c, s, t, a, b, x in want), key=str)


def plain_turn(probs, a, b, h, t):
    """Lead and early triggers of the turn from frame a to b; ``probs`` maps the scored frames."""
    lead = max((b - i + 1 for i in range(max(a, b - h + 1), b + 1) if probs.get(i, -1) > t), default=0)
    early, nxt = 0, a
    for i in range(a, b - h + 1):
        if i >= nxt and probs.get(i, -1) > t:
            early, nxt = early + 1, i + h
    return lead, early


def check_turns(spark, probs, turns, horizons, grid, piece):
    rows = [("s", a, b, h, i, p) for a, b in turns for i, p in probs.items() if a <= i <= b for h in horizons]
    scored = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "run_start", "run_end", "horizon", "idx", "prob"]))
    got = {(r.run_start, r.horizon, r.th_idx): (r.lead, r.early) for r in FR.turn_metrics(scored, ["k"], grid, piece).collect()}
    assert got == {(a, h, k): plain_turn(probs, a, b, h, t) for a, b in turns for h in horizons for k, t in enumerate(grid)}


@pytest.mark.parametrize("fold", [2, 3])
def test_turn_pieces_compose(spark, monkeypatch, fold):
    """Several levels of pieces, some of them without scores; a horizon longer than a piece."""
    monkeypatch.setattr(FR, "FOLD", fold)
    rng = random.Random(fold)
    probs = {i: rng.random() for i in range(700) if i // 9 % 4}
    check_turns(spark, probs, [(0, 99), (100, 611), (620, 625), (630, 699)], (3, 7, 13), [0.3, 0.6, 0.95], 8)


def test_turn_of_a_million_frames(spark):
    rng = np.random.default_rng(1)
    probs = dict(enumerate(rng.random(1_000_000).tolist()))
    check_turns(spark, probs, [(0, 999_999)], (6,), [0.5, 0.9], FR.PIECE)


@pytest.mark.parametrize("shard", [2_000_000, 12])
def test_containment_by_automata(spark, monkeypatch, shard):
    """Both directions, nested and overlapping needles, non-ASCII and repeated texts; one automaton or a grid of them."""
    monkeypatch.setattr(G, "SHARD_CHARS", shard)
    rng = random.Random(shard)
    make = lambda n: "".join(rng.choices("abéß😀 ", k=n))
    ls = [make(rng.randrange(1, 9)) for _ in range(60)] + ["abab" * 20, "ab", "ab", "", None]
    rs = [make(rng.randrange(1, 6)) for _ in range(50)] + ["bab", "ab", "x" * 90, "abab" * 20, ""]
    got = G.containment_pairs(spark.createDataFrame([(x, "h") for x in ls], "l string, n string"), spark.createDataFrame([(x,) for x in rs], "r string")).collect()
    want = {(a, b) for a in ls for b in rs if a and b and (a in b or b in a)}
    assert sorted(map(tuple, got)) == sorted(want)
    none = spark.createDataFrame([], "r string")
    assert G.containment_pairs(spark.createDataFrame([("a",)], "l string"), none).count() == 0


def test_items_without_an_answer(spark):
    items = spark.createDataFrame([("a", "Q1"), ("b", "Q2"), ("c", "Q3")], "item_id string, question string")
    outputs = spark.createDataFrame([("a", " yes \n"), ("c", None), ("z", "no item")], "item_id string, output_text string")
    done, missing = EV.benchmark_responses(items, outputs)
    assert sorted((r.item_id, r.answers.top1_answer, r.answers.top5_answer) for r in done.collect()) == [("a", "yes", "yes"), ("c", None, None)]
    assert [tuple(r) for r in missing.collect()] == [("b", "Q2")]


def test_python_batches_are_bounded(spark):
    """A Python worker gets long texts a few megabytes at a time, not 10,000 rows or 64 MB."""
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    texts = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("t"))
    assert max(r.n for r in texts.mapInArrow(sizes, "n long").collect()) < 10_000_000


def test_entity_files_are_spread(spark):
    """A small file of many rows is one task, unless its rows are dealt to all cores before they are turned into JSON."""
    from convlake.workloads.chunks import entity_files
    from convlake.workloads.registry import Tables

    files = entity_files(Tables(spark, "/root/testdata/sf0.01")).filter("path LIKE 'courses/%'")
    held = [r.n for r in files.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(held) >= 4 and max(held) <= 0.4 * sum(held)
