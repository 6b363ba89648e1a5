"""Files on disk: entities, transcripts, chunks, tables."""

import json

from pyspark.sql import functions as F

from convlake import workloads
from convlake.operators import chunks as C
from convlake.sources import entities as E
from convlake.sources import pages as P
from convlake.sources import records as R
from convlake.sources import transcripts as TR


def test_entity_files(spark, tmp_path):
    files = {
        "courses/IDS.json": {"metadata": {"code": "ÍDS x"}, "content": {"lecturer": " "}},
        "courses/nocode.json": {"metadata": {}},
        "personnel_profiles/Novák_Jan,_Ing.json": {"contact": {"details": {"e_mail": "a@b"}}},
        "projects/p1.json": {"title": "One  Title", "deep": [{"x": [["y", {"z": "w"}]]}]},
        "note.json": {"a": 1, "b": None},
    }
    for name, body in files.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps(body, ensure_ascii=False))
    e = E.read_entities(spark, str(tmp_path))
    got = {(r.entity_type, r.entity_id) for r in e.collect()}
    assert got == {("Course", "ids x"), ("Course", "nocode"), ("Person", "novak jan"), ("Project", "one title"), ("Document", "note")}
    leaves = {(r.entity_id, r.source_field): r.text for r in E.flatten_leaves(e).collect()}
    assert leaves == {("ids x", "metadata.code"): "ÍDS x", ("novak jan", "contact.details.e_mail"): "a@b", ("one title", "title"): "One  Title", ("one title", "deep[0].x[0][0]"): "y", ("one title", "deep[0].x[0][1].z"): "w"}


def test_chunk_files_round_trip(spark, tmp_path):
    rec = spark.createDataFrame([("Course", "x", "p", "f", " ".join(str(i) for i in range(50)), "")], "entity_type string, entity_id string, source_path string, source_field string, text string, entity_context string")
    ch = C.build_chunks(rec, C.ChunkingConfig(chunk_size=20, chunk_overlap=5))
    R.write_chunks(ch, str(tmp_path / "c"))
    back = R.read_chunks(spark, str(tmp_path / "c"))
    assert sorted(back.collect()) == sorted(ch.collect()) and back.count() == 3


def test_tsv_is_sorted(spark, tmp_path):
    df = spark.createDataFrame([(3.0, "c"), (1.0, "a"), (2.0, "b")], "timestamp double, nickname string")
    R.write_tsv(df, str(tmp_path / "t"), "timestamp")
    lines = [r.value for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert sorted(set(lines)) == ["a", "b", "c", "nickname"]


def test_timed_line_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# file.sph\n# Transcribed by x\n\n0.10 2.5 A: hello: you \n3 4 B: b\n")
    got = [(r.start_s, r.end_s, r.speaker, r.text) for r in TR.read_timed_lines(spark, str(tmp_path / "a.txt")).collect()]
    assert got == [(0.1, 2.5, "A", "hello: you"), (3.0, 4.0, "B", "b")]


def test_trace_files(spark, tmp_path):
    d = tmp_path / "item1"
    d.mkdir()
    (d / "output.timings.json").write_text(json.dumps({"generations": [{"status": "completed", "llm_first_token_sec": 2.5}], "speculation_attempts": [], "vad_pause_detection_times_sec": [1.0, 2.0]}))
    g, a, p = TR.explode_traces(TR.read_traces(spark, str(tmp_path)))
    assert [(r.item, r.llm_first_token_sec) for r in g.collect()] == [("item1", 2.5)] and a.count() == 0 and p.count() == 2


def test_pages(spark):
    html = '<title>T &amp; x</title><h2>List</h2><ul><li><a class="c" href="/a?b">one  <b>1</b></a></li><li><a href="/a?b">again</a></li></ul><!-- <p>no</p> --><p>text</p><a href="rel#f">r</a><a href="//h.org/">h</a>'
    df = spark.createDataFrame([(1, "http://s.org/d/p.html?q", html)], "page_id int, url string, html string")
    links = sorted((r.link, r.text, r.heading) for r in P.extract_links(df).collect())
    assert links == [("http://h.org/", "h", "List"), ("http://s.org/a?b", "one 1", "List"), ("http://s.org/d/rel#f", "r", "List")]
    assert P.page_text(P.extract_sections(df)).first().text == "T & x\nList\n- one 1\n- again\ntext"


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, name string, p string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", None)], "id int, name string, p string")
    assert sorted(tuple(r) for r in R.upsert_nodes(old, new, "id").collect()) == [(1, "a", "x"), (2, "b", "y"), (3, "c", None)]
    assert R.duplicate_keys(old.union(old.filter(F.col("id") == 1)), ["id"]).first().copies == 2
    wide = spark.createDataFrame([(1, "a", "m1"), (2, "b", "m2"), (None, "n", "m0")], "id int, name string, mail string")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 6), (None, "q", 7)], "id int, name string, age int")
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, R.upsert_nodes(wide, new, "id").collect()), key=key) == [(1, "a", "m1", None), (2, "b", "m2", 5), (3, "c", None, 6), (None, "q", "m0", 7)]
    assert sorted(map(tuple, R.upsert_nodes(wide, new, "id", null_overwrites=True).collect()), key=key)[1] == (2, None, "m2", 5)


def test_wrapper_counts_are_not_broadcast(spark, tmp_path):
    body = json.dumps({"about": [{"text": "a"}, {"text": "b"}], "roles": [{"organization": {"value": "G"}}], "name": "N"})
    spark.createDataFrame([(str(i), body) for i in range(9)], "path string, body string").write.parquet(str(tmp_path / "in"))
    leaves = E.flatten_leaves(spark.read.parquet(str(tmp_path / "in")))
    out = E.collapse_wrappers(leaves, "path")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted((r.source_field, r.text) for r in out.filter("path = '4'").collect()) == [("about", "a\n\nb"), ("name", "N"), ("roles[0].organization", "G")]


def test_traces_are_read_once(spark, tmp_path):
    body = json.dumps({"generations": [{"generation_index": 0, "status": "completed"}, {"generation_index": 1}], "vad_pause_detection_times_sec": [1.5, 2.0]})
    df = spark.createDataFrame([("a", body), ("b", "{}"), ("c", json.dumps({"speculation_attempts": [{"attempt_index": 3, "trigger_time_sec": 0.5}]}))], "item string, body string")
    rows = sorted((r.item, r.kind, r.pos, (r.generations or r.attempts or [None])[0], r.pauses) for r in TR.trace_rows(df).collect())
    assert rows == [("a", "generations", 0, 0, None), ("a", "generations", 1, 1, None), ("a", "pauses", 0, None, 1.5), ("a", "pauses", 1, None, 2.0), ("c", "attempts", 0, 3, None)]
    plan = workloads.QUERIES["s6_explode_traces"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
