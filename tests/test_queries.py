"""Registered queries against DuckDB on the smallest tables.

A sample by default; CONVLAKE_ALL_QUERIES=1 runs every query that has SQL.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "chunk_counts_by_language", "w1_token_windows", "s1_read_entities", "h6_collapse_wrappers", "a2_hit_rates", "k2_rerank", "a7_grade_summary",
    "w2_fill_gaps", "w3_resolve_overlaps", "w4_merge_close_segments", "w6_merge_same_role", "w26_rechunk_words", "w7_forecast_labels",
    "a14_forecast_metrics", "w14_endpoint_latency", "a9_latency_distribution", "j7_nearest_in_time", "j9_fifo_match", "a30_phase_timestamps",
    "u7_build_edges", "j4_fuzzy_link", "j5_lookup_exact_then_contains", "k4_diverse_quota_sample", "s13_extract_links", "t3_speculation_batch",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
NAMES = sorted(entry.oracle_sql()) if os.environ.get("CONVLAKE_ALL_QUERIES") else SAMPLE


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6f}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in TABLES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["w3_resolved_timeline"])
def test_turns_covered_by_a_neighbour(spark, tmp_path, name):
    """A turn shorter than what the next one reaches back has no length, or a negative one, and still counts."""
    rows = [(1, 0, "user", "x" * 50), (1, 1, "assistant", "y" * 14), (1, 2, "user", "x" * 40), (1, 3, "user", None), (1, 4, "assistant", "")]
    rows += [(2, 0, "assistant", "y"), (2, 1, "user", "x" * 30), (2, 2, "assistant", "yy"), (2, 3, "assistant", "y" * 60), (2, 4, "user", "x")]
    rows += [(3, 0, "system", "y" * 30), (3, 2, "assistant", "yyy"), (3, 3, "user", "x" * 9), (3, 5, "user", "x"), (3, 6, None, "y" * 25)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    assert want[0][0] == len(rows) and want[0][2] > 1
    assert [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()] == want
