"""Extension points exercised on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.functions import hooks as H
from convlake.operators import chunks as C
from convlake.operators import questions as Q
from convlake.plans import slices as S
from convlake.sources import entities as E
from convlake.streaming.ordered import fold_sorted
from convlake.streaming.signals import cooldown_machine
from convlake.workloads import views as VW
from convlake.workloads.chunks import DOC_TOKENS, LEAVES, SPACE, doc_records, entity_files
from convlake.workloads.registry import query


@query("h14_flatten_answer", """
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')), CAST(p_partkey AS VARCHAR)], lambda x: length(x) >= 4))), '|') AS targets FROM part""")
def _(t):
    """Answers that mix text, numbers, booleans and nested lists."""
    answer = F.to_json(F.struct(F.col("p_name").alias("a"), F.array(F.struct(F.col("p_brand").alias("b"), F.lit(True).alias("c"))).alias("d"), F.col("p_partkey").alias("e"), F.lit(" ").alias("f")))
    return t.part.select("p_partkey", F.array_join(F.sort_array(E.answer_targets(answer)), "|").alias("targets"))


@query("x1_header_builder", f"""WITH {DOC_TOKENS} SELECT chunk_id, md5('## ' || source_field || chr(10) || chunk_text) AS m FROM chunks""")
def _(t):
    cfg = C.ChunkingConfig(include_metadata_header=True)
    ch = C.build_chunks(doc_records(t), cfg, header=lambda df: F.concat(F.lit("## "), "source_field"))
    return ch.select("chunk_id", F.md5("embedding_text").alias("m"))


def letter_counts():
    """A toy embedder: counts of five letters."""
    import numpy as np

    return lambda texts: np.array([[s.count(c) for c in "abcde"] for s in texts], dtype=np.float32).reshape(-1, 5)


@query("x2_embedding_hook", "SELECT doc_id, " + ", ".join(f"length(text) - length(replace(text, '{c}', '')) AS n_{c}" for c in "abcde") + " FROM documents")
def _(t):
    v = H.embed_texts(t.documents, "doc_id", "text", lambda: letter_counts())
    return v.select("doc_id", *[F.col("embedding")[i].cast("long").alias(f"n_{c}") for i, c in enumerate("abcde")])


@query("x3_query_builder", f"SELECT item_id, lower(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')) || '?' AS query FROM benchmark")
def _(t):
    return H.build_queries(t.benchmark, "text", lambda q: F.concat(F.lower(q), F.lit("?"))).select("item_id", "query")


@query("x4_answer_generator", "SELECT item_id, 'I do not know.' AS answer FROM benchmark")
def _(t):
    return H.add_column(t.benchmark, "answer", "string", H.constant_answer("I do not know.")).select("item_id", "answer")


@query("x5_grader_hook", "SELECT doc_id, CASE WHEN length(text) > 1000 THEN 5 ELSE 1 END::DOUBLE AS score FROM documents")
def _(t):
    grader = lambda: lambda pdf: pdf["text"].str.len().gt(1000) * 4.0 + 1.0
    return H.add_column(t.documents.select("doc_id", "text"), "score", "double", grader).select("doc_id", "score")


@query("x6_leaf_table_function", f"WITH {LEAVES} SELECT path, source_field, text FROM leaf")
def _(t):
    files = entity_files(t)
    return files.lateralJoin(H.JsonLeaves(F.col("body").outer())).select("path", "source_field", "text")


@query("x7_ordered_fold", f"""WITH RECURSIVE {VW.FRAMES}, tr AS (SELECT user_id, idx FROM frames WHERE prob > 0.3),
k AS (SELECT user_id, min(idx) AS idx FROM tr GROUP BY 1 UNION ALL SELECT k.user_id, min(tr.idx) FROM k JOIN tr ON tr.user_id = k.user_id AND tr.idx >= k.idx + 8 GROUP BY k.user_id)
SELECT user_id, idx FROM k""")
def _(t):
    """The cooldown as a user-defined ordered fold, cut where a gap restarts it."""
    f = VW.frames(t).filter("prob > 0.3").select("user_id", F.col("idx").alias("ts_us"), F.col("idx").alias("id"))
    f = S.scan(f, ["user_id"], ["ts_us"], S.by_index("ts_us"), [S.Lag("_prev", F.col("ts_us"))])
    f = f.withColumn("_new", F.coalesce(F.col("ts_us") - F.col("_prev") >= 8, F.lit(True)).cast("long"))
    f = S.scan(f, ["user_id"], ["ts_us"], S.by_index("ts_us"), [S.RunSum("burst", F.col("_new"))])
    return fold_sorted(f, cooldown_machine(8), ["user_id", "burst"]).select("user_id", F.col("id").alias("idx"))


@query("h40_membership_items", """
WITH h AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), u AS (SELECT l_partkey, row_number() OVER (ORDER BY md5('9|' || l_partkey), CAST(l_partkey AS VARCHAR)) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT l_partkey FROM h)),
e AS (SELECT DISTINCT l_suppkey, ('0x' || md5('9|' || l_suppkey)[1:8])::BIGINT AS s FROM h),
f AS (SELECT e.l_suppkey, u.l_partkey, (u.i - e.s % u.n + u.n) % u.n AS k FROM e, u WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.l_suppkey = e.l_suppkey AND h.l_partkey = u.l_partkey))
SELECT CAST(l_suppkey AS VARCHAR) AS entity, 'supplies_yes' AS type, 'Does ' || l_suppkey || ' supply ' || arg_min(l_partkey, md5('9|yes|' || l_suppkey || '|' || l_partkey)) || '?' AS question, 'Yes' AS expected_answer FROM h GROUP BY l_suppkey
UNION ALL SELECT CAST(l_suppkey AS VARCHAR), 'supplies_no', 'Does ' || l_suppkey || ' supply ' || arg_min(l_partkey, k) || '?', 'No' FROM f GROUP BY l_suppkey""")
def _(t):
    return Q.membership_items(t.lineitem, "l_suppkey", "l_partkey", "supplies", ["Does {entity} supply {value}?"], "9")
