"""Vector search, re-ranking, hit rates, grades."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.functions import text as T
from convlake.operators import chunks as C
from convlake.operators import evaluation as EV
from convlake.operators import vectors as V
from convlake.session import staged
from convlake.workloads.chunks import DOC_TOKENS, SPACE, TOKS, doc_chunks
from convlake.workloads.registry import Tables, query

# Every vector is a query; its label picks what is asked for and where chunks come from.
FIELD = """CASE {l} % 5 WHEN 0 THEN 'contact.details.work_phone' WHEN 1 THEN 'contact.details.e_mail'
  WHEN 2 THEN 'content.department' WHEN 3 THEN 'team.leader' ELSE 'about.text' END"""
DATASET = """CASE {l} % 7 WHEN 0 THEN 'SET_courses_structured' WHEN 1 THEN 'SET_courses_longform' WHEN 2 THEN 'SET_groups_v1'
  WHEN 3 THEN 'SET_personnel_v1' WHEN 4 THEN 'SET_projects_v1' WHEN 5 THEN 'SET_projects_v2' ELSE 'misc_set' END"""
QUESTION = """CASE {l} % 5 WHEN 0 THEN 'What is the work phone?' WHEN 1 THEN 'Which e-mail?' WHEN 2 THEN 'Which Department runs it?'
  WHEN 3 THEN 'Who is the contact of the group?' ELSE 'What is it about?' END"""
ANSWER_FIELD = """CASE {l} % 5 WHEN 0 THEN 'contact.details.work_phone' WHEN 1 THEN 'contact.details' WHEN 2 THEN 'department'
  WHEN 3 THEN 'team.*.name' ELSE 'about.text(first)' END"""


def pool(t: Tables, k: int):
    e = t.embeddings
    hits = V.vector_topk(e.select(F.col("vec_id").alias("query_id"), "embedding"), e, k, exclude_same=True)
    v = e.select("vec_id", F.expr(FIELD.format(l="label")).alias("source_field"), F.col("label").alias("vlabel"))
    q = e.select(
        F.col("vec_id").alias("query_id"), F.col("label").alias("qlabel"), F.expr(QUESTION.format(l="label")).alias("question"),
        F.lit("").alias("item_type"), F.expr(ANSWER_FIELD.format(l="label")).alias("answer_field"), F.expr(DATASET.format(l="label")).alias("dataset"),
    )
    return hits.join(v, "vec_id").join(q, "query_id")


POOL = f"""
sims AS (SELECT q.vec_id AS query_id, v.vec_id, q.label AS qlabel, v.label AS vlabel,
           list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
         FROM embeddings q, embeddings v WHERE q.vec_id <> v.vec_id),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sims QUALIFY rank <= 40),
bon AS (SELECT *, {FIELD.format(l="vlabel")} AS source_field,
   CASE qlabel % 5
     WHEN 0 THEN CASE vlabel % 5 WHEN 0 THEN 0.5 + 0.65 WHEN 1 THEN -0.2 ELSE 0 END
     WHEN 1 THEN CASE vlabel % 5 WHEN 0 THEN 0.35 - 0.15 WHEN 1 THEN 0.35 + 0.65 ELSE 0 END
     WHEN 2 THEN CASE vlabel % 5 WHEN 2 THEN 0.2 + 0.8 ELSE 0 END
     WHEN 3 THEN CASE vlabel % 5 WHEN 3 THEN 0.7 WHEN 4 THEN -0.35 ELSE 0 END
     ELSE CASE vlabel % 5 WHEN 4 THEN 0.5 ELSE 0 END END AS bonus FROM pool),
rer AS (SELECT query_id, vec_id, qlabel, vlabel, source_field, score AS dense_score, CAST(bonus AS DOUBLE) AS intent_bonus, score + bonus AS score, new_rank AS rank FROM
   (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score + bonus DESC, score DESC, vec_id) AS new_rank FROM bon) WHERE new_rank <= 5),
res AS (SELECT 'raw' AS technique, query_id, vec_id, qlabel, vlabel, source_field, rank FROM bon WHERE rank <= 5
        UNION ALL SELECT 'rerank', query_id, vec_id, qlabel, vlabel, source_field, rank FROM rer)
"""


@query("j6_vector_topk", f"""WITH {POOL} SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, round(score, 6) AS score FROM pool WHERE rank <= 10""")
def _(t):
    e = t.embeddings
    top = V.vector_topk(e.select(F.col("vec_id").alias("query_id"), "embedding"), e, 10, exclude_same=True)
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


FEATS = """SELECT id, idx, round(w / greatest(sqrt(sum(w * w) OVER (PARTITION BY id)), 1e-12) * 1024) AS v FROM (
  SELECT id, ('0x' || h[1:7])::BIGINT % 64 AS idx, sum((CASE WHEN ('0x' || h[9:10])::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END) * (1 + ('0x' || h[11:12])::BIGINT / 255.0::DOUBLE)) AS w
  FROM (SELECT id, md5(unnest({toks})) AS h FROM {of}) GROUP BY 1, 2)"""


FEW_HITS = 200_000


@query("j6_chunk_search", f"""WITH {DOC_TOKENS},
cf AS ({FEATS.format(toks=TOKS, of="(SELECT chunk_id AS id, chunk_text AS text FROM chunks)")}),
qf AS ({FEATS.format(toks=TOKS, of="(SELECT 'q' || item_id AS id, text FROM benchmark)")}),
sc AS (SELECT qf.id AS item_id, cf.id AS chunk_id, sum(qf.v * cf.v) AS score FROM qf JOIN cf USING (idx) GROUP BY 1, 2),
tp AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 10)
SELECT tp.item_id, rank, tp.chunk_id, score / 1048576.0::DOUBLE AS score, entity_id, token_count, contains(chunk_text, array_to_string({TOKS.replace("text", "b.text")}[1:8], ' ')) AS answer_hit
FROM tp JOIN chunks USING (chunk_id) JOIN benchmark b ON 'q' || b.item_id = tp.item_id""")
def _(t):
    """Documents to chunks, vectors, search over their text ids, chunks attached, and whether they hold the asked passage.

    Vectors are whole numbers, so equal chunks have equal scores in any order of adding.
    """
    chunks = doc_chunks(t)
    asked = t.benchmark.select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), "text")

    def vectors(df, id):
        return V.hashed_vectors(df, id, "text", 64).select(id, F.transform("embedding", lambda x: F.round(x * 1024)).alias("embedding"))

    hits = staged(V.vector_topk(vectors(asked, "query_id"), vectors(chunks.select("chunk_id", F.col("chunk_text").alias("text")), "chunk_id").withColumnRenamed("chunk_id", "vec_id"), 10))
    ids = hits.select(F.col("vec_id").alias("chunk_id")).distinct()
    # ten ids a question; where they are few, the chunks' texts are not shuffled to be cut to them
    chunks = chunks.join(F.broadcast(ids) if hits.count() <= FEW_HITS else ids, "chunk_id", "left_semi")
    hits = C.attach_chunks(hits.withColumnRenamed("vec_id", "chunk_id"), chunks.select("chunk_id", "source_path", "entity_id", F.col("token_count").cast("long").alias("token_count"), "chunk_text"), "source_path")
    start = F.array_join(F.slice(T.tokens(F.col("text")), 1, 8), " ")
    out = hits.join(asked.withColumn("start", start), "query_id")
    return out.select(
        F.col("query_id").alias("item_id"), F.col("rank").cast("long").alias("rank"), "chunk_id", (F.col("score") / 1048576.0).alias("score"),
        "entity_id", "token_count", F.contains("chunk_text", "start").alias("answer_hit"),
    )


@query("k1_topk_per_query", f"""WITH {POOL}, doc AS (SELECT doc_id, text FROM documents)
SELECT query_id, vec_id, CAST(rank AS BIGINT) AS rank, left(text, 220) AS preview FROM pool LEFT JOIN doc ON doc_id = vec_id WHERE rank <= 3""")
def _(t):
    e = t.embeddings
    hits = V.vector_topk(e.select(F.col("vec_id").alias("query_id"), "embedding"), e, 3, exclude_same=True).drop("rank")
    texts = t.documents.select(F.col("doc_id").alias("vec_id"), "text")
    top = V.topk_per_query(hits.join(texts, "vec_id", "left"), 3, "text", 220)
    return top.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), "preview")


@query("k2_rerank", f"""WITH {POOL} SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, round(dense_score, 6) AS dense_score,
round(intent_bonus, 6) AS intent_bonus, round(score, 6) AS score FROM rer""")
def _(t):
    r = V.rerank(pool(t, 40), 5)
    return r.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("dense_score", 6).alias("dense_score"), F.round("intent_bonus", 6).alias("intent_bonus"), F.round("score", 6).alias("score"))


@query("h18_intent_bonus", f"""WITH {POOL} SELECT qlabel % 5 AS asked, vlabel % 5 AS found, round(CAST(avg(bonus) AS DOUBLE), 6) AS bonus, count(*) AS n FROM bon GROUP BY 1, 2""")
def _(t):
    b = T.intent_bonus(F.col("question"), F.col("item_type"), F.col("source_field"), T.answer_field_hints(F.col("answer_field")))
    return pool(t, 40).groupBy((F.col("qlabel") % 5).alias("asked"), (F.col("vlabel") % 5).alias("found")).agg(F.round(F.avg(b), 6).alias("bonus"), F.count(F.lit(1)).alias("n"))


@query("h17_l2_normalise", """
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12))), 6) AS s
FROM embeddings""")
def _(t):
    n = V.l2_normalise(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


@query("h16_hash_embedding", f"""
WITH f AS (SELECT doc_id, md5(tok) AS h FROM (SELECT doc_id, unnest({TOKS}) AS tok FROM documents)),
g AS (SELECT doc_id, ('0x' || h[1:7])::BIGINT % 64 AS idx,
        (CASE WHEN ('0x' || h[9:10])::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END) * (1 + ('0x' || h[11:12])::BIGINT / 255.0::DOUBLE) AS w FROM f),
s AS (SELECT doc_id, idx, sum(w) AS w FROM g GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM s GROUP BY 1)
SELECT doc_id, idx, round(w / greatest(norm, 1e-12), 6) AS value FROM s JOIN n USING (doc_id) """)
def _(t):
    v = V.hashed_features(t.documents, "doc_id", "text", 64)
    return v.select("doc_id", "idx", F.round("value", 6).alias("value"))


@query("h16_hash_embedding_blake2b")
def _(t):
    """Dense vectors with the digest the stored vectors use; length one or zero."""
    v = t.documents.select("doc_id", V.hash_embedding(64)("text").alias("v"))
    return v.select("doc_id", F.size("v").cast("long").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("length"))


# --- hit rates: entity target = label, answer target = 'answer <label>' ---------------------------


TECHNIQUES = ["raw", "rerank"]


def results(t: Tables):
    """The dense and the re-ranked order of one pool, side by side."""
    p = V.score_pool(pool(t, 40)).withColumn("new_rank", F.row_number().over(V.rerank_order()))
    ranks = F.array(F.struct(F.lit("raw").alias("technique"), F.col("rank").alias("rank")), F.struct(F.lit("rerank").alias("technique"), F.col("new_rank").alias("rank")))
    both = p.select("query_id", "vlabel", "source_field", F.explode(ranks).alias("r")).filter("r.rank <= 5")
    return both.select(
        "r.technique", F.col("query_id").alias("item_id"), "r.rank", F.concat(F.lit("Label #"), F.col("vlabel").cast("string")).alias("entity_id"),
        "source_field", F.concat(F.lit("It is answer: "), (F.col("vlabel") % 4).cast("string"), F.lit(".")).alias("preview"),
    )


def questions(t: Tables):
    return t.embeddings.select(
        F.col("vec_id").alias("item_id"), F.expr(DATASET.format(l="label")).alias("dataset"),
        F.when(F.col("label") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("label "), F.col("label").cast("string")))).alias("entity_targets"),
        F.array(F.concat(F.lit("answer "), (F.col("label") % 4).cast("string"))).alias("answer_targets"),
        F.expr(ANSWER_FIELD.format(l="label")).alias("answer_field"),
    )


HITS = POOL + f""",
flags AS (SELECT technique, query_id, rank, qlabel % 3 <> 0 AND qlabel = vlabel AS e,
   CASE qlabel % 5 WHEN 0 THEN vlabel % 5 = 0 WHEN 1 THEN vlabel % 5 IN (0, 1) WHEN 2 THEN vlabel % 5 = 2 WHEN 3 THEN false ELSE vlabel % 5 = 4 END AS f,
   qlabel % 4 = vlabel % 4 AS a FROM res),
firsts AS (SELECT technique, query_id, min(CASE WHEN e THEN rank END) AS er, min(CASE WHEN f THEN rank END) AS fr, min(CASE WHEN a THEN rank END) AS ar FROM flags GROUP BY 1, 2),
qh AS (SELECT t.technique, {DATASET.format(l="label")} AS dataset, vec_id AS item_id, k, label % 3 <> 0 AS mapped,
   coalesce(er <= k, false) AS eh, coalesce(fr <= k, false) AS fh, coalesce(ar <= k, false) AS ah,
   coalesce(er <= k, false) OR coalesce(fr <= k, false) OR coalesce(ar <= k, false) AS nh,
   CASE WHEN er <= k THEN 1.0 / er ELSE 0 END::DOUBLE AS rr
 FROM embeddings, (VALUES ('raw'), ('rerank')) t(technique), (VALUES (1), (5)) kk(k)
 LEFT JOIN firsts ON firsts.technique = t.technique AND firsts.query_id = vec_id),
rates AS (SELECT technique, CAST(k AS INT) AS k, coalesce(dataset, 'overall') AS dataset, count(*) AS questions, avg(eh::INT) AS entity_hit_rate, avg(fh::INT) AS field_hit_rate,
   avg(ah::INT) AS answer_hit_rate, avg(nh::INT) AS any_hit_rate, avg(rr) AS entity_mrr
 FROM qh GROUP BY GROUPING SETS ((technique, k), (technique, k, dataset))),
macro AS (SELECT technique, k, CASE WHEN dataset = 'overall' THEN 'overall' WHEN dataset LIKE '%longform%' THEN 'longform' WHEN dataset LIKE '%courses%' THEN 'courses'
   WHEN dataset LIKE '%groups%' THEN 'groups' WHEN dataset LIKE '%personnel%' THEN 'personnel' WHEN dataset LIKE '%projects%' THEN 'projects' ELSE 'other' END AS bucket,
   avg(entity_hit_rate) AS entity_hit_rate, avg(field_hit_rate) AS field_hit_rate, avg(answer_hit_rate) AS answer_hit_rate, avg(any_hit_rate) AS any_hit_rate, avg(entity_mrr) AS entity_mrr
 FROM rates GROUP BY 1, 2, 3)
"""


def hits(t: Tables):
    return EV.question_hits(results(t), questions(t), [1, 5], TECHNIQUES)


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


SQL6 = ", ".join(f"round({c}, 6) AS {c}" for c in EV.RATES)


@query("h15_question_hits", f"""WITH {HITS} SELECT technique, dataset, item_id, k, mapped, eh AS entity_hit, fh AS field_hit, ah AS answer_hit, nh AS any_hit, round(rr, 6) AS rr FROM qh""")
def _(t):
    return hits(t).withColumn("rr", F.round("rr", 6))


@query("a2_hit_rates", f"WITH {HITS} SELECT technique, k, dataset, questions, {SQL6} FROM rates")
def _(t):
    return EV.hit_rates(hits(t)).select("technique", "k", "dataset", "questions", *r6(*EV.RATES))


@query("a3_mapped_hit_rates", f"""WITH {HITS} SELECT technique, k, coalesce(dataset, 'overall') AS dataset, count(*) AS total, count(*) FILTER (mapped) AS mapped,
round(avg(eh::INT) FILTER (mapped), 6) AS entity_hit_rate, round(avg(fh::INT) FILTER (mapped), 6) AS field_hit_rate, round(avg(rr) FILTER (mapped), 6) AS entity_mrr
FROM qh GROUP BY GROUPING SETS ((technique, k), (technique, k, dataset))""")
def _(t):
    return EV.mapped_hit_rates(hits(t)).select("technique", "k", "dataset", "total", "mapped", *r6("entity_hit_rate", "field_hit_rate", "entity_mrr"))


@query("a4_bucket_macro_mean", f"WITH {HITS} SELECT technique, k, bucket, {SQL6} FROM macro")
def _(t):
    return EV.bucket_macro_mean(EV.hit_rates(hits(t))).select("technique", "k", "bucket", *r6(*EV.RATES))


_TABLE = ", ".join(f"round(max(CASE WHEN bucket = '{b}' THEN field_hit_rate END), 6) AS {b}" for b in ["overall", *T.DATASET_BUCKETS])


@query("a5_rate_table", f"WITH {HITS} SELECT technique, k, {_TABLE} FROM macro GROUP BY 1, 2")
def _(t):
    table = EV.rate_table(EV.bucket_macro_mean(EV.hit_rates(hits(t))), "field_hit_rate")
    return table.select("technique", "k", *r6("overall", *T.DATASET_BUCKETS))


@query("p8_dataset_bucket", """
SELECT CASE WHEN name LIKE '%courses%' THEN 'courses' WHEN name LIKE '%projects%' THEN 'projects' ELSE 'other' END AS bucket, count(*) AS n
FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'my_courses_projects_' WHEN 1 THEN 'projects_' ELSE '' END || source AS name FROM documents) GROUP BY 1""")
def _(t):
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, "My_Courses_projects_").when(F.col("doc_id") % 3 == 1, "PROJECTS_").otherwise(""), "source")
    return t.documents.groupBy(T.dataset_bucket(name).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# --- grades -------------------------------------------------------------------------------------------


def graded(t: Tables):
    """Labelled documents as answers: the reference is a passage or a yes/no."""
    d = t.labels.join(t.documents, "doc_id")
    toks = T.tokens(F.col("text"))
    return d.select(
        "doc_id", F.concat(F.lit("SET_"), "source", F.lit("_v1")).alias("dataset"), F.when(F.col("quality") == 1, F.col("lang")).otherwise(F.lit(" ")).alias("topic0"), "lang", "quality", "toxic",
        F.when(F.col("doc_id") % 4 == 0, "Yes").when(F.col("doc_id") % 4 == 1, F.array_join(F.slice(toks, 2, 3), " ")).when(F.col("doc_id") % 4 == 2, F.concat(F.array_join(F.slice(toks, 3, 2), " "), F.lit(" zzzz yyyy xxxx"))).otherwise(F.lit("")).alias("expected_answer"),
        F.when((F.col("doc_id") % 8 == 0), "true!").otherwise(F.col("text")).alias("top1_answer"), F.col("text").alias("top5_answer"),
    ).withColumn("topic", T.topic_of(F.col("topic0"), F.lit(None).cast("string"), F.lit(" "), F.col("dataset")))


GR = f"""
ga AS (SELECT doc_id, lang, quality, toxic, 'SET_' || source || '_v1' AS dataset, CASE WHEN quality = 1 THEN lang ELSE 'SET_' || source || '_v1' END AS topic, text,
   CASE doc_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN lower(array_to_string({TOKS}[2:4], ' ')) WHEN 2 THEN lower(array_to_string({TOKS}[3:4], ' ') || ' zzzz yyyy xxxx') ELSE '' END AS ref,
   CASE WHEN doc_id % 8 = 0 THEN 'true!' ELSE lower(text) END AS a1, lower(text) AS a5 FROM labels JOIN documents USING (doc_id)),
gb AS (SELECT *, list_filter(string_split_regex(ref, '{SPACE}+'), lambda w: length(w) > 3) AS ws FROM ga),
gc AS (SELECT *, len(list_filter(ws, lambda w: contains(a1, w))) / greatest(len(ws), 1)::DOUBLE AS s1,
   len(list_filter(ws, lambda w: contains(a5, w))) / greatest(len(ws), 1)::DOUBLE AS s5 FROM gb),
gr AS (SELECT *, doc_id % 8 = 0 AS top1_binary_override,
   (CASE WHEN doc_id % 8 = 0 THEN 5 WHEN ref = '' THEN 3 WHEN contains(a1, ref) THEN 5 WHEN s1 <= 0.05 THEN 1 WHEN s1 <= 0.2 THEN 2 WHEN s1 <= 0.45 THEN 3 ELSE 4 END)::DOUBLE AS top1_score,
   (CASE WHEN ref = '' THEN 3 WHEN contains(a5, ref) THEN 5 WHEN s5 <= 0.05 THEN 1 WHEN s5 <= 0.2 THEN 2 WHEN s5 <= 0.45 THEN 3 ELSE 4 END)::DOUBLE AS top5_score FROM gc)
"""


@query("h19_lexical_grade", f"WITH {GR} SELECT doc_id, top1_score, top5_score FROM gr")
def _(t):
    return EV.grade_answers(graded(t)).select("doc_id", "top1_score", "top5_score")


@query("h20_binary_override", f"WITH {GR} SELECT doc_id, top1_binary_override FROM gr")
def _(t):
    return EV.grade_answers(graded(t)).select("doc_id", "top1_binary_override")


@query("h21_parse_score", """SELECT doc_id, CASE WHEN doc_id % 7 <= 5 THEN greatest(doc_id % 7, 1) END AS score FROM documents""")
def _(t):
    out = F.concat("text", F.lit(" [result]\n "), (F.col("doc_id") % 7).cast("string"), F.lit(" "))
    return t.documents.select("doc_id", T.parse_score(out).cast("long").alias("score"))


@query("h22_topic_of", f"WITH {GR} SELECT topic, count(*) AS n FROM gr GROUP BY 1")
def _(t):
    return graded(t).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("h23_category_of", "SELECT doc_id, source AS category FROM documents")
def _(t):
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("SET_"), F.upper("source"), F.lit("_x_y"))).otherwise(F.concat("source", F.lit("_SET_1")))
    return t.documents.select("doc_id", T.category_of(name, "SET_").alias("category"))


@query("a6_judge_rows", f"""WITH l AS (
  SELECT 'g' || (doc_id % 2) AS generator, 'j' AS judge, CASE WHEN doc_id % 3 = 0 THEN 'courses' ELSE 'other' END AS bucket, s.score_of, s.score
  FROM labels, LATERAL (VALUES ('top1', CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1.0 + quality END), ('top5', 3.0 + toxic)) s(score_of, score) WHERE s.score IS NOT NULL)
SELECT generator, judge, score_of, coalesce(bucket, 'overall') AS bucket, round(avg(score), 6) AS mean_score, count(*) AS n
FROM l GROUP BY GROUPING SETS ((generator, judge, score_of), (generator, judge, score_of, bucket))""")
def _(t):
    rows = t.labels.select(
        F.concat(F.lit("g"), (F.col("doc_id") % 2).cast("string")).alias("generator"), F.lit("j").alias("judge"),
        F.when(F.col("doc_id") % 3 == 0, "SET_courses").otherwise("SET_x").alias("dataset"),
        F.when(F.col("doc_id") % 5 == 0, "n/a").otherwise((1.0 + F.col("quality")).cast("string")).alias("top1_score"),
        (3.0 + F.col("toxic")).cast("string").alias("top5_score"),
    )
    return EV.judge_rows(rows).withColumn("mean_score", F.round("mean_score", 6))


_GS = "count(*) AS questions, " + ", ".join(f"round({f}({a}_score), 6) AS {a}_{n}" for a in ("top1", "top5") for f, n in (("avg", "mean"), ("stddev_pop", "std")))


@query("a7_grade_summary", f"""WITH {GR}, tm AS (SELECT topic, avg(top1_score) AS m1, avg(top5_score) AS m5 FROM gr GROUP BY 1)
SELECT topic, {_GS}, CAST(NULL AS DOUBLE) AS top1_macro_mean, CAST(NULL AS DOUBLE) AS top5_macro_mean FROM gr GROUP BY 1
UNION ALL SELECT 'overall', {_GS}, (SELECT round(avg(m1), 6) FROM tm), (SELECT round(avg(m5), 6) FROM tm) FROM gr""")
def _(t):
    s = EV.grade_summary(EV.grade_answers(graded(t)))
    return s.select("topic", "questions", *r6(*[f"{a}_{n}" for a in ("top1", "top5") for n in ("mean", "std", "macro_mean")]))


@query("a8_category_scores", f"""WITH {GR}
SELECT 'dataset' AS level, dataset AS name, count(*) AS n, round(avg(top1_score), 6) AS top1_mean, round(avg(top5_score), 6) AS top5_mean FROM gr GROUP BY 2
UNION ALL SELECT 'category', lower(split_part(substr(dataset, 5), '_', 1)), count(*), round(avg(top1_score), 6), round(avg(top5_score), 6) FROM gr GROUP BY 2
UNION ALL SELECT 'overall', 'all', count(*), round(avg(top1_score), 6), round(avg(top5_score), 6) FROM gr""")
def _(t):
    s = EV.category_scores(EV.grade_answers(graded(t)), "SET_")
    return s.select("level", "name", "n", *r6("top1_mean", "top5_mean"))


@query("j11_benchmark_responses", f"""
SELECT b.item_id, md5(regexp_replace(d.text, '^{SPACE}+|{SPACE}+$', '', 'g')) AS answer_md5, true AS answered FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 7
UNION ALL SELECT b.item_id, NULL, false FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = b.item_id * 7)""")
def _(t):
    items = t.benchmark.withColumnRenamed("text", "question").withColumn("doc_id", F.col("item_id") * 7)
    outputs = t.documents.join(items.select("doc_id", "item_id"), "doc_id").select("item_id", F.col("text").alias("output_text"))
    done, missing = EV.benchmark_responses(items.drop("doc_id"), outputs)
    return done.select("item_id", F.md5("answers.top1_answer").alias("answer_md5"), F.lit(True).alias("answered")).unionByName(
        missing.select("item_id", F.lit(None).cast("string").alias("answer_md5"), F.lit(False).alias("answered"))
    )


@query("j11_benchmark_items", """
SELECT CAST(max(doc_id) AS VARCHAR) AS id, source || doc_id % 50 AS item_id, lang AS dataset FROM documents GROUP BY 2, 3 QUALIFY max(doc_id) = max(max(doc_id)) OVER (PARTITION BY source || doc_id % 50)""")
def _(t):
    """One file per document; an item id found in several files keeps the last one."""
    item = F.to_json(F.struct(F.array(F.struct(F.concat("source", (F.col("doc_id") % 50).cast("string")).alias("id"), F.col("doc_id").cast("string").alias("question"), F.lit("x").alias("expected_answer"))).alias("items")))
    files = t.documents.select(F.concat(F.lit("bench/"), F.col("lang"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".json")).alias("path"), item.alias("body"), "doc_id")
    # the path order must be the document order here, so the folder comes after the number
    files = files.withColumn("path", F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit("/"), F.element_at(F.split("path", "/"), 2), F.lit("/f.json")))
    items = EV.explode_items(files, "struct<id:string,question:string,expected_answer:string,type:string>")
    return items.select(F.col("question").alias("id"), "item_id", "dataset")


@query("u5_dedupe_by_question", """
SELECT md5(text) AS question_md5, min(doc_id) AS ord, max(doc_id) AS last_id FROM documents GROUP BY text""")
def _(t):
    items = t.documents.select(F.col("doc_id").alias("ord"), F.col("text").alias("question"), F.col("doc_id").alias("last_id"))
    return EV.dedupe_by_question(items, "ord").select(F.md5("question").alias("question_md5"), "ord", "last_id")


CTX = POOL + """,
lines AS (SELECT query_id, CASE vlabel % 2 WHEN 0 THEN 'code=x' || vlabel || ' | body text' ELSE 'room=r' || vlabel END AS line, min(rank) AS r FROM pool WHERE rank <= 5 GROUP BY 1, 2)
"""


def context_hits(t: Tables):
    p = pool(t, 5)
    label = F.col("vlabel").cast("string")
    body = F.when(F.col("vlabel") % 2 == 0, F.concat(F.lit("[CONTEXT] entity_type=E | entity_id=7 | code=x"), label, F.lit(" | body text [FIELD=a.code] x"), label)).otherwise(
        F.concat(F.lit("entity_id=1 | room=r"), label, F.lit(" [FIELD=a.b.room]\n r"), label))
    return p.select("query_id", "rank", F.lit("s").alias("source_path"), F.round("score", 3).alias("score"), body.alias("preview"))


@query("h31_clean_preview", f"WITH {POOL} SELECT query_id, CAST(rank AS BIGINT) AS rank, CASE vlabel % 2 WHEN 0 THEN 'code=x' || vlabel || ' | body text' ELSE 'room=r' || vlabel END AS line FROM pool WHERE rank <= 5")
def _(t):
    return context_hits(t).select("query_id", F.col("rank").cast("long").alias("rank"), T.clean_preview(F.col("preview")).alias("line"))


@query("h32_format_context", f"""WITH {CTX}, num AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS n FROM lines)
SELECT query_id, string_agg('[' || n || '] ' || line, chr(10) ORDER BY n) AS context FROM num GROUP BY 1""")
def _(t):
    return EV.format_context(context_hits(t), "query_id")


@query("h38_reranker_gate", f"""WITH {POOL} SELECT query_id, CASE WHEN query_id % 9 = 0 THEN 'rag_error' WHEN query_id % 9 = 1 THEN 'empty_results' WHEN score < 0.40 THEN 'below_min_score' END AS reason FROM pool WHERE rank = 1""")
def _(t):
    top = pool(t, 1)
    err = F.when(F.col("query_id") % 9 == 0, "boom")
    ctx = F.when(F.col("query_id") % 9 != 1, "[1] x").otherwise("")
    return top.select("query_id", EV.reranker_gate(ctx, err, F.col("score")).alias("reason"))
