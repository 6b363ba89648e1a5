"""Chunking, sources and sinks, text forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.functions import text as T
from convlake.operators import chunks as C
from convlake.session import spread
from convlake.sources import entities as E
from convlake.sources import records as R
from convlake.workloads.registry import Tables, query

# the white space classes as RE2 spells them
SPACE = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACE_IN_LINE = r"[ \t\x{b}\x{c}\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

TOKS = f"list_filter(string_split_regex(text, '{SPACE}+'), lambda x: x <> '')"
DOC_TOKENS = f"""
toks AS (SELECT doc_id, lang, source, text, {TOKS} AS tk FROM documents),
wins AS (
  SELECT doc_id, lang, source, i AS chunk_index, tk[i * 320 + 1 : i * 320 + 384] AS w
  FROM (SELECT *, unnest(range(CASE WHEN len(tk) <= 384 THEN 1
        ELSE CAST(ceil((len(tk) - 384) / 320.0) AS BIGINT) + 1 END)) AS i FROM toks WHERE len(tk) >= 20)),
chunks AS (
  SELECT lower(lang) || ':' || doc_id || ':' || source || ':' || chunk_index AS chunk_id, lang AS entity_type,
         CAST(doc_id AS VARCHAR) AS entity_id, source AS source_field, chunk_index, len(w) AS token_count,
         array_to_string(w, ' ') AS chunk_text
  FROM wins)
"""


def doc_records(t: Tables):
    d = t.documents
    eid = F.col("doc_id").cast("string")
    return d.select(
        F.col("lang").alias("entity_type"), eid.alias("entity_id"), F.concat(F.lit("documents/"), eid).alias("source_path"),
        F.col("source").alias("source_field"), "text",
        C.entity_context(F.col("lang"), eid, chars=F.col("n_chars").cast("string")).alias("entity_context"),
    )


def doc_chunks(t: Tables, cfg: C.ChunkingConfig = C.ChunkingConfig()):
    return C.build_chunks(doc_records(t), cfg)


@query("chunk_counts_by_language", f"""WITH {DOC_TOKENS}
SELECT entity_type AS lang, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens,
       count(DISTINCT entity_id) AS documents FROM chunks GROUP BY 1""")
def _(t):
    first = (F.col("chunk_index") == 0).cast("long")
    return doc_chunks(t).groupBy(F.col("entity_type").alias("lang")).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"), F.sum(first).alias("documents")
    )


@query("w1_token_windows", f"""WITH {DOC_TOKENS}
SELECT chunk_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(token_count AS BIGINT) AS token_count,
       md5(chunk_text) AS chunk_md5 FROM chunks""")
def _(t):
    return doc_chunks(t).select("chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("token_count").cast("long").alias("token_count"), F.md5("chunk_text").alias("chunk_md5"))


@query("w1_context_chunks", f"""WITH {DOC_TOKENS}
SELECT chunk_id, md5('[CONTEXT] entity_type=' || entity_type || ' | entity_id=' || entity_id || ' | chars=' || n_chars
         || ' [FIELD=' || source_field || ']' || chr(10) || chunk_text) AS text_md5,
       md5('[ENTITY=' || entity_type || '] [ID=' || entity_id || '] [FIELD=' || source_field || ']' || chr(10)
         || '[CONTEXT] entity_type=' || entity_type || ' | entity_id=' || entity_id || ' | chars=' || n_chars
         || ' [FIELD=' || source_field || ']' || chr(10) || chunk_text) AS embedding_md5
FROM chunks JOIN documents ON entity_id = CAST(doc_id AS VARCHAR)""")
def _(t):
    cfg = C.ChunkingConfig(chunk_impl="basic_ctx", include_metadata_header=True)
    return doc_chunks(t, cfg).select("chunk_id", F.md5("chunk_text").alias("text_md5"), F.md5("embedding_text").alias("embedding_md5"))


@query("a1_chunk_summary", f"""WITH {DOC_TOKENS}, f AS (
  SELECT source_field AS name, count(*) AS chunks FROM chunks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT 'total' AS section, 'all' AS name, count(*) AS chunks FROM chunks
UNION ALL SELECT 'entity_type', entity_type, count(*) FROM chunks GROUP BY 2
UNION ALL SELECT 'field', name, chunks FROM f""")
def _(t):
    return C.chunk_summary(doc_chunks(t))


@query("j1_attach_chunks", f"""WITH {DOC_TOKENS}, dup AS (
  SELECT *, CASE WHEN copy = 1 THEN 'later ' || chunk_text ELSE chunk_text END AS body FROM chunks, (VALUES (0), (1)) v(copy)),
hits AS (SELECT entity_type || ':' || entity_id || ':' || source_field || ':' || k AS chunk_id, entity_id AS q, k
         FROM chunks, (VALUES (0), (1)) kk(k) WHERE chunk_index = 0)
SELECT h.q, CAST(h.k AS BIGINT) AS k, h.chunk_id, left(d.body, 220) AS preview
FROM hits h LEFT JOIN dup d ON d.chunk_id = h.chunk_id AND d.copy = 1""")
def _(t):
    """Hits on the first two chunks of each document against a store holding every id twice."""
    ch = doc_chunks(t).select("chunk_id", "entity_type", "entity_id", "source_field", "chunk_index", "chunk_text")
    copies = ch.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    store = copies.select("chunk_id", "copy", F.when(F.col("copy") == 1, F.concat(F.lit("later "), "chunk_text")).otherwise(F.col("chunk_text")).alias("body"))
    hits = ch.filter("chunk_index = 0").select(F.col("entity_id").alias("q"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("k"), "entity_type", "entity_id", "source_field")
    hits = hits.select("q", "k", F.concat_ws(":", "entity_type", "entity_id", "source_field", F.col("k").cast("string")).alias("chunk_id"))
    return C.attach_chunks(hits, store, "copy").select("q", "k", "chunk_id", F.left("body", F.lit(220)).alias("preview"))


@query("s2_read_chunks", f"""WITH {DOC_TOKENS}
SELECT chunk_id, entity_type, CAST(token_count AS BIGINT) AS token_count, md5(chunk_text) AS chunk_md5 FROM chunks""")
def _(t):
    """Chunk records as JSON lines (every second one followed by a blank line) and back."""
    lines = doc_chunks(t).select(F.explode(F.array(F.to_json(F.struct("*")), F.lit(" "))).alias("value"))
    return R.parse_chunk_lines(lines).select("chunk_id", "entity_type", F.col("token_count").cast("long").alias("token_count"), F.md5("chunk_text").alias("chunk_md5"))


@query("s8_write_chunks", f"""WITH {DOC_TOKENS}
SELECT entity_type, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens FROM chunks GROUP BY 1""")
def _(t):
    """Chunks written split by entity type to the shared folder, and read back."""
    import uuid

    from convlake.session import shared_dir

    path = f"{shared_dir(t.spark)}/chunks-{uuid.uuid4().hex}"
    R.write_chunks(doc_chunks(t), path, fmt="parquet")
    back = t.spark.read.parquet(path)
    return back.groupBy("entity_type").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"))


@query("s9_run_manifest", f"""WITH {DOC_TOKENS}
SELECT '384' AS chunk_size, 'chunks.json' AS chunks_artifact, 'index.bin' AS index_artifact,
       count(*) AS chunks_total, CAST(sum(token_count) AS BIGINT) AS tokens_total,
       CAST((SELECT count(*) FROM embeddings) AS BIGINT) AS vectors FROM chunks""")
def _(t):
    previous = t.embeddings.agg(F.count(F.lit(1)).alias("n")).select(
        F.create_map(F.lit("index"), F.lit("index.bin"), F.lit("chunks"), F.lit("old.json")).alias("artifacts"),
        F.create_map(F.lit("vectors"), "n", F.lit("chunks_total"), F.lit(0).cast("long")).alias("stats"),
    )
    m = C.run_manifest(doc_chunks(t), C.ChunkingConfig(), {"chunks": "chunks.json"}, previous)
    return m.select(
        F.col("chunking")["chunk_size"].alias("chunk_size"), F.col("artifacts")["chunks"].alias("chunks_artifact"),
        F.col("artifacts")["index"].alias("index_artifact"), F.col("stats")["chunks_total"].alias("chunks_total"),
        F.col("stats")["tokens_total"].alias("tokens_total"), F.col("stats")["vectors"].alias("vectors"),
    )


@query("s10_pending_work", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return R.pending_work(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"])


@query("s11_upsert_nodes", """
SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) END, c_name) AS name,
       coalesce(CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN c_mktsegment END,
                CASE WHEN c_custkey % 5 <> 0 THEN 'old' END) AS segment
FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 <> 0 OR c_custkey % 10 = 5""")
def _(t):
    c = t.customer
    old = c.filter("c_custkey % 2 <> 0 OR c_custkey % 5 <> 0").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.expr("CASE WHEN c_custkey % 5 <> 0 THEN 'old' END").alias("segment"))
    new = c.filter("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END").alias("segment"))
    return R.upsert_nodes(old, new, "id")


@query("s11_upsert_edges", """
SELECT c_custkey AS src, CAST(c_nationkey AS BIGINT) AS dst,
       CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS source
FROM customer WHERE c_custkey % 2 <> 0 OR c_nationkey <> 7""")
def _(t):
    e = t.customer.select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("dst"))
    old = e.filter("src % 2 <> 0").withColumn("source", F.lit("old"))
    new = e.filter("src % 2 = 0").withColumn("source", F.lit("new"))
    nodes = t.nation.filter("n_nationkey <> 7").select(F.col("n_nationkey").cast("long").alias("id"))
    return R.upsert_edges(old, new, ["src", "dst"], t.customer.select(F.col("c_custkey").alias("id")), nodes)


def submissions(t: Tables):
    c = t.customer
    return c.select(
        F.col("c_acctbal").alias("timestamp"), F.col("c_acctbal").cast("string").alias("timestamp_str"),
        F.struct(
            F.col("c_custkey").alias("verification_id"), F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
            F.when(F.col("c_custkey") % 100 == 1, F.lit("twin")).otherwise(F.col("c_name")).alias("nickname"),
            F.when(F.col("c_mktsegment") == "BUILDING", "BY").otherwise("CC0").alias("license"), F.lit("1.0").alias("format_version"),
        ).alias("submission"),
        F.struct(F.col("c_mktsegment").alias("text")).alias("verification"),
    )


@query("s12_flatten_to_tsv", """
SELECT c_custkey AS verification_id, lower(c_name) || '@example.org' AS email,
       CASE WHEN c_custkey % 100 = 1 THEN 'twin' ELSE c_name END AS nickname, c_mktsegment AS verification_text FROM customer""")
def _(t):
    return R.flatten_submissions(submissions(t)).select("verification_id", "email", "nickname", "verification_text")


@query("s12_submission_problems", """
SELECT 'nickname' AS "check", 'twin' AS found, count(*) AS n FROM customer WHERE c_custkey % 100 = 1 HAVING count(*) > 1
UNION ALL SELECT 'license', 'BY', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' HAVING count(*) > 0""")
def _(t):
    return R.submission_problems(submissions(t))


# --- entities derived from the star schema ---------------------------------------------------


def entity_files(t: Tables):
    """Customers as people, parts as courses, suppliers as groups: (path, JSON body).

    A table of many short rows is a small file, so one task, while every row is turned into JSON and read field by field.
    """
    c, p, s = spread(t.customer), spread(t.part), spread(t.supplier)
    mail = F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.org")))
    people = c.select(
        F.concat(F.lit("personnel_profiles/"), "c_name", F.lit("_Ing.,_PhD.json")).alias("path"),
        F.to_json(F.struct(
            F.col("c_name").alias("name"), F.lit("detail").alias("title"),
            F.struct(F.struct(mail.alias("e_mail"), F.concat(F.lit("R"), F.col("c_nationkey").cast("string")).alias("room")).alias("details")).alias("contact"),
            F.array(F.struct(F.col("c_mktsegment").alias("text")), F.struct(F.concat(F.lit("Balance "), F.col("c_acctbal").cast("int").cast("string")).alias("text"))).alias("about"),
            F.array(F.struct(F.struct(F.lit("Group").alias("value")).alias("organization"))).alias("roles"),
            F.struct(F.lit("home").alias("a")).alias("links"), F.lit("http://example.org").alias("profile_url"),
        )).alias("body"))
    courses = p.select(
        F.concat(F.lit("courses/"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("path"),
        F.to_json(F.struct(
            F.struct(
                F.when(F.col("p_partkey") % 4 != 0, F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string"))).alias("code"),
                F.col("p_name").alias("course_name"),
                F.when(F.col("p_size") % 3 == 0, "Winter semester").when(F.col("p_size") % 3 == 1, "Summer semester").otherwise("8 credits").alias("semester"),
            ).alias("metadata"),
            F.struct(F.col("p_type").alias("department")).alias("content"),
        )).alias("body"))
    groups = s.select(
        F.concat(F.lit("groups/"), F.col("s_suppkey").cast("string"), F.lit(".json")).alias("path"),
        F.to_json(F.struct(F.col("s_name").alias("group"), F.struct(F.array(F.struct(F.concat(F.lit("Head of "), "s_name").alias("name"))).alias("principal_researcher")).alias("team"))).alias("body"))
    return people.unionByName(courses).unionByName(groups)


MAIL = "CASE WHEN c_custkey % 3 <> 0 THEN lower(replace(c_name, '#', '.')) || '@example.org' END"
CODE = "CASE WHEN p_partkey % 4 <> 0 THEN p_brand || '-' || p_partkey END"
ENTITIES = f"""
ents AS (
  SELECT 'personnel_profiles/' || c_name || '_Ing.,_PhD.json' AS path, 'Person' AS entity_type,
         lower(replace(c_name, '#', ' ')) AS entity_id,
         'person=' || c_name || '_Ing.,_PhD' || coalesce(' | email=' || {MAIL}, '') || ' | room=R' || c_nationkey AS tail FROM customer
  UNION ALL
  SELECT 'courses/' || p_partkey || '.json', 'Course', coalesce(lower(replace({CODE}, '#', ' ')), CAST(p_partkey AS VARCHAR)),
         'code=' || coalesce({CODE}, CAST(p_partkey AS VARCHAR)) || ' | course_name=' || p_name || ' | department=' || p_type FROM part
  UNION ALL
  SELECT 'groups/' || s_suppkey || '.json', 'ResearchGroup', lower(replace(s_name, '#', ' ')),
         'group=' || s_name || ' | contact=Head of ' || s_name FROM supplier)
"""
LEAVES = f"""
leaves AS (
  SELECT 'personnel_profiles/' || c_name || '_Ing.,_PhD.json' AS path, u.source_field, u.text FROM customer,
    LATERAL (VALUES ('name', c_name), ('title', 'detail'), ('contact.details.e_mail', {MAIL}), ('contact.details.room', 'R' || c_nationkey),
             ('about[0].text', c_mktsegment), ('about[1].text', 'Balance ' || CAST(trunc(c_acctbal) AS INT)), ('roles[0].organization.value', 'Group'),
             ('links.a', 'home'), ('profile_url', 'http://example.org')) u(source_field, text)
  UNION ALL
  SELECT 'courses/' || p_partkey || '.json', u.source_field, u.text FROM part,
    LATERAL (VALUES ('metadata.code', {CODE}), ('metadata.course_name', p_name),
             ('metadata.semester', CASE p_size % 3 WHEN 0 THEN 'Winter semester' WHEN 1 THEN 'Summer semester' ELSE '8 credits' END),
             ('content.department', p_type)) u(source_field, text)
  UNION ALL
  SELECT 'groups/' || s_suppkey || '.json', u.source_field, u.text FROM supplier,
    LATERAL (VALUES ('group', s_name), ('team.principal_researcher[0].name', 'Head of ' || s_name)) u(source_field, text)),
leaf AS (SELECT * FROM leaves WHERE text IS NOT NULL)
"""


@query("s1_read_entities", f"""WITH {ENTITIES}
SELECT path, entity_type, entity_id, 'entity_type=' || entity_type || ' | entity_id=' || entity_id || ' | ' || tail AS entity_context FROM ents""")
def _(t):
    return E.parse_entities(entity_files(t)).drop("body")


@query("h9_entity_context", f"""WITH {ENTITIES}
SELECT entity_type, count(*) AS n, CAST(sum(length('entity_type=' || entity_type || ' | entity_id=' || entity_id || ' | ' || tail)) AS BIGINT) AS chars
FROM ents GROUP BY 1""")
def _(t):
    return E.parse_entities(entity_files(t)).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("entity_context")).cast("long").alias("chars"))


@query("p1_flatten_leaves", f"WITH {LEAVES} SELECT path, source_field, text FROM leaf")
def _(t):
    return E.flatten_leaves(entity_files(t)).select("path", "source_field", "text")


@query("p1_flatten_props", "SELECT event_id, 'k' AS source_field, json_extract_string(props, '$.k') AS text FROM events")
def _(t):
    return E.flatten_map(t.events, "props", ["event_id"])


@query("p2_classify_fields", f"""WITH {LEAVES}
SELECT source_field, regexp_matches(source_field, '^contact\\.details\\.(e_mail|room)$|^metadata\\.(code|course_name|semester)$') AS short_fact,
       false AS noisy, count(*) AS n FROM leaf GROUP BY 1""")
def _(t):
    return C.classify_fields(E.flatten_leaves(entity_files(t))).groupBy("source_field", "short_fact", "noisy").agg(F.count(F.lit(1)).alias("n"))


@query("p3_min_token_filter", f"""SELECT doc_id FROM documents WHERE len({TOKS}) >= 20""")
def _(t):
    return C.min_token_filter(t.documents, C.ChunkingConfig(), field="source").select("doc_id")


@query("p4_prune_document", f"""WITH {LEAVES}
SELECT path, source_field, text FROM leaf WHERE source_field NOT IN ('links.a', 'profile_url', 'title')""")
def _(t):
    return E.prune_leaves(E.flatten_leaves(entity_files(t))).select("path", "source_field", "text")


@query("h6_collapse_wrappers", f"""WITH {LEAVES}
SELECT path, 'about' AS source_field, string_agg(text, chr(10) || chr(10) ORDER BY source_field) AS text FROM leaf WHERE source_field LIKE 'about%' GROUP BY 1
UNION ALL SELECT path, CASE source_field WHEN 'roles[0].organization.value' THEN 'roles[0].organization' ELSE source_field END, text
FROM leaf WHERE source_field NOT LIKE 'about%' AND source_field NOT IN ('links.a', 'profile_url', 'title')""")
def _(t):
    return E.collapse_wrappers(E.prune_leaves(E.flatten_leaves(entity_files(t))), "path").select("path", "source_field", "text")


# --- text forms ----------------------------------------------------------------------------------

CANON = rf"trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '{T.NOT_WORD}', ' ', 'g'), '{SPACE}+', ' ', 'g'))"


@query("h1_canonicalize_text", f"SELECT doc_id, md5({CANON}) AS m FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(T.canonicalize_text(F.col("text"))).alias("m"))


@query("h2_canonicalize_person", """
SELECT c_custkey, lower(replace(c_name, '#', ' ')) AS person FROM customer""")
def _(t):
    full = F.concat(F.lit("Ing._"), "c_name", F.when(F.col("c_custkey") % 2 == 0, F.lit(",_doc. Ing.")).otherwise(F.lit("\uff0c doktor")))
    return t.customer.select("c_custkey", T.canonicalize_person(full).alias("person"))


@query("h3_normalize_semester", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'winter' WHEN 1 THEN 'summer' ELSE 'unknown' END AS semester FROM part""")
def _(t):
    label = F.when(F.col("p_size") % 3 == 0, "Winter semester").when(F.col("p_size") % 3 == 1, "in SUMMER, yearly").otherwise("midwinter")
    return t.part.select("p_partkey", T.normalize_semester(label).alias("semester"))


NT = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  text, '\r\n?', chr(10), 'g'), '{T.ZERO_WIDTH}', '', 'g'), '{SPACE_IN_LINE}+', ' ', 'g'), ' ?\n ?', chr(10), 'g'),
  '\n{{3,}}', chr(10) || chr(10), 'g'), '^{SPACE}+|{SPACE}+$', '', 'g')"""


@query("h4_normalise_text", f"SELECT doc_id, md5({NT}) AS m FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(T.normalise_text(F.col("text"))).alias("m"))


@query("h5_strip_diacritics", "SELECT doc_id, md5(strip_accents(text)) AS m FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(T.strip_diacritics("text")).alias("m"))


@query("h7_tokenize_ws", f"SELECT doc_id, CAST(len({TOKS}) AS BIGINT) AS n, md5(array_to_string({TOKS}, '|')) AS m FROM documents")
def _(t):
    toks = T.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(toks).cast("long").alias("n"), F.md5(F.array_join(toks, "|")).alias("m"))


@query("h8_truncate_tokens", f"""
SELECT doc_id, CASE WHEN len({TOKS}) <= 48 THEN md5(text) ELSE md5(array_to_string({TOKS}[1:48], ' ')) END AS m FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.md5(T.truncate_tokens(F.col("text"), 48)).alias("m"))


@query("h10_chunk_header", f"""WITH {DOC_TOKENS}
SELECT chunk_id, '[ENTITY=' || entity_type || '] [ID=' || entity_id || '] [FIELD=' || source_field || ']' AS header FROM chunks""")
def _(t):
    ch = doc_chunks(t)
    return ch.select("chunk_id", C.default_header(ch).alias("header"))


@query("h12_match_normal_form", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS m FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(T.match_normal_form(F.col("text"))).alias("m"))


HINTS = r"""list_distinct(list_filter(list_transform(string_split_regex(f, '[+/,]'),
  lambda p: lower(trim(regexp_replace(replace(replace(replace(trim(regexp_replace(p, '\([^)]*\)', '', 'g')), '[]', ''), '.*.', '.'), '*', ''), '\.+', '.', 'g'), '.'))),
  lambda p: p <> ''))"""


@query("h13_answer_field_hints", f"""
SELECT doc_id, array_to_string(list_sort({HINTS}), '|') AS hints
FROM (SELECT doc_id, source || '.*.' || lang || '[]/' || source || '(x)+..Meta*,' || lang || '(a/b)' AS f FROM documents)""")
def _(t):
    f = F.concat("source", F.lit(".*."), "lang", F.lit("[]/"), "source", F.lit("(x)+..Meta*,"), "lang", F.lit("(a/b)"))
    return t.documents.select("doc_id", F.array_join(F.sort_array(T.answer_field_hints(f)), "|").alias("hints"))


@query("h33_strip_block", "SELECT doc_id, md5(text) AS m FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents)")
def _(t):
    wrapped = F.concat(F.col("text"), F.lit("\n[RAG_CONTEXT] [1] "), F.col("text"), F.lit("[/RAG_CONTEXT]\n"))
    return t.documents.select("doc_id", F.md5(T.strip_block(wrapped)).alias("m"))


@query("h34_speakable_text", f"""
SELECT page_id, md5(replace(translate(regexp_replace(html, '^{SPACE}+|{SPACE}+$', '', 'g'), '“”‘’*_`', '""'''''), ' : ', ' ')) AS m FROM pages""")
def _(t):
    return t.pages.select("page_id", F.md5(T.speakable_text(F.col("html"))).alias("m"))


SPOKEN = "replace(regexp_replace(translate(replace(translate(lower(text), '?', ' '), ' hundred and ', ' '), '-.,', '   '), '\\bi''m\\b', 'i am', 'g'), '''', '')"
for _d, _w in enumerate(T.DIGIT_WORDS):
    SPOKEN = f"regexp_replace({SPOKEN}, '\\b{_d}\\b', '{_w}', 'g')"


@query("h35_spoken_normal_form", f"SELECT doc_id, md5(trim(regexp_replace({SPOKEN}, '{SPACE}+', ' ', 'g'))) AS m FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(T.spoken_normal_form(F.col("text"))).alias("m"))


@query("h36_key_slug", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM documents")
def _(t):
    return t.documents.select("doc_id", T.key_slug(F.col("text")).alias("slug"))


@query("h37_silence_marker_strip", "SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 0 THEN '...' ELSE text END) AS m FROM conversations")
def _(t):
    msg = F.when(F.col("turn") % 3 == 0, F.lit("...")).otherwise(F.concat(F.lit("..."), F.col("text")))
    return t.conversations.select("conv_id", "turn", F.md5(T.silence_marker_strip(msg)).alias("m"))
