"""Graph on the star schema, question sets, web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.operators import graph as G
from convlake.operators import questions as Q
from convlake.sources import pages as P
from convlake.workloads.chunks import CODE, MAIL, SPACE, entity_files
from convlake.workloads.registry import Tables, query

# --- graph: customers, suppliers, parts, nations, regions ------------------------------------------------

TIER = "CASE {k} % 3 WHEN 0 THEN 'free_text_fallback' WHEN 1 THEN 'known_personnel_filename' ELSE 'anchored_identity' END"
EDGES = f"""
raw AS (
  SELECT 'LIVES_IN' AS rel_type, 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, {TIER.format(k='c_custkey')} AS source, 'customer' AS evidence_path, 'c_nationkey' AS evidence_field, c_custkey AS ord FROM customer
  UNION ALL SELECT 'BASED_IN', 's' || s_suppkey, 'n' || s_nationkey, {TIER.format(k='s_suppkey')}, 'supplier', 's_nationkey', s_suppkey FROM supplier
  UNION ALL SELECT 'IN_REGION', 'n' || n_nationkey, 'r' || n_regionkey, 'unknown', 'nation', 'n_regionkey', n_nationkey FROM nation
  UNION ALL SELECT 'SUPPLIES', 's' || l_suppkey, 'p' || l_partkey, {TIER.format(k='l_linenumber')}, 'lineitem', 'l_partkey', l_orderkey * 10 + l_linenumber FROM lineitem
  UNION ALL SELECT 'BOUGHT', 'c' || o_custkey, 'p' || l_partkey, {TIER.format(k='l_quantity::BIGINT')}, 'orders', 'o_orderkey', l_orderkey * 10 + l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cf AS (SELECT *, CASE source WHEN 'free_text_fallback' THEN 0.75 WHEN 'known_personnel_filename' THEN 0.90 WHEN 'anchored_identity' THEN 0.97 ELSE 0.5 END::DOUBLE AS confidence FROM raw),
edges AS (SELECT rel_type, src, dst, source, evidence_path, evidence_field, confidence FROM cf QUALIFY row_number() OVER (PARTITION BY rel_type, src, dst ORDER BY confidence DESC, ord) = 1)
"""


def node(kind: str, c: str):
    return F.concat(F.lit(kind), F.col(c).cast("string"))


def edge_sources(t: Tables):
    def tier(k):
        return F.expr(TIER.format(k=k))

    li = t.lineitem
    lo = li.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return [
        G.edge(t.customer, "LIVES_IN", node("c", "c_custkey"), node("n", "c_nationkey"), tier("c_custkey"), F.lit("customer"), "c_nationkey", F.col("c_custkey")),
        G.edge(t.supplier, "BASED_IN", node("s", "s_suppkey"), node("n", "s_nationkey"), tier("s_suppkey"), F.lit("supplier"), "s_nationkey", F.col("s_suppkey")),
        G.edge(t.nation, "IN_REGION", node("n", "n_nationkey"), node("r", "n_regionkey"), F.lit("unknown"), F.lit("nation"), "n_regionkey", F.col("n_nationkey").cast("long")),
        G.edge(li, "SUPPLIES", node("s", "l_suppkey"), node("p", "l_partkey"), tier("l_linenumber"), F.lit("lineitem"), "l_partkey", at),
        G.edge(lo, "BOUGHT", node("c", "o_custkey"), node("p", "l_partkey"), tier("CAST(l_quantity AS BIGINT)"), F.lit("orders"), "o_orderkey", at),
    ]


def graph_edges(t: Tables):
    return G.build_edges(*edge_sources(t))


def graph_nodes(t: Tables):
    parts = [("customer", t.customer, "c", "c_custkey"), ("supplier", t.supplier, "s", "s_suppkey"), ("part", t.part, "p", "p_partkey"), ("nation", t.nation, "n", "n_nationkey"), ("region", t.region, "r", "r_regionkey")]
    out = [df.select(F.lit(k).alias("type"), node(p, c).alias("id")) for k, df, p, c in parts]
    for df in out[1:]:
        out[0] = out[0].unionByName(df)
    return out[0]


@query("u7_build_edges", f"WITH {EDGES} SELECT * FROM edges")
def _(t):
    return graph_edges(t)


@query("u6_merge_edge_evidence", f"WITH {EDGES} SELECT rel_type, source, count(*) AS n FROM edges GROUP BY 1, 2")
def _(t):
    return graph_edges(t).groupBy("rel_type", "source").agg(F.count(F.lit(1)).alias("n"))


@query("u2_distinct_edges", f"WITH {EDGES} SELECT DISTINCT rel_type, src, dst FROM raw")
def _(t):
    s = edge_sources(t)
    out = s[0]
    for x in s[1:]:
        out = out.unionByName(x)
    return G.distinct_edges(out)


@query("a22_evidence_distribution", f"WITH {EDGES} SELECT rel_type, source, count(*) AS edges, round(avg(confidence), 3) AS avg_confidence FROM edges GROUP BY 1, 2")
def _(t):
    return G.evidence_distribution(graph_edges(t))


@query("a23_graph_stats", f"""WITH {EDGES} SELECT 'edge' AS kind, rel_type AS name, count(*) AS n FROM edges GROUP BY 2
UNION ALL SELECT 'node', 'customer', count(*) FROM customer UNION ALL SELECT 'node', 'supplier', count(*) FROM supplier UNION ALL SELECT 'node', 'part', count(*) FROM part
UNION ALL SELECT 'node', 'nation', count(*) FROM nation UNION ALL SELECT 'node', 'region', count(*) FROM region""")
def _(t):
    return G.graph_stats(graph_nodes(t), graph_edges(t)).select("kind", "name", "n")


@query("j16_unresolved_edges", "SELECT 'LIVES_IN' AS rel_type, count(*) AS unresolved FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'BOUGHT', count(*) FROM (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0)")
def _(t):
    """Customers in debt are left out of the nodes."""
    debt = t.customer.filter("c_acctbal < 0").select(node("c", "c_custkey").alias("id"))
    return G.unresolved_edges(graph_edges(t), graph_nodes(t).join(debt, "id", "left_anti"))


@query("j13_graph_paths", "SELECT 'c' || c_custkey AS n0, 'n' || c_nationkey AS n1, CASE WHEN n_regionkey <> 2 THEN 'r' || n_regionkey END AS n2 FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    """Customer to nation, and on to the region where that edge is known."""
    e = graph_edges(t).filter("dst <> 'r2'")
    return G.graph_paths(graph_nodes(t).filter("type = 'customer'").select(F.col("id").alias("n0")), e, [("LIVES_IN", False), ("IN_REGION", True)])


@query("j2_enrich_course_names", f"""WITH f AS (SELECT p_brand, trim(arg_min(p_name, p_partkey)) AS course_name FROM part WHERE p_size > 5 GROUP BY 1)
SELECT p_partkey, course_name FROM part LEFT JOIN f USING (p_brand)""")
def _(t):
    course = F.struct(F.concat(F.col("p_brand"), F.lit("  ")).alias("abbreviation"), F.when(F.col("p_size") > 5, F.col("p_name")).alias("title"))
    cur = t.part.select(F.col("p_partkey").alias("ord"), F.array(F.struct(F.array(course).alias("courses"))).alias("curriculum"))
    return G.enrich_names(t.part.select("p_partkey", "p_brand"), cur, "p_brand").select("p_partkey", "course_name")


def order_mentions(t: Tables):
    """Three mentions per order: the customer's name with a title, an alias, and a stranger."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    m = F.array(F.lit("Ghost Writer"), F.concat(F.lit("Ing._"), F.replace("c_name", F.lit("#"), F.lit("_")), F.lit(", PhD.")), F.concat(F.lit("Cust-"), F.col("o_custkey").cast("string")), F.lit(" "))
    return o.select("o_orderkey", F.posexplode(m).alias("pos", "mention"))


def people(t: Tables):
    return t.customer.select(F.lower(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("id"), "c_name", F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("name"))


@query("j3_resolve_entities", """
SELECT o_orderkey, lower(replace(c_name, '#', ' ')) AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'anchored_identity' ELSE 'known_personnel_filename' END AS source, CAST(1 AS BIGINT) AS pos
FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t):
    p = people(t)
    links = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("display_name"), F.lit("http://example.org").alias("url"))
    links = links.withColumn("display_name", F.replace("display_name", F.lit("#"), F.lit(" ")))
    r = G.resolve_entities(order_mentions(t), G.person_aliases(p, links), p, "o_orderkey")
    return r.select("o_orderkey", "id", "source", F.col("pos").cast("long").alias("pos"))


@query("h28_names_in_text", """WITH m AS (SELECT c_custkey, unnest(regexp_extract_all('by Anna Maria Novak and Petr Svoboda in ' || CASE WHEN c_custkey % 2 = 0 THEN 'Old Town, ' ELSE 'TOWN ' END || 'Karel', '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){1,3})\\b', 1)) AS mention FROM customer)
SELECT mention, count(*) AS n FROM m GROUP BY 1""")
def _(t):
    text = F.concat(
        F.lit("by Anna Maria Novak and Petr Svoboda in "), F.when(F.col("c_custkey") % 2 == 0, "Old Town, ").otherwise("TOWN "),
        F.lit("Karel and Ing Novak, Petr Svoboda"),
    )
    return G.names_in_text(t.customer.withColumn("t", text), "c_custkey", "t").groupBy("mention").agg(F.count(F.lit(1)).alias("n"))


@query("h29_role_candidates", "SELECT c_custkey, u.pos, u.mention FROM customer, LATERAL (VALUES (CAST(0 AS BIGINT), c_name), (1, c_mktsegment)) u(pos, mention)")
def _(t):
    text = F.concat(F.lit(" "), F.col("c_name"), F.lit(" | (DEPT) | "), F.col("c_mktsegment"), F.lit("| (A-1/B)|"))
    r = G.role_candidates(t.customer.withColumn("t", text), "c_custkey", "t")
    return r.select("c_custkey", F.col("pos").cast("long").alias("pos"), "mention")


LINKTEXT = """CASE p_partkey % 5 WHEN 0 THEN s_name WHEN 1 THEN 'Foo & Co; ' || s_name || ' ltd, more' WHEN 2 THEN right(s_name, 4) || '| nothing' WHEN 3 THEN 'zzz ' || p_name ELSE '' END"""


def canon(c):
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("j4_fuzzy_link", f"""
WITH v AS (SELECT p_partkey, {LINKTEXT} AS txt FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)),
c AS (SELECT p_partkey, u.pos, {canon("split_part(u.cand, ',', 1)")} AS l FROM v, LATERAL (SELECT 0 AS pos, txt AS cand UNION ALL SELECT i, trim(string_split_regex(txt, '[;|]')[i]) FROM range(1, 4) r(i)) u WHERE txt <> '' AND u.cand <> ''),
m AS (SELECT p_partkey, pos, s_suppkey, CASE WHEN l = {canon('s_name')} THEN 0 ELSE 1 END AS tier FROM c JOIN supplier ON contains(l, {canon('s_name')}) OR contains({canon('s_name')}, l) WHERE l <> '')
SELECT p_partkey, s_suppkey AS id FROM m QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY pos, tier, s_suppkey) = 1""")
def _(t):
    n = t.supplier.agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    p = t.part.withColumn("one", F.lit(1)).join(n, "one").withColumn("s_suppkey", F.col("p_partkey") % F.col("n"))
    texts = p.join(t.supplier, "s_suppkey").select("p_partkey", F.expr(LINKTEXT).alias("txt"))
    ents = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"))
    return G.fuzzy_link(texts, ents, "p_partkey", "txt", cut_comma=True)


ASK = "CASE s_suppkey % 4 WHEN 0 THEN 'NATION_' || s_nationkey WHEN 1 THEN 'the Nation_' || s_nationkey || '!' WHEN 2 THEN 'nation' ELSE 'none' END"


@query("j5_lookup_exact_then_contains", f"""WITH q AS (SELECT s_suppkey, {canon(ASK)} AS l FROM supplier), e AS (SELECT lower(n_name) AS r FROM nation),
m AS (SELECT s_suppkey, r, l = r AS eq, row_number() OVER (PARTITION BY s_suppkey ORDER BY l <> r, r) AS k, bool_or(l = r) OVER (PARTITION BY s_suppkey) AS has FROM q JOIN e ON contains(l, r) OR contains(r, l))
SELECT q.s_suppkey, max(CASE WHEN k = 1 THEN r END) AS id, coalesce(string_agg(r, ',' ORDER BY k) FILTER (k BETWEEN 2 AND 5 AND NOT has), '') AS alternatives FROM q LEFT JOIN m ON m.s_suppkey = q.s_suppkey GROUP BY 1""")
def _(t):
    q = t.supplier.select("s_suppkey", F.expr(ASK).alias("q"))
    r = G.lookup_exact_then_contains(q, t.nation.select(F.lower("n_name").alias("id")), "s_suppkey", "q")
    return r.select("s_suppkey", "id", F.array_join("alternatives", ",").alias("alternatives"))


@query("j15_negative_sample", """
WITH h AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), u AS (SELECT l_partkey, row_number() OVER (ORDER BY md5('s|' || l_partkey), l_partkey) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT l_partkey FROM h)),
e AS (SELECT DISTINCT l_suppkey, ('0x' || md5('s|' || l_suppkey)[1:8])::BIGINT AS s FROM h),
f AS (SELECT e.l_suppkey, u.l_partkey, (u.i - e.s % u.n + u.n) % u.n AS k FROM e, u WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.l_suppkey = e.l_suppkey AND h.l_partkey = u.l_partkey))
SELECT l_suppkey, arg_min(l_partkey, k) AS l_partkey FROM f GROUP BY 1""")
def _(t):
    return G.negative_sample(t.lineitem, "l_suppkey", "l_partkey", "s")


# --- records and questions -----------------------------------------------------------------------------------


@query("h41_entity_records", f"""
SELECT 'Person' AS kind, lower(replace(c_name, '#', ' ')) AS id, {MAIL} AS a, 'R' || c_nationkey AS b FROM customer
UNION ALL SELECT 'Course', coalesce({CODE}, CAST(p_partkey AS VARCHAR)), CASE WHEN p_size % 3 < 2 THEN CASE p_size % 3 WHEN 0 THEN 'Winter semester' ELSE 'Summer semester' END END, p_type FROM part
UNION ALL SELECT 'Group', s_name, 'Head of ' || s_name, 'principal_researcher' FROM supplier""")
def _(t):
    files = entity_files(t)
    p = Q.person_records(files.filter("path LIKE 'personnel_profiles/%'")).select(F.lit("Person").alias("kind"), F.col("profile_id").alias("id"), F.col("email").alias("a"), F.col("office_room").alias("b"))
    c = Q.course_records(files.filter("path LIKE 'courses/%'")).select(F.lit("Course").alias("kind"), F.col("code").alias("id"), F.col("semester").alias("a"), F.col("department").alias("b"))
    g = Q.group_records(files.filter("path LIKE 'groups/%'")).select(F.lit("Group").alias("kind"), F.col("group").alias("id"), F.col("contact_person").alias("a"), F.get("members", F.lit(0))["role"].alias("b"))
    return p.unionByName(c).unionByName(g)


def project_table(t: Tables):
    """Parts as projects: the brand pays, the type is the program."""
    p = t.part.select(
        F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("title"), F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("agency"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("program"), F.col("p_size").cast("string").alias("period"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("C"), F.col("p_partkey").cast("string"))).alias("code"))
    return p


def project_items(t: Tables):
    p = project_table(t)
    other = G.negative_sample(p.filter("agency IS NOT NULL"), "title", "agency", "neg").withColumnRenamed("agency", "other_agency")
    return Q.candidate_items(p.join(other, "title", "left"), "title", Q.project_rules(), "1337")


# one SQL row per item; the wrong agency is the first other one in digest order from the title's place
ITEMS = """
pj AS (SELECT p_name || ' ' || p_partkey AS title, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS agency, CASE WHEN p_size % 3 <> 0 THEN p_type END AS program, CAST(p_size AS VARCHAR) AS period, CASE WHEN p_partkey % 2 = 0 THEN 'C' || p_partkey END AS code FROM part),
ag AS (SELECT agency, row_number() OVER (ORDER BY md5('neg|' || agency), agency) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT agency FROM pj WHERE agency IS NOT NULL)),
ng AS (SELECT title, arg_min(ag.agency, (i - ('0x' || md5('neg|' || title)[1:8])::BIGINT % n + n) % n) AS other FROM pj JOIN ag ON ag.agency <> pj.agency GROUP BY 1),
pn AS (SELECT pj.*, ng.other FROM pj LEFT JOIN ng USING (title)),
it AS (SELECT title AS entity, u.type, u.question, u.expected_answer FROM pn, LATERAL (VALUES
  ('funded_by_yes', 'Does ' || agency || ' pay for ' || title || '?', CASE WHEN agency IS NOT NULL THEN 'Yes' END),
  ('agency_funding_yes', 'Is ' || agency || ' the source of funds of ' || title || '?', CASE WHEN agency IS NOT NULL THEN 'Yes' END),
  ('who_funding', CASE ('0x' || md5('1337|who_funding|' || title)[1:6])::BIGINT % 2 WHEN 0 THEN 'Who pays for ' || title || '?' ELSE 'Which agency supports ' || title || '?' END, agency),
  ('funded_by_no', 'Does ' || other || ' pay for ' || title || '?', CASE WHEN other IS NOT NULL THEN 'No' END),
  ('agency_funding_no', 'Is ' || other || ' the source of funds of ' || title || '?', CASE WHEN other IS NOT NULL THEN 'No' END),
  ('project_program', 'Which program is ' || title || ' in?', program),
  ('project_period', 'When does ' || title || ' run?', period),
  ('project_code', 'What is the code of ' || title || '?', code)) u(type, question, expected_answer) WHERE u.expected_answer IS NOT NULL)
"""


@query("h40_candidate_items", f"WITH {ITEMS} SELECT entity, type, question, expected_answer FROM it")
def _(t):
    return project_items(t).select("entity", "type", "question", "expected_answer")


@query("h40_course_items")
def _(t):
    """All course families; teachers stay unknown in the derived courses."""
    files = entity_files(t).filter("path LIKE 'courses/%'")
    c = Q.course_records(files).withColumn("teacher", F.get("teachers", F.lit(0)))
    c = c.withColumn("other_teacher", F.lit(None).cast("string")).withColumn("textbook", F.lit(None).cast("string"))
    return Q.candidate_items(c, "code", Q.course_rules(), "1337")


@query("h40_person_items")
def _(t):
    p = Q.person_records(entity_files(t).filter("path LIKE 'personnel_profiles/%'"))
    out = Q.candidate_items(p, "name", Q.attribute_rules(Q.PERSON_ATTRIBUTES, "name"), "1337").select("type", "question", F.col("expected_answer").cast("string").alias("expected_answer"))
    for kind, col in Q.PERSON_FACTS:
        held = p.select("name", col).where(F.col(col).isNotNull())
        asked = Q.membership_items(held, "name", col, kind, [f"Is {{value}} the {kind} of {{entity}}?"], "1337")
        out = out.unionByName(asked.select("type", "question", "expected_answer"))
    return out


@query("h39_render_template", """
SELECT title, CASE ('0x' || md5('t|' || title)[1:6])::BIGINT % 3 WHEN 0 THEN 'A ' || title WHEN 1 THEN 'B ' || title || ' x' ELSE title || ' C' END AS text FROM (SELECT p_name || ' ' || p_partkey AS title FROM part)""")
def _(t):
    p = project_table(t)
    return p.select("title", Q.render_template(["A {title}", "B {title} x", "{title} C"], F.concat(F.lit("t|"), F.col("title")), {"title": F.col("title")}).alias("text"))


@query("j17_answer_lookup", f"""WITH {ITEMS} SELECT entity, type, question, CASE WHEN type IN ('funded_by_yes', 'funded_by_no', 'agency_funding_yes', 'agency_funding_no', 'who_funding') THEN agency
WHEN type = 'project_code' THEN code ELSE expected_answer END AS actual_answer FROM it JOIN pj ON pj.title = it.entity""")
def _(t):
    kinds = ["funded_by_yes", "funded_by_no", "agency_funding_yes", "agency_funding_no", "who_funding"]
    answers = {k: F.col("agency") for k in kinds} | {"project_code": F.col("code")}
    return Q.answer_lookup(project_items(t), project_table(t).withColumnRenamed("title", "entity"), "entity", answers).select("entity", "type", "question", "actual_answer")


QUOTAS = {"project_code": 12, "who_funding": 10, "funded_by_no": 9, "project_program": 0}
SAMPLE = f"""{ITEMS},
hs AS (SELECT *, md5('7|' || type || '|' || question) AS h, md5('7/fill|' || question) AS h2, CASE type WHEN 'project_code' THEN 12 WHEN 'who_funding' THEN 10 WHEN 'funded_by_no' THEN 9 ELSE 0 END AS quota FROM it)
"""
FILL = """,
rest AS (SELECT * FROM hs WHERE question NOT IN (SELECT question FROM picked) ORDER BY h2 LIMIT 19),
allp AS (SELECT entity, type, question FROM picked UNION ALL SELECT entity, type, question FROM rest)
SELECT entity, type, question, printf('item_%03d', row_number() OVER (ORDER BY entity, type, question)) AS id FROM allp"""


@query("k3_quota_sample", f"WITH {SAMPLE}, picked AS (SELECT * FROM hs QUALIFY row_number() OVER (PARTITION BY type ORDER BY h) <= quota) {FILL}")
def _(t):
    s = Q.quota_sample(project_items(t).select("type", "question", "entity"), QUOTAS, 50, "7", ["entity", "type", "question"])
    return s.select("entity", "type", "question", "id")


# entity of a sampled item: the first word of its title, so that entities repeat
@query("k4_diverse_quota_sample", f"""WITH {SAMPLE}, en AS (SELECT *, split_part(entity, ' ', 1) AS e FROM hs),
pa AS (SELECT *, row_number() OVER (PARTITION BY type, e ORDER BY h) > 1 AS again FROM en), picked AS (SELECT * FROM pa QUALIFY row_number() OVER (PARTITION BY type ORDER BY again, h) <= quota),
rest AS (SELECT * FROM en WHERE question NOT IN (SELECT question FROM picked) ORDER BY h2 LIMIT 19),
allp AS (SELECT e, type, question FROM picked UNION ALL SELECT e, type, question FROM rest)
SELECT e AS entity, type, question, printf('item_%03d', row_number() OVER (ORDER BY e, type, question)) AS id FROM allp""")
def _(t):
    items = project_items(t).select("type", "question", F.substring_index("entity", " ", 1).alias("entity"))
    return Q.diverse_quota_sample(items, QUOTAS, 50, "7", ["entity", "type", "question"]).select("entity", "type", "question", "id")


@query("k6_shortest_text", f"""WITH s AS (SELECT lang, source, doc_id, trim(regexp_replace(text, '{SPACE}+', ' ', 'g')) AS t FROM documents),
b AS (SELECT lang, source, t FROM s WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY length(t), doc_id) = 1)
SELECT lang, source, left(CASE WHEN length(t) > 140 THEN trim(split_part(t, '.', 1)) ELSE t END, 160) AS text FROM b""")
def _(t):
    return Q.shortest_text(t.documents, ["lang", "source"], "text", "doc_id")


# --- pages -----------------------------------------------------------------------------------------------------

HID = "regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g')"


def inner(c):
    out = f"regexp_replace({c}, '<[^>]*>', ' ', 'g')"
    for ref, ch in P.ENTITIES:
        out = f"replace({out}, '{ref}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '{SPACE}+', ' ', 'g'))"


PAT = P.LINK_OR_HEADING.replace("'", "''")
LINKS = f"""
h AS (SELECT page_id, url, {HID} AS x FROM pages),
m AS (SELECT page_id, url, unnest(regexp_extract_all(x, '{PAT}', 1)) AS href, unnest(regexp_extract_all(x, '{PAT}', 2)) AS t, unnest(regexp_extract_all(x, '{PAT}', 3)) AS hd, generate_subscripts(regexp_extract_all(x, '{PAT}', 1), 1) - 1 AS pos FROM h),
c AS (SELECT *, last_value(CASE WHEN href = '' AND hd <> '' THEN {inner('hd')} END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS heading, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS root, regexp_replace(url, '[?#].*$', '') AS page FROM m),
l AS (SELECT page_id, pos, {inner('t')} AS text, heading, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || href
   WHEN href LIKE '/%' THEN root || href WHEN href LIKE '#%' THEN regexp_replace(url, '#.*$', '') || href WHEN href LIKE '?%' THEN page || href
   ELSE CASE WHEN length(page) > length(root) THEN regexp_replace(page, '[^/]*$', '') ELSE root || '/' END || href END AS link FROM c WHERE href <> '')
"""


@query("s13_extract_links", f"WITH {LINKS} SELECT page_id, link, pos, text, heading FROM l QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY pos) = 1")
def _(t):
    return P.extract_links(t.pages).withColumn("pos", F.col("pos").cast("long"))


SPAT = P.SECTION.replace("'", "''")
SECT = f"""
h AS (SELECT page_id, url, {HID} AS x FROM pages),
m AS (SELECT page_id, url, lower(unnest(regexp_extract_all(x, '{SPAT}', 1))) AS tag, unnest(regexp_extract_all(x, '{SPAT}', 2)) AS b, generate_subscripts(regexp_extract_all(x, '{SPAT}', 1), 1) - 1 AS pos FROM h),
s AS (SELECT page_id, url, pos, tag, CASE WHEN tag = 'li' THEN '- ' ELSE '' END || {inner('b')} AS text FROM m WHERE {inner('b')} <> '')
"""


@query("s14_extract_sections", f"WITH {SECT} SELECT page_id, pos, tag, md5(text) AS text_md5 FROM s")
def _(t):
    return P.extract_sections(t.pages).select("page_id", F.col("pos").cast("long").alias("pos"), "tag", F.md5("text").alias("text_md5"))


@query("s14_page_text", f"WITH {SECT} SELECT page_id, md5(string_agg(text, chr(10) ORDER BY pos)) AS text_md5 FROM s GROUP BY 1")
def _(t):
    return P.page_text(P.extract_sections(t.pages)).select("page_id", F.md5("text").alias("text_md5"))


@query("s14_repeated_lines", f"WITH {SECT} SELECT regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS site, md5(text) AS text_md5, count(DISTINCT page_id) AS pages FROM s GROUP BY 1, 2 HAVING count(DISTINCT page_id) > 1")
def _(t):
    return P.repeated_lines(P.extract_sections(t.pages)).select("site", F.md5("text").alias("text_md5"), "pages")


RULES = {
    "email": [(r"mailto:([^\s\"'>]+)", 1), (r"\b[\w.+-]+@[\w-]+\.[\w.]+", 0)],
    "number": [(r"\b(\d{4})\b", 1), (r"\d+", 0)],
    "first_words": [(r"^([^.\n]{3,60})[.\n]", 1)],
}


@query("p14_extract_attributes", r"""WITH a AS (SELECT doc_id,
  coalesce(nullif(regexp_extract(text, 'mailto:([^\s"''>]+)', 1), ''), nullif(regexp_extract(text, '\b[\w.+-]+@[\w-]+\.[\w.]+', 0), '')) AS email,
  coalesce(nullif(regexp_extract(text, '\b(\d{4})\b', 1), ''), nullif(regexp_extract(text, '\d+', 0), '')) AS num,
  nullif(trim(regexp_replace(regexp_extract(text, '^([^.\n]{3,60})[.\n]', 1), '\s+', ' ', 'g')), '') AS fw FROM documents)
SELECT doc_id, u.attribute, u.value FROM a, LATERAL (VALUES ('email', email), ('number', num), ('first_words', fw)) u(attribute, value) WHERE u.value IS NOT NULL""")
def _(t):
    return P.extract_attributes(t.documents, "doc_id", "text", RULES)


@query("p14_extract_lists", """SELECT page_id, 'url_parts' AS attribute, unnest(list_distinct(list_filter(string_split(regexp_extract(url, '://([^?#]*)', 1), '/'), lambda x: x <> ''))) AS value FROM pages""")
def _(t):
    return P.extract_attributes(t.pages, "page_id", "url", {"url_parts": [("://([^?#]*)", 1)]}, "/")
