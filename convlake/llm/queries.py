"""Registered queries of the operators in this folder, with their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from convlake.llm import bpe, entropy, factors, importance, langid, mixing, negatives, packing, repair, secrets, simhash, sketches, voronoi
from convlake.llm.common import staged
from convlake.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{path.rstrip('/')}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_near_dedup(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprints over four-word shingles, linked at four differing bits or fewer."""
    return simhash.near_copies(table(spark, path, "documents"), words=4, radius=4)


@query
def op10_bounded_space_packing(spark: SparkSession, path: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    pieces = packing.pack(table(spark, path, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op9_language_id(spark: SparkSession, path: str) -> DataFrame:
    """Predicted language of every document; a quarter of the documents is never learned from."""
    docs = table(spark, path, "documents")
    held = F.coalesce(langid.remainder() == 2, F.lit(False)).alias("held_out")
    return langid.identified(docs).select("doc_id", held, "lang_pred", "score", "rejected")


def _spans_sql(rule: secrets.Rule, order: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, p AS start, {order} AS k, p + length(m) AS "end", '{rule.kind}' AS kind FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(ps) AS part, unnest(list_transform(range(1, len(ms) + 1), lambda i:
      list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))) AS p
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {rule.group}) AS ps,
      string_split_regex(t, '{pattern}') AS gaps FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
  ) WHERE length(part) >= {rule.least}"""


ORACLES["op5_secret_scan"] = f"""
WITH s AS ({" UNION ALL ".join(_spans_sql(rule, k) for k, rule in enumerate(secrets.RULES))}),
t AS (SELECT doc_id, string_agg(kind || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, k) AS spans,
  coalesce(string_agg(kind || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, k) FILTER (k < {len(secrets.BASE)}), '') AS base,
  count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN t USING (doc_id)
"""


@query
def op5_secret_scan(spark: SparkSession, path: str) -> DataFrame:
    """Secrets of every document: the three base kinds and the further rules."""
    found = secrets.scan(table(spark, path, "documents"))
    of = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secrets.listed(F.filter("_spans", lambda s: s["order"] < len(secrets.BASE)))
    return found.select("doc_id", *[of(rule.kind) for rule in secrets.BASE], F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("_spans")).alias("spans"))


WORD = "[^\\x20\\x09-\\x0D]+"
ORACLES["op2_source_mixing"] = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
  substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
f AS (SELECT *, sum(size) OVER () AS t, sum(weight) OVER () AS tw,
  coalesce(sum(size) OVER w, 0) AS fs, coalesce(sum(weight) OVER w, 0) AS fw, row_number() OVER (ORDER BY size / weight, source) AS k
  FROM s WINDOW w AS (ORDER BY size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (t - 3::DOUBLE * fs) / (tw - fw) AS level, k FROM f WHERE 3 * size > (t - 3::DOUBLE * fs) / (tw - fw) * weight ORDER BY k LIMIT 1),
g AS (SELECT source, size, least(3::DOUBLE * size, coalesce((SELECT level FROM l), 0) * weight) AS target FROM s),
p AS (SELECT doc_id, d.source, d.size, g.size AS source_size, g.target, floor(g.target)::BIGINT AS words,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0
  ELSE (words // source_size * size + greatest(0, least(size, words % source_size - place)))::BIGINT END AS taken FROM p
"""


@query
def op2_source_mixing(spark: SparkSession, path: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mixed_sizes(table(spark, path, "documents"))


@query
def op3_substring_dedup(spark: SparkSession, path: str) -> DataFrame:
    """What repeated windows of 35 words take from every document."""
    out = factors.remove_repeats(table(spark, path, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op7_document_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Sketches of every text and of its edited text, with their likeness and that of the next document."""
    rows = sketches.with_next(table(spark, path, "documents"))
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int"))
    rows = rows.withColumn("edited", F.concat(kept, "next_head")).withColumn("edited_sketch", sketches.sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketches.as_text(F.col("sketch")).alias("fingerprint"),
        sketches.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketches.containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketches.containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


ORACLES["op4_voronoi_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op4_voronoi_top_k(spark: SparkSession, path: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    found = voronoi.top_k(table(spark, path, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return found.withColumnRenamed("id", "vec_id")


@query
def op6_cross_entropy_difference(spark: SparkSession, path: str) -> DataFrame:
    """Loss difference of every document; the target are the documents labelled good."""
    good = table(spark, path, "labels").where("quality = 1")
    return entropy.scored(table(spark, path, "documents"), good)


@query
def op8_importance_resampling(spark: SparkSession, path: str) -> DataFrame:
    """Draws and selection of every document; as large a share is selected as is labelled good."""
    return importance.resampled(table(spark, path, "documents"), table(spark, path, "labels"))


@query
def op11_byte_pair_encoding(spark: SparkSession, path: str) -> DataFrame:
    """Ids of every text by the ranks of the multilingual vocabulary, and the bytes they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.encoded(table(spark, path, "documents"), ranks, public_tokenizers.PATTERN)
    return rows.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


ORACLES["op12_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS a, d.vec_id AS d, q.label = d.label AS same, list_dot_product(q.v, d.v)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
p AS (SELECT a, d AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, d) <= 5),
n AS (SELECT p.a, positive_id, positive_score, s.d, s.score, row_number() OVER (PARTITION BY p.a, positive_id ORDER BY s.score DESC, s.d) AS r
  FROM p JOIN s ON p.a = s.a AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT a AS anchor_id, positive_id, r::INTEGER AS rank, d AS negative_id, positive_score, score AS negative_score FROM n WHERE r <= 3
"""


@query
def op12_hard_negatives(spark: SparkSession, path: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh carries the next label."""
    rows = table(spark, path, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with five of twenty kinds of rows damaged; a row's kind is a digest of its id and turn. Nulls are one space."""
    gap = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", gap("conv_id"), gap("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(gap("text"), ".!?", "")).otherwise(gap("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(gap("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1))
    rows = rows.withColumn("kind", kind).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies))
    return rows.drop("col")


@query
def op13_conversation_repair(spark: SparkSession, path: str) -> DataFrame:
    """Faults of the damaged conversations, their cheapest repair and the digest of what it gives."""
    rows = table(spark, path, "conversations")
    found = damaged(rows)
    audits = staged(repair.audited(found), "audits")
    every = rows.select(F.col("conv_id").alias("c")).distinct()
    for part in (audits, repair.digests(found, audits)):
        every = every.join(part, F.col("c").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    zeros = [F.coalesce(n, F.lit(0)).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select(F.col("c").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
