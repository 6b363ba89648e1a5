"""Entity graph: mentions to ids, containment links, edges with provenance, path patterns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions import text as T
from convlake.plans import slices as S
from convlake.session import staged

# fixed values: how far an edge source is trusted, and which wins at equal trust
SOURCE_CONFIDENCE = {"free_text_fallback": 0.75, "known_personnel_filename": 0.90, "anchored_identity": 0.97}
SOURCE_PRIORITY = {"free_text_fallback": 1, "known_personnel_filename": 2, "anchored_identity": 3}
DEFAULT_CONFIDENCE, DEFAULT_PRIORITY = 0.5, 0
NAME_IN_TEXT = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b"
DEPARTMENT_TAG = r"^\([A-Z0-9\-/]+\)$"

SHARD_CHARS = 2_000_000  # characters of the needles of one automaton (some 100 MB)


def _lookup(c: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def source_confidence(c: Column) -> Column:
    return _lookup(c, SOURCE_CONFIDENCE, DEFAULT_CONFIDENCE)


def source_priority(c: Column) -> Column:
    return _lookup(c, SOURCE_PRIORITY, DEFAULT_PRIORITY)


def names_in_text(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Probable person names (two to four capitalised words): (doc, pos, mention).

    At least two of the words are no titles; a repeated name counts at its first place.
    """
    found = F.regexp_extract_all(text, F.lit(NAME_IN_TEXT), F.lit(1))
    bare = lambda m: F.filter(F.split(F.lower(m), r"\s+"), lambda w: ~w.isin(T.PERSON_TITLES))
    found = F.array_distinct(F.filter(found, lambda m: F.size(bare(m)) >= 2))
    return df.select(doc, F.posexplode(found).alias("pos", "mention"))


def role_candidates(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Names of a pipe-separated role field without its department tags: (doc, pos, mention)."""
    parts = F.transform(F.split(text, r"\|"), lambda p: T.strip(p))
    kept = F.filter(parts, lambda p: (p != "") & ~p.rlike(DEPARTMENT_TAG))
    return df.select(doc, F.posexplode(kept).alias("pos", "mention"))


def person_aliases(people: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(alias, id, anchored): every id, every canonical name, and display names of known aliases.

    ``people``: id, name; ``links``: display_name, url.
    """
    own = people.select(F.col("id").alias("alias"), "id").unionByName(people.filter("name IS NOT NULL").select(T.canonicalize_person(F.col("name")).alias("alias"), "id"))
    own = own.filter("alias <> ''").groupBy("alias").agg(F.min("id").alias("id"))
    if links is None:
        return own.withColumn("anchored", F.lit(False))
    names = links.select(T.canonicalize_person(F.col("display_name")).alias("alias")).distinct()
    anchored = own.join(names, "alias").select("id").distinct().withColumn("anchored", F.lit(True))
    return own.join(anchored, "id", "left").select("alias", "id", F.coalesce("anchored", F.lit(False)).alias("anchored"))


def resolve_entities(mentions: DataFrame, aliases: DataFrame, known: DataFrame, doc: str, free_text: bool = False) -> DataFrame:
    """Mentions to known ids, one row per document and id at its first position.

    ``source`` says how the id was found: over an anchored alias, by name, or in free text. The
    lookup tables hold one row per key, so a mention that fills a third of the input is split by
    the adaptive skew join.
    """
    m = mentions.withColumn("_canon", T.canonicalize_person(F.col("mention"))).filter("_canon <> ''")
    m = m.join(aliases.withColumnRenamed("alias", "_canon"), "_canon", "left")
    m = m.withColumn("id", F.coalesce("id", "_canon")).join(known.select("id"), "id", "left_semi")
    source = F.when(F.coalesce("anchored", F.lit(False)), "anchored_identity").otherwise("free_text_fallback" if free_text else "known_personnel_filename")
    return m.groupBy(doc, "id").agg(F.min_by(source, "pos").alias("source"), F.min("pos").alias("pos"))


# --- containment ------------------------------------------------------------------------------------


def _scanner(needles: Sequence[str]):
    """Texts -> (text, needle) for each needle in a text, once, by one Aho-Corasick automaton over all needles."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for n in needles:
        automaton.add_word(n, n)
    automaton.make_automaton()

    def scan(texts: Iterable[str]) -> pd.DataFrame:
        return pd.DataFrame([(h, n) for h in texts for n in {n for _, n in automaton.iter(h)}], columns=["h", "n"])

    return scan


def _contained(hay: DataFrame, needle: DataFrame, longest: int, hay_chars: int, chars: int) -> DataFrame:
    """Pairs (h, n) of the texts in stored tables of distinct ones, where ``h`` contains ``n``.

    ``longest``: characters of the longest text, ``hay_chars`` and ``chars``: of all texts and needles.

    Each text is read once, by an automaton over needles that are together SHARD_CHARS characters at most.
    If all needles are no more than that, they go to every task; else shards of needles meet chunks of
    texts in a grid. Needles longer than every text are left out.
    """
    spark = hay.sparkSession
    needle = needle.where(F.length("n") <= longest)
    if chars > SHARD_CHARS:
        chars = needle.agg(F.coalesce(F.sum(F.length("n")), F.lit(0))).first()[0]
    schema = "h string, n string"
    if not chars:
        return spark.createDataFrame([], schema)
    if chars <= SHARD_CHARS:
        needles = spark.sparkContext.broadcast([r.n for r in needle.collect()])

        def scan_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scan = _scanner(needles.value)
            for pdf in batches:
                yield scan(pdf["h"])

        return hay.mapInPandas(scan_all, schema)
    shards, chunks = -(-chars // SHARD_CHARS), -(-hay_chars // SHARD_CHARS)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    hay = hay.select("h", part("h", chunks).alias("chunk"), every(shards).alias("shard"))
    needle = needle.select("n", part("n", shards).alias("shard"), every(chunks).alias("chunk"))

    def scan_cell(texts: pd.DataFrame, needles: pd.DataFrame) -> pd.DataFrame:
        return _scanner(needles["n"])(texts["h"]) if len(needles) and len(texts) else pd.DataFrame(columns=["h", "n"], dtype=object)

    return hay.groupBy("shard", "chunk").cogroup(needle.groupBy("shard", "chunk")).applyInPandas(scan_cell, schema)


def containment_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (l, r) of the text columns ``l`` and ``r`` where one contains the other."""
    ls, rs = (staged(df.select(c).filter(F.col(c) != "").distinct()) for df, c in ((left, "l"), (right, "r")))
    sizes = ls.select(F.length("l").alias("l"), F.lit(0).alias("r")).union(rs.select(F.lit(0), F.length("r")))
    l_most, l_chars, r_most, r_chars = sizes.agg(*[F.coalesce(f(c), F.lit(0)) for c in "lr" for f in (F.max, F.sum)]).first()
    a = _contained(ls.withColumnRenamed("l", "h"), rs.withColumnRenamed("r", "n"), l_most, l_chars, r_chars).select(F.col("h").alias("l"), F.col("n").alias("r"))
    b = _contained(rs.withColumnRenamed("r", "h"), ls.withColumnRenamed("l", "n"), r_most, r_chars, l_chars).select(F.col("n").alias("l"), F.col("h").alias("r"))
    return a.union(b.filter("l <> r"))  # equal texts are among the first


def fuzzy_link(texts: DataFrame, entities: DataFrame, key: str, value: str, cut_comma: bool = False, equality_first: bool = True) -> DataFrame:
    """Multi-value texts to entities by equal or containing names; the first candidate decides.

    Candidates are the whole value and its parts at ``;`` and ``|`` (with ``cut_comma`` up to the
    first comma). ``entities``: id, name, ord. Within a candidate equality wins if
    ``equality_first``, then the smallest ``ord``.
    """
    whole = F.array(F.col(value))
    parts = F.filter(F.transform(F.split(value, r"[;|]"), lambda p: T.strip(p)), lambda p: p != "")
    cand = texts.filter(F.col(value) != "").select(key, F.posexplode(F.concat(whole, parts)).alias("cand_pos", "cand"))
    if cut_comma:
        cand = cand.withColumn("cand", F.substring_index("cand", ",", 1))
    cand = cand.select(key, "cand_pos", T.canonicalize_text(F.col("cand")).alias("l")).filter("l <> ''")
    ents = entities.select("id", "ord", T.canonicalize_text(F.col("name")).alias("r")).filter("r <> ''")
    tier = F.when(F.col("l") == F.col("r"), 0).otherwise(1) if equality_first else F.lit(0)
    # of the entities with one name only the first can win
    named = ents.groupBy("r").agg(F.min_by(F.struct("ord", "id"), F.struct("ord", "id")).alias("e"))
    best = containment_pairs(cand, ents).join(named, "r").groupBy("l").agg(F.min(F.struct(tier.alias("tier"), F.col("e.ord").alias("ord"), F.col("e.id").alias("id"))).alias("b"))
    return cand.join(best, "l").groupBy(key).agg(F.min_by("b.id", F.struct("cand_pos", "b")).alias("id"))


def lookup_exact_then_contains(queries: DataFrame, entities: DataFrame, key: str, query: str, limit: int = 5) -> DataFrame:
    """Exact id, else up to ``limit`` ids in a containment relation: the first is the answer.

    ``entities``: id (canonical). Output: key, id, alternatives.
    """
    q = queries.select(key, T.canonicalize_text(F.col(query)).alias("l")).filter("l <> ''")
    ids = entities.select(F.col("id").alias("r")).distinct()
    asked = q.select("l").distinct()
    exact = asked.join(ids, F.col("l") == F.col("r")).select("l", F.array("r").alias("found"))
    pairs = containment_pairs(asked.join(exact, "l", "left_anti"), ids)
    w = Window.partitionBy("l").orderBy("r")
    top = pairs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit)
    near = top.groupBy("l").agg(F.sort_array(F.collect_list("r")).alias("found"))
    hit = q.join(exact.unionByName(near), "l", "left")
    return hit.select(key, F.get("found", F.lit(0)).alias("id"), F.coalesce(F.slice("found", 2, limit), F.array().cast("array<string>")).alias("alternatives"))


def enrich_names(docs: DataFrame, curriculum: DataFrame, code: str) -> DataFrame:
    """Title of a document's code from nested curricula; the first title seen counts.

    ``curriculum``: ord, curriculum array<struct<courses array<struct<abbreviation, title>>>>.
    """
    sem = curriculum.select("ord", F.posexplode("curriculum").alias("_s", "sem"))
    course = sem.select("ord", "_s", F.posexplode("sem.courses").alias("_c", "course")).filter("course.abbreviation IS NOT NULL AND course.title IS NOT NULL")
    norm = T.normalise_text
    titles = course.groupBy(norm(F.col("course.abbreviation")).alias("_code")).agg(F.min_by(norm(F.col("course.title")), F.struct("ord", "_s", "_c")).alias("course_name"))
    return docs.withColumn("_code", norm(F.col(code))).join(titles, "_code", "left").drop("_code")


# --- edges ------------------------------------------------------------------------------------------------


def edge(df: DataFrame, rel: str, src: Column, dst: Column, source: Column, path: Column, field: str, ord: Column) -> DataFrame:
    """One edge source as rows of the common edge table."""
    return df.select(
        F.lit(rel).alias("rel_type"), src.alias("src"), dst.alias("dst"), source.alias("source"), path.alias("evidence_path"),
        F.lit(field).alias("evidence_field"), source_confidence(source).alias("confidence"), ord.alias("ord"),
    )


def merge_edge_evidence(edges: DataFrame) -> DataFrame:
    """Per edge the evidence with the highest confidence, then source priority, then the earliest."""
    rest = ["source", "evidence_path", "evidence_field", "confidence"]
    rank = F.struct("confidence", source_priority(F.col("source")).alias("p"), (-F.col("ord")).alias("o"))
    best = edges.groupBy("rel_type", "src", "dst").agg(F.max_by(F.struct(*rest), rank).alias("e"))
    return best.select("rel_type", "src", "dst", "e.*")


def build_edges(*sources: DataFrame) -> DataFrame:
    """Union of all edge sources, one row per edge with its best evidence."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return merge_edge_evidence(out)


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("rel_type", "src", "dst").distinct()


def evidence_distribution(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel_type", F.coalesce("source", F.lit("none")).alias("source")).agg(
        F.count(F.lit(1)).alias("edges"), F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 3).alias("avg_confidence")
    )


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node counts per type and edge counts per relation."""
    n = nodes.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("node"))
    e = edges.groupBy(F.col("rel_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("edge"))
    return n.unionByName(e)


def unresolved_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges per relation whose source node does not exist."""
    missing = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_anti")
    return missing.groupBy("rel_type").agg(F.count(F.lit(1)).alias("unresolved"))


def graph_paths(start: DataFrame, edges: DataFrame, hops: Sequence[tuple[str, bool]]) -> DataFrame:
    """Follow relations from ``start`` (column ``n0``): ``hops`` are (relation, optional).

    Each hop adds the column of the node reached; an optional hop keeps paths that end early.
    """
    out = start
    for i, (rel, optional) in enumerate(hops):
        step = edges.filter(F.col("rel_type") == rel).select(F.col("src").alias(f"n{i}"), F.col("dst").alias(f"n{i + 1}"))
        out = out.join(step, f"n{i}", "left" if optional else "inner")
    return out.select(*[f"n{i}" for i in range(len(hops) + 1)])


def negative_sample(held: DataFrame, entity: str, value: str, seed: str) -> DataFrame:
    """One value per entity that it does not hold, picked by digest.

    The universe of values is put in digest order and numbered. An entity starts at its own place
    and takes the first free one from there, round the end. Its held places, counted from the start
    and put in order, are 0, 1, 2, … up to the first free one, so an ordered scan finds it.
    """
    pairs = held.select(entity, value).distinct()
    universe = pairs.select(value).distinct().withColumn("_m", F.md5(F.concat_ws("|", F.lit(seed), value)))
    universe = universe.withColumn("_all", F.lit(0))
    at = F.conv(F.substring("_m", 1, 4), 16, 10).cast("long")
    ranked = S.row_index(universe, ["_all"], ["_m", value], at, "_i").select(value, "_i")
    size = ranked.agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0))
    own = pairs.join(ranked, value).select(entity, "_i")
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), entity)), 1, 8), 16, 10).cast("long")
    counts = own.groupBy(entity).agg(F.count(F.lit(1)).alias("_d")).withColumn("_all", F.lit(0)).join(size, "_all").filter("_d < _n")
    counts = counts.select(entity, "_n", (start % F.col("_n")).alias("_s"))
    away = own.join(counts, entity).select(entity, "_n", "_s", F.pmod(F.col("_i") - F.col("_s"), F.col("_n")).alias("_k"))
    placed = S.row_index(away, [entity], ["_k"], S.by_index("_k", 1 << 20), "_at")
    # up to the first free place both agree, from there on the places run ahead
    first = placed.groupBy(entity).agg(F.count_if(F.col("_k") == F.col("_at")).alias("_free"), F.first("_n").alias("_n"), F.first("_s").alias("_s"))
    first = first.select(entity, ((F.col("_s") + F.col("_free")) % F.col("_n")).alias("_i"))
    return first.join(ranked, "_i").select(entity, value)
