"""Nested JSON entities: one document per file, read as variants and flattened to leaves."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from convlake.functions import text as T
from convlake.operators.chunks import entity_context

# fixed values: folder -> entity type
ENTITY_FOLDERS = {
    "personnel_profiles": "Person",
    "courses": "Course",
    "groups": "ResearchGroup",
    "projects": "Project",
    "publications": "Publication",
}
# fixed values: keys whose wrapped texts are paragraphs of one text
PARAGRAPH_KEYS = ["about", "overview", "abstract", "details", "description", "content", "current_research_topics"]


def read_entity_files(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, body) for every JSON file below ``root``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    full = F.col("_metadata.file_path")
    base = root.rstrip("/").split("://")[-1]
    return files.select(F.substring_index(full, f"{base}/", -1).alias("path"), F.col("value").alias("body"))


def field(body: Column, path: str) -> Column:
    """Trimmed text at a JSON path, null when missing or blank."""
    return F.nullif(T.strip(F.get_json_object(body, f"$.{path}")), F.lit(""))


def parse_entities(files: DataFrame) -> DataFrame:
    """(path, body) to (path, entity_type, entity_id, entity_context, body)."""
    body, path = F.col("body"), F.col("path")
    top = F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("root")
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    kind = F.lit("Document")
    for folder, name in ENTITY_FOLDERS.items():
        kind = F.when(top == folder, name).otherwise(kind)
    raw = (
        F.when(kind == "Course", F.coalesce(field(body, "metadata.code"), stem))
        .when(kind == "ResearchGroup", F.coalesce(field(body, "group"), stem))
        .when(kind == "Project", F.coalesce(field(body, "title"), field(body, "project"), stem))
        .when(kind == "Publication", F.coalesce(field(body, "title"), stem))
        .otherwise(stem)
    )
    df = files.select("path", "body", stem.alias("stem"), kind.alias("entity_type"), raw.alias("_raw"))
    name = F.when(F.col("entity_type") == "Person", F.substring_index(F.replace("_raw", F.lit("_"), F.lit(" ")), ",", 1)).otherwise(F.col("_raw"))
    df = df.withColumn("_canon", T.canonicalize_text(name))
    person = F.trim(F.array_join(F.filter(F.split("_canon", " "), lambda x: ~x.isin(T.PERSON_TITLES)), " "))
    df = df.withColumn("entity_id", F.when(F.col("entity_type") == "Person", person).otherwise(F.col("_canon")))
    kind, eid, stem = F.col("entity_type"), F.col("entity_id"), F.col("stem")
    context = (
        F.when(kind == "Course", entity_context(kind, eid, code=F.coalesce(field(body, "metadata.code"), stem), course_name=field(body, "metadata.course_name"), department=field(body, "content.department")))
        .when(kind == "Person", entity_context(kind, eid, person=stem, email=field(body, "contact.details.e_mail"), room=field(body, "contact.details.room")))
        .when(kind == "ResearchGroup", entity_context(kind, eid, group=F.coalesce(field(body, "group"), stem), contact=F.coalesce(field(body, "team.principal_researcher[0].name"), field(body, "team.principal_researcher[0]"))))
        .when(kind == "Project", entity_context(kind, eid, project=F.coalesce(field(body, "title"), field(body, "project"), stem), code=field(body, "metadata.code"), agency=field(body, "metadata.agency")))
        .when(kind == "Publication", entity_context(kind, eid, title=F.coalesce(field(body, "title"), stem), year=field(body, "year"), type=field(body, "sections.type.text")))
        .otherwise(entity_context(kind, eid))
    )
    return df.select("path", "entity_type", "entity_id", context.alias("entity_context"), "body")


def read_entities(spark: SparkSession, root: str) -> DataFrame:
    return parse_entities(read_entity_files(spark, root))


def _leaves(value, prefix=""):
    if isinstance(value, str):
        if value.strip():
            yield prefix or "text", value.strip()
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, f"{prefix}.{k}" if prefix else str(k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _leaves(v, f"{prefix}[{i}]")


LEAVES = ArrayType(StructType([StructField("source_field", StringType()), StructField("text", StringType())]))


@F.pandas_udf(LEAVES)
def json_leaves(bodies: pd.Series) -> pd.Series:
    """String leaves of a document of any depth; blank and other leaves are dropped."""
    return bodies.map(lambda b: [{"source_field": p, "text": t} for p, t in _leaves(json.loads(b))])


def _answers(value):
    if isinstance(value, bool) or value is None:
        return
    if isinstance(value, (int, float)):
        yield str(value)
    elif isinstance(value, str):
        if value.strip():
            yield value.strip()
    else:
        for v in value.values() if isinstance(value, dict) else value:
            yield from _answers(v)


@F.pandas_udf(ArrayType(StringType()))
def answer_strings(answers: pd.Series) -> pd.Series:
    """Strings and numbers of a JSON answer of any shape; booleans are no targets."""
    return answers.map(lambda a: [] if a is None else list(_answers(json.loads(a))))


def answer_targets(answer: Column, min_length: int = 4) -> Column:
    """Distinct normalised answer strings that are long enough to look for."""
    forms = F.transform(answer_strings(answer), lambda s: T.match_normal_form(s))
    return F.array_distinct(F.filter(forms, lambda s: F.length(s) >= min_length))


def flatten_leaves(entities: DataFrame) -> DataFrame:
    """One row per string leaf: ``seq`` keeps the order of the document."""
    keep = [c for c in entities.columns if c != "body"]
    return entities.select(*keep, F.posexplode(json_leaves("body")).alias("seq", "_leaf")).select(*keep, "seq", "_leaf.*")


def flatten_map(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """Depth-one documents: (key, value) without leaving the JVM."""
    return df.select(*keep, F.explode(F.from_json(col, "map<string,string>")).alias("source_field", "text")).filter(F.trim("text") != "")


def prune_leaves(leaves: DataFrame, drop_links: bool = True, drop_urls: bool = True) -> DataFrame:
    """Drop leaves below ``links`` keys, at URL keys, blank ones, and ``title: detail``."""
    steps = F.transform(F.split(F.regexp_replace("source_field", r"\[\d+\]", ""), r"\."), lambda k: F.lower(F.trim(k)))
    out = leaves.filter(T.strip(F.col("text")) != "")
    if drop_links:
        out = out.filter(~F.exists(steps, lambda k: k == "links"))
    if drop_urls:
        out = out.filter(~F.exists(steps, lambda k: (k == "url") | k.endswith("_url")))
    return out.filter(~((F.element_at(steps, -1) == "title") & (F.lower(T.strip(F.col("text"))) == "detail")))


def collapse_wrappers(leaves: DataFrame, doc: str) -> DataFrame:
    """Shorten ``k.text``/``k.value`` wrappers to ``k``; join wrapped paragraphs of known keys.

    A wrapper is an object whose only leaf is that one. Items of a list of wrappers become one
    text for paragraph keys or single items, and stay separate otherwise. The counts are as many as the
    leaves, but small by Spark's estimate, which the explode misleads: they are merged, not broadcast.
    """
    parent = F.regexp_extract("source_field", r"^(.*)\.(?:text|value)$", 1)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(F.split("source_field", r"\."))),
        lambda n: F.array_join(F.slice(F.split("source_field", r"\."), 1, n), "."),
    )
    sizes = leaves.select(doc, F.explode(prefixes).alias("_parent")).groupBy(doc, "_parent").agg(F.count(F.lit(1)).alias("_size"))
    marked = leaves.withColumn("_parent", parent).join(sizes.hint("merge"), [doc, "_parent"], "left")
    sole = (F.col("_parent") != "") & (F.col("_size") == 1)
    path = F.when(sole, F.col("_parent")).otherwise(F.col("source_field"))
    marked = marked.select(doc, "seq", "text", path.alias("_path"), (sole & F.col("source_field").endswith(".text")).alias("_wrapped"))
    stem = F.when(F.col("_wrapped") & F.col("_path").rlike(r"\[\d+\]$"), F.regexp_replace("_path", r"\[\d+\]$", ""))
    marked = marked.withColumn("_list", stem)
    lists = marked.filter(F.col("_list").isNotNull()).groupBy(doc, "_list").agg(F.count(F.lit(1)).alias("_items"))
    marked = marked.join(lists.hint("merge"), [doc, "_list"], "left")
    last_key = F.lower(F.trim(F.regexp_replace(F.element_at(F.split("_list", r"\."), -1), r"\[\d+\]", "")))
    joined = F.col("_list").isNotNull() & ((F.col("_items") == 1) | last_key.isin(PARAGRAPH_KEYS))
    marked = marked.withColumn("source_field", F.when(joined, F.col("_list")).otherwise(F.col("_path")))
    parts = F.sort_array(F.collect_list(F.struct("seq", "text")))
    return marked.groupBy(doc, "source_field").agg(F.min("seq").alias("seq"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))
