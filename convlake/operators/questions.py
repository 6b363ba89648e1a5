"""Question sets from entity attributes: records, items, answers, seeded samples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions import text as T
from convlake.operators.graph import negative_sample
from convlake.session import staged
from convlake.sources.entities import field

# fixed values: how points are written in assessment texts
POINT_PATTERNS = {
    "midterm": [r"(\d+)\s*pts?[^\n]*mid[- ]?term", r"mid[- ]?term[^\n]*?(\d+)\s*points", r"half[- ]?semestral[^\n]*?(\d+)\s*pts?"],
    "final": [r"(\d+)\s*pts?[^\n]*final exam", r"final exam[^\n]*?(\d+)\s*points", r"semestral exam[^\n]*?(\d+)\s*pts?"],
    "project": [r"(\d+)\s*pts?[^\n]*projects?", r"projects?[^\n]*?(\d+)\s*points", r"presentation of project[^\n]*?(\d+)\s*points"],
}


@dataclass(frozen=True)
class ItemRule:
    """One kind of question: asked when ``answer`` is not null."""

    type: str
    answer_field: str
    templates: tuple[str, ...]
    answer: Column
    slots: tuple[str, ...] = ()


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """First group of the first pattern that matches, case ignored."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit("")) for p in patterns])


def points(text: Column, kind: str) -> Column:
    return F.concat(first_match(text, POINT_PATTERNS[kind]), F.lit(" pts"))


def people_list(c: Column) -> Column:
    """Names of a pipe-separated field, department tags left out, repeats dropped."""
    names = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda p: T.squeeze(p))
    return F.array_distinct(F.filter(names, lambda p: (p != "") & ~p.startswith("(")))


def course_records(entities: DataFrame) -> DataFrame:
    """Course entities (path, body) to flat attribute rows."""
    b = F.col("body")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    get = lambda p: T.squeeze(field(b, p))
    blob = F.concat_ws("\n", F.get_json_object(b, "$.content.assessment_points"), F.get_json_object(b, "$.content.progress_assessment"))
    credits = F.regexp_extract(get("metadata.credits"), r"(?i)(\d+)\s*credits?", 1)
    semester = get("metadata.semester")
    project_blob = F.concat_ws("\n", *[F.get_json_object(b, f"$.content.{k}") for k in ("time_span", "assessment_points", "progress_assessment")])
    fallbacks = F.array(*[F.struct(field(b, f"metadata.{k}").alias("label"), F.lit(k).alias("field")) for k in ("semester", "credits", "academic_year")])
    hit = F.get(F.filter(fallbacks, lambda x: T.normalize_semester(x["label"]) != "unknown"), F.lit(0))
    some = F.get(F.filter(fallbacks, lambda x: x["label"].isNotNull()), F.lit(0))
    return entities.select(
        F.coalesce(field(b, "metadata.code"), stem).alias("code"), get("metadata.course_name").alias("course_name"),
        F.when(credits != "", F.concat(credits, F.lit(" credits"))).alias("credits"),
        F.when(semester.rlike(r"(?i)\b(winter|summer)\b"), semester).alias("semester"),
        F.coalesce(hit["label"], some["label"]).alias("semester_label"), T.normalize_semester(hit["label"]).alias("semester_norm"),
        F.coalesce(hit["field"], F.when(some["label"].isNotNull(), F.lit("semester"))).alias("semester_source_field"),
        F.nullif(T.squeeze(F.substring_index(field(b, "content.department"), "|", 1)), F.lit("")).alias("department"),
        F.array_distinct(F.concat(people_list(field(b, "content.lecturer")), people_list(field(b, "content.instructor")))).alias("teachers"),
        points(blob, "midterm").alias("midterm_points"), points(blob, "final").alias("final_points"), points(blob, "project").alias("project_points"),
        project_blob.rlike(r"(?i)\bproject(s)?\b").alias("has_project"),
    )


def person_records(entities: DataFrame) -> DataFrame:
    """Person entities to contact rows; the id is the canonical name."""
    b = F.col("body")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    name, mail, room = field(b, "name"), field(b, "contact.details.e_mail"), field(b, "contact.details.room")
    return entities.select(
        T.canonicalize_person(F.coalesce(name, stem)).alias("profile_id"), name.alias("name"), mail.alias("email"), room.alias("office_room"),
        field(b, "contact.details.work_phone").alias("phone"), field(b, "teaching.consulting_hours").alias("consulting_hours"),
        mail.isNotNull().alias("has_email"), room.isNotNull().alias("has_office_room"),
    )


def project_records(entities: DataFrame) -> DataFrame:
    b = F.col("body")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    title = F.coalesce(field(b, "title"), field(b, "project"), stem)
    return entities.select(T.squeeze(title).alias("title"), *[T.squeeze(field(b, f"metadata.{p}")).alias(n) for n, p in (("agency", "agency"), ("program", "program"), ("period", "project_period"), ("code", "code"))])


def publication_records(entities: DataFrame) -> DataFrame:
    b = F.col("body")
    return entities.select(field(b, "title").alias("title"), field(b, "year").alias("year"), *[field(b, f"sections.{s}.text").alias(s) for s in ("authors", "projects", "research_groups", "departments", "type", "publisher")]).filter("title IS NOT NULL")


def group_records(entities: DataFrame) -> DataFrame:
    """Group entities with their members (role, name) as an array."""
    b = F.col("body")
    team = F.from_json(F.get_json_object(b, "$.team"), "map<string,array<struct<name:string,position:string>>>")
    members = F.flatten(F.transform(F.map_entries(team), lambda e: F.transform(e["value"], lambda m: F.struct(e["key"].alias("role"), m["name"].alias("name")))))
    return entities.select(field(b, "group").alias("group"), F.filter(members, lambda m: m["name"].isNotNull()).alias("members"), T.squeeze(field(b, "team.principal_researcher[0].name")).alias("contact_person"))


# --- items -------------------------------------------------------------------------------------------------


def render_template(templates: Sequence[str], seed: Column, slots: dict[str, Column]) -> Column:
    """One of the templates by the seed's digest, its slots filled."""
    pick = F.conv(F.substring(F.md5(seed), 1, 6), 16, 10).cast("int") % len(templates)
    out = F.element_at(F.array(*[F.lit(x) for x in templates]), pick + 1)
    for name, value in slots.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value)
    return out


def candidate_items(records: DataFrame, key: str, rules: Sequence[ItemRule], seed: str) -> DataFrame:
    """One question per record and rule whose answer exists: a row-local explode.

    Output: entity, type, question, expected_answer, answer_field.
    """
    rows = []
    for r in rules:
        at = F.concat_ws("|", F.lit(seed), F.lit(r.type), F.col(key))
        ask = render_template(r.templates, at, {s: F.coalesce(F.col(s).cast("string"), F.lit("")) for s in r.slots})
        rows.append(F.struct(F.lit(r.type).alias("type"), ask.alias("question"), r.answer.cast("string").alias("expected_answer"), F.lit(r.answer_field).alias("answer_field")))
    out = records.select(F.col(key).cast("string").alias("entity"), F.explode(F.array(*rows)).alias("r")).select("entity", "r.*")
    return out.filter("expected_answer IS NOT NULL")


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").when(~flag, "No")


def course_rules() -> list[ItemRule]:
    """Thirteen kinds of course questions; ``teacher`` and ``other_teacher`` come from the caller."""
    c = F.col
    one = ("code",)
    return [
        ItemRule("midterm_points", "content.assessment_points/progress_assessment(mid-term)", ("How many points does the mid-term of {code} give?", "What is the mid-term of {code} worth?"), c("midterm_points"), one),
        ItemRule("final_points", "content.assessment_points/progress_assessment(final)", ("How many points does the final exam of {code} give?", "What is the final exam of {code} worth?"), c("final_points"), one),
        ItemRule("project_points", "content.assessment_points/progress_assessment(project)", ("How many points does the project of {code} give?", "What is project work in {code} worth?"), c("project_points"), one),
        ItemRule("has_project", "content.time_span/assessment/progress(project presence)", ("Does {code} have a project?", "Is a project part of {code}?"), yes_no(c("has_project")), one),
        ItemRule("who_teaches", "content.lecturer/content.instructor", ("Who are the teachers of {code}?", "Who gives {code}?"), F.nullif(F.array_join(F.slice("teachers", 1, 4), ", "), F.lit("")), one),
        ItemRule("is_teacher_yes", "content.lecturer/content.instructor", ("Is {code} taught by {teacher}?",), F.when(c("teacher").isNotNull(), "Yes"), ("code", "teacher")),
        ItemRule("is_teacher_no", "content.lecturer/content.instructor", ("Is {code} taught by {other_teacher}?",), F.when(c("other_teacher").isNotNull(), "No"), ("code", "other_teacher")),
        ItemRule("is_summer", "metadata.semester", ("Does {code} take place in summer?", "Is {code} a summer course?"), yes_no(F.lower("semester").contains("summer")), one),
        ItemRule("credits", "metadata.credits", ("How many credits does {code} bring?", "What credits come with {code}?"), c("credits"), one),
        ItemRule("textbook", "content.fundamental_literature/content.study_literature(first item)", ("Name one textbook for {code}.", "What can one read for {code}?"), c("textbook"), one),
        ItemRule("department", "content.department", ("Which department gives {code}?", "Whose course is {code}?"), c("department"), one),
        ItemRule("code_expansion", "metadata.course_name", ("What is the name of {code}?", "What does the code {code} mean?"), c("course_name"), one),
        ItemRule("code_lookup", "metadata.code", ("What is the code of {course_name}?",), F.when(c("course_name").isNotNull(), c("code")), ("course_name",)),
    ]


def project_rules() -> list[ItemRule]:
    """Eight kinds of project questions; ``other_agency`` comes from the caller."""
    c = F.col
    yes, no = F.when(c("agency").isNotNull(), "Yes"), F.when(c("other_agency").isNotNull(), "No")
    return [
        ItemRule("funded_by_yes", "metadata.agency", ("Does {agency} pay for {title}?",), yes, ("title", "agency")),
        ItemRule("agency_funding_yes", "metadata.agency", ("Is {agency} the source of funds of {title}?",), yes, ("title", "agency")),
        ItemRule("who_funding", "metadata.agency", ("Who pays for {title}?", "Which agency supports {title}?"), c("agency"), ("title",)),
        ItemRule("funded_by_no", "metadata.agency", ("Does {other_agency} pay for {title}?",), no, ("title", "other_agency")),
        ItemRule("agency_funding_no", "metadata.agency", ("Is {other_agency} the source of funds of {title}?",), no, ("title", "other_agency")),
        ItemRule("project_program", "metadata.program", ("Which program is {title} in?",), c("program"), ("title",)),
        ItemRule("project_period", "metadata.project_period", ("When does {title} run?",), c("period"), ("title",)),
        ItemRule("project_code", "metadata.code", ("What is the code of {title}?",), c("code"), ("title",)),
    ]


def attribute_rules(family: Sequence[tuple[str, str, str]], slot: str) -> list[ItemRule]:
    """Rules (type, column, field) for families whose questions ask for one attribute."""
    return [ItemRule(kind, fld, (f"What is the {kind.replace('_', ' ')} of {{{slot}}}?", f"Give the {kind.replace('_', ' ')} of {{{slot}}}."), F.col(col), (slot,)) for kind, col, fld in family]


# fixed values: (type, record column, answer field) of the attribute questions
PERSON_ATTRIBUTES = [("email", "email", "contact.details.e_mail"), ("phone", "phone", "contact.details.work_phone"), ("consulting_hours", "consulting_hours", "teaching.consulting_hours")]
PUBLICATION_ATTRIBUTES = [("year", "year", "year"), ("authors", "authors", "sections.authors.text"), ("type", "type", "sections.type.text"), ("publisher", "publisher", "sections.publisher.text"), ("projects", "projects", "sections.projects.text"), ("research_groups", "research_groups", "sections.research_groups.text"), ("departments", "departments", "sections.departments.text")]
GROUP_ATTRIBUTES = [("contact_person", "contact_person", "team.principal_researcher[].name")]


# fixed values: (type, record column) of the yes/no questions on people
PERSON_FACTS = [("office", "office_room")]


def membership_items(held: DataFrame, entity: str, value: str, kind: str, templates: Sequence[str], seed: str) -> DataFrame:
    """Yes/no questions on a list attribute: one held value and one not held per entity.

    ``held``: one row per (entity, value), such as people and their projects, awards, groups,
    rooms or organisations. Templates use ``{entity}`` and ``{value}``.
    """
    pairs = held.select(F.col(entity).cast("string").alias("entity"), F.col(value).cast("string").alias("value")).distinct()
    yes = pairs.groupBy("entity").agg(F.min_by("value", _digest(f"{seed}|yes", "entity", "value")).alias("value"))
    no = negative_sample(pairs, "entity", "value", seed)
    both = yes.withColumn("expected_answer", F.lit("Yes")).unionByName(no.withColumn("expected_answer", F.lit("No")))
    at = F.concat_ws("|", F.lit(seed), "expected_answer", "entity")
    ask = render_template(templates, at, {"entity": F.col("entity"), "value": F.col("value")})
    return both.select("entity", F.concat(F.lit(f"{kind}_"), F.lower("expected_answer")).alias("type"), ask.alias("question"), "expected_answer")


def answer_lookup(items: DataFrame, entities: DataFrame, key: str, answers: dict[str, Column]) -> DataFrame:
    """Gold answer of each item: the entity attribute its type names, else the expected answer."""
    df = items.join(entities, key, "left")
    out = F.lit(None).cast("string")
    for kind, c in answers.items():
        out = F.when(F.col("type") == kind, c.cast("string")).otherwise(out)
    known = F.col("type").isin(*answers)
    return df.select(*items.columns, F.when(known, out).otherwise(F.col("expected_answer")).alias("actual_answer"))


# --- samples -----------------------------------------------------------------------------------------------


def _digest(seed: str, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *cols))


def _top(df: DataFrame, group: str, order: Sequence[Column], quota: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= F.col(quota)).drop("_n")


def _finish(picked: DataFrame, pool: DataFrame, quotas: dict[str, int], n: int, order: Sequence[str], prefix: str) -> DataFrame:
    """Fill up to ``n`` from the pool, put in a stable order, and number.

    The picks are few and read twice, so they are staged. Of the pool the first n + picks rows
    in fill order are enough, whichever of them are picked already.
    """
    picked = staged(picked)
    head = pool.orderBy("_h2", "question").limit(n + sum(quotas.values()))
    rest = head.join(picked.select("question"), "question", "left_anti")
    rest = rest.withColumn("_prio", F.lit(1)).withColumn("_quota_ord", F.lit(0)).withColumn("_h", F.col("_h2"))
    keep = picked.withColumn("_prio", F.lit(0)).unionByName(rest).orderBy("_prio", "_quota_ord", "_h", "question").limit(n)
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))  # at most n rows
    return keep.select(*[c for c in pool.columns if not c.startswith("_")], F.format_string(f"{prefix}_%03d", number).alias("id"))


def _pool(items: DataFrame, seed: str) -> DataFrame:
    """Items with distinct questions and their seeded orders."""
    rest = [c for c in items.columns if c != "question"]
    unique = items.groupBy("question").agg(F.min(F.struct(*rest)).alias("r")).select("question", "r.*")
    return unique.withColumn("_h", _digest(seed, "type", "question")).withColumn("_h2", _digest(f"{seed}/fill", "question"))


def _quota_table(pool: DataFrame, quotas: dict[str, int]) -> DataFrame:
    q, o = F.lit(0), F.lit(0)
    for i, (kind, n) in enumerate(quotas.items()):
        q, o = F.when(F.col("type") == kind, n).otherwise(q), F.when(F.col("type") == kind, i).otherwise(o)
    return pool.withColumn("_quota", q).withColumn("_quota_ord", o)


def quota_sample(items: DataFrame, quotas: dict[str, int], n: int, seed: str, order: Sequence[str], prefix: str = "item") -> DataFrame:
    """Seeded sample: each type up to its quota, filled to ``n`` from all, sorted and numbered.

    ``items``: type, question and further columns. No question is taken twice.
    """
    pool = _pool(items, seed)
    picked = _top(_quota_table(pool, quotas).filter("_quota > 0"), "type", [F.col("_h"), F.col("question")], "_quota").drop("_quota")
    return _finish(picked, pool, quotas, n, order, prefix)


def diverse_quota_sample(items: DataFrame, quotas: dict[str, int], n: int, seed: str, order: Sequence[str], entity: str = "entity", prefix: str = "item") -> DataFrame:
    """As ``quota_sample``, but a type takes one item per entity before it takes a second.

    Both passes are limited to the quota inside each task, so a large entity costs nothing.
    """
    pool = _pool(items, seed)
    wanted = _quota_table(pool, quotas).filter("_quota > 0")
    firsts = wanted.groupBy("type", entity).agg(F.min(F.struct("_h", "question")).alias("_f")).select("type", F.col("_f.question").alias("question"))
    by = [F.col("_h"), F.col("question")]
    one = _top(wanted.join(firsts, ["type", "question"], "left_semi"), "type", by, "_quota").withColumn("_pass", F.lit(0))
    two = _top(wanted.join(firsts, ["type", "question"], "left_anti"), "type", by, "_quota").withColumn("_pass", F.lit(1))
    picked = _top(one.unionByName(two), "type", [F.col("_pass"), *by], "_quota").drop("_quota", "_pass")
    return _finish(picked, pool, quotas, n, order, prefix)


def shortest_text(df: DataFrame, keys: Sequence[str], text: str, order: str) -> DataFrame:
    """Shortest non-blank text per key; a long one is cut to its first sentence, at most 160 chars."""
    t = df.select(*keys, order, T.squeeze(F.col(text)).alias("t")).filter("t <> ''")
    best = t.groupBy(*keys).agg(F.min_by("t", F.struct(F.length("t"), order)).alias("t"))
    cut = F.when(F.length("t") > 140, F.trim(F.substring_index("t", ".", 1))).otherwise(F.col("t"))
    return best.select(*keys, F.left(cut, F.lit(160)).alias("text"))
