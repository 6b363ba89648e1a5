"""Text forms as Column expressions.

Java's ``\\s`` is ASCII only unless flagged; ``SPACE`` follows the Unicode white space rules.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values --------------------------------------------------------------------------

SPACE = r"(?U:[\s\x1c-\x1f])"
SPACE_IN_LINE = r"(?U:[\s\x1c-\x1f&&[^\n]])"
ZERO_WIDTH = r"[\x{200b}-\x{200d}\x{feff}]"
NOT_WORD = r"[^\p{L}\p{N}_\s-]"

PERSON_TITLES = ["bc", "bsc", "csc", "dr", "eng", "h", "hc", "ing", "mba", "mgr", "msc", "phd", "prof", "rndr"]

NAME_LIKE_KEYS = [
    "name", "person", "title", "guarantor", "course_coordinator", "lecturer", "instructor",
    "authors", "team_members", "organization",
]
NAME_LIKE_PARTS = ["name", "author", "lectur", "instructor", "guarantor", "coordinator"]

DIGIT_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]

YES_FORMS = ["yes", "true", "y", "1"]
NO_FORMS = ["no", "false", "n", "0"]

INTERRUPTION_MARK = "—"
SILENCE_MARK = "..."

RAG_BLOCK = r"(?s)\n?\[RAG_CONTEXT\].*?\[/RAG_CONTEXT\]\s*"

# --- Unicode forms: Spark has no normalisation function ----------------------------------


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def _unmarked(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))


@F.pandas_udf(StringType())
def strip_diacritics(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return s.map(_unmarked)


# --- general forms --------------------------------------------------------------------------


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; ends trimmed."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def tokens(c: Column) -> Column:
    """Tokens separated by Unicode white space."""
    return F.array_remove(F.split(c, f"{SPACE}+"), "")


def truncate_tokens(c: Column, n: int) -> Column:
    """First ``n`` tokens joined by a space; text with no more than ``n`` tokens is unchanged."""
    if n <= 0:
        return c
    toks = tokens(c)
    return F.when(F.size(toks) <= n, c).otherwise(F.array_join(F.slice(toks, 1, n), " "))


def _canonical(composed: Column) -> Column:
    plain = strip_diacritics(F.lower(strip(composed)))
    return squeeze(F.regexp_replace(plain, NOT_WORD, " "))


def canonicalize_text(c: Column) -> Column:
    """Lower case, no accents, no punctuation but the hyphen, single spaces."""
    return _canonical(nfkc(F.coalesce(c, F.lit(""))))


def canonicalize_person(c: Column) -> Column:
    """The name before the first comma (after compatibility forms) in canonical form, without title tokens.

    A part of a composed text is composed, with spaces for underscores too; composing it again would
    only add a Python process to every task.
    """
    name = F.substring_index(F.replace(nfkc(F.coalesce(c, F.lit(""))), F.lit("_"), F.lit(" ")), ",", 1)
    kept = F.filter(F.split(_canonical(name), " "), lambda x: ~x.isin(PERSON_TITLES))
    return F.trim(F.array_join(kept, " "))


def normalize_semester(c: Column) -> Column:
    return (
        F.when(c.rlike(r"(?i)\bwinter\b"), "winter").when(c.rlike(r"(?i)\bsummer\b"), "summer").otherwise("unknown")
    )


def normalise_text(c: Column, compose: bool = True) -> Column:
    """Tidy every line, keep line breaks, allow one blank line in a row."""
    t = F.regexp_replace(c, "\r\n?", "\n")
    if compose:
        t = nfkc(t)
    t = F.regexp_replace(t, ZERO_WIDTH, "")
    t = F.regexp_replace(t, f"{SPACE_IN_LINE}+", " ")
    t = F.regexp_replace(t, " ?\n ?", "\n")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def text_units(c: Column) -> Column:
    """Units of a tidied text: split at line ends and pipes, blanks dropped."""
    return F.filter(F.transform(F.split(c, r"\n+|\|"), lambda x: F.trim(x)), lambda x: x != "")


def is_name_like(key: Column) -> Column:
    k = F.lower(F.trim(key))
    hit = k.isin(NAME_LIKE_KEYS)
    for part in NAME_LIKE_PARTS:
        hit = hit | k.contains(part)
    return hit


def is_url_key(key: Column) -> Column:
    k = F.lower(F.trim(key))
    return (k == "url") | k.endswith("_url")


def key_slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def speakable_text(c: Column) -> Column:
    """Text without marks a voice cannot speak, quotes straightened."""
    t = F.translate(strip(c), "“”‘’*_`", "\"\"''")
    return F.replace(t, F.lit(" : "), F.lit(" "))


def spoken_normal_form(c: Column) -> Column:
    """Lower case, punctuation to spaces, lone digits as words."""
    t = F.replace(F.translate(F.lower(c), "?", " "), F.lit(" hundred and "), F.lit(" "))
    t = F.translate(t, "-.,", "   ")
    t = F.regexp_replace(t, r"\bi'm\b", "i am")
    t = F.replace(t, F.lit("'"), F.lit(""))
    for digit, word in enumerate(DIGIT_WORDS):
        t = F.regexp_replace(t, rf"\b{digit}\b", word)
    return squeeze(t)


def strip_block(c: Column, pattern: str = RAG_BLOCK) -> Column:
    return strip(F.regexp_replace(c, pattern, ""))


def silence_marker_strip(c: Column) -> Column:
    """Drop a leading silence marker unless it is the whole message."""
    return F.when(c.startswith(SILENCE_MARK) & (c != SILENCE_MARK), F.substring(c, len(SILENCE_MARK) + 1, 2**31 - 1)).otherwise(c)


# --- retrieval evaluation --------------------------------------------------------------------


def match_normal_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def answer_field_hints(c: Column) -> Column:
    """Field names named by an answer-field note such as ``a.b[]/c.*.d(e)``."""

    def one(p: Column) -> Column:
        p = F.trim(F.regexp_replace(p, r"\([^)]*\)", ""))
        p = F.replace(p, F.lit("[]"), F.lit(""))
        p = F.replace(p, F.lit(".*."), F.lit("."))
        p = F.replace(p, F.lit("*"), F.lit(""))
        return F.lower(F.trim(F.regexp_replace(p, r"\.+", "."), F.lit(".")))

    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[+/,]"), one)
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def field_hit(field: Column, hints: Column) -> Column:
    low = F.lower(F.coalesce(field, F.lit("")))
    return (low != "") & F.exists(hints, lambda h: low.contains(h))


def answer_hit(preview: Column, entity: Column, field: Column, targets: Column) -> Column:
    """Any normalised target inside the normalised preview, entity id and field name."""
    hay = F.trim(F.concat_ws(" ", match_normal_form(preview), match_normal_form(entity), match_normal_form(field)))
    return (hay != "") & F.exists(targets, lambda t: (t != "") & hay.contains(t))


def intent_bonus(question: Column, item_type: Column, field: Column, hints: Column) -> Column:
    """Score added to a chunk whose field fits what the question asks for."""
    q, t, f = (F.lower(F.coalesce(c, F.lit(""))) for c in (question, item_type, field))

    def rule(cond: Column, value: float) -> Column:
        return F.when(cond, value).otherwise(0.0)

    per_hint = F.aggregate(
        hints,
        F.lit(0.0),
        lambda acc, h: acc + F.when(f == h, 0.50).when(f.startswith(h), 0.35).when(f.contains(h), 0.20).otherwise(0.0),
    )
    phone = q.contains("phone") | t.contains("phone")
    mail = q.contains("email") | q.contains("e-mail") | t.contains("email")
    office = q.contains("office") | q.contains("located") | t.contains("office")
    contact = q.contains("contact") & q.contains("group")
    dept = q.contains("department") | t.contains("department")
    books = t.contains("study_literature") | q.contains("literature")
    member = t.contains("member_role") | t.contains("member_of_group")
    # fixed values: the weight of each rule
    return (
        per_hint
        + rule(phone & (f.contains("work_phone") | f.endswith("phone")), 0.65)
        + rule(phone & f.contains("e_mail"), -0.20)
        + rule(mail & f.contains("e_mail"), 0.65)
        + rule(mail & f.contains("work_phone"), -0.15)
        + rule(office & f.contains("contact.details.room"), 0.60)
        + rule(contact & f.startswith("team."), 0.70)
        + rule(contact & f.startswith("about."), -0.35)
        + rule(dept & f.endswith("department"), 0.80)
        + rule(dept & (f.contains("lecturer") | f.contains("instructor")), -0.20)
        + rule(t.contains("learning_objectives") & f.endswith("learning_objectives"), 0.90)
        + rule(books & (f.contains("fundamental_literature") | f.contains("study_literature")), 0.85)
        + rule(member & f.startswith("team."), 0.75)
        + rule(member & f.startswith("about."), -0.25)
    )


# --- grading -----------------------------------------------------------------------------------


def lexical_grade(answer: Column, reference: Column) -> Column:
    """1 to 5 by how much of the reference occurs in the answer."""
    a, r = F.lower(F.coalesce(answer, F.lit(""))), strip(F.lower(F.coalesce(reference, F.lit(""))))
    words = F.filter(tokens(r), lambda w: F.length(w) > 3)
    share = F.size(F.filter(words, lambda w: a.contains(w))) / F.greatest(F.size(words), F.lit(1))
    return (
        F.when(r == "", 3.0)
        .when(a.contains(r), 5.0)
        .when(share <= 0.05, 1.0)
        .when(share <= 0.2, 2.0)
        .when(share <= 0.45, 3.0)
        .otherwise(4.0)
    )


def binary_form(c: Column) -> Column:
    low = F.rtrim(F.lower(strip(F.coalesce(c, F.lit("")))), F.lit(".!"))
    return F.when(low.isin(YES_FORMS), "yes").when(low.isin(NO_FORMS), "no")


def binary_override(expected: Column, predicted: Column) -> Column:
    """True when both answers are the same yes/no form, which grades as 5."""
    return F.coalesce(binary_form(expected) == binary_form(predicted), F.lit(False))


def parse_score(c: Column) -> Column:
    """Score after ``[RESULT]``; 0 becomes 1, no score gives null."""
    digit = F.regexp_extract(c, r"(?i)\[RESULT\]\s*([0-5])", 1)
    return F.when(digit != "", F.greatest(digit.try_cast("int"), F.lit(1)))


def topic_of(topic: Column, item_type: Column, answer_field: Column, dataset: Column) -> Column:
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in (topic, item_type, answer_field)], dataset)


def category_of(dataset: Column, prefix: str) -> Column:
    """Name part before the first underscore, after a corpus prefix if there is one."""
    rest = F.when(dataset.startswith(prefix) & (F.length(dataset) > len(prefix)), F.substring(dataset, len(prefix) + 1, 2**31 - 1)).otherwise(dataset)
    return F.lower(F.substring_index(rest, "_", 1))


def dataset_bucket(c: Column) -> Column:
    """First of the fixed bucket names that occurs in the name."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit("other")
    for name in reversed(DATASET_BUCKETS):
        out = F.when(low.contains(name), name).otherwise(out)
    return out


# fixed values: bucket names in order of precedence
DATASET_BUCKETS = ["longform", "courses", "groups", "personnel", "projects", "publications"]


# --- context text ------------------------------------------------------------------------------


def clean_preview(c: Column) -> Column:
    """Drop structural ``key=value`` parts; append the field value if it adds something."""
    c = F.coalesce(c, F.lit(""))
    mark = r"\[FIELD=([^\]]+)\]"
    has = c.rlike(mark)
    head = F.when(has, F.regexp_extract(c, r"(?s)^(.*?)\[FIELD=[^\]]+\]", 1)).otherwise(c)
    key = F.regexp_extract(c, mark, 1)
    value = strip(F.regexp_extract(c, r"(?s)\[FIELD=[^\]]+\](.*)$", 1))
    head = F.regexp_replace(strip(head), r"^\[CONTEXT\]\s*", "")
    parts = F.filter(
        F.transform(F.split(head, r"\|"), lambda p: strip(p)),
        lambda p: (p != "") & ~F.trim(F.substring_index(p, "=", 1)).isin("entity_type", "entity_id"),
    )
    head = F.array_join(parts, " | ")
    extra = has & (value != "") & ~head.contains(value)
    return F.when(extra, F.concat(head, F.lit(" | "), F.substring_index(key, ".", -1), F.lit(": "), value)).otherwise(head)
