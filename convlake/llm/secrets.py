"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regex gives a Boolean query over trigrams: an OR of ANDs that every match satisfies. The
index holds, for the trigrams of these queries, the documents whose lower-cased text has them. The
postings of an AND are intersected by counting its trigrams per document; documents that satisfy a
query are the rule's candidates, and only they are verified with the regex. Rules without a mandatory
trigram scan every text. Postings are rows (trigram, document), so a frequent trigram is spread over
tasks, and the intersection is a grouped count by document.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.llm.common import staged, unused

_parser = re._parser

MOST_STRINGS = 64  # alternatives kept apart in a query
CHUNK = 256  # lengths summed at a time


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose group has fewer than ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # of a run, the first AKIA has the longest rest: same as 20 of AKIA[A-Z0-9]+
    Rule("hex", r"[0-9a-f]{24,}"),  # a run of 24 or more, as [0-9a-f]+ would give
)
MORE = (
    Rule("forge_token", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

Query = tuple[frozenset[str], ...] | None  # an OR of ANDs of trigrams; None holds for every text


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    every = {x | y for x in a for y in b}
    return tuple(sorted(every, key=sorted)) if len(every) <= MOST_STRINGS else min(a, b, key=len)


def _either(queries: list[Query]) -> Query:
    found = {x for q in queries if q is not None for x in q}
    return None if any(q is None for q in queries) or len(found) > MOST_STRINGS else tuple(sorted(found, key=sorted))


def _query_of(strings: set[str]) -> Query:
    """Every match holds one of the strings."""
    return _either([(frozenset(s[i : i + 3] for i in range(len(s) - 2)),) if len(s) > 2 else None for s in strings])


def _node(op, arg) -> tuple[set[str] | None, Query]:
    """All strings a node can match (None: too many to list), and the query of a longer node."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}, None
    if name == "IN":
        chars: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= 8 else (None, None)
    if name == "SUBPATTERN":
        return _sequence(arg[3])
    if name == "BRANCH":
        parts = [_sequence(x) for x in arg[1]]
        if all(strings is not None for strings, _ in parts):
            return set().union(*(strings for strings, _ in parts)), None
        return None, _either([q if strings is None else _query_of(strings) for strings, q in parts])
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, what = arg
        strings, query = _sequence(what)
        if strings is not None and int(high) <= 2:
            every = {"".join(x) for n in range(low, int(high) + 1) for x in itertools.product(strings, repeat=n)}
            return (every, None) if len(every) <= MOST_STRINGS else (None, None)
        return None, (query if strings is None else _query_of(strings)) if low else None
    if name == "AT":
        return {""}, None
    return None, None


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    run, query, whole = {""}, None, True
    for op, arg in nodes:
        strings, inner = _node(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        query, whole = _both(query, _query_of(run)), False
        run = strings or {""}
        query = _both(query, inner)
    return (run, None) if whole else (None, _both(query, _query_of(run)))


def trigram_query(pattern: str) -> Query:
    """Boolean query over lower-case trigrams that every match of the pattern satisfies."""
    strings, query = _sequence(_parser.parse(pattern))
    return query if strings is None else _query_of(strings)


def _key(id_col: str) -> Column:
    """Rows meet their postings by id. Rows that share an id share candidates, which verification sorts out."""
    return F.xxhash64(F.col(id_col).cast("string"))


def build_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, key) of the given trigrams, from whole lower-cased texts."""
    low = docs.select(_key(id_col).alias("key"), F.lower(text_col).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): for each document the rules whose query its trigrams satisfy."""
    spark = index.sparkSession
    ands = [(kind, n, t, len(terms)) for kind, query in queries.items() for n, terms in enumerate(query) for t in sorted(terms)]
    terms = spark.createDataFrame(ands, "kind string, n int, trigram string, of int")  # a row per trigram of the rules
    met = index.join(F.broadcast(terms), "trigram").groupBy("key", "kind", "n").agg(F.count_distinct("trigram").alias("has"), F.first("of").alias("of"))
    return met.where("has = of").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _sums_before(lengths: Column) -> Column:
    """For each length the sum of those before it, and at the end the sum of all."""
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(CHUNK)), lambda at: F.slice(lengths, at + 1, F.lit(CHUNK)))
    add = lambda have, x: F.concat(have, F.array(F.element_at(have, -1) + x))
    total = lambda chunk: F.aggregate(chunk, F.lit(0), lambda have, x: have + x)
    starts = F.aggregate(F.transform(chunks, total), F.array(F.lit(0)), add)
    inner = F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), lambda chunk, at: F.slice(F.aggregate(chunk, F.array(at), add), F.lit(1), F.size(chunk)))
    return F.flatten(inner)


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Structs (start, order, end, kind) of the leftmost non-overlapping matches, in code points."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(F.slice(between, F.lit(1), F.size(whole)), whole, lambda gap, hit: F.length(gap) + F.length(hit))
    before = F.arrays_zip(_sums_before(lengths).alias("at"), F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("hit"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"))
    kept = F.filter(before, lambda m: F.length(m["part"]) >= rule.least)
    start = lambda m: m["at"] + F.length(m["gap"])
    return F.transform(kept, lambda m: F.struct(start(m).alias("start"), F.lit(order).alias("order"), (start(m) + F.length(m["hit"])).alias("end"), F.lit(rule.kind).alias("kind")))


NO_SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", out: str = "_spans") -> DataFrame:
    """``docs`` with ``out`` (replaced if there is one): structs (start, order, end, kind) by start, then by the order of the rules.

    Offsets are code points, the end exclusive. Null and empty texts have no spans. Rows are kept as
    they are, repeated ones and null ids included; other columns pass through, whatever their names.
    """
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    indexed = {kind: query for kind, query in queries.items() if query is not None}
    trigrams = sorted({t for query in indexed.values() for terms in query for t in terms})
    key, at, kinds = (unused(docs, name) for name in ("_key", "_at", "_kinds"))
    rows = docs.withColumn(key, _key(id_col))
    if indexed:
        found = staged(candidates(build_index(docs, trigrams, id_col, text_col), indexed), "candidates")
        rows = rows.join(found.withColumnsRenamed({"key": at, "kinds": kinds}), F.col(key) == F.col(at), "left")
    text, none = F.coalesce(F.col(text_col), F.lit("")), F.array().cast(NO_SPANS)
    every = []
    for order, rule in enumerate(rules):
        may = F.array_contains(kinds, rule.kind) if rule.kind in indexed else F.lit(True)
        every.append(F.when(may & F.rlike(text, F.lit(rule.pattern)), spans(text, rule, order)).otherwise(none))
    return rows.withColumn(out, F.array_sort(F.concat(*every))).drop(key, at, kinds)


def listed(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by <kind> in the text; overlapping spans as one, by the first.

    A text without spans, null included, stays as it is, and so do all other columns.
    """
    text = F.col(text_col)
    state = "struct<end:int,cuts:array<struct<start:int,end:int,kind:string>>>"
    join = lambda have, s: F.when(
        s["start"] >= have["end"], F.struct(s["end"].alias("end"), F.concat(have["cuts"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("cuts"))
    ).otherwise(
        F.struct(
            F.greatest(have["end"], s["end"]).alias("end"),
            F.concat(F.slice(have["cuts"], F.lit(1), F.size(have["cuts"]) - 1), F.array(F.struct(F.element_at(have["cuts"], -1)["start"].alias("start"), F.greatest(have["end"], s["end"]).alias("end"), F.element_at(have["cuts"], -1)["kind"].alias("kind")))).alias("cuts"),
        )
    )
    found, cuts = unused(docs, "_spans"), unused(docs, "_cuts")
    merged = F.aggregate(found, F.from_json(F.lit('{"end":0,"cuts":[]}'), state), lambda have, s: join(have, s).cast(state))["cuts"]
    rows = scan(docs, rules, id_col, text_col, found).withColumn(cuts, F.when(F.size(found) > 0, merged))
    ends = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["end"]))
    parts = F.zip_with(cuts, F.slice(ends, F.lit(1), F.size(cuts)), lambda c, at: F.concat(F.substring(text, at + 1, c["start"] - at), F.lit("<"), c["kind"], F.lit(">")))
    whole = F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))
    return rows.withColumn(text_col, F.when(F.col(cuts).isNull(), text).otherwise(whole)).select(*docs.columns)
