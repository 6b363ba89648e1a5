"""Repair of conversation structure by iterative-deepening A*.

A conversation should give role initials ``(s?(ua)+)?``: at most one system message at its start, then
user and assistant in turn. The audit is the cheapest list of edits that gets there, one letter an
edit: (K)eep 0, (R)erole to user or assistant 1, (D)elete 2, (I)nsert an empty message 5; a blank row
or one whose role and text came earlier must be deleted, a truncated row adds 5 if it stays. Among
the cheapest lists the ASCII-least counts.

The search is depth-first with the edits in ASCII order (D, I, K, R), under a bound on the cost that
starts at what every list costs at least and rises to the least cost that was found missing. A table
holds for each state (rows done, role that is due) what the rest costs at least, as far as failures
have shown; a state that cannot finish within what is left is not entered again. The first accepting
path is the answer.

A conversation may be of any length: its rows are reduced to a role letter and a fault letter, and
pieces of at most PIECE rows are searched apart, for each state they may be entered in and left in.
A fold over the pieces' costs picks the states at the cuts. Inserts belong to the row that follows
(or to the end), so a piece's lists are free of prefixes of each other and the least of all is put
together from the least of each piece. Duplicates are found by a grouping on digests, rows are
numbered by range, and texts are moved once, to be written out in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.llm.common import numbered, staged

PIECE = 64  # rows searched together
SPACE = "\\x20\\x09-\\x0D"
COST = {"D": 2, "I": 5, "K": 0, "R": 1}
TRUNCATED = 5
NEVER = 1 << 40
#: Role letters so far: nothing, a system message, a user's (an assistant's is due), an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
DONE = (START, ASSISTANT)
KEEPS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEAST = {"x": 2, "~": 2}  # cost of a row by its fault, whatever the state
ROLES = {USER: "user", ASSISTANT: "assistant"}
EDITS = re.compile("I*[DKR]|I+")  # a row's edit with the inserts ahead of it, or inserts at the end
OPTION = "struct<entry:int,exit:int,cost:bigint,letters:string>"


class Search:
    """Cheapest edits of a piece: ``roles`` and ``faults`` hold a letter per row (x must go, ~ is truncated).

    ``last``: the conversation ends with the piece, so messages may be inserted behind its rows.
    """

    def __init__(self, roles: str, faults: str, goals: tuple[int, ...], last: bool):
        self.roles, self.faults, self.goals, self.last, self.n = roles, faults, goals, last, len(roles)
        rest = [0] * (self.n + 1)
        for k in range(self.n - 1, -1, -1):
            rest[k] = rest[k + 1] + LEAST.get(faults[k], 0 if roles[k] in "sua" else 1)
        self.needs = [[least] * 4 for least in rest]  # by rows done and state; only ever raised
        self.path: list[str] = []
        ends = list(last or state in goals for state in range(4))  # from which states a goal can be reached at all
        for at in range(self.n, -1, -1):
            if at < self.n:
                ends = [any(ends[then] for _, _, to, then in self.steps(at, state) if to > at) for state in range(4)]
                ends = [true or ends[USER] or ends[ASSISTANT] for true in ends]  # inserts lead to both
            self.needs[at] = [least if true else NEVER for least, true in zip(self.needs[at], ends)]

    def steps(self, at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """Edits in ASCII order: letter, cost, rows done and state behind it."""
        there = at < self.n
        if there:
            yield "D", COST["D"], at + 1, state
        if there or self.last:
            yield "I", COST["I"], at, DUE[state]
        if there and self.faults[at] != "x":
            stays = TRUNCATED if self.faults[at] == "~" else 0
            to = KEEPS.get((self.roles[at], state))
            if to is not None:
                yield "K", COST["K"] + stays, at + 1, to
            yield "R", COST["R"] + stays, at + 1, DUE[state]

    def within(self, at: int, state: int, left: int) -> bool:
        """Whether the rest can be done for ``left``; the path then ends in it, else ``needs`` is above ``left``."""
        if at == self.n and state in self.goals:
            return True
        needs = NEVER
        for letter, cost, to, then in self.steps(at, state):
            if cost + self.needs[to][then] <= left:
                self.path.append(letter)
                if self.within(to, then, left - cost):
                    return True
                self.path.pop()
            needs = min(needs, cost + self.needs[to][then])
        self.needs[at][state] = max(self.needs[at][state], needs)
        return False

    def cheapest(self, entry: int) -> tuple[int, str] | None:
        """Cost and letters from the state ``entry``; None if there are none."""
        while (bound := self.needs[0][entry]) < NEVER:
            self.path.clear()
            if self.within(0, entry, bound):
                return bound, "".join(self.path)
        return None


def options(roles: str, faults: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, letters) of a piece, for every way through that exists; sorted by entry and letters."""
    out = []
    for goals in [DONE] if last else [(START,), (SYSTEM,), (USER,), (ASSISTANT,)]:
        search = Search(roles, faults, goals, last)
        for entry in (START,) if first else range(4):
            found = search.cheapest(entry)
            if found:
                out.append((entry, goals[-1], *found))
    return sorted(out, key=lambda o: (o[0], o[3]))


def choose(pieces: list[list[tuple[int, int, int]]]) -> list[int]:
    """The option (a place in its list) of each piece on the cheapest way from START through all; ties go to earlier places."""
    ahead, ways = [0] * 4, []  # cost of the pieces behind by state; the last piece's options have one exit, a goal
    for listed in reversed(pieces):
        best: list[tuple[int, int]] = [(NEVER, -1)] * 4
        for place, (entry, exit_, cost) in enumerate(listed):
            best[entry] = min(best[entry], (cost + ahead[exit_], place))
        ahead = [cost for cost, _ in best]
        ways.append([place for _, place in best])
    state, out = START, []
    for listed, way in zip(pieces, reversed(ways)):
        out.append(way[state])
        state = listed[way[state]][1]
    return out


def _options(roles: pd.Series, faults: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    names = ("entry", "exit", "cost", "letters")
    return pd.Series([[dict(zip(names, o)) for o in options(*piece)] for piece in zip(roles, faults, first, last)], dtype=object)


def _digest(role: Column, text: Column) -> list[Column]:
    """Two hashes that stand for role and text."""
    return [F.xxhash64(role, text), F.xxhash64(F.lit("repair"), text, role)]


def _named(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    gap = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return rows.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), gap(role_col).alias("role"), gap(text_col).alias("text")).withColumns(dict(zip(("h1", "h2"), _digest(F.col("role"), F.col("text")))))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]


def audited(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Turns are in order, null turns first; rows of one turn go by role and then by a digest of the text.
    Rows equal in all come one after the other, the first counts as original. Null roles and texts
    count as one space. A null id is a conversation of its own. A role is judged by its first letter;
    an empty role has none that fits. Other columns are not read, whatever their names.
    """
    named = _named(rows, id_col, turn_col, role_col, text_col)
    ends = F.regexp_extract("text", f"([^{SPACE}])[{SPACE}]*\\z", 1)
    head = F.substring("role", 1, 1)
    initial = F.when(head.isin("s", "u", "a"), head).otherwise("-").alias("initial")
    # equal rows may go in any order; the salt lets their range be cut
    lean = named.select("conv", "turn", "role", "h1", "h2", ends.alias("end"), initial, (F.monotonically_increasing_id() % 1024).alias("salt"))
    lined = staged(numbered(lean, [F.col("conv").asc_nulls_first(), *_order(), F.col("salt")], "place").drop("role", "salt"), "lined")
    # the first of the rows that are equal in role and text; places are unique, so a common text is no hot key
    firsts = lined.where("end <> ''").groupBy("conv", "h1", "h2").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("original"))
    fault = F.when(F.col("end") == "", "blank").when(F.col("original").isNull(), "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated")
    judged = staged(lined.join(firsts, "place", "left").select("conv", "turn", "place", "initial", fault.alias("fault")), "judged")
    of = lambda kind: F.count_if(F.col("fault") == kind).alias(kind)
    totals = judged.groupBy("conv").agg(F.min("place").alias("start"), F.count("*").alias("n"), of("blank"), of("duplicate"), of("truncated"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    totals = staged(totals.withColumn("key", F.col("start")), "totals")  # a conversation's first place is its key from here on
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", "~").otherwise(".")
    placed = judged.join(totals.select(F.col("conv").alias("c"), "key", "n"), F.col("conv").eqNullSafe(F.col("c")))
    placed = placed.select("key", "n", (F.col("place") - F.col("key")).alias("at"), F.struct("place", "initial", letter.alias("letter")).alias("row"))
    piece = F.floor(F.col("at") / PIECE).alias("piece")
    joined = lambda what: F.array_join(F.transform("rows", lambda r: r[what]), "")
    pieces = placed.groupBy("key", "n", piece).agg(F.sort_array(F.collect_list("row")).alias("rows"))  # PIECE rows at most
    pieces = pieces.select("key", "piece", (F.col("piece") == F.floor((F.col("n") - 1) / PIECE)).alias("last"), joined("initial").alias("roles"), joined("letter").alias("faults"))
    pieces = staged(pieces.withColumn("options", F.pandas_udf(_options, f"array<{OPTION}>")("roles", "faults", F.col("piece") == 0, "last")), "pieces")
    cut = pieces.where("piece > 0 OR NOT last")

    def fold(key, listed: pd.DataFrame) -> pd.DataFrame:
        listed = listed.sort_values("piece")
        ways = [[(o["entry"], o["exit"], o["cost"]) for o in found] for found in listed["found"]]
        return pd.DataFrame({"key": key[0], "piece": listed["piece"], "choice": choose(ways)})

    costs = cut.select("key", "piece", F.transform("options", lambda o: F.struct(o["entry"].alias("entry"), o["exit"].alias("exit"), o["cost"].alias("cost"))).alias("found"))
    choices = costs.groupBy("key").applyInPandas(fold, "key long, piece long, choice int")
    whole = pieces.where("piece = 0 AND last").withColumn("choice", F.lit(0))
    done = cut.join(choices, ["key", "piece"]).unionByName(whole).withColumn("o", F.element_at("options", F.col("choice") + 1))
    # of each piece its letters and what is needed for the pairs of roles, in it and across the cuts
    inner = F.size(F.filter(F.sequence(F.lit(1), F.length("roles")), lambda k: (k > 1) & ~F.substring(F.col("roles"), k - 1, F.lit(2)).isin("su", "ua", "au")))
    part = F.struct("piece", F.col("o.letters").alias("letters"), F.col("o.cost").alias("cost"), inner.alias("inner"), F.substring("roles", 1, 1).alias("head"), F.substring("roles", -1, 1).alias("tail"))
    audits = done.groupBy("key").agg(F.sort_array(F.collect_list(part)).alias("p"))  # as long as the audit, which is one value
    across = F.size(F.filter(F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda a, b: F.concat(a["tail"], b["head"])), lambda pair: ~pair.isin("su", "ua", "au")))
    total = lambda name: F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x[name])
    audits = audits.select("key", (total("inner") + across).alias("illegal"), total("cost").alias("cost"), F.array_join(F.transform("p", lambda x: x["letters"]), "").alias("audit"))
    return totals.join(audits, "key").select(F.col("conv").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _in_order(rows: DataFrame, audits: DataFrame, names: tuple[str, str, str, str]) -> DataFrame:
    """Each conversation's audit, followed by its rows in order, all in one task."""
    head = audits.select(F.col(names[0]).alias("conv"), F.col("audit"))
    lines = _named(rows, *names).withColumn("audit", F.lit(None).cast("string"))
    every = lines.unionByName(head, allowMissingColumns=True).withColumn("line", F.col("audit").isNull())
    return every.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "line", *_order()).select("conv", "audit", "turn", "role", "text")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each conversation (id, None, None, None, None), then its repaired rows (id, edit, turn, role, text)."""
    conv, tokens, state = None, iter(()), START

    def made(token: str, turn, role: str, text: str) -> Iterator[tuple]:
        nonlocal state
        for letter in token:
            if letter == "K":
                state = KEEPS[role[:1], state]
                yield conv, letter, turn, role, text
            elif letter != "D":
                state = DUE[state]
                yield conv, letter, *((None, ROLES[state], "") if letter == "I" else (turn, ROLES[state], text))

    for batch in batches:
        for line in batch.to_pylist():
            if line["audit"] is None:
                yield from made(next(tokens)[0], line["turn"], line["role"], line["text"])
                continue
            for behind in tokens:
                yield from made(behind[0], None, "", "")
            conv, tokens, state = line["conv"], EDITS.finditer(line["audit"]), START
            yield conv, None, None, None, None
    for behind in tokens:
        yield from made(behind[0], None, "", "")


def repaired(rows: DataFrame, audits: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of the repaired conversations: id, position (from 0), edit (K, R or I), turn, role, text.

    ``audits`` is the result of ``audited`` on the same rows. A conversation is written in one task, a
    batch of rows at a time; inserted rows have no turn.
    """
    ordered = _in_order(rows, audits, (id_col, turn_col, role_col, text_col))
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, at = None, [], 0

        def seen(source):
            nonlocal schema
            for batch in source:
                of = batch.schema
                schema = schema or pa.schema([of.field("conv"), pa.field("position", pa.int64()), pa.field("edit", pa.string()), of.field("turn"), of.field("role"), of.field("text")])
                yield batch

        for conv, edit, turn, role, text in _edited(seen(batches)):
            if edit is None:
                at = 0
                continue
            held.append((conv, at, edit, turn, role, text))
            at += 1
            if len(held) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    out = ordered.mapInArrow(write, f"conv {kinds['conv']}, position long, edit string, turn {kinds['turn']}, role string, text string")
    return out.withColumnRenamed("conv", id_col)


def digests(rows: DataFrame, audits: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The id and SHA-256 (hex) of each repaired conversation, written as ``role:text`` lines.

    A hash of one text is sequential, so a conversation's rows pass through one task, one at a time.
    """
    ordered = _in_order(rows, audits, (id_col, turn_col, role_col, text_col))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, keys, sums = None, [], []

        def seen(source):
            nonlocal kind
            for batch in source:
                kind = batch.schema.field("conv").type
                yield batch

        running, empty = None, True
        for conv, edit, _, role, text in _edited(seen(batches)):
            if edit is None:
                if running is not None:
                    sums.append(running.hexdigest())
                keys.append(conv)
                running, empty = hashlib.sha256(), True
                continue
            running.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
            empty = False
        if running is not None:
            sums.append(running.hexdigest())
        for at in range(0, len(keys), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 4096], kind), pa.array(sums[at : at + 4096])], ["conv", "repaired_sha256"])

    kind = ordered.schema["conv"].dataType.simpleString()
    return ordered.mapInArrow(digest, f"conv {kind}, repaired_sha256 string").withColumnRenamed("conv", id_col)
