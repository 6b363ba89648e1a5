"""Conversation repair against a plain table of cheapest edits."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from convlake.llm import queries, repair

SPACE = " \t\n\v\f\r"
GRAMMAR = re.compile("(s?(ua)+)?")


def least(rows, faults):
    """(cost, audit, lines) by every way forward: the least (cost, audit) for each grammar state, row by row."""
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def with_inserts(best):
        for _ in range(4):
            for q, (cost, audit, lines) in list(best.items()):
                for letter, to in moves[q].items():
                    if letter != "s":
                        one = (cost + 5, audit + "I", lines + [f"{names[letter]}:"])
                        best[to] = min(best.get(to, one), one, key=lambda x: x[:2])
        return best

    best = {"": (0, "", [])}
    for (role, text), fault in zip(rows, faults):
        after = {}
        for q, (cost, audit, lines) in with_inserts(best).items():
            ways = [(q, 2, "D", [])]
            if fault != "x":
                extra = 5 if fault == "~" else 0
                for letter, to in moves[q].items():
                    if role[:1] == letter:
                        ways.append((to, extra, "K", [f"{role}:{text}"]))
                    if letter != "s":
                        ways.append((to, extra + 1, "R", [f"{names[letter]}:{text}"]))
            for to, price, edit, made in ways:
                one = (cost + price, audit + edit, lines + made)
                after[to] = min(after.get(to, one), one, key=lambda x: x[:2])
        best = after
    best = with_inserts(best)
    return min((best[q] for q in ("", "a") if q in best), key=lambda x: x[:2])


def plain(rows):
    """(conv, turn, role, text) rows, undamaged here: what audited and digests give per conversation."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, lines in groups.items():
        lines.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in lines:
            body = text.strip(SPACE)
            kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append("." if kind is None else "~" if kind == "truncated" else "x")
            if kind:
                counts[kind] += 1
        initials = [role[:1] for _, role, _ in lines]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [t for t, _, _ in lines if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, made = least([r[1:] for r in lines], faults)
        assert GRAMMAR.fullmatch("".join(x[0] for x in made))
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def damage(rows):
    for conv, turn, role, text in rows:
        gap = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{gap(conv)}:{gap(turn)}".encode()) % 20
        role, text = gap(role), gap(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "conv_id long, turn long, role string, text string, audit string, place int, key double")


def check(spark, rows):
    df = frame(spark, rows)
    audits = repair.audited(df)
    sums = {r.conv_id: r.repaired_sha256 for r in repair.digests(df, audits).collect()}
    got = {r.conv_id: (*tuple(r)[1:], sums[r.conv_id]) for r in audits.collect()}
    want = plain(rows)
    assert got == want and len(sums) == len(want)
    lines = repair.repaired(df, audits).orderBy("conv_id", "position").collect()
    made = {}
    for r in lines:
        assert r.position == len(made.setdefault(r.conv_id, []))
        made[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(made.get(c, [])).encode()).hexdigest() for c in want} == sums


def test_search():
    rnd = random.Random(5)
    for _ in range(3000):
        n = rnd.randrange(9)
        roles, faults = "".join(rnd.choices("suaa-u", k=n)), "".join(rnd.choices("...x~", k=n))
        cost, letters = repair.Search(roles, faults, repair.DONE, True).cheapest(repair.START)
        assert (cost, letters) == least([(r, "t") for r in roles], faults)[:2], (roles, faults)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_pieces_put_together(size):
    """Pieces of a few rows give the answer of the whole, also where the cheapest ways tie."""
    rnd = random.Random(size)
    for _ in range(1500):
        n = rnd.randrange(1, 12)
        roles, faults = "".join(rnd.choices("suaa-u", k=n)), "".join(rnd.choices("...x~", k=n))
        cuts = range(0, n, size)
        found = [repair.options(roles[k : k + size], faults[k : k + size], k == 0, k + size >= n) for k in cuts]
        picked = [f[c] for f, c in zip(found, repair.choose([[o[:3] for o in f] for f in found]))]
        assert (sum(o[2] for o in picked), "".join(o[3] for o in picked)) == least([(r, "t") for r in roles], faults)[:2]


def conversations(spark, path):
    return [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


def test_query(spark):
    rows = conversations(spark, "/root/testdata/sf0.001")
    want = plain(damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r.conv_id: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r[0]: want.get(r[0], nothing) for r in rows}


def test_damage_of_odd_rows(spark):
    rows = [(c, t, r, x) for c in (None, 0, 1, -5) for t in (None, *range(12)) for r, x in ((None, "a.b!"), ("user", None))]
    df = frame(spark, rows)
    got = sorted(tuple(r) for r in queries.damaged(df).select(*[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("conv_id", "turn", "role", "text")]).collect())
    want = sorted(tuple("null" if v is None else str(v) for v in r) for r in damage(rows))
    assert got == want


def test_odd_rows(spark):
    rows = [(1, None, "user", "Null turn."), (1, 3, "assistant", "Yes."), (1, 9, "user", "no end")]
    rows += [(2, None, None, None), (2, None, "", "Empty role."), (3, 1, "system", "Only.")]
    rows += [(None, 1, "user", "x." * 50_000), (None, 2, "assistant", "y!  \n\t")]
    rows += [(4, 5, "user", "Same.")] * 3 + [(4, 6, "assistant", "Same.")] * 2 + [(5, 1, "tool", "T."), (5, 2, "unknown", "　"), (5, 2**40, "assistant", "\x1c?")]
    check(spark, rows)
    assert repair.audited(frame(spark, [])).count() == 0


def test_long_conversation(spark):
    """One conversation of many pieces, beside short ones."""
    rnd = random.Random(2)
    rows = [(7, k, rnd.choice(["user", "assistant", "assistant", "system", "x"]), rnd.choice(["", "Ends.", f"No. {k}", f"Number {k}."])) for k in range(700)]
    rows += [(8, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(repair.PIECE)] + [(9, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(repair.PIECE + 1)]
    check(spark, rows)
