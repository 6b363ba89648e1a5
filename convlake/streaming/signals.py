"""Turn signals as state machines: pause average, anticipation, speculation, silence, words."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.plans import slices as S
from convlake.streaming.ordered import Machine, fold_sorted

# fixed values: live settings
PAUSE_THRESHOLD = 0.6
FRAME_S = 0.08
STEPS_TO_WAIT = 12
ANTICIPATE_THRESHOLD = 0.5
WINDOW_US = 960_000
SILENCE_US = 7_000_000
WORD_SPACE = re.compile(r"\s+")


def smooth(value: float, new: float, dt: float, attack: float, release: float) -> float:
    """Exponential average whose half-life depends on the direction of change."""
    keep = float(np.exp2(-dt / (attack if new > value else release)))
    return keep * value + (1 - keep) * new


def pause_machine(attack: float, release: float, dt: float = FRAME_S, wait: int = STEPS_TO_WAIT, initial: float = 1.0) -> Machine:
    """Pause average and interruptions.

    Rows: ts_us, id, kind, value. ``step`` updates the average (the first ``wait`` steps do not);
    a ``word`` starts a user message if none is open, which resets the average, and interrupts
    the bot if it speaks; ``bot`` marks bot speech; ``resume`` and ``resume_bot`` restore what a
    later island needs (see ``message_islands``). Output kinds: step, interrupt, speech_started.
    """

    def step(st: dict, row: tuple) -> list[tuple]:
        ts, rid, kind, value = row
        if kind.startswith("resume"):
            st["wait"] = max(st["wait"] - int(value), 0)
            st["role"] = "bot" if kind == "resume_bot" else "waiting"
            return []
        if kind == "bot":
            st["role"] = "bot"
            return []
        if kind == "word":
            out = []
            if st["role"] == "bot":
                out.append((rid, "interrupt", None, False))
            if st["role"] != "user":
                st["ema"], st["role"] = 0.0, "user"
                out.append((rid, "speech_started", None, False))
            return out
        if st["wait"] > 0:
            st["wait"] -= 1
        else:
            st["ema"] = smooth(st["ema"], value, dt, attack, release)
        return [(rid, "step", st["ema"], st["role"] == "user" and st["ema"] > PAUSE_THRESHOLD)]

    return Machine(
        step, ["ts_us", "id", "kind", "value"], "id bigint, kind string, ema double, pause boolean",
        initial={"ema": initial, "wait": wait, "role": "waiting"},
    )


def anticipation_machine(threshold: float = ANTICIPATE_THRESHOLD, cooldown_us: int = WINDOW_US) -> Machine:
    """Trigger decisions with the gates that failed.

    Rows: ts_us, id, kind, value; ``prob`` rows are decided, ``word`` and ``bot`` rows set who
    speaks.
    """

    def step(st: dict, row: tuple) -> list[tuple]:
        ts, rid, kind, value = row
        if kind != "prob":
            st["role"] = "user_speaking" if kind == "word" else "bot_speaking"
            return []
        failed = []
        if value < threshold:
            failed.append("below_threshold")
        if st["last"] is not None and ts - st["last"] < cooldown_us:
            failed.append("cooldown")
        if st["role"] != "user_speaking":
            failed.append("blocked_by_conversation_state")
        if not failed:
            st["last"] = ts
        return [(rid, not failed, ",".join(failed))]

    return Machine(
        step, ["ts_us", "id", "kind", "value"], "id bigint, triggered boolean, reasons string",
        initial={"last": None, "role": "waiting_for_user"},
    )


def speculation_machine(window_us: int = WINDOW_US, drain_us: int = 30_000_000) -> Machine:
    """Life of speculative attempts; one output row per change of an attempt's status or buffer.

    Rows: ts_us, id, kind. ``trigger`` starts an attempt and supersedes the active one, which is
    kept as the fallback; ``chunk`` buffers audio for the active attempt; the window expires on
    its own and keeps the buffer; ``pause`` commits the active attempt or the fallback, whichever
    has audio first, or discards; ``interrupt`` stops a committed attempt that still drains.
    ``done`` completes the active attempt, which a pause can still commit; ``failed`` and
    ``cancel`` end it.
    """

    def change(st: dict, a: dict, status: str, reason: str, ts: int) -> tuple:
        st["seq"] += 1
        a["status"], a["reason"] = status, reason
        return (st["seq"], a["index"], status, reason, a["chunks"], ts)

    def tick(st: dict, now: int) -> list[tuple]:
        a = st["active"]
        if a is not None and not a["expired"] and now - a["start"] > window_us:
            a["expired"] = True
            return [change(st, a, "buffered", "window_expired_buffer_kept", a["start"] + window_us)]
        return []

    def step(st: dict, row: tuple) -> list[tuple]:
        ts, _, kind = row
        a, out = st["active"], []
        if kind == "trigger":
            if a is not None:
                out.append(change(st, a, "cancelled", "graceful_supersede_fallback_saved", ts))
                st["fallback"] = a
            st["n"] += 1
            st["active"] = {"index": st["n"], "start": ts, "chunks": 0, "expired": False, "status": "started"}
            st["drain"] = None
            out.append(change(st, st["active"], "started", "trigger", ts))
        elif kind == "chunk" and a is not None:
            a["chunks"] += 1
            out.append(change(st, a, a["status"], a["reason"], ts))
        elif kind == "done" and a is not None:
            out.append(change(st, a, "completed", "finished_without_commit", ts))
        elif kind in ("failed", "cancel") and a is not None:
            out.append(change(st, a, *(("failed", "exception") if kind == "failed" else ("cancelled", "task_cancelled")), ts))
            st["active"] = None
        elif kind == "pause":
            done = None
            if a is not None and a["chunks"] > 0:
                done = a
                out.append(change(st, a, "committed", "vad_confirmed_from_expired_buffer" if a["expired"] else "vad_confirmed", ts))
            else:
                if a is not None:
                    out.append(change(st, a, "discarded", "VAD with empty buffer", ts))
                f = st["fallback"]
                if f is not None and f["chunks"] > 0:
                    done = f
                    out.append(change(st, f, "committed", "vad_confirmed_from_fallback", ts))
            st["active"] = st["fallback"] = None
            st["drain"] = {**done, "since": ts} if done else None
        elif kind == "interrupt" and st["drain"] is not None:
            if ts - st["drain"]["since"] <= drain_us:
                out.append(change(st, st["drain"], "interrupted", "interrupted_while_draining_committed_audio", ts))
            st["drain"] = None
        return out

    def deadline(st: dict) -> int | None:
        a = st["active"]
        return a["start"] + window_us + 1 if a is not None and not a["expired"] else None

    return Machine(
        step, ["ts_us", "id", "kind"], "seq bigint, attempt bigint, status string, status_reason string, chunks bigint, at_us bigint",
        tick, deadline, {"n": 0, "seq": 0, "active": None, "fallback": None, "drain": None},
    )


def silence_machine(timeout_us: int = SILENCE_US) -> Machine:
    """A marker when the user stays silent for longer than the timeout after waiting began.

    Rows: ts_us, id, kind; ``waiting`` starts the clock, ``user`` activity stops it.
    """

    def tick(st: dict, now: int) -> list[tuple]:
        if st["since"] is not None and now - st["since"] > timeout_us:
            out = [(st["id"], st["since"] + timeout_us)]
            st["since"] = None
            return out
        return []

    def step(st: dict, row: tuple) -> list[tuple]:
        ts, rid, kind = row
        st["since"], st["id"] = (ts, rid) if kind == "waiting" else (None, None)
        return []

    return Machine(
        step, ["ts_us", "id", "kind"], "id bigint, marker_us bigint", tick,
        lambda st: None if st["since"] is None else st["since"] + timeout_us + 1, {"since": None, "id": None},
    )


def words_machine(flush_us: int = 1_000_000) -> Machine:
    """Text deltas to whole words; the rest of a stream is flushed after a silence.

    Rows: ts_us, id, text. A word keeps the space before it.
    """

    def emit(st: dict, word: str) -> tuple:
        st["n"] += 1
        return (st["n"], st["prefix"] + word)

    def tick(st: dict, now: int) -> list[tuple]:
        if st["buffer"] and now - st["last"] > flush_us:
            out = [emit(st, st["buffer"])]
            st["buffer"], st["prefix"] = "", ""
            return out
        return []

    def step(st: dict, row: tuple) -> list[tuple]:
        ts, _, text = row
        *whole, rest = WORD_SPACE.split(st["buffer"] + text)
        out = []
        for w in whole:
            if w:
                out.append(emit(st, w))
            st["prefix"] = " "
        st["buffer"], st["last"] = rest, ts
        return out

    return Machine(
        step, ["ts_us", "id", "text"], "word_idx bigint, word string", tick,
        lambda st: st["last"] + flush_us + 1 if st["buffer"] else None, {"n": 0, "buffer": "", "prefix": "", "last": 0},
    )


# --- batch twins ---------------------------------------------------------------------------------------------


def cooldown_machine(cooldown_us: int) -> Machine:
    """Ids of rows that are not within the cooldown of the last row kept."""

    def step(st: dict, row: tuple) -> list[tuple]:
        ts, rid = row
        if st["last"] is not None and ts - st["last"] < cooldown_us:
            return []
        st["last"] = ts
        return [(rid,)]

    return Machine(step, ["ts_us", "id"], "id bigint", initial={"last": None})


def anticipation_decisions(events: DataFrame, key: str, order: list[str], threshold: float, cooldown_us: int) -> DataFrame:
    """Batch form of the trigger decisions.

    Who speaks comes from an ordered scan. A candidate that follows the one before by a full
    cooldown always fires, so the candidates fall into bursts, and only a burst needs a fold.
    """
    at = S.by_micros("ts_us")
    df = S.scan(events, [key], order, at, [S.LastValid("_role", F.when(F.col("kind") != "prob", F.col("kind")), inclusive=False)])
    prob = df.filter("kind = 'prob'").withColumn("_low", F.col("value") < threshold).withColumn("_block", F.coalesce(F.col("_role") != "word", F.lit(True)))
    cand = prob.filter(~F.col("_low") & ~F.col("_block")).select(key, *order)
    cand = S.scan(cand, [key], order, at, [S.Lag("_prev", F.col("ts_us"))])
    cand = cand.withColumn("_new", F.coalesce(F.col("ts_us") - F.col("_prev") >= cooldown_us, F.lit(True)).cast("long"))
    cand = S.scan(cand, [key], order, at, [S.RunSum("burst", F.col("_new"))])
    fired = fold_sorted(cand, cooldown_machine(cooldown_us), [key, "burst"]).select(key, "id", F.lit(True).alias("triggered"))
    out = prob.join(fired, [key, "id"], "left").withColumn("triggered", F.coalesce("triggered", F.lit(False)))
    out = S.scan(out, [key], order, at, [S.LastValid("_last", F.when(F.col("triggered"), F.col("ts_us")), inclusive=False)])
    hot = F.coalesce(F.col("ts_us") - F.col("_last") < cooldown_us, F.lit(False))
    reasons = F.array_compact(F.array(F.when(F.col("_low"), "below_threshold"), F.when(hot, "cooldown"), F.when(F.col("_block"), "blocked_by_conversation_state")))
    return out.select(key, "id", "triggered", F.array_join(reasons, ",").alias("reasons"))


def speculation_outcomes(events: DataFrame, key: str, order: list[str], window_us: int, drain_us: int, until: int) -> DataFrame:
    """Final status of every attempt, from ordered scans only.

    What happens to an attempt depends on the events up to the next trigger and on the attempt
    after it, so the state machine has a closed form: attempts are numbered by a running count,
    chunks count until the first pause, and the next attempt tells whether this one was its
    fallback.
    """
    at = S.by_micros("ts_us")
    kind = F.col("kind")
    df = S.scan(events, [key], order, at, [S.RunSum("attempt", (kind == "trigger").cast("long"))]).filter("attempt > 0")
    df = S.scan(df, [key, "attempt"], order, at, [S.RunSum("_pauses", (kind == "pause").cast("long"))])
    per = df.groupBy(key, "attempt").agg(
        F.min(F.when(kind == "trigger", F.col("ts_us"))).alias("start"),
        F.min(F.when(kind == "pause", F.col("ts_us"))).alias("pause"),
        F.count_if((kind == "chunk") & (F.col("_pauses") == 0)).alias("chunks"),
        # only the first interruption after the first pause, before a second pause, can hit the drain
        F.min(F.when((kind == "interrupt") & (F.col("_pauses") == 1), F.col("ts_us"))).alias("stop"),
    )
    nxt = F.struct("pause", "chunks", "stop")
    per = S.scan(per, [key], ["attempt"], S.by_index("attempt"), [S.Lead("_n", nxt), S.Lead("_s", F.col("start"))])
    own = F.col("pause").isNotNull()
    from_next = ~own & F.col("_n").isNotNull() & F.col("_n.pause").isNotNull() & (F.col("_n.chunks") == 0) & (F.col("chunks") > 0)
    committed = (own & (F.col("chunks") > 0)) | F.coalesce(from_next, F.lit(False))
    commit = F.when(own, F.col("pause")).otherwise(F.col("_n.pause"))
    stop = F.when(own, F.col("stop")).otherwise(F.col("_n.stop"))
    interrupted = committed & F.coalesce(stop - commit <= drain_us, F.lit(False))
    late = F.col("pause") - F.col("start") > window_us
    status = (
        F.when(interrupted, "interrupted").when(committed, "committed").when(own, "discarded")
        .when(F.col("_s").isNotNull(), "cancelled").when(F.lit(until) - F.col("start") > window_us, "buffered").otherwise("started")
    )
    reason = (
        F.when(interrupted, "interrupted_while_draining_committed_audio")
        .when(committed & ~own, "vad_confirmed_from_fallback")
        .when(committed & late, "vad_confirmed_from_expired_buffer").when(committed, "vad_confirmed").when(own, "VAD with empty buffer")
        .when(F.col("_s").isNotNull(), "graceful_supersede_fallback_saved").when(status == "buffered", "window_expired_buffer_kept").otherwise("trigger")
    )
    return per.select(key, "attempt", status.alias("status"), reason.alias("status_reason"), "chunks")


def long_silences(events: DataFrame, key: str, order: list[str], timeout_us: int, until: int) -> DataFrame:
    """Batch form of the silence marker: the next event comes too late, or not at all."""
    df = S.scan(events, [key], order, S.by_micros("ts_us"), [S.Lead("_next", F.col("ts_us"), F.lit(until))])
    quiet = df.filter((F.col("kind") == "waiting") & (F.col("_next") - F.col("ts_us") > timeout_us))
    return quiet.select(key, "id", (F.col("ts_us") + timeout_us).alias("marker_us"))


def message_islands(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Events cut where a word opens a user message, which restarts the pause average.

    Every later island begins with a resume row that says who spoke before and how many steps
    have passed, so islands of one stream fold independently.
    """
    at = S.by_micros("ts_us")
    role = F.when(F.col("kind").isin("word", "bot"), F.col("kind"))
    steps = (F.col("kind") == "step").cast("long")
    df = S.scan(events, [key], order, at, [S.LastValid("_role", role, inclusive=False), S.RunSum("_steps", steps, inclusive=False)])
    df = df.withColumn("_new", ((F.col("kind") == "word") & (F.coalesce("_role", F.lit("none")) != "word")).cast("long"))
    df = S.scan(df, [key], order, at, [S.RunSum("island", F.col("_new"))])
    own = F.struct("id", "kind", "value")
    resume = F.struct(F.lit(-1).cast("long").alias("id"), F.when(F.col("_role") == "bot", "resume_bot").otherwise("resume").alias("kind"), F.col("_steps").cast("double").alias("value"))
    return df.select(key, "island", "ts_us", F.explode(F.when(F.col("_new") == 1, F.array(resume, own)).otherwise(F.array(own))).alias("r")).select(key, "island", "ts_us", "r.*")
