"""Streams over the event and conversation tables, next to their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.streaming import signals as SG
from convlake.streaming import windows as SW
from convlake.streaming.ordered import fold_sorted, latest_time, run_stream
from convlake.workloads import views as VW
from convlake.workloads.chunks import SPACE
from convlake.workloads.registry import Tables, query

HOUR = 3_600_000_000
BUCKET_MS = 30 * 86_400_000  # a user has some seventy events in thirty days
KINDS = {
    "pause": {"view": "step", "error": "step", "signup": "step", "click": "word", "purchase": "bot"},
    "anticipation": {"view": "prob", "error": "prob", "signup": "prob", "click": "word", "purchase": "bot"},
    "speculation": {"view": "trigger", "click": "chunk", "signup": "pause", "error": "interrupt"},
    "silence": {"purchase": "waiting", "click": "user", "view": "user"},
}


def source(t: Tables, name: str) -> str:
    """Path of a table for a stream, as a pattern: a plain path may not be a file there, and a table is a file or a folder of files."""
    return f"{t.path}/[{name[0]}]{name[1:]}.parquet"


def stream(t: Tables):
    e = SW.stream_events(t.spark, source(t, "events"), t.events.schema)
    return e.withColumn("ts_us", F.unix_micros("ts"))


def turns(t: Tables):
    return t.spark.readStream.schema(t.conversations.schema).parquet(source(t, "conversations"))


def signals(df, role: str):
    """Event types as the signals of a machine (the value on a 0 to 1 scale)."""
    kind = F.lit(None).cast("string")
    for typ, name in KINDS[role].items():
        kind = F.when(F.col("event_type") == typ, name).otherwise(kind)
    return df.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("id", F.col("event_id")).withColumn("value", F.least(F.col("value") / 100, F.lit(1.0)))


def sql_kind(role: str) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS[role].items()) + " END"


def sig(role: str) -> str:
    return f"""sg AS (SELECT * FROM (SELECT user_id, event_id AS id, epoch_us(ts) AS ts_us, {sql_kind(role)} AS kind, least(value / 100, 1.0) AS value FROM events) WHERE kind IS NOT NULL),
rn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, id) AS r FROM sg)"""


ATTACK, RELEASE = 0.08, 0.2
EMA = f"""WITH RECURSIVE {sig('pause')},
st AS (SELECT DISTINCT user_id, 0::BIGINT AS r, NULL::BIGINT AS id, '' AS kind, 1.0::DOUBLE AS ema, 12 AS wait, 'waiting' AS role, '' AS was FROM sg
 UNION ALL SELECT st.user_id, rn.r, rn.id, rn.kind,
  CASE WHEN rn.kind = 'word' AND role <> 'user' THEN 0.0 WHEN rn.kind = 'step' AND wait = 0 THEN
    CASE WHEN value > ema THEN exp2(-0.08::DOUBLE / {ATTACK}::DOUBLE) ELSE exp2(-0.08::DOUBLE / {RELEASE}::DOUBLE) END * ema
    + (1 - CASE WHEN value > ema THEN exp2(-0.08::DOUBLE / {ATTACK}::DOUBLE) ELSE exp2(-0.08::DOUBLE / {RELEASE}::DOUBLE) END) * value ELSE ema END,
  CASE WHEN rn.kind = 'step' AND wait > 0 THEN wait - 1 ELSE wait END, CASE rn.kind WHEN 'word' THEN 'user' WHEN 'bot' THEN 'bot' ELSE role END, role
 FROM st JOIN rn ON rn.user_id = st.user_id AND rn.r = st.r + 1),
res AS (SELECT user_id, id, 'step' AS kind, round(ema, 6) AS ema, role = 'user' AND ema > 0.6 AS pause FROM st WHERE kind = 'step'
 UNION ALL SELECT user_id, id, 'interrupt', NULL, false FROM st WHERE kind = 'word' AND was = 'bot'
 UNION ALL SELECT user_id, id, 'speech_started', NULL, false FROM st WHERE kind = 'word' AND was <> 'user')
""".replace("exp2(", "pow(2.0::DOUBLE, ")


def pause_rows(df):
    return df.select("user_id", "id", "kind", F.round("ema", 6).alias("ema"), "pause")


@query("t1_pause_ema", f"{EMA} SELECT * FROM res")
def _(t):
    out = run_stream(signals(stream(t), "pause"), SG.pause_machine(ATTACK, RELEASE), "user_id", bucket_ms=BUCKET_MS)
    return pause_rows(SW.run_to_table(out, "t1"))


@query("t1_pause_ema_batch", f"{EMA} SELECT * FROM res")
def _(t):
    e = signals(VW.events(t), "pause").select("user_id", "ts_us", "id", "kind", "value")
    islands = SG.message_islands(e, "user_id", ["ts_us", "id"])
    return pause_rows(fold_sorted(islands, SG.pause_machine(ATTACK, RELEASE), ["user_id", "island"]))


@query("t10_interrupt_on_speech", f"{EMA} SELECT user_id, id, kind FROM res WHERE kind <> 'step'")
def _(t):
    out = run_stream(signals(stream(t), "pause"), SG.pause_machine(ATTACK, RELEASE), "user_id", bucket_ms=BUCKET_MS)
    return SW.run_to_table(out.filter("kind <> 'step'"), "t10").select("user_id", "id", "kind")


ANT = f"""WITH RECURSIVE {sig('anticipation')},
st AS (SELECT DISTINCT user_id, 0::BIGINT AS r, NULL::BIGINT AS id, '' AS kind, 'waiting_for_user' AS role, NULL::BIGINT AS last, false AS fired, '' AS reasons FROM sg
 UNION ALL SELECT st.user_id, rn.r, rn.id, rn.kind, CASE rn.kind WHEN 'word' THEN 'user_speaking' WHEN 'bot' THEN 'bot_speaking' ELSE role END,
  CASE WHEN rn.kind = 'prob' AND value >= 0.2 AND coalesce(ts_us - last >= {12 * HOUR}, true) AND role = 'user_speaking' THEN ts_us ELSE last END,
  rn.kind = 'prob' AND value >= 0.2 AND coalesce(ts_us - last >= {12 * HOUR}, true) AND role = 'user_speaking',
  array_to_string(list_filter([CASE WHEN value < 0.2 THEN 'below_threshold' END, CASE WHEN ts_us - last < {12 * HOUR} THEN 'cooldown' END, CASE WHEN role <> 'user_speaking' THEN 'blocked_by_conversation_state' END], lambda x: x IS NOT NULL), ',')
 FROM st JOIN rn ON rn.user_id = st.user_id AND rn.r = st.r + 1)
SELECT user_id, id, fired AS triggered, reasons FROM st WHERE kind = 'prob'"""


@query("t2_anticipation_trigger", ANT)
def _(t):
    return SW.run_to_table(run_stream(signals(stream(t), "anticipation"), SG.anticipation_machine(0.2, 12 * HOUR), "user_id", bucket_ms=BUCKET_MS), "t2")


@query("t2_anticipation_batch", ANT)
def _(t):
    e = signals(VW.events(t), "anticipation").select("user_id", "ts_us", "id", "kind", "value")
    return SG.anticipation_decisions(e, "user_id", ["ts_us", "id"], 0.2, 12 * HOUR)


WINDOW, DRAIN = 12 * HOUR, 24 * HOUR
SPEC = f"""WITH {sig('speculation')},
a AS (SELECT *, sum((kind = 'trigger')::INT) OVER (PARTITION BY user_id ORDER BY r) AS attempt FROM rn),
b AS (SELECT *, sum((kind = 'pause')::INT) OVER (PARTITION BY user_id, attempt ORDER BY r) AS pauses FROM a WHERE attempt > 0),
p AS (SELECT user_id, attempt, min(ts_us) FILTER (kind = 'trigger') AS st, min(ts_us) FILTER (kind = 'pause') AS pause, count(*) FILTER (kind = 'chunk' AND pauses = 0) AS chunks, min(ts_us) FILTER (kind = 'interrupt' AND pauses = 1) AS stop FROM b GROUP BY 1, 2),
n AS (SELECT *, lead(st) OVER w AS nst, lead(pause) OVER w AS np, lead(chunks) OVER w AS nc, lead(stop) OVER w AS ns, (SELECT epoch_us(max(ts)) FROM events) AS until FROM p WINDOW w AS (PARTITION BY user_id ORDER BY attempt)),
c AS (SELECT *, coalesce((pause IS NOT NULL AND chunks > 0) OR (pause IS NULL AND np IS NOT NULL AND nc = 0 AND chunks > 0), false) AS com FROM n),
d AS (SELECT *, com AND coalesce(coalesce(CASE WHEN pause IS NOT NULL THEN stop ELSE ns END) - coalesce(pause, np) <= {DRAIN}, false) AS intr FROM c)
SELECT user_id, CAST(attempt AS BIGINT) AS attempt, chunks,
 CASE WHEN intr THEN 'interrupted' WHEN com THEN 'committed' WHEN pause IS NOT NULL THEN 'discarded' WHEN nst IS NOT NULL THEN 'cancelled' WHEN until - st > {WINDOW} THEN 'buffered' ELSE 'started' END AS status,
 CASE WHEN intr THEN 'interrupted_while_draining_committed_audio' WHEN com AND pause IS NULL THEN 'vad_confirmed_from_fallback' WHEN com AND pause - st > {WINDOW} THEN 'vad_confirmed_from_expired_buffer' WHEN com THEN 'vad_confirmed'
  WHEN pause IS NOT NULL THEN 'VAD with empty buffer' WHEN nst IS NOT NULL THEN 'graceful_supersede_fallback_saved' WHEN until - st > {WINDOW} THEN 'window_expired_buffer_kept' ELSE 'trigger' END AS status_reason FROM d"""


@query("t3_speculation_lifecycle", SPEC)
def _(t):
    """The last status and buffer each attempt reaches in the stream."""
    out = run_stream(signals(stream(t), "speculation"), SG.speculation_machine(WINDOW, DRAIN), "user_id", bucket_ms=BUCKET_MS)
    rows = SW.run_to_table(out, "t3")
    final = rows.groupBy("user_id", "attempt").agg(F.max_by(F.struct("status", "status_reason", "chunks"), "seq").alias("s"))
    return final.select("user_id", "attempt", "s.*")


@query("t3_speculation_batch", SPEC)
def _(t):
    e = VW.events(t)
    return SG.speculation_outcomes(signals(e, "speculation"), "user_id", ["ts_us", "id"], WINDOW, DRAIN, latest_time(e))


SIL = f"""WITH {sig('silence')}, n AS (SELECT *, coalesce(lead(ts_us) OVER (PARTITION BY user_id ORDER BY r), {{until}}) AS nx FROM rn)
SELECT user_id, id, ts_us + {24 * HOUR} AS marker_us FROM n WHERE kind = 'waiting' AND nx - ts_us > {24 * HOUR}"""
UNTIL = "(SELECT max(epoch_us(ts)) FROM events WHERE event_type IN ('purchase', 'click', 'view'))"


@query("t4_long_silence", SIL.format(until=UNTIL))
def _(t):
    return SW.run_to_table(run_stream(signals(stream(t), "silence"), SG.silence_machine(24 * HOUR), "user_id", bucket_ms=BUCKET_MS), "t4")


@query("t4_long_silence_batch", SIL.format(until=UNTIL))
def _(t):
    e = signals(VW.events(t), "silence")
    return SG.long_silences(e, "user_id", ["ts_us", "id"], 24 * HOUR, latest_time(e))


@query("t5_rechunk_stream", f"""
WITH w AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(text, '{SPACE}+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(string_split_regex(text, '{SPACE}+'), lambda x: x <> ''), 1) AS i,
  regexp_matches(text, '^{SPACE}') AS sp FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS word_idx, CASE WHEN i > 1 OR sp THEN ' ' || w ELSE w END AS word FROM w""")
def _(t):
    """Deltas of seven characters, turns 100 s apart; silence, or the end of input, flushes the last word of a turn."""
    d = turns(t).select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,7}"), F.lit(0))).alias("i", "text"))
    d = d.select("conv_id", "text", F.col("i").cast("long").alias("id"), ((F.col("turn") + 1) * 100_000_000 + F.col("i") * 10).alias("ts_us"))
    d = d.withColumn("ts", F.timestamp_micros("ts_us"))
    return SW.run_to_end(d, lambda rows: run_stream(rows, SG.words_machine(), "conv_id"), "t5")


@query("t8_turn_sessions", f"""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type FROM events),
f AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {6 * HOUR} THEN 0 ELSE 1 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY us, event_id) AS segment FROM f)
SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS pieces, string_agg(event_type, ' ' ORDER BY us, event_id) AS text FROM g GROUP BY user_id, segment""")
def _(t):
    """All sessions; the gap itself still joins."""
    s = SW.run_to_end(stream(t), lambda e: SW.turn_sessions(e, ["user_id"], "6 hours 1 microsecond", "0 seconds", "event_type"), "t8")
    return s.select("user_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "pieces", "text")


DAY_US = 24 * HOUR
EDGES = [0.5, 1.0, 5.0, 10.0, 20.0, 40.0, 60.0]  # fixed values: turn duration bins


@query("t9_live_histograms", f"""SELECT event_type, epoch_us(ts) // {DAY_US} * {DAY_US} AS start_us, count(*) AS "count", round(sum(value), 4) AS sum, {', '.join(f"count(*) FILTER (value <= {e}) AS le_{str(e).replace('.', '_')}" for e in EDGES)}
FROM events GROUP BY 1, 2""")
def _(t):
    h = SW.run_to_end(stream(t), lambda e: SW.live_histograms(e, ["event_type"], "value", EDGES, "1 day", "0 seconds"), "t9")
    return h.withColumn("sum", F.round("sum", 4)).withColumn("start_us", F.unix_micros("start_ts")).drop("start_ts")


@query("t7_step_timeline", f"""SELECT user_id, epoch_us(ts) // {HOUR} * {HOUR} AS start_us, count(*) FILTER (event_type = 'click') AS received_n, max(value) FILTER (event_type = 'click') AS received_peak,
count(*) FILTER (event_type = 'view') AS emitted_n, max(value) FILTER (event_type = 'view') AS emitted_peak, count(*) FILTER (event_type NOT IN ('click', 'view')) AS other_events FROM events GROUP BY 1, 2""")
def _(t):
    s = SW.run_to_end(stream(t), lambda e: SW.step_timeline(e, ["user_id"], "1 hour", "0 seconds", "click", "view", "value"), "t7")
    return s.select("user_id", F.unix_micros("start_ts").alias("start_us"), F.col("received.n").alias("received_n"), F.col("received.peak").alias("received_peak"), F.col("emitted.n").alias("emitted_n"), F.col("emitted.peak").alias("emitted_peak"), "other_events")
