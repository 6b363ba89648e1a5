"""Timing traces, event logs, latencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.functions import text as T
from convlake.operators import traces as TC
from convlake.plans import slices as S
from convlake.sources import transcripts as TR
from convlake.workloads import views as VW
from convlake.workloads.chunks import NT
from convlake.workloads.registry import Tables, query
from convlake.workloads.turns import timeline

def day():
    return S.by_micros("ts_us")


U = ["user_id"]
EV = "ev AS (SELECT *, epoch_us(ts) AS ts_us FROM events)"

# --- orders as dialogue items, their lines as generations, attempts and words -----------------------------

POS = "{'n': l_linenumber, 'p': l_partkey, 's': l_suppkey}"
LINE_ID = "concat_ws('-', l_linenumber, l_partkey, l_suppkey)"
GEN = f"""
gen AS (SELECT l_orderkey AS item, {POS} AS pos, CASE l_linestatus WHEN 'F' THEN 'completed' ELSE 'started' END AS status,
  l_quantity / 10 AS vad, CASE WHEN l_tax > 0.02 THEN l_quantity / 10 + l_discount END AS llm, l_quantity / 10 + l_discount + l_tax AS tok FROM lineitem),
items AS (SELECT o_orderkey AS item, (o_orderkey % 40) / 10.0::DOUBLE AS input_end_s FROM orders)
"""


def line(t: Tables):
    return t.lineitem.select(
        F.col("l_orderkey").alias("item"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.expr(LINE_ID).alias("line_id"), F.col("l_linenumber").alias("ln"), "l_returnflag", "l_linestatus",
        "l_quantity", "l_discount", "l_tax", (F.col("l_quantity") / 10).alias("q"),
    )


def items(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("item"), ((F.col("o_orderkey") % 40) / 10.0).alias("input_end_s"))


def generations(t: Tables):
    v = line(t)
    tok = F.col("q") + F.col("l_discount") + F.col("l_tax")
    stages = [F.col("q"), F.when(F.col("l_tax") > 0.02, F.col("q") + F.col("l_discount")), tok, F.lit(None).cast("double"), tok, tok]
    return v.select("item", "pos", F.when(F.col("l_linestatus") == "F", "completed").otherwise("started").alias("status"), *[c.alias(n) for c, n in zip(stages, TC.STAGES)])


def trace_files(t: Tables):
    """Every order line as one trace file with two generations, one attempt and two pauses."""
    v = line(t)
    gens = F.array(*[
        F.struct(F.lit(i).alias("generation_index"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("started").alias("status"), F.lit("vad_pause").alias("start_trigger"), (F.col("l_quantity") + i).alias("vad_pause_detected_sec"))
        for i in (0, 1)])
    att = F.array(F.struct(F.col("ln").alias("attempt_index"), F.col("l_quantity").alias("trigger_time_sec"), F.col("l_returnflag").alias("status")))
    body = F.to_json(F.struct(gens.alias("generations"), att.alias("speculation_attempts"), F.array(F.col("l_quantity"), F.col("l_quantity") + 2).alias("vad_pause_detection_times_sec")))
    return v.select(F.concat_ws("-", F.col("item").cast("string"), "line_id").alias("item"), body.alias("body"))


@query("s6_explode_traces", """
SELECT 'generations' AS kind, count(*) * 2 AS n, CAST(sum(l_quantity * 2 + 1) AS DOUBLE) AS s FROM lineitem
UNION ALL SELECT 'attempts', count(*), CAST(sum(l_quantity + l_linenumber) AS DOUBLE) FROM lineitem
UNION ALL SELECT 'pauses', count(*) * 2, CAST(sum(l_quantity * 2 + 2) AS DOUBLE) FROM lineitem""")
def _(t):
    rows = TR.trace_rows(trace_files(t))
    values = {"generations": F.col("generations.vad_pause_detected_sec"), "attempts": F.col("attempts.trigger_time_sec") + F.col("attempts.attempt_index"), "pauses": F.col("pauses")}
    one = rows.agg(*[F.struct(F.lit(k).alias("kind"), F.count_if(F.col("kind") == k).alias("n"), F.sum(c).alias("s")).alias(k) for k, c in values.items()])
    return one.select(F.inline(F.array(*values)))


@query("p13_compact_columns", """
SELECT CASE l_linestatus WHEN 'F' THEN 'completed' ELSE 'started' END AS status, l_returnflag AS outcome, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS trigger_sum FROM lineitem GROUP BY 1, 2""")
def _(t):
    c = TR.compact_columns(trace_files(t), ["generation_index", "status"], ["trigger_time_sec", "status"])
    g, a = F.col("generations")[0], F.col("speculation_attempts")[0]
    return c.groupBy(g["status"].alias("status"), a["status"].alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum(a["trigger_time_sec"]).alias("trigger_sum"))


@query("a11_stage_latencies", f"""WITH {GEN},
f AS (SELECT item, arg_min(vad, pos) AS vad, arg_min(coalesce(llm, -1), pos) AS llm0, arg_min(tok, pos) AS tok FROM gen WHERE status = 'completed' GROUP BY 1),
d AS (SELECT round(vad - input_end_s, 3) AS v, CASE WHEN llm0 >= 0 THEN round(llm0 - input_end_s, 3) END AS l, round(tok - input_end_s, 3) AS k FROM f JOIN items USING (item) WHERE round(vad - input_end_s, 3) > 0)
SELECT 'vad_pause_detected_sec' AS stage, count(*) AS n, round(avg(v), 3) AS latency FROM d
UNION ALL SELECT 'llm_generation_started_sec', count(l), round(avg(l), 3) FROM d
UNION ALL SELECT u.s, count(*), round(avg(k), 3) FROM d, (VALUES ('llm_first_token_sec'), ('tts_first_token_received_sec'), ('tts_first_audio_chunk_received_sec')) u(s) GROUP BY 1""")
def _(t):
    return TC.stage_latencies(generations(t), items(t))


RL = f"""{GEN},
w AS (SELECT item, vad AS s, vad + 0.3 AS e FROM gen JOIN items USING (item) WHERE vad >= input_end_s),
r AS (SELECT item, min(s) AS f, max(e) AS l, count(*) AS n FROM w GROUP BY 1),
na AS (SELECT l_orderkey AS item, count(*) FILTER (l_returnflag <> 'N') AS attempts FROM lineitem GROUP BY 1),
pi AS (SELECT item, coalesce(attempts, 0) AS attempts, (n IS NOT NULL AND NOT (l - f < 1.0 AND n <= 3))::INT AS turn_taken, CASE WHEN n IS NOT NULL AND NOT (l - f < 1.0 AND n <= 3) THEN greatest(round(f - input_end_s, 3), 0) END AS latency
  FROM items LEFT JOIN r USING (item) LEFT JOIN na USING (item))
"""


def per_item(t: Tables):
    v = line(t)
    words = v.select("item", F.col("q").alias("start_s"), (F.col("q") + 0.3).alias("end_s"))
    tries = v.groupBy("item").agg(F.count_if(F.col("l_returnflag") != "N").alias("attempts"))
    it = items(t).join(tries, "item", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    return TC.response_latency(it, words)


@query("a10_response_latency", f"WITH {RL} SELECT item, turn_taken, latency, attempts FROM pi")
def _(t):
    return per_item(t)


@query("a10_latency_report", f"""WITH {RL} SELECT count(*) AS items, round(avg(turn_taken), 3) AS turn_taken_rate, round(avg(latency), 3) AS latency, count(*) FILTER (attempts > 0) AS with_speculation,
count(*) FILTER (attempts = 0) AS without_speculation, round(avg(latency) FILTER (attempts > 0), 3) AS latency_with, round(avg(latency) FILTER (attempts = 0), 3) AS latency_without FROM pi""")
def _(t):
    return TC.latency_report(per_item(t))


def attempts(t: Tables):
    v = line(t)
    return v.select(
        "item", "pos", F.when(F.col("l_returnflag") == "A", "committed").when(F.col("l_returnflag") == "R", "cancelled").when(F.col("ln") % 2 == 0, "discarded").otherwise("buffered").alias("status"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.04), "graceful_supersede_fallback_saved").when((F.col("l_returnflag") == "A") & (F.col("l_tax") > 0.06), "vad_confirmed_from_fallback").otherwise("other").alias("status_reason"),
        (F.col("ln") % 3).alias("buffered_audio_chunks"),
    )


@query("a13_attempt_breakdown", """
SELECT l_orderkey AS item, count(*) AS attempts, count(*) FILTER (l_returnflag = 'A') AS n_committed, count(*) FILTER (l_returnflag = 'R') AS n_cancelled,
 count(*) FILTER (l_returnflag = 'N' AND l_linenumber % 2 = 0) AS n_discarded, count(*) FILTER (l_returnflag = 'N' AND l_linenumber % 2 = 1) AS n_buffered,
 count(*) FILTER (l_returnflag = 'R' AND l_linenumber % 3 > 0 AND l_tax <= 0.04) AS wasted, count(*) FILTER (l_returnflag = 'R' AND l_linenumber % 3 > 0 AND l_tax > 0.04) AS saved_as_fallback,
 bool_or(l_returnflag = 'A' AND l_tax > 0.06) AS fallback_used FROM lineitem GROUP BY 1""")
def _(t):
    return TC.attempt_breakdown(attempts(t))


@query("j8_commit_details", f"""WITH a AS (SELECT l_orderkey AS item, {LINE_ID} AS id, l_quantity / 10 + 0.4::DOUBLE AS ts, CASE WHEN l_tax > 0.04 THEN l_quantity / 10 + 0.1::DOUBLE END AS own, l_quantity / 10 + 0.4::DOUBLE + l_discount AS fin FROM lineitem WHERE l_returnflag = 'A'),
p AS (SELECT l_orderkey AS item, l_quantity / 10 AS ts FROM lineitem WHERE l_returnflag <> 'A'),
j AS (SELECT a.item, a.id, a.ts, own, fin, max(p.ts) AS near FROM a LEFT JOIN p ON p.item = a.item AND p.ts <= a.ts AND a.ts - p.ts < 2.5 GROUP BY ALL)
SELECT item, id, round(coalesce(own, near), 6) AS pause, round(ts - coalesce(own, near), 6) AS drain_after_pause, round(fin - ts, 6) AS drain_duration FROM j""")
def _(t):
    v = line(t)
    drain = F.col("q") + 0.4
    a = v.select("item", F.col("line_id").alias("id"), drain.alias("ts"), F.when(F.col("l_returnflag") == "A", "committed").otherwise("cancelled").alias("status"), F.when(F.col("l_tax") > 0.04, F.col("q") + 0.1).alias("own_pause"), (drain + F.col("l_discount")).alias("drain_end"))
    p = v.filter("l_returnflag <> 'A'").select("item", F.col("q").alias("ts"), F.col("line_id").alias("id"))
    d = TC.commit_details(a, p, ["item"], F.floor(F.col("ts") / 60).cast("long"))
    return d.select("item", "id", *[F.round(c, 6).alias(c) for c in ("pause", "drain_after_pause", "drain_duration")])


@query("j14_latest_call", f"""WITH c AS (SELECT l_orderkey AS item, l_linenumber AS generation_index, arg_max(l_quantity, {POS}) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT g.item, g.generation_index, c.q FROM (SELECT DISTINCT l_orderkey AS item, l_linenumber AS generation_index FROM lineitem) g LEFT JOIN c ON c.item = g.item AND c.generation_index = g.generation_index""")
def _(t):
    v = line(t).withColumnRenamed("ln", "generation_index")
    calls = v.select("item", "generation_index", F.col("l_returnflag").alias("stage"), "pos", "l_quantity")
    g = TC.latest_call(v.select("item", "generation_index").distinct(), calls, ["item", "generation_index"], "pos", "R")
    return g.select("item", "generation_index", F.col("call.l_quantity").alias("q"))


# --- events -------------------------------------------------------------------------------------------------


@query("s7_read_events", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def _(t):
    """Typed payloads parsed from the event log."""
    e = t.events.select("event_type", F.from_json("props", "struct<k:bigint>").alias("p"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k"))


NEAR = f"""{EV}, a AS (SELECT user_id, event_id, ts_us FROM ev WHERE event_type = 'click'), b AS (SELECT user_id, ts_us, min(event_id) AS id FROM ev WHERE event_type = 'view' GROUP BY 1, 2),
m AS (SELECT a.user_id, a.event_id, a.ts_us, b.id, abs(a.ts_us - b.ts_us) AS d, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.ts_us - b.ts_us), b.ts_us) AS r FROM a JOIN b USING (user_id) WHERE abs(a.ts_us - b.ts_us) <= 14400000000)
"""


def sides(t: Tables):
    e = VW.events(t)
    a = e.filter("event_type = 'click'").select("user_id", "ts_us", "event_id")
    b = e.filter("event_type = 'view'").select("user_id", "ts_us", F.col("event_id").alias("id"))
    return a, b


@query("j7_nearest_in_time", f"""WITH {NEAR} SELECT user_id, min(event_id) AS event_id, id AS matched_id, arg_min(d, event_id) AS distance FROM m WHERE r = 1 GROUP BY 1, 3""")
def _(t):
    a, b = sides(t)
    return TC.nearest_in_time(a, b, U, "ts_us", "event_id", 4 * 3600 * 1000000, day()).select("user_id", "event_id", "matched_id", "distance")


@query("j8_asof_backward", f"""WITH {EV}, a AS (SELECT user_id, event_id, ts_us FROM ev WHERE event_type = 'click'), b AS (SELECT user_id, ts_us FROM ev WHERE event_type = 'view')
SELECT a.user_id, a.event_id, max(b.ts_us) AS asof_ts FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts_us <= a.ts_us AND a.ts_us - b.ts_us < 36000000000 GROUP BY 1, 2""")
def _(t):
    a, b = sides(t)
    return TC.asof_backward(a, b, U, "ts_us", "event_id", 10 * 3600 * 1000000, day()).select("user_id", "event_id", "asof_ts")


@query("j9_fifo_match", f"""WITH {EV}, e AS (SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS epoch FROM ev),
k AS (SELECT user_id, event_id, epoch, event_type, row_number() OVER (PARTITION BY user_id, epoch, event_type ORDER BY ts_us, event_id) - 1 AS k FROM e WHERE event_type IN ('click', 'view'))
SELECT r.user_id, r.epoch, r.k AS nth, r.event_id AS ready_id, d.event_id AS delivered_id FROM k r JOIN k d ON r.user_id = d.user_id AND r.epoch = d.epoch AND r.k = d.k AND r.event_type = 'click' AND d.event_type = 'view'""")
def _(t):
    kind = F.when(F.col("event_type") == "click", "ready").when(F.col("event_type") == "view", "delivered").when(F.col("event_type") == "error", "reset")
    e = VW.events(t).select("user_id", "ts_us", "event_id", kind.alias("kind"), F.col("event_id").alias("id")).filter("kind IS NOT NULL")
    return TC.fifo_match(e, U, ["ts_us", "event_id"], day())


@query("j9_drain_steps", f"""WITH {VW.FRAMES}, i AS (SELECT user_id, idx, idx * 2 AS arrival, CAST(1 + floor(prob * 10) AS BIGINT) % 5 AS n FROM frames),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i),
m AS (SELECT *, max(arrival - before) OVER (PARTITION BY user_id ORDER BY idx) AS lag FROM b)
SELECT user_id, idx, unnest(range(n)) AS piece, CAST(lag + before AS BIGINT) + unnest(range(n)) AS step FROM m WHERE n > 0""")
def _(t):
    f = VW.frames(t).select("user_id", "idx", (F.col("idx") * 2).alias("arrival"), (((1 + F.floor(F.col("prob") * 10)) % 5) * 960).cast("long").alias("n_samples"))
    return TC.drain_steps(f, U, "idx", 960).select("user_id", "idx", F.col("piece").cast("long").alias("piece"), "step")


PAIRS = "pr AS (SELECT user_id, min(value) FILTER (event_id % 2 = 0) AS base, min(value) FILTER (event_id % 2 = 1) AS spec FROM events GROUP BY 1)"


def run_pairs(t: Tables):
    e = t.events.groupBy("user_id").agg(F.min(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("base"), F.min(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("spec"))
    e = e.withColumn("item", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return TC.compare_runs(e.select("item", F.col("base").alias("lat")), e.select("item", F.col("spec").alias("lat")), "item", "lat", "u")


@query("j10_compare_runs", f"WITH {PAIRS} SELECT 'u' || user_id AS item, base, spec, round(spec - base, 6) AS delta FROM pr")
def _(t):
    return run_pairs(t).withColumn("delta", F.round("delta", 6))


@query("a12_run_comparison", f"""WITH {PAIRS}, l AS (SELECT u.series, u.v FROM pr, LATERAL (VALUES ('base', base), ('spec', spec), ('delta', spec - base)) u(series, v) WHERE u.v IS NOT NULL)
SELECT series, count(*) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS stdev, round(quantile_cont(v, 0.5), 6) AS median FROM l GROUP BY 1""")
def _(t):
    return TC.run_comparison(run_pairs(t)).select("series", "n", *[F.round(c, 6).alias(c) for c in ("mean", "stdev", "median")])


@query("a9_latency_distribution", """SELECT event_type, count(*) AS "count", round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def _(t):
    d = TC.latency_distribution(t.events, ["event_type"], "value")
    return d.select("event_type", "count", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p90", "p95")])


@query("a9_approximate_distribution")
def _(t):
    return TC.approximate_distribution(t.events, ["event_type"], "value")


@query("a29_ok_fraction", "SELECT count(*) AS runs, round(avg((event_type <> 'error')::INT), 6) AS ok_fraction FROM events")
def _(t):
    return TC.ok_fraction(t.events, F.col("event_type") != "error").withColumn("ok_fraction", F.round("ok_fraction", 6))


@query("a30_phase_timestamps", f"""WITH {EV}, e AS (SELECT *, CAST(sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS BIGINT) AS response FROM ev),
p AS (SELECT user_id, response, min(ts_us) FILTER (event_type = 'signup') AS pause, min(ts_us) FILTER (event_type = 'click') AS created, min(ts_us) FILTER (event_type = 'view') AS first_text,
  min(ts_us) FILTER (event_type = 'purchase') AS first_audio, bool_or(event_type = 'error') AS closed FROM e WHERE response > 0 GROUP BY 1, 2)
SELECT user_id, response, pause, created, first_text, first_audio, CASE WHEN closed THEN 'completed' ELSE 'started' END AS status,
  (created IS NULL OR pause <= created) AND (first_text IS NULL OR (pause <= first_text AND created IS NOT NULL AND created <= first_text)) AS ordered FROM p""")
def _(t):
    e = VW.events(t).withColumnRenamed("event_type", "type")
    return TC.phase_timestamps(e, "user_id", ["ts_us", "event_id"], day(), "ts_us", "signup", {"created": "click", "first_text": "view", "first_audio": "purchase"}, {"error": "completed"}, exempt=["first_audio"])


EDGES = [0.5, 1.0, 5.0, 10.0, 20.0, 40.0, 60.0]  # fixed values: turn duration bins


@query("a26_fixed_histogram", f"""SELECT event_type, le, count(*) AS "count", round(sum(value), 4) AS sum, count(*) FILTER (value <= le) AS bucket FROM events, (VALUES {', '.join(f'({e}::DOUBLE)' for e in EDGES)}) e(le) GROUP BY 1, 2""")
def _(t):
    return TC.fixed_histogram(t.events, ["event_type"], "value", EDGES).withColumn("sum", F.round("sum", 4))


@query("a21_field_coverage", """
SELECT 'quality' AS field, count(*) AS total, count(quality) AS present FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'lang', count(*), count(lang) FROM documents""")
def _(t):
    return TC.field_coverage(t.documents.join(t.labels, "doc_id", "left"), "doc_id", ["quality", "lang"])[0]


@query("a21_missing_fields", "SELECT 'quality' AS field, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return TC.field_coverage(t.documents.join(t.labels, "doc_id", "left"), "doc_id", ["quality", "lang"])[1]


@query("a24_inverted_lists", "SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) - 1 AS place FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)")
def _(t):
    return TC.inverted_lists(t.lineitem, "l_partkey", "l_orderkey")


UN = r"list_filter(list_transform(string_split_regex({c}, '\n+|\|'), lambda x: trim(x)), lambda x: x <> '')"
COV = f"""
n AS (SELECT doc_id, {NT} AS text FROM documents),
c AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), ' ') WHEN 1 THEN replace(text, 'e', 'E') ELSE text END AS clean FROM n),
su AS (SELECT doc_id, unit, count(*) AS n FROM (SELECT doc_id, unnest({UN.format(c='text')}) AS unit FROM c) GROUP BY 1, 2),
cu AS (SELECT doc_id, unit, count(*) AS m FROM (SELECT doc_id, unnest({UN.format(c='clean')}) AS unit FROM c) GROUP BY 1, 2),
bl AS (SELECT doc_id, array_to_string({UN.format(c='clean')}, chr(10)) AS blob FROM c),
cv AS (SELECT su.doc_id, sum(n) AS total, sum(CASE WHEN coalesce(m, 0) >= n THEN n WHEN contains(blob, su.unit) THEN 1 ELSE 0 END) AS matched
  FROM su LEFT JOIN cu ON cu.doc_id = su.doc_id AND cu.unit = su.unit JOIN bl ON bl.doc_id = su.doc_id GROUP BY 1)
"""


def coverage(t: Tables):
    src = t.documents.select("doc_id", T.normalise_text(F.col("text")).alias("source"))
    c = F.col("source")
    changed = F.when(F.col("doc_id") % 3 == 0, F.replace(c, F.lit("\n"), F.lit(" "))).when(F.col("doc_id") % 3 == 1, F.translate(c, "e", "E")).otherwise(c)
    return TC.multiset_coverage(src.withColumn("clean", changed), "doc_id", "source", "clean")


@query("a25_multiset_coverage", f"WITH {COV} SELECT doc_id, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(matched, 0) AS BIGINT) AS matched, coalesce(round(matched / total::DOUBLE, 6), 1) AS coverage FROM c LEFT JOIN cv USING (doc_id)")
def _(t):
    return coverage(t).withColumn("coverage", F.round("coverage", 6))


@query("k5_sort_then_limit", f"WITH {COV} SELECT doc_id, coalesce(round(matched / total::DOUBLE, 6), 1) AS coverage FROM c LEFT JOIN cv USING (doc_id) ORDER BY 2, 1 LIMIT 20")
def _(t):
    return coverage(t).select("doc_id", F.round("coverage", 6).alias("coverage")).orderBy("coverage", "doc_id").limit(20)


# --- message timings ---------------------------------------------------------------------------------------

MSG = VW.TURN_TIMES + """,
ms AS (SELECT conv_id, turn AS i, role, start_ms / 1000.0::DOUBLE AS s, (start_ms + dur_ms) / 1000.0::DOUBLE AS e FROM turn_times),
mg AS (SELECT conv_id, i, role, CASE WHEN role = 'user' THEN (s + 0.2) - s END AS stt, CASE WHEN role = 'assistant' THEN (s - 0.1) - lag(e) OVER (PARTITION BY conv_id ORDER BY i) END AS vad,
  CASE WHEN role = 'assistant' THEN s - (s - 0.1) END AS llm, CASE WHEN role = 'assistant' THEN (s + 0.15) - s END AS tts_start, CASE WHEN role = 'assistant' THEN ((e - s) * 1.1) / (e - (s + 0.15)) END AS rtf FROM ms)
"""


def messages(t: Tables):
    v = timeline(t).join(t.conversations.select("conv_id", F.col("turn").alias("seg"), "role"), ["conv_id", "seg"])
    s, e, u = F.col("start_s"), F.col("end_s"), F.col("role") == "user"
    return v.select(
        "conv_id", F.col("seg").alias("i"), "role", F.when(u, s).otherwise(s + 0.15).alias("audio_start"), F.when(u, s + 0.2).otherwise(s).alias("text_start"),
        e.alias("audio_end"), F.when(~u, s - 0.1).alias("response_created"), ((e - s) * 1.1).alias("received_audio_length"))


GAPS = ["stt", "vad", "llm", "tts_start", "tts_realtime_factor"]


@query("w17_message_gaps", f"WITH {MSG} SELECT conv_id, i, role, round(stt, 6) AS stt, round(vad, 6) AS vad, round(llm, 6) AS llm, round(tts_start, 6) AS tts_start, round(rtf, 6) AS tts_realtime_factor FROM mg")
def _(t):
    return TC.message_gaps(messages(t)).select("conv_id", "i", "role", *[F.round(c, 6).alias(c) for c in GAPS])


@query("a28_combine_reports", f"WITH {MSG} SELECT round(avg(stt), 6) AS stt, round(avg(vad), 6) AS vad, round(avg(llm), 6) AS llm, round(avg(tts_start), 6) AS tts_start, round(avg(rtf), 6) AS tts_realtime_factor FROM mg")
def _(t):
    g = TC.message_gaps(messages(t))
    parts = [g.filter(F.col("conv_id") % 2 == i) for i in (0, 1)]
    return TC.combine_reports(*parts).select(*[F.round(c, 6).alias(c) for c in GAPS])


@query("p10_validate_timing", f"""WITH {MSG} SELECT role, CASE WHEN role = 'user' THEN s < s + 0.2 AND s < e ELSE s - 0.1 < s + 0.15 AND s + 0.15 < e END AS valid, count(*) AS n FROM ms GROUP BY 1, 2""")
def _(t):
    return TC.validate_timing(messages(t)).groupBy("role", "valid").agg(F.count(F.lit(1)).alias("n"))


# --- signal blocks: event values as samples ------------------------------------------------------------------

SIG = VW.FRAMES + ", x AS (SELECT user_id, idx AS i, prob AS x FROM frames)"


def samples(t: Tables):
    return VW.frames(t).select("user_id", F.col("idx").alias("i"), F.col("prob").alias("x"))


@query("w19_rms_blocks", f"WITH {SIG} SELECT user_id, i // 8 AS block, round(sqrt(avg(x * x)), 6) AS rms FROM x GROUP BY 1, 2")
def _(t):
    return TC.rms_blocks(samples(t), U, 8).select("user_id", "block", F.round("rms", 6).alias("rms"))


@query("w20_first_onset", f"WITH {SIG}, b AS (SELECT user_id, (i - 3) // 4 AS block, sqrt(avg(x * x)) AS rms, count(*) AS n FROM x WHERE i >= 3 GROUP BY 1, 2) SELECT user_id, min(block) * 4 + 3 AS onset FROM b WHERE n = 4 AND rms > 0.3 GROUP BY 1")
def _(t):
    return TC.first_onset(samples(t), U, 4, 0.3, 3)


@query("w21_trim_trailing_quiet", f"""WITH {SIG}, m AS (SELECT user_id, i, avg(x * x) OVER w AS a, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
p AS (SELECT user_id, max(abs(x)) AS peak, count(*) AS length FROM x GROUP BY 1)
SELECT p.user_id, length, least(max(i) FILTER (n = 5 AND sqrt(a) > peak * pow(10, -6 / 20.0::DOUBLE)) + 5 + 2, length) AS keep FROM p JOIN m ON m.user_id = p.user_id GROUP BY p.user_id, length""")
def _(t):
    return TC.trim_trailing_quiet(samples(t), U, 5, 2, -6.0)


@query("w22_trim_quiet_run", f"""WITH {SIG}, q AS (SELECT *, x <= 0.2 AND coalesce(sum(0.25) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 2 AS quiet FROM x),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, quiet ORDER BY i) AS grp FROM q)
SELECT user_id, i AS idx, quiet AND count(*) OVER (PARTITION BY user_id, quiet, grp) >= 6 AS dropped FROM g""")
def _(t):
    c = samples(t).select("user_id", F.col("i").alias("idx"), F.col("x").alias("rms"), F.lit(0.25).alias("dur_s"))
    return TC.trim_quiet_run(c, U, 6, 2.0, 0.2).select("user_id", "idx", "dropped")


@query("w23_rebase", f"""WITH {EV}, s AS (SELECT user_id, min(ts_us) - 200000 AS st FROM ev WHERE event_type = 'signup' GROUP BY 1) SELECT user_id, event_id, ts_us - st AS ts_us FROM ev JOIN s USING (user_id) WHERE ts_us >= st""")
def _(t):
    r = TC.rebase(VW.events(t), U, ["ts_us"], F.col("event_type") == "signup", 200000)
    return r.select("user_id", "event_id", F.col("ts_us").cast("long").alias("ts_us"))


@query("w18_place_regions", f"""WITH {EV}, c AS (SELECT user_id, event_id, ts_us, ts_us // 86400000000 AS region, ts_us // 1000000 AS t, CAST(round(value * 1000) AS BIGINT) AS dur, CASE WHEN event_type = 'click' THEN 500 ELSE 0 END AS wait FROM ev),
r AS (SELECT user_id, region, min(t) AS f, sum(dur + wait) AS l FROM c GROUP BY 1, 2),
r1 AS (SELECT *, coalesce(sum(l) OVER (PARTITION BY user_id ORDER BY region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb FROM r),
r2 AS (SELECT *, max(f - cb) OVER (PARTITION BY user_id ORDER BY region) + cb AS st FROM r1)
SELECT c.user_id, c.event_id, CAST(st AS BIGINT) AS region_start, CAST(st + sum(dur + wait) OVER (PARTITION BY c.user_id, c.region ORDER BY ts_us, event_id) - dur AS BIGINT) AS start_s FROM c JOIN r2 ON r2.user_id = c.user_id AND r2.region = c.region""")
def _(t):
    """Each day of a user is a region, each event a chunk (whole units of time)."""
    e = VW.events(t).select(
        "user_id", "event_id", "ts_us", F.floor(F.col("ts_us") / 86400000000).alias("region"), F.floor(F.col("ts_us") / 1000000).alias("first_ts"),
        F.round(F.col("value") * 1000).cast("long").alias("dur_s"), F.when(F.col("event_type") == "click", 500).otherwise(0).cast("long").alias("wait_s"))
    p = TC.place_regions(e, U, ["ts_us", "event_id"], F.floor(F.col("region") / 365).cast("long"), S.by_micros("ts_us", 3_600_000_000))
    return p.select("user_id", "event_id", "region_start", "start_s")
