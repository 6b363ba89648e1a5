"""Frame runs, forecast targets, turn metrics and endpoint scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.operators import frames as FR
from convlake.operators import turns as U
from convlake.plans import slices as S
from convlake.session import staged
from convlake.workloads import views as VW
from convlake.workloads.registry import Tables, query
from convlake.workloads.turns import FR as TURN_FRAMES
from convlake.workloads.turns import TL, timeline

KEYS = ["user_id"]
FREQ = 12.5
HORIZONS = [4, 8]
GRID = FR.threshold_grid()


def frames(t: Tables):
    return VW.frames(t)


def scores(t: Tables):
    """One score per horizon: the longer horizon is a little less sure."""
    h = F.array(*[F.struct(F.lit(x).alias("horizon"), F.lit(1 - i / 10).alias("f")) for i, x in enumerate(HORIZONS)])
    return frames(t).select("user_id", "idx", "prob", F.explode(h).alias("h")).select("user_id", "idx", "h.horizon", (F.col("prob") * F.col("h.f")).alias("prob"))


RUNS = VW.FRAMES + """,
isl AS (SELECT *, idx - row_number() OVER (PARTITION BY user_id, label ORDER BY idx) AS grp FROM frames),
runs AS (SELECT user_id, label, min(idx) AS first, max(idx) AS last FROM isl GROUP BY user_id, label, grp),
rr AS (SELECT *, lead(label) OVER w AS nl, lag(label) OVER w AS pl, lag(first) OVER w AS pf FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY first)),
fr AS (SELECT f.user_id, f.idx, f.prob, f.label, r.first, r.last, r.nl, r.pl, r.pf FROM frames f JOIN rr r ON f.user_id = r.user_id AND f.idx BETWEEN r.first AND r.last),
hz(horizon, fac) AS (VALUES (4, 1.0::DOUBLE), (8, 0.9::DOUBLE)),
tg AS (SELECT user_id, idx, horizon, prob * fac AS prob, label,
   CASE WHEN label = 3 AND nl = 1 AND last + 1 - idx <= horizon AND last - first + 1 >= greatest(horizon, 3) THEN 1
        WHEN label = 1 AND pl = 3 AND idx = first AND first - pf >= greatest(horizon, 3) THEN 1 ELSE 0 END AS target FROM fr, hz)
"""


@query("w5_label_runs", f"WITH {RUNS} SELECT user_id, label, first, last FROM runs")
def _(t):
    return FR.label_runs(frames(t), KEYS)


@query("p7_min_turn_filter", f"WITH {RUNS} SELECT user_id, label, first, last FROM runs WHERE (last - first + 1) / 12.5 >= 0.4")
def _(t):
    return FR.min_turn_filter(FR.label_runs(frames(t), KEYS), FREQ, 0.4)


@query("w7_forecast_labels", f"WITH {RUNS} SELECT user_id, idx, horizon, target FROM tg")
def _(t):
    return FR.forecast_labels(frames(t), KEYS, HORIZONS, 3)


def targets(t: Tables):
    """Forecast targets next to the scores."""
    return FR.forecast_labels(frames(t), KEYS, HORIZONS, 3).join(scores(t), ["user_id", "idx", "horizon"])


@query("w8_shift_labels", f"WITH {VW.FRAMES} SELECT user_id, idx, CASE WHEN idx < 3 THEN -1 ELSE lag(label, 3) OVER (PARTITION BY user_id ORDER BY idx) END AS label FROM frames")
def _(t):
    return FR.shift_labels(frames(t), KEYS, 3).select("user_id", "idx", "label")


@query("w8_shift_labels_coin", f"""WITH {VW.FRAMES} SELECT user_id, idx, CASE WHEN md5('s' || user_id)[1:1] >= '8' THEN label WHEN idx < 3 THEN -1
ELSE lag(label, 3) OVER (PARTITION BY user_id ORDER BY idx) END AS label FROM frames""")
def _(t):
    coin = F.substring(F.md5(F.concat(F.lit("s"), F.col("user_id").cast("string"))), 1, 1) < "8"
    return FR.shift_labels(frames(t), KEYS, 3, coin).select("user_id", "idx", "label")


RAMP = RUNS + """,
st AS (SELECT *, CASE WHEN target = 1 AND coalesce(lag(target) OVER w, 0) <> 1 THEN idx END AS s FROM tg WINDOW w AS (PARTITION BY user_id, horizon ORDER BY idx)),
rp AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY user_id, horizon ORDER BY idx) AS s0 FROM st),
wt AS (SELECT *, (CASE WHEN target = 1 THEN CASE WHEN idx - s0 >= horizon THEN 0 ELSE 2.0 - 1.0 * (idx - s0) / (horizon - 1)::DOUBLE END ELSE 1 END)::DOUBLE AS weight,
   max(target) OVER (PARTITION BY user_id, horizon ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) = 1 AS near FROM rp)
"""


@query("w9_ramp_weights", f"WITH {RAMP} SELECT user_id, idx, horizon, round(weight, 6) AS weight FROM wt")
def _(t):
    return FR.ramp_weights(targets(t), KEYS, 2.0, 1.0).select("user_id", "idx", "horizon", F.round("weight", 6).alias("weight"))


@query("w10_near_positive_mask", f"WITH {RAMP} SELECT user_id, idx, horizon, near FROM wt")
def _(t):
    return FR.near_positive_mask(targets(t), KEYS, 5).select("user_id", "idx", "horizon", "near")


@query("p15_mask_labels", f"WITH {RUNS} SELECT user_id, idx, horizon, CASE WHEN label = 2 THEN -1 ELSE target END AS target, label = 2 AS other FROM tg")
def _(t):
    return FR.mask_labels(FR.forecast_labels(frames(t), KEYS, HORIZONS, 3), frames(t), KEYS)


@query("w11_greedy_cooldown", f"""WITH RECURSIVE {VW.FRAMES}, tr AS (SELECT user_id, idx FROM frames WHERE prob > 0.3),
k AS (SELECT user_id, min(idx) AS idx FROM tr GROUP BY 1 UNION ALL
      SELECT k.user_id, min(tr.idx) FROM k JOIN tr ON tr.user_id = k.user_id AND tr.idx >= k.idx + 8 GROUP BY k.user_id)
SELECT user_id, idx FROM k""")
def _(t):
    return FR.greedy_cooldown(frames(t).filter("prob > 0.3").select("user_id", "idx"), KEYS, 8, piece=32)


TM = RUNS + """,
th AS (SELECT i AS th_idx, 0.05::DOUBLE + i * ((0.7::DOUBLE - 0.05::DOUBLE) / 39) AS threshold FROM range(40) r(i)),
sc AS (SELECT user_id, idx, prob * fac AS prob, horizon, first, last FROM fr, hz WHERE label = 3 AND (last - first + 1) / 12.5 >= 0.4),
tm AS (SELECT user_id, first AS run_start, last AS run_end, horizon, th_idx,
   coalesce(max(CASE WHEN last - idx < horizon AND prob > threshold THEN last - idx + 1 END), 0) AS lead,
   list_reduce(list_prepend(0::BIGINT, coalesce(list(idx ORDER BY idx) FILTER (last - idx >= horizon AND prob > threshold), [])),
     lambda a, x: CASE WHEN x >= a // 1000000 THEN (x + horizon) * 1000000 + a % 1000000 + 1 ELSE a END) % 1000000 AS early
   FROM sc, th GROUP BY 1, 2, 3, 4, 5),
ts AS (SELECT *, CASE WHEN run_end - run_start + 1 > horizon THEN early / ceil((run_end - run_start + 1 - horizon) / horizon::DOUBLE) ELSE 0 END::DOUBLE AS early_share FROM tm)
"""


def per_turn(t: Tables, piece: int = FR.PIECE):
    return FR.turn_metrics(FR.turn_scores(scores(t), frames(t), KEYS, FREQ, 0.4), KEYS, GRID, piece)


@query("w12_lead_times", f"WITH {TM} SELECT user_id, run_start, horizon, th_idx, lead FROM ts")
def _(t):
    return per_turn(t).select("user_id", "run_start", "horizon", "th_idx", "lead")


@query("w13_early_triggers", f"WITH {TM} SELECT user_id, run_start, horizon, th_idx, CAST(early AS BIGINT) AS early, early > 0 AS early_any, round(early_share, 6) AS early_share FROM ts")
def _(t):
    return per_turn(t, piece=8).select("user_id", "run_start", "horizon", "th_idx", "early", (F.col("early") > 0).alias("early_any"), F.round("early_share", 6).alias("early_share"))


MET = TM + """,
met AS (SELECT th_idx, horizon, count(*) AS turns, round(avg((early > 0)::INT) * 100, 6) AS premature_pct, round(avg(early), 4) AS early_mean, round(avg(early_share), 4) AS early_share_mean,
  round(avg((lead >= horizon - 1)::INT), 2) AS entry_accuracy, quantile_cont(early, 0.5)::DOUBLE AS early_median,
  round(quantile_cont(round(lead / 12.5::DOUBLE, 4), 0.5) * 1000) AS lead_median_ms FROM ts GROUP BY 1, 2)
"""


def metrics(t: Tables):
    return FR.forecast_metrics(per_turn(t), FREQ).withColumn("premature_pct", F.round("premature_pct", 6))


@query("a14_forecast_metrics", f"WITH {MET} SELECT * FROM met")
def _(t):
    return metrics(t)


@query("a16_operating_point", f"""WITH {MET} SELECT horizon, arg_min(th_idx, CASE WHEN entry_accuracy > 0.3 THEN round((entry_accuracy - 0.3) * 1000) ELSE 1000000 END + th_idx / 1000) AS th_idx FROM met GROUP BY 1""")
def _(t):
    return FR.operating_point(metrics(t).select("horizon", "th_idx", "entry_accuracy"), ["horizon"], "entry_accuracy", 0.3, "th_idx").select("horizon", "th_idx")


@query("u3_common_keys", f"WITH {MET} SELECT th_idx FROM met WHERE premature_pct > 5 INTERSECT SELECT th_idx FROM met WHERE lead_median_ms > 0 INTERSECT SELECT th_idx FROM met WHERE entry_accuracy > 0.2")
def _(t):
    m = staged(metrics(t))
    return FR.common_keys(m.filter("premature_pct > 5").select("th_idx"), m.filter("lead_median_ms > 0").select("th_idx"), m.filter("entry_accuracy > 0.2").select("th_idx"))


@query("w16_collapse_equal_neighbours", f"""WITH {MET}, ch AS (SELECT *, CASE WHEN lag(lead_median_ms) OVER w IS DISTINCT FROM lead_median_ms OR lag(early_median) OVER w IS DISTINCT FROM early_median THEN th_idx END AS k
  FROM met WINDOW w AS (PARTITION BY horizon ORDER BY th_idx))
SELECT horizon, th_idx, CASE WHEN k IS NULL THEN last_value(k IGNORE NULLS) OVER (PARTITION BY horizon ORDER BY th_idx) END AS alias FROM ch""")
def _(t):
    c = FR.collapse_equal_neighbours(staged(metrics(t)), ["horizon"], "th_idx", ["lead_median_ms", "early_median"])
    return c.select("horizon", "th_idx", "alias")


LAT = RUNS + """,
th AS (SELECT i AS th_idx, 0.05::DOUBLE + i * ((0.7::DOUBLE - 0.05::DOUBLE) / 39) AS threshold FROM range(40) r(i)),
en AS (SELECT user_id, first AS end_idx, CASE WHEN pl = 3 THEN pf ELSE first END AS a, CASE WHEN nl IS NULL THEN 6 ELSE least(6, last - first + 1) END AS bound FROM rr WHERE label = 1),
lat AS (SELECT e.user_id, e.end_idx, th_idx, coalesce(min(f.idx) FILTER (f.prob > threshold) - e.end_idx, any_value(bound)) AS latency
  FROM en e JOIN frames f ON f.user_id = e.user_id AND f.idx >= e.a AND f.idx < e.end_idx + bound, th GROUP BY 1, 2, 3)
"""


@query("w14_endpoint_latency", f"WITH {LAT} SELECT * FROM lat")
def _(t):
    return FR.endpoint_latency(frames(t), KEYS, GRID, 6)


@query("a15_endpoint_metrics", f"""WITH {LAT} SELECT th_idx, round(avg((latency < 0)::INT) * 100, 6) AS cutoff_pct,
round(quantile_cont(latency, 0.5) FILTER (latency >= 0) * 80, 6) AS positive_median_ms, round(quantile_cont(latency, 0.9) FILTER (latency >= 0) * 80, 6) AS positive_p90_ms,
round(quantile_cont(latency, 0.5) * 80, 6) AS all_median_ms, round(quantile_cont(latency, 0.9) * 80, 6) AS all_p90_ms FROM lat GROUP BY 1""")
def _(t):
    m = FR.endpoint_metrics(FR.endpoint_latency(frames(t), KEYS, GRID, 6), FREQ)
    return m.select("th_idx", *[F.round(c, 6).alias(c) for c in m.columns if c != "th_idx"])


@query("w15_crossings", f"""WITH {VW.FRAMES} SELECT user_id, idx FROM frames QUALIFY lag(prob) OVER (PARTITION BY user_id ORDER BY idx) < 0.6 AND prob >= 0.6""")
def _(t):
    return FR.crossings(frames(t), KEYS, ["idx"], S.by_index("idx"), "prob", 0.6).select("user_id", "idx")


CM = f"WITH {VW.FRAMES}, gp AS (SELECT label AS gold, CASE WHEN prob < 0.1 THEN 1 WHEN prob < 0.2 THEN 2 ELSE 3 END AS pred FROM frames)"


def gold_pred(t: Tables):
    return frames(t).select(F.col("label").alias("gold"), F.when(F.col("prob") < 0.1, 1).when(F.col("prob") < 0.2, 2).otherwise(3).alias("pred"))


@query("a17_confusion_matrix", f"""{CM}, c AS (SELECT gold, pred, count(*) AS n FROM gp GROUP BY 1, 2)
SELECT gold, pred, n, round(sum(CASE WHEN gold = pred THEN n ELSE 0 END) OVER (PARTITION BY gold) / (sum(n) OVER (PARTITION BY gold))::DOUBLE, 6) AS recall,
round(sum(CASE WHEN gold = pred THEN n ELSE 0 END) OVER () / (sum(n) OVER ())::DOUBLE, 6) AS accuracy FROM c""")
def _(t):
    m = FR.confusion_matrix(gold_pred(t), "gold", "pred", [0, 1, 2, 3])
    return m.withColumn("recall", F.round("recall", 6)).withColumn("accuracy", F.round("accuracy", 6))


@query("a17_mean_recall", f"""{CM} SELECT round(avg(r), 6) AS mean_recall FROM (SELECT gold, round(avg((gold = pred)::INT) * 100, 2) AS r FROM gp WHERE gold IN (1, 3) GROUP BY 1)""")
def _(t):
    m = FR.class_mean_recall(FR.confusion_matrix(gold_pred(t), "gold", "pred", [0, 1, 2, 3]), [1, 3])
    return m.select(F.round("mean_recall", 6).alias("mean_recall"))


@query("a18_horizon_accuracy", f"""WITH {RUNS}, a AS (SELECT horizon, avg(((prob > 0.5) = (target = 1))::INT) AS accuracy FROM tg WHERE label <> 2 GROUP BY 1)
SELECT horizon, round(accuracy, 6) AS accuracy FROM a UNION ALL SELECT -1, round(avg(accuracy), 6) FROM a""")
def _(t):
    df = FR.mask_labels(targets(t), frames(t), KEYS)
    return FR.horizon_accuracy(df).select("horizon", F.round("accuracy", 6).alias("accuracy"))


@query("a19_weighted_logloss", f"""WITH {RAMP} SELECT round(avg(weight * -(target * CASE WHEN prob <= 0 THEN -100 ELSE greatest(ln(prob), -100) END
  + (1 - target) * CASE WHEN prob >= 1 THEN -100 ELSE greatest(ln(1 - prob), -100) END)), 6) AS loss, count(*) AS frames FROM wt WHERE near""")
def _(t):
    df = FR.near_positive_mask(FR.ramp_weights(targets(t), KEYS, 2.0, 1.0), KEYS, 5).filter("near")
    return FR.weighted_logloss(df, F.col("weight")).select(F.round("loss", 6).alias("loss"), "frames")


@query("a19_constant_weights", f"""WITH {RUNS} SELECT round(avg(CASE WHEN target = 1 THEN 2 ELSE 0.5 END * -(target * CASE WHEN prob <= 0 THEN -100 ELSE greatest(ln(prob), -100) END
  + (1 - target) * CASE WHEN prob >= 1 THEN -100 ELSE greatest(ln(1 - prob), -100) END)), 6) AS loss, count(*) AS frames FROM tg""")
def _(t):
    return FR.weighted_logloss(targets(t), F.when(F.col("target") == 1, 2.0).otherwise(0.5)).select(F.round("loss", 6).alias("loss"), "frames")


def scored_conversations(t: Tables):
    fr = U.frames_from_turns(U.fill_gaps(timeline(t), ["conv_id"]), ["conv_id"], FREQ)
    return fr.withColumn("prob", ((F.col("idx") * 37 + F.col("conv_id")) % 1000) / 1000)


HIT = TURN_FRAMES + """,
cf AS (SELECT conv_id, unnest(range(a, b)) AS idx FROM bd WHERE b > a),
hf AS (SELECT conv_id, idx FROM cf WHERE ((idx * 37 + conv_id) % 1000) / 1000.0 >= 0.97),
sg AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 'Pause A' ELSE 'Turn B' END AS folder, conv_id, seg, CAST(floor(start_ms / 1000.0::DOUBLE * 12.5) AS BIGINT) AS a, CAST(floor(end_ms / 1000.0::DOUBLE * 12.5) AS BIGINT) AS b,
   seg = max(seg) OVER (PARTITION BY conv_id) AS is_last FROM tl),
wh AS (SELECT folder, s.conv_id, seg, collar_s, coalesce(bool_or(idx >= a + 5 AND idx < b), false) AS early, coalesce(bool_or(idx >= b AND idx < b + CAST(floor(collar_s * 12.5) AS BIGINT)), false) AS late
  FROM sg s CROSS JOIN (VALUES (0.4::DOUBLE), (2.0::DOUBLE)) c(collar_s) LEFT JOIN hf ON hf.conv_id = s.conv_id AND idx >= a AND idx < b + 25
  WHERE folder LIKE '%Pause%' OR NOT is_last GROUP BY 1, 2, 3, 4)
"""


def segment_hits(t: Tables):
    seg = timeline(t).withColumn("folder", F.when(F.col("conv_id") % 3 == 0, "Pause A").otherwise("Turn B"))
    return FR.window_hits(seg, scored_conversations(t), "conv_id", FREQ, 0.97, [0.4, 2.0])


@query("j12_window_hits", f"WITH {HIT} SELECT folder, conv_id, seg, collar_s, early, late FROM wh")
def _(t):
    return segment_hits(t)


@query("a20_pause_handling", f"""WITH {HIT} SELECT coalesce(folder, 'overall') AS folder, collar_s, count(*) AS segments, round(1 - avg(early::INT), 6) AS pause_accuracy, round(avg(late::INT), 6) AS late_rate
FROM wh GROUP BY GROUPING SETS ((collar_s), (folder, collar_s))""")
def _(t):
    return FR.pause_handling(segment_hits(t)).select("folder", "collar_s", "segments", F.round("pause_accuracy", 6).alias("pause_accuracy"), F.round("late_rate", 6).alias("late_rate"))


@query("p9_trigger_policy", f"""WITH e AS (SELECT event_id, value, event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)) / 3600000000.0 AS gap FROM events)
SELECT event_id, value >= 50 AND coalesce(gap >= 6, true) AND event_type = 'click' AS triggered,
 array_to_string(list_filter([CASE WHEN value < 50 THEN 'below_threshold' END, CASE WHEN gap < 6 THEN 'cooldown' END, CASE WHEN event_type <> 'click' THEN 'blocked_by_conversation_state' END], lambda x: x IS NOT NULL), ',') AS reasons FROM e""")
def _(t):
    e = VW.events(t)
    e = S.scan(e, KEYS, ["ts_us", "event_id"], S.by_micros("ts_us"), [S.Lag("_ts", F.col("ts_us"))])
    state = F.when(F.col("event_type") == "click", "user_speaking").otherwise("bot_speaking")
    p = FR.trigger_policy(e, F.col("value") / 100, (F.col("ts_us") - F.col("_ts")) / 3600000000, state, 0.5, 6.0)
    return p.select("event_id", "triggered", F.array_join("drop_reasons", ",").alias("reasons"))
