"""Timing traces and event logs: matching in time, latencies, distributions, signal blocks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.functions import text as T
from convlake.operators.frames import with_runs
from convlake.plans import slices as S
from convlake.plans.quantiles import exact_quantiles

# --- matching in time -------------------------------------------------------------------------------


def _time_line(a: DataFrame, b: DataFrame, keys: Sequence[str], ts: str, id: str) -> DataFrame:
    """Rows of both sides on one line; at equal times ``b`` comes first, and only its least id."""
    left = a.select(*keys, ts, F.lit(1).alias("_side"), F.struct(*a.columns).alias("_a"), F.lit(None).cast(b.schema["id"].dataType).alias("_bid"), F.col(id).alias("_ord"))
    right = b.groupBy(*keys, ts).agg(F.min("id").alias("_bid"))
    right = right.select(*keys, ts, F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_a"].dataType).alias("_a"), "_bid", F.lit(None).cast(a.schema[id].dataType).alias("_ord"))
    return left.unionByName(right)


def nearest_in_time(a: DataFrame, b: DataFrame, keys: Sequence[str], ts: str, id: str, tolerance: float, slice_expr: Column) -> DataFrame:
    """For each row of ``a`` the row of ``b`` (keys, ts, id) nearest in time within ``tolerance``.

    The earlier row wins a tie; each ``b`` row keeps its first ``a`` (smallest ``id`` column). The
    neighbours on both sides come from one ordered scan, so no pairs are formed.
    """
    at = F.when(F.col("_side") == 0, F.struct(F.col(ts).alias("t"), F.col("_bid").alias("id")))
    line = S.scan(_time_line(a, b, keys, ts, id), keys, [ts, "_side", "_ord"], slice_expr, [S.LastValid("_p", at), S.NextValid("_n", at)])
    near = line.filter(F.col("_side") == 1)
    dp, dn = F.col(ts) - F.col("_p.t"), F.col("_n.t") - F.col(ts)
    pick = F.when(dn.isNull() | (dp <= dn), F.struct(dp.alias("d"), F.col("_p.id").alias("id"))).otherwise(F.struct(dn.alias("d"), F.col("_n.id").alias("id")))
    near = near.select(*keys, "_a", pick.alias("m")).filter(F.col("m.d") <= tolerance)
    first = near.groupBy(*keys, F.col("m.id").alias("matched_id")).agg(F.min_by(F.struct("_a", F.col("m.d").alias("d")), f"_a.{id}").alias("r"))
    return first.select(*[F.col(f"r._a.{c}").alias(c) for c in a.columns], "matched_id", F.col("r.d").alias("distance"))


def asof_backward(a: DataFrame, b: DataFrame, keys: Sequence[str], ts: str, id: str, tolerance: float, slice_expr: Column) -> DataFrame:
    """For each row of ``a`` the time of the latest ``b`` at or before it, if nearer than ``tolerance``."""
    at = F.when(F.col("_side") == 0, F.col(ts))
    line = S.scan(_time_line(a, b, keys, ts, id), keys, [ts, "_side", "_ord"], slice_expr, [S.LastValid("_p", at)])
    hit = F.when(F.col(ts) - F.col("_p") < tolerance, F.col("_p"))
    return line.filter(F.col("_side") == 1).select("_a.*", hit.alias("asof_ts"))


def commit_details(attempts: DataFrame, pauses: DataFrame, keys: Sequence[str], slice_expr: Column, tolerance: float = 2.5) -> DataFrame:
    """Drain times of committed attempts against the pause that confirmed them.

    The attempt's own pause counts, else the latest one less than ``tolerance`` before its drain.
    ``attempts``: keys, id, ts (drain start), status, own_pause, drain_end; ``pauses``: keys, ts, id.
    """
    rows = attempts.filter((F.col("status") == "committed") & F.col("ts").isNotNull())
    near = asof_backward(rows, pauses, keys, "ts", "id", tolerance, slice_expr)
    pause = F.coalesce("own_pause", "asof_ts")
    return near.select(*keys, "id", pause.alias("pause"), (F.col("ts") - pause).alias("drain_after_pause"), (F.col("drain_end") - F.col("ts")).alias("drain_duration"))


def fifo_match(events: DataFrame, keys: Sequence[str], order: Sequence[str], slice_expr: Column) -> DataFrame:
    """k-th ready item with the k-th delivery of the same reset epoch.

    ``events``: keys, order, ``kind`` in (ready, delivered, reset), ``id``. A reset empties the
    queue, so items and deliveries count from zero after it.
    """
    df = S.scan(events, keys, order, slice_expr, [S.RunSum("epoch", (F.col("kind") == "reset").cast("long"))])
    df = df.filter(F.col("kind") != "reset")
    df = S.row_index(df, [*keys, "epoch", "kind"], order, slice_expr, "nth")
    ready = df.filter("kind = 'ready'").select(*keys, "epoch", "nth", F.col("id").alias("ready_id"))
    done = df.filter("kind = 'delivered'").select(*keys, "epoch", "nth", F.col("id").alias("delivered_id"))
    return ready.join(done, [*keys, "epoch", "nth"])


def drain_steps(items: DataFrame, keys: Sequence[str], order: str, step: int) -> DataFrame:
    """Play a queue of sample blocks, one ``step`` of samples per time step.

    ``items``: keys, order (dense), arrival (step index), n_samples (a multiple of ``step``).
    A longer block is split and its tail stays first in line. Piece ``k`` plays at the running
    maximum of (arrival - k) plus k.
    """
    df = items.withColumn("_n", (F.col("n_samples") / step).cast("long"))
    df = S.scan(df, keys, [order], S.by_index(order), [S.RunSum("_before", F.col("_n"), inclusive=False)])
    df = S.scan(df, keys, [order], S.by_index(order), [S.RunMax("_lag", F.col("arrival") - F.col("_before"))])
    df = df.filter("_n > 0").select(*keys, order, "_before", "_lag", F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("piece", "_x"))
    return df.select(*keys, order, "piece", (F.col("_lag") + F.col("_before") + F.col("piece")).alias("step"))


def compare_runs(base: DataFrame, spec: DataFrame, key: str, value: str, prefix: str | None = None) -> DataFrame:
    """Items of both runs with the difference; it is null if one value is missing."""
    b = base.select(key, F.col(value).alias("base"))
    s = spec.select(key, F.col(value).alias("spec"))
    if prefix:
        b = b.filter(F.col(key).startswith(prefix))
    return b.join(s, key).withColumn("delta", F.col("spec") - F.col("base"))


def run_comparison(pairs: DataFrame) -> DataFrame:
    """Mean, median and sample standard deviation of both runs and of their differences."""
    long = pairs.select(F.explode(F.array(*[F.struct(F.lit(n).alias("series"), F.col(n).alias("v")) for n in ("base", "spec", "delta")])).alias("r")).select("r.*")
    stats = {"n": F.count("v"), "mean": F.avg("v"), "stdev": F.coalesce(F.stddev_samp("v"), F.lit(0.0))}
    return exact_quantiles(long, ["series"], "v", {"median": 0.5}, stats)


def latest_call(generations: DataFrame, calls: DataFrame, keys: Sequence[str], order: str, stage: str) -> DataFrame:
    """Left join each generation to its last call of one stage."""
    rest = [c for c in calls.columns if c not in (*keys, "stage")]
    last = calls.filter(F.col("stage") == stage).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("call"))
    return generations.join(last, list(keys), "left")


# --- latencies ------------------------------------------------------------------------------------------


def latency_distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, median, p90 and p95 (interpolated) per metric; count 0 and nulls without values."""
    return exact_quantiles(df, keys, value, {"median": 0.5, "p90": 0.9, "p95": 0.95}, stats={"count": F.count(value), "mean": F.avg(value)})


def approximate_distribution(df: DataFrame, keys: Sequence[str], value: str, accuracy: int = 10000) -> DataFrame:
    """One-pass sketch variant of ``latency_distribution`` (rank error 1/accuracy)."""
    q = F.percentile_approx(value, [0.5, 0.9, 0.95], accuracy)
    out = df.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), q.alias("_q"))
    return out.select(*keys, "count", "mean", *[F.col("_q")[i].alias(n) for i, n in enumerate(("median", "p90", "p95"))])


def response_latency(items: DataFrame, words: DataFrame, clamp: bool = True, min_s: float = 1.0, min_words: int = 3) -> DataFrame:
    """Per item: was the turn taken, and how long after the input end.

    ``items``: item, input_end_s, attempts; ``words``: item, start_s, end_s. A reply of at most
    ``min_words`` words within ``min_s`` does not take the turn. ``clamp`` raises negative
    latencies to 0.
    """
    after = words.join(items.select("item", "input_end_s"), "item").filter(F.col("start_s") >= F.col("input_end_s"))
    reply = after.groupBy("item").agg(F.min("start_s").alias("first"), F.max_by("end_s", F.struct("start_s", "end_s")).alias("last"), F.count(F.lit(1)).alias("n"))
    df = items.join(reply, "item", "left")
    taken = F.col("n").isNotNull() & ~((F.col("last") - F.col("first") < min_s) & (F.col("n") <= min_words))
    lat = F.round(F.col("first") - F.col("input_end_s"), 3)
    lat = F.greatest(lat, F.lit(0.0)) if clamp else lat
    return df.select("item", taken.cast("int").alias("turn_taken"), F.when(taken, lat).alias("latency"), "attempts")


def latency_report(per_item: DataFrame) -> DataFrame:
    """Averages rounded to milliseconds, also split by whether anything was speculated."""
    lat = F.col("latency")
    return per_item.agg(
        F.count(F.lit(1)).alias("items"), F.round(F.avg("turn_taken"), 3).alias("turn_taken_rate"), F.round(F.avg(lat), 3).alias("latency"),
        F.count_if(F.col("attempts") > 0).alias("with_speculation"), F.count_if(F.col("attempts") == 0).alias("without_speculation"),
        F.round(F.avg(F.when(F.col("attempts") > 0, lat)), 3).alias("latency_with"), F.round(F.avg(F.when(F.col("attempts") == 0, lat)), 3).alias("latency_without"),
    )


STAGES = [
    "vad_pause_detected_sec", "llm_generation_started_sec", "llm_first_token_sec", "tts_generation_started_sec",
    "tts_first_token_received_sec", "tts_first_audio_chunk_received_sec",
]


def stage_latencies(generations: DataFrame, items: DataFrame, order: str = "pos") -> DataFrame:
    """Average time from the input end to each stage of an item's first completed generation.

    Items whose pause was detected before the input end do not count.
    """
    first = generations.filter("status = 'completed'").groupBy("item").agg(F.min_by(F.struct(*STAGES), order).alias("g"))
    df = first.join(items.select("item", "input_end_s"), "item")
    since = {s: F.round(F.col(f"g.{s}") - F.col("input_end_s"), 3) for s in STAGES}
    df = df.filter(since[STAGES[0]] > 0)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), c.alias("v")) for s, c in since.items()])).alias("r")).select("r.*")
    return long.filter("v IS NOT NULL").groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 3).alias("latency"))


def attempt_breakdown(attempts: DataFrame) -> DataFrame:
    """Attempts per item by outcome; cancelled ones with audio were saved as fallback or wasted."""
    lost = (F.col("status") == "cancelled") & (F.coalesce("buffered_audio_chunks", F.lit(0)) > 0)
    saved = F.coalesce(F.col("status_reason") == "graceful_supersede_fallback_saved", F.lit(False))
    return attempts.groupBy("item").agg(
        F.count(F.lit(1)).alias("attempts"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("committed", "cancelled", "discarded", "buffered")],
        F.count_if(lost & ~saved).alias("wasted"), F.count_if(lost & saved).alias("saved_as_fallback"),
        F.coalesce(F.bool_or((F.col("status") == "committed") & (F.col("status_reason") == "vad_confirmed_from_fallback")), F.lit(False)).alias("fallback_used"),
    )


# --- message timings --------------------------------------------------------------------------------------


def validate_timing(messages: DataFrame) -> DataFrame:
    """``valid``: users start before their text and end, replies are created before they sound."""
    user = (F.col("audio_start") < F.col("text_start")) & (F.col("audio_start") < F.col("audio_end"))
    reply = (F.col("response_created") < F.col("audio_start")) & (F.col("audio_start") < F.col("audio_end"))
    return messages.withColumn("valid", F.coalesce(F.when(F.col("role") == "user", user).otherwise(reply), F.lit(False)))


def message_gaps(messages: DataFrame, key: str = "conv_id", order: str = "i") -> DataFrame:
    """Latencies of each message: speech-to-text for users; pause, model, voice start and real-time
    factor for replies."""
    df = S.scan(messages, [key], [order], S.by_index(order), [S.Lag("_end", F.col("audio_end"))])
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    return df.select(
        key, order, "role", F.when(user, F.col("text_start") - F.col("audio_start")).alias("stt"),
        F.when(reply, F.col("response_created") - F.col("_end")).alias("vad"), F.when(reply, F.col("text_start") - F.col("response_created")).alias("llm"),
        F.when(reply, F.col("audio_start") - F.col("text_start")).alias("tts_start"),
        F.when(reply, F.col("received_audio_length") / (F.col("audio_end") - F.col("audio_start"))).alias("tts_realtime_factor"),
    )


def combine_reports(*reports: DataFrame) -> DataFrame:
    """One row of means over the message rows of all reports."""
    rows = reports[0]
    for r in reports[1:]:
        rows = rows.unionByName(r)
    return rows.agg(*[F.avg(c).alias(c) for c in ("stt", "vad", "llm", "tts_start", "tts_realtime_factor")])


def ok_fraction(runs: DataFrame, ok: Column) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.avg(ok.cast("double")).alias("ok_fraction"))


# --- event logs ---------------------------------------------------------------------------------------------


def phase_timestamps(events: DataFrame, key: str, order: Sequence[str], slice_expr: Column, ts: str, opener: str, phases: dict[str, str], closers: dict[str, str], exempt: Sequence[str] = ()) -> DataFrame:
    """Event log to one row per response.

    An ``opener`` event starts a response; each phase takes the time of its first event; the last
    closing event gives the status. ``ordered`` tells whether no phase starts before an earlier
    one (exempt phases do not count).
    """
    df = S.scan(events, [key], order, slice_expr, [S.RunSum("response", (F.col("type") == opener).cast("long"))])
    at = F.struct(*order)
    df = df.filter("response > 0").groupBy(key, "response").agg(
        F.min(F.when(F.col("type") == opener, F.col(ts))).alias("pause"),
        *[F.min(F.when(F.col("type") == typ, F.col(ts))).alias(name) for name, typ in phases.items()],
        F.max_by("type", F.when(F.col("type").isin(*closers), at)).alias("_closer"),
    )
    status = F.lit("started")
    for typ, name in closers.items():
        status = F.when(F.col("_closer") == typ, name).otherwise(status)
    ordered, seen = F.lit(True), [F.col("pause")]
    for name in phases:
        if name in exempt:
            continue
        for earlier in seen:
            ordered = ordered & (F.col(name).isNull() | (earlier.isNotNull() & (earlier <= F.col(name))))
        seen.append(F.col(name))
    return df.select(key, "response", "pause", *phases, status.alias("status"), ordered.alias("ordered"))


def fixed_histogram(df: DataFrame, keys: Sequence[str], value: str, edges: Sequence[float]) -> DataFrame:
    """Cumulative bucket counts (rows with value <= edge), with count and sum, in long form."""
    v = F.col(value)
    agg = df.groupBy(*keys).agg(
        F.count(v).alias("count"), F.sum(v).alias("sum"),
        F.array(*[F.struct(F.lit(float(e)).alias("le"), F.count_if(v <= e).alias("bucket")) for e in edges]).alias("_b"),
    )
    return agg.select(*keys, "count", "sum", F.explode("_b").alias("b")).select(*keys, "count", "sum", "b.*")


def field_coverage(df: DataFrame, id: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(total and present per field, one row per missing field and id)."""
    flags = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().alias("present")) for f in fields])
    long = df.select(id, F.explode(flags).alias("r")).select(id, "r.*")
    totals = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(f).alias(f"_{i}") for i, f in enumerate(fields)])
    counts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{i}").alias("present")) for i, f in enumerate(fields)])
    return totals.select("total", F.explode(counts).alias("r")).select("r.field", "total", "r.present"), long.filter(~F.col("present")).select("field", id)


def multiset_coverage(docs: DataFrame, doc: str, source: str, clean: str) -> DataFrame:
    """Share of source text units found in the cleaned document.

    A unit counts fully when the clean side holds it as often; a unit found inside the clean text
    counts once. Both sides are in one row, so nothing is shuffled. Without source units: 1.
    """
    def units(side: int, c: str) -> Column:
        return F.transform(T.text_units(F.col(c)), lambda u: F.struct(u.alias("unit"), F.lit(side).alias("side")))

    rows = docs.select(doc, F.array_sort(F.concat(units(0, source), units(1, clean))).alias("_units"), F.array_join(T.text_units(F.col(clean)), "\n").alias("_blob"))
    # equal neighbours become runs; a unit's clean run stands right behind its source run
    first = F.filter(F.sequence(F.lit(1), F.size("_units")), lambda i: (i == 1) | (F.get("_units", i - 1) != F.get("_units", i - 2)))
    rows = rows.withColumn("_first", F.when(F.size("_units") > 0, first).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("_last", F.concat("_first", F.array(F.size("_units") + 1)))
    rows = rows.withColumn("_runs", F.transform("_first", lambda i, k: F.struct(F.get("_units", i - 1).alias("item"), (F.get("_last", k + 1) - i).cast("long").alias("n"))))

    def counted(r: Column, k: Column) -> Column:
        after = F.get("_runs", k + 1)
        m = F.when(after["item"]["unit"] == r["item"]["unit"], after["n"]).otherwise(F.lit(0))
        return F.struct(r["item"]["unit"].alias("unit"), r["item"]["side"].alias("side"), r["n"].alias("n"), m.alias("m"))

    state = F.struct(F.lit(0).cast("long").alias("matched"), F.lit(0).cast("long").alias("total"))

    def add(have: Column, unit: Column) -> Column:
        n = unit["n"]
        hit = F.when(unit["m"] >= n, n).otherwise(F.col("_blob").contains(unit["unit"]).cast("long"))
        return F.struct((have["matched"] + hit).alias("matched"), (have["total"] + n).alias("total"))

    rows = rows.withColumn("_counted", F.filter(F.transform("_runs", counted), lambda u: u["side"] == 0))
    out = rows.select(doc, F.aggregate("_counted", state, add).alias("s")).select(doc, "s.total", "s.matched")
    return out.withColumn("coverage", F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(1.0))


def inverted_lists(df: DataFrame, value: str, holder: str) -> DataFrame:
    """Holders of each value in order, one row per holder with its place in the list.

    Long form, since a popular value may have any number of holders.
    """
    at = F.floor(F.col(holder) / S.ROWS_PER_SLICE).cast("long")
    return S.row_index(df.select(value, holder).distinct(), [value], [holder], at, "place")


# --- signal blocks -----------------------------------------------------------------------------------------


def rms_blocks(samples: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    block = F.floor(F.col("i") / n).cast("long")
    return samples.groupBy(*keys, block.alias("block")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.count(F.lit(1)).alias("n"))


def first_onset(samples: DataFrame, keys: Sequence[str], n: int, threshold: float, start: int = 0) -> DataFrame:
    """Index of the first full block of ``n`` samples from ``start`` that is louder than the threshold."""
    shifted = samples.filter(F.col("i") >= start).withColumn("i", F.col("i") - start)
    loud = rms_blocks(shifted, keys, n).filter((F.col("n") == n) & (F.col("rms") > threshold))
    return loud.groupBy(*keys).agg((F.min("block") * n + start).alias("onset"))


def trim_trailing_quiet(samples: DataFrame, keys: Sequence[str], window: int, pad: int, db: float = -24.0) -> DataFrame:
    """Length to keep: the last loud window plus a pad; loudness is relative to the peak.

    A window is the ``window`` samples from an index on; its samples in the next slice are
    copied, so the moving mean needs one shuffle and no join.
    """
    rows = max(S.ROWS_PER_SLICE, window)
    own, i = F.floor(F.col("i") / rows).cast("long"), F.pmod(F.col("i"), F.lit(rows))
    df = samples.withColumn("_own", own).withColumn(S.SLICE, F.explode(F.array_compact(F.array(own, F.when((i < window - 1) & (own > 0), own - 1)))))
    w = S.Window.partitionBy(*keys, S.SLICE).orderBy("i").rowsBetween(0, window - 1)
    df = df.select(*keys, "i", "_own", F.col(S.SLICE), F.sum(F.col("x") * F.col("x")).over(w).alias("_s"), F.count(F.lit(1)).over(w).alias("_n"))
    loud = df.filter((F.col("_own") == F.col(S.SLICE)) & (F.col("_n") == window))
    peaks = samples.groupBy(*keys).agg(F.max(F.abs("x")).alias("_peak"), F.count(F.lit(1)).alias("length"))
    limit = F.col("_peak") * math.pow(10, db / 20)
    last = loud.join(peaks, list(keys)).filter(F.sqrt(F.col("_s") / window) > limit).groupBy(*keys).agg(F.max("i").alias("_last"))
    out = peaks.join(last, list(keys), "left")
    keep = F.when(F.col("_peak") == 0, F.col("length")).otherwise(F.least(F.col("_last") + window + pad, F.col("length")))
    return out.select(*keys, "length", keep.alias("keep"))


def trim_quiet_run(chunks: DataFrame, keys: Sequence[str], min_run: int, min_emitted_s: float, rms_limit: float) -> DataFrame:
    """Mark chunks to drop: quiet runs of at least ``min_run`` once enough was emitted.

    Nothing is dropped before ``min_emitted_s``, so the emitted time until then is the running
    sum of all durations. ``chunks``: keys, idx (dense), rms, dur_s.
    """
    df = S.scan(chunks, keys, ["idx"], S.by_index("idx"), [S.RunSum("_before", F.col("dur_s"), inclusive=False)])
    df = df.withColumn("quiet", (F.col("rms") <= rms_limit) & (F.col("_before") >= min_emitted_s)).drop("_before")
    runs = with_runs(df, keys, "quiet")
    drop = F.col("quiet") & (F.col("run_end") - F.col("run_start") + 1 >= min_run)
    return runs.withColumn("dropped", drop).select(*chunks.columns, "dropped")


def rebase(df: DataFrame, keys: Sequence[str], times: Sequence[str], anchor: Column, pad: float = 0.0) -> DataFrame:
    """Cut each recording at its first anchor row less ``pad`` and shift all times to start there."""
    start = df.filter(anchor).groupBy(*keys).agg((F.min(times[0]) - pad).alias("_start"))
    out = df.join(start, list(keys)).filter(F.col(times[0]) >= F.col("_start"))
    for c in times:
        out = out.withColumn(c, F.col(c) - F.col("_start"))
    return out.drop("_start")


def place_regions(chunks: DataFrame, keys: Sequence[str], order: Sequence[str], region_slice: Column, chunk_slice: Column) -> DataFrame:
    """Start time of every chunk when regions play one after the other.

    A region starts at its own first time or at the end of the one before, whichever is later:
    with ``cb`` the total length of earlier regions that is max(first - cb) so far, plus cb.
    ``chunks``: keys, region, order, first_ts, dur_s, wait_s (silence before the chunk).
    """
    keys = list(keys)
    length = F.col("dur_s") + F.col("wait_s")
    regions = chunks.groupBy(*keys, "region").agg(F.min("first_ts").alias("_first"), F.sum(length).alias("_len"))
    regions = S.scan(regions, keys, ["region"], region_slice, [S.RunSum("_cb", F.col("_len"), inclusive=False)])
    regions = S.scan(regions, keys, ["region"], region_slice, [S.RunMax("_lead", F.col("_first") - F.col("_cb"))])
    regions = regions.select(*keys, "region", (F.col("_lead") + F.col("_cb")).alias("region_start"))
    df = S.scan(chunks, [*keys, "region"], order, chunk_slice, [S.RunSum("_in", length)])
    df = df.join(regions, [*keys, "region"])
    return df.select(*keys, "region", *order, "region_start", (F.col("region_start") + F.col("_in") - F.col("dur_s")).alias("start_s"))
