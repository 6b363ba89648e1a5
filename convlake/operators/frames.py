"""Frame labels and scores: runs, forecast targets, cooldown, turn metrics over threshold grids.

Frames are long rows: key columns, a dense ``idx`` and values. Computations along ``idx`` run in
slices (plans.slices), so a stream of any length spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.plans import slices as S

SYSTEM_END_ID, USER_END_ID, SYSTEM_ID, USER_ID = 0, 1, 2, 3
PIECE = 4096
FOLD, LEVELS = 512, 2  # pieces composed at a time, and how often


def threshold_grid(lo: float = 0.05, hi: float = 0.7, n: int = 40) -> list[float]:
    """Evenly spaced thresholds, both ends included."""
    return [lo + i * ((hi - lo) / (n - 1)) for i in range(n)]


def horizon_frames(ms: int, freq: float) -> int:
    return int(ms * freq // 1000)


def with_runs(frames: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Add the run of each frame: ``run_start``, ``run_end``, ``prev_label``, ``next_label``.

    ``prev_start`` is the start of the run before, on the first frame of a run only.
    """
    c = F.struct(F.col(label).alias("l"))
    df = S.neighbours(frames, keys, "idx", [S.Lag("_prev", c), S.Lead("_next", c)])
    first = F.col("_prev").isNull() | ~F.col("_prev.l").eqNullSafe(F.col(label))
    last = F.col("_next").isNull() | ~F.col("_next.l").eqNullSafe(F.col(label))
    begin = F.when(first, F.struct(F.col("idx").alias("i"), F.col("_prev.l").alias("l")))
    end = F.when(last, F.struct(F.col("idx").alias("i"), F.col("_next.l").alias("l")))
    df = S.scan(
        df, keys, ["idx"], F.col(S.SLICE),
        [S.LastValid("_rs", begin), S.NextValid("_re", end), S.LastValid("prev_start", begin["i"], inclusive=False)],
    )
    return df.select(
        *frames.columns, F.col("_rs.i").alias("run_start"), F.col("_re.i").alias("run_end"),
        F.col("_rs.l").alias("prev_label"), F.col("_re.l").alias("next_label"), "prev_start",
    )


def label_runs(frames: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Run-length encoding: one row (label, first, last) per run, read off the first frames."""
    r = with_runs(frames, keys, label).filter(F.col("idx") == F.col("run_start"))
    return r.select(*keys, label, F.col("run_start").alias("first"), F.col("run_end").alias("last"))


def min_turn_filter(runs: DataFrame, freq: float, min_s: float) -> DataFrame:
    return runs.filter((F.col("last") - F.col("first") + 1) / freq >= min_s)


def forecast_labels(frames: DataFrame, keys: Sequence[str], horizons: Sequence[int], min_len: int = 1) -> DataFrame:
    """Targets (keys, idx, horizon, target): the last ``h`` user frames before a user end and the
    end frame itself are 1, if the turn has at least max(min_len, h) user frames."""
    df = with_runs(frames.select(*keys, "idx", "label"), keys)
    h = F.col("horizon")
    df = df.withColumn("horizon", F.explode(F.array(*[F.lit(x) for x in horizons])))
    need = F.greatest(h, F.lit(min_len))
    in_turn = (F.col("label") == USER_ID) & (F.col("next_label") == USER_END_ID) & (F.col("run_end") + 1 - F.col("idx") <= h) & (F.col("run_end") - F.col("run_start") + 1 >= need)
    at_end = (F.col("label") == USER_END_ID) & (F.col("prev_label") == USER_ID) & (F.col("idx") == F.col("run_start")) & (F.col("idx") - F.col("prev_start") >= need)
    return df.select(*keys, "idx", "horizon", F.coalesce(in_turn | at_end, F.lit(False)).cast("int").alias("target"))


def shift_labels(frames: DataFrame, keys: Sequence[str], n: int, coin: Column | None = None) -> DataFrame:
    """Delay labels by ``n`` frames, -1 first; with ``coin`` only where it is true for the stream.

    A dense index makes this an equi-join on the shifted index, which no long stream can skew.
    """
    moved = frames.select(*keys, (F.col("idx") + n).alias("idx"), F.col("label").alias("_moved"))
    df = frames.join(moved, [*keys, "idx"], "left")
    shifted = F.when(F.col("idx") < n, -1).otherwise(F.col("_moved"))
    if coin is not None:
        shifted = F.when(coin, shifted).otherwise(F.col("label"))
    return df.withColumn("label", shifted).drop("_moved")


def ramp_weights(targets: DataFrame, keys: Sequence[str], max_w: float, min_w: float, rest_w: float = 1.0) -> DataFrame:
    """Weight falling from max to min over the first ``horizon`` frames of each positive run.

    Later frames of a run weigh 0, frames outside runs ``rest_w``.
    """
    g = [*keys, "horizon"]
    df = S.neighbours(targets, g, "idx", [S.Lag("_y", F.col("target"), F.lit(0))])
    start = F.when((F.col("target") == 1) & (F.col("_y") != 1), F.col("idx"))
    df = S.scan(df, g, ["idx"], F.col(S.SLICE), [S.LastValid("_start", start)])
    pos, h = F.col("idx") - F.col("_start"), F.col("horizon")
    ramp = F.when(pos >= h, 0.0).otherwise(max_w - (max_w - min_w) * pos / F.greatest(h - 1, F.lit(1)))
    return df.withColumn("weight", F.when(F.col("target") == 1, ramp).otherwise(rest_w)).drop("_y", "_start")


def near_positive_mask(targets: DataFrame, keys: Sequence[str], w: int) -> DataFrame:
    """True for frames within ``w`` of a positive one."""
    hit = F.when(F.col("target") == 1, F.col("idx"))
    df = S.scan(targets, [*keys, "horizon"], ["idx"], S.by_index("idx"), [S.LastValid("_b", hit), S.NextValid("_a", hit)])
    near = F.coalesce(F.col("idx") - F.col("_b") <= w, F.lit(False)) | F.coalesce(F.col("_a") - F.col("idx") <= w, F.lit(False))
    return df.withColumn("near", near).drop("_a", "_b")


def mask_labels(targets: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Targets of the other party's frames become -1; ``other`` marks them."""
    tags = frames.select(*keys, "idx", F.coalesce(F.col("label").isin(SYSTEM_ID, SYSTEM_END_ID), F.lit(False)).alias("other"))
    df = targets.join(tags, [*keys, "idx"])
    return df.withColumn("target", F.when(F.col("other"), -1).otherwise(F.col("target")))


def _cooldown_fold(idxs: Column, start: Column, n: int) -> Column:
    """(next allowed idx, kept idxs) after walking sorted ``idxs`` from ``start``."""
    init = F.struct(start.cast("long").alias("nxt"), F.array().cast("array<bigint>").alias("kept"))
    return F.aggregate(
        idxs, init,
        lambda a, x: F.when(x >= a["nxt"], F.struct((x + n).alias("nxt"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a),
    )


def greedy_cooldown(triggers: DataFrame, keys: Sequence[str], n: int, piece: int = PIECE) -> DataFrame:
    """Keep the first trigger of a stream, skip the next ``n`` frames, and so on.

    The walk is sequential, but a piece of the stream meets the walk only through the number of
    frames still blocked at its start, less than ``n`` cases. Each piece computes its exit for
    every entry. Such tables compose, so FOLD pieces make one of a larger piece, and so on for LEVELS;
    the real entries then come down the tree, and the pieces fold independently. One row holds a
    piece, or FOLD tables of ``n`` numbers.
    """
    if piece < n:
        raise ValueError("a piece must cover the cooldown")
    keys = list(keys)
    # a struct is never null, so streams with null keys meet in plain joins
    cut = triggers.select(F.struct(*keys).alias("_k"), F.col("idx").cast("long").alias("idx"), S.by_index("idx", piece).alias("_p"))
    cut = cut.groupBy("_k", "_p").agg(F.sort_array(F.collect_list("idx")).alias("_ix"))
    begin = F.col("_p") * piece
    exits = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda e: F.greatest(_cooldown_fold(F.col("_ix"), begin + e, n)["nxt"] - (begin + piece), F.lit(0)),
    )
    entries = _entries(cut.select("_k", "_p", exits.alias("_x")), n, LEVELS)
    kept = cut.join(entries, ["_k", "_p"])
    return kept.select("_k.*", F.explode(_cooldown_fold(F.col("_ix"), begin + F.col("_e"), n)["kept"]).alias("idx"))


def _entries(table: DataFrame, n: int, levels: int) -> DataFrame:
    """(_k, _p, _e): the real entry of each piece, from the pieces' exits ``_x`` for all ``n`` entries.

    A piece that is missing lets nothing through.
    """
    fold = FOLD if levels else 1 << 62  # the last level has few pieces and takes them as one
    groups = table.groupBy("_k", F.floor(F.col("_p") / fold).cast("long").alias("_q")).agg(F.sort_array(F.collect_list(F.struct("_p", "_x"))).alias("_steps"))
    first = F.col("_q") * fold

    def walk(entry: Column) -> Column:
        init = F.struct((first - 1).alias("p"), entry.cast("long").alias("blocked"), F.array().cast("array<struct<_p:bigint,_e:bigint>>").alias("entries"))

        def step(a: Column, s: Column) -> Column:
            now = F.when(s["_p"] == a["p"] + 1, a["blocked"]).otherwise(F.lit(0).cast("long"))
            return F.struct(s["_p"].alias("p"), F.get(s["_x"], now.cast("int")).alias("blocked"), F.concat(a["entries"], F.array(F.struct(s["_p"].alias("_p"), now.alias("_e")))).alias("entries"))

        return F.aggregate("_steps", init, step)

    if levels:
        through = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda e: F.when(walk(e)["p"] == first + fold - 1, walk(e)["blocked"]).otherwise(F.lit(0).cast("long")))
        above = _entries(groups.select("_k", F.col("_q").alias("_p"), through.alias("_x")), n, levels - 1)
        groups = groups.join(above.withColumnsRenamed({"_p": "_q", "_e": "_in"}), ["_k", "_q"])
    else:
        groups = groups.withColumn("_in", F.lit(0).cast("long"))
    return groups.select("_k", F.explode(walk(F.col("_in"))["entries"]).alias("_r")).select("_k", "_r.*")


def turn_scores(scores: DataFrame, frames: DataFrame, keys: Sequence[str], freq: float, min_turn_s: float, turn_label: int = USER_ID) -> DataFrame:
    """Scores of frames inside turns that are long enough, with the bounds of their turn.

    ``scores``: keys, idx, horizon (frames), prob.
    """
    turns = with_runs(frames.select(*keys, "idx", "label"), keys).filter(F.col("label") == turn_label)
    turns = turns.filter((F.col("run_end") - F.col("run_start") + 1) / freq >= min_turn_s)
    return scores.join(turns.select(*keys, "idx", "run_start", "run_end"), [*keys, "idx"])


def turn_metrics(scored: DataFrame, keys: Sequence[str], grid: Sequence[float], piece: int = PIECE) -> DataFrame:
    """Per turn, horizon and threshold: lead time and early triggers.

    ``lead``: frames from the first trigger inside the last ``horizon`` frames to the turn end, 0
    if there is none. ``early``: triggers before that window, each followed by ``horizon`` frames
    of cooldown; ``early_share``: their share of the possible number. The grid is evaluated on
    arrays of one turn piece, so frames are never multiplied by thresholds in a shuffle. A piece
    becomes a table over the frames still blocked at its start; FOLD such tables are composed to one,
    so a row holds FOLD of them, or at the end one for each ``piece * FOLD`` frames of a turn.
    """
    keys = list(keys)
    h = F.col("horizon").cast("long")
    inside = F.col("run_end") - F.col("idx") < h
    lead = F.col("run_end") - F.col("idx") + 1
    leads = F.array(*[F.max(F.when(inside & (F.col("prob") > t), lead)) for t in grid])
    # scores that reach no threshold cannot start a trigger
    outs = F.sort_array(F.collect_list(F.when(~inside & (F.col("prob") > min(grid)), F.struct(F.col("idx").cast("long").alias("i"), F.col("prob").alias("p")))))
    turn = [*keys, "run_start", "run_end", "horizon"]
    df = scored.withColumn("_p", F.floor((F.col("idx") - F.col("run_start")) / piece).cast("long"))
    df = df.groupBy(*turn, "_p").agg(leads.alias("_leads"), outs.alias("_outs"))

    begin = F.col("run_start") + F.col("_p") * piece
    entries = F.when(F.col("_p") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), h - 1))
    thresholds = F.array(*[F.lit(t) for t in grid])

    def walk(t: Column, e: Column) -> Column:
        init = F.struct((begin + e).alias("nxt"), F.lit(0).cast("long").alias("n"))
        end = F.aggregate(
            F.col("_outs"), init,
            lambda a, f: F.when((f["p"] > t) & (f["i"] >= a["nxt"]), F.struct((f["i"] + h).alias("nxt"), (a["n"] + 1).alias("n"))).otherwise(a),
        )
        return F.struct(F.greatest(end["nxt"] - (begin + piece), F.lit(0)).alias("out"), end["n"].alias("n"))

    folds = F.transform(thresholds, lambda t: F.transform(entries, lambda e: walk(t, e)))
    df = df.withColumn("_folds", folds)
    df = _composed(df, turn, h, len(grid), piece, FOLD)
    df = _composed(df, turn, h, len(grid), piece * FOLD, None)
    df = df.select(*turn, "_leads", "_folds", F.posexplode(thresholds).alias("th_idx", "threshold"))
    i = F.col("th_idx")
    length = F.col("run_end") - F.col("run_start") + 1
    possible = F.ceil(F.greatest(length - F.col("horizon"), F.lit(0)) / F.col("horizon"))
    early = F.get(F.get("_folds", i), F.lit(0))["n"]
    df = df.select(*turn, "th_idx", "threshold", F.coalesce(F.get("_leads", i), F.lit(0)).alias("lead"), early.alias("early"), possible.alias("possible"))
    share = F.when(F.col("possible") > 0, F.col("early") / F.col("possible")).otherwise(0.0)
    return df.withColumn("early_share", share).drop("possible")


def _composed(df: DataFrame, turn: Sequence[str], h: Column, thresholds: int, width: int, fold: int | None) -> DataFrame:
    """Makes one piece of each ``fold`` pieces of ``width`` frames (of all that a turn has left if None).

    A piece holds, for each threshold, its largest lead (``_leads``) and a table (``_folds``) that
    gives for each number of frames still blocked at its start how many are at its end, and
    how many triggers it has. Such tables compose; a piece without rows lets time pass only.
    """
    q = F.floor(F.col("_p") / fold).cast("long") if fold else F.lit(0).cast("long")
    df = df.groupBy(*turn, q.alias("_q")).agg(F.sort_array(F.collect_list(F.struct("_p", "_leads", "_folds"))).alias("_steps"))
    first = F.col("_q") * (fold or 1)
    passed = lambda blocked, pieces: F.greatest(blocked - pieces * width, F.lit(0).cast("long"))

    def walk(i: Column, entry: Column) -> Column:
        init = F.struct((first - 1).alias("p"), entry.cast("long").alias("out"), F.lit(0).cast("long").alias("n"))

        def add(a: Column, s: Column) -> Column:
            r = F.get(F.get(s["_folds"], i), passed(a["out"], s["_p"] - a["p"] - 1).cast("int"))
            return F.struct(s["_p"].alias("p"), r["out"].alias("out"), (a["n"] + r["n"]).alias("n"))

        end = lambda a: F.struct((passed(a["out"], first + (fold - 1) - a["p"]) if fold else a["out"]).alias("out"), a["n"].alias("n"))
        return F.aggregate("_steps", init, add, end)

    each = F.sequence(F.lit(0), F.lit(thresholds - 1))
    entries = F.when(F.col("_q") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), h - 1))
    leads = F.transform(each, lambda i: F.array_max(F.transform("_steps", lambda s: F.get(s["_leads"], i))))
    folds = F.transform(each, lambda i: F.transform(entries, lambda e: walk(i, e)))
    alone = F.col("run_end") - F.col("run_start") < width  # most turns are one piece
    leads, folds = (F.when(alone, F.get("_steps", F.lit(0))[name]).otherwise(made) for name, made in (("_leads", leads), ("_folds", folds)))
    return df.select(*turn, F.col("_q").alias("_p"), leads.alias("_leads"), folds.alias("_folds"))


def forecast_metrics(per_turn: DataFrame, freq: float, collar: int = 1) -> DataFrame:
    """Report row per (threshold, horizon)."""
    # leads are whole frames up to the horizon and early counts small integers, so the exact
    # percentile keeps few distinct values per group and everything is one aggregation
    lead_s = F.round(F.col("lead") / freq, 4)
    return per_turn.groupBy("th_idx", "horizon").agg(
        F.count(F.lit(1)).alias("turns"), (F.avg((F.col("early") > 0).cast("double")) * 100).alias("premature_pct"),
        F.round(F.avg("early"), 4).alias("early_mean"), F.percentile("early", F.lit(0.5)).alias("early_median"),
        F.round(F.avg("early_share"), 4).alias("early_share_mean"),
        F.round(F.percentile(lead_s, F.lit(0.5)) * 1000).alias("lead_median_ms"),
        F.round(F.avg((F.col("lead") >= F.col("horizon") - collar).cast("double")), 2).alias("entry_accuracy"),
    )


def operating_point(metrics: DataFrame, curve: Sequence[str], metric: str, target: float, order: str) -> DataFrame:
    """Per curve the row whose ``metric`` is the closest strictly above ``target``.

    Ties, and curves that stay below the target, take the first row in ``order``.
    """
    rest = [c for c in metrics.columns if c not in curve]
    above = F.col(metric) > target
    rank = F.struct((~above).alias("below"), F.when(above, F.col(metric) - target).otherwise(0.0).alias("d"), order)
    best = metrics.groupBy(*curve).agg(F.min_by(F.struct(*rest), rank).alias("r"))
    return best.select(*curve, "r.*")


def endpoint_latency(frames: DataFrame, keys: Sequence[str], grid: Sequence[float], max_latency: int) -> DataFrame:
    """Signed frames from each user end to the first score over each threshold.

    The search runs from the start of the user turn before to ``max_latency`` after the end (no
    further than the gap lasts); the default is that bound. Every frame belongs to one end at
    most, so no range join is needed. Output: keys, end_idx, th_idx, latency.
    """
    keys = list(keys)
    df = with_runs(frames.select(*keys, "idx", "label", "prob"), keys)
    gap = F.col("label") == USER_END_ID
    length = F.col("run_end") - F.col("run_start") + 1
    bound = F.when(F.col("next_label").isNull(), F.lit(max_latency).cast("long")).otherwise(F.least(F.lit(max_latency), length))
    end = F.when(gap, F.col("run_start")).when((F.col("label") == USER_ID) & (F.col("next_label") == USER_END_ID), F.col("run_end") + 1)
    df = df.withColumn("end_idx", end).filter(F.col("end_idx").isNotNull() & (~gap | (F.col("idx") - F.col("run_start") < max_latency)))
    first = F.array(*[F.min(F.when(F.col("prob") > t, F.col("idx"))) for t in grid])
    ends = df.groupBy(*keys, "end_idx").agg(first.alias("_first"), F.max(F.when(gap, bound)).alias("bound"))
    out = ends.filter(F.col("bound").isNotNull()).select(*keys, "end_idx", "bound", F.posexplode("_first").alias("th_idx", "_f"))
    return out.select(*keys, "end_idx", "th_idx", F.coalesce(F.col("_f") - F.col("end_idx"), F.col("bound")).alias("latency"))


def endpoint_metrics(latencies: DataFrame, freq: float, key: str = "th_idx", value: str = "latency") -> DataFrame:
    """Per threshold: % negative; median and p90 (ms) over the non-negative and over all."""
    # latencies are whole frames between a turn length and the bound: few distinct values
    ms = 1000 / freq
    late = F.when(F.col(value) >= 0, F.col(value))

    def at(c: Column, q: float) -> Column:
        return F.percentile(c, F.lit(q)) * ms

    return latencies.groupBy(key).agg(
        (F.avg((F.col(value) < 0).cast("double")) * 100).alias("cutoff_pct"),
        at(late, 0.5).alias("positive_median_ms"), at(late, 0.9).alias("positive_p90_ms"),
        at(F.col(value), 0.5).alias("all_median_ms"), at(F.col(value), 0.9).alias("all_p90_ms"),
    )


def crossings(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_expr: Column, value: str, threshold: float) -> DataFrame:
    """Rows where the value rises to the threshold from below."""
    out = S.scan(df, keys, order, slice_expr, [S.Lag("_v", F.col(value))])
    return out.filter((F.col("_v") < threshold) & (F.col(value) >= threshold)).drop("_v")


def collapse_equal_neighbours(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], ref: Sequence[Column] | None = None) -> DataFrame:
    """Mark rows equal to the kept row before: ``alias`` names it, null for rows that are kept.

    With ``ref`` rows equal to the reference values get the alias -1 instead.
    """
    v = F.struct(*values)
    same_ref = (F.struct(*[c.alias(n) for c, n in zip(ref, values)]) == v) if ref is not None else F.lit(False)
    # rows equal to the reference never become the row others compare with
    df = df.withColumn("_v", v).withColumn("_r", same_ref)
    at = F.floor(F.col(order) / S.ROWS_PER_SLICE).cast("long")
    base = F.when(~F.col("_r"), F.col("_v"))
    df = S.scan(df, keys, [order], at, [S.LastValid("_prev", base, inclusive=False)])
    changed = ~F.col("_r") & (F.col("_prev").isNull() | (F.col("_prev") != F.col("_v")))
    df = S.scan(df.withColumn("_kept", changed), keys, [order], at, [S.LastValid("_key", F.when(F.col("_kept"), F.col(order)))])
    alias = F.when(~F.col("_kept"), F.when(F.col("_r"), F.lit(-1)).otherwise(F.col("_key")))
    return df.withColumn("alias", alias).drop("_v", "_r", "_prev", "_kept", "_key")


def confusion_matrix(df: DataFrame, gold: str, pred: str, classes: Sequence[int]) -> DataFrame:
    """Counts per (gold, pred) with the row recall and the overall accuracy.

    The matrix is one row per class pair, so it is normalised on the aggregated rows.
    """
    pairs = df.filter(F.col(gold).isin(*classes) & F.col(pred).isin(*classes))
    counts = pairs.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy("gold").agg(F.sum("n").alias("gold_n"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("right"))
    total = rows.agg(F.sum("right").alias("r"), F.sum("gold_n").alias("t")).select((F.col("r") / F.col("t")).alias("accuracy"), F.lit(1).alias("_one"))
    out = counts.join(rows, "gold").withColumn("_one", F.lit(1)).join(total, "_one").drop("_one")
    return out.select("gold", "pred", "n", (F.col("right") / F.col("gold_n")).alias("recall"), "accuracy")


def class_mean_recall(matrix: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Mean recall in percent over the named classes."""
    per = matrix.filter(F.col("gold").isin(*classes)).groupBy("gold").agg(F.first("recall").alias("recall"))
    return per.agg(F.avg(F.round(F.col("recall") * 100, 2)).alias("mean_recall"))


def horizon_accuracy(df: DataFrame) -> DataFrame:
    """Binary accuracy per horizon over unmasked targets, and the mean over horizons (-1)."""
    per = df.filter(F.col("target") != -1).groupBy("horizon").agg(F.avg(((F.col("prob") > 0.5) == (F.col("target") == 1)).cast("double")).alias("accuracy"))
    return per.unionByName(per.agg(F.avg("accuracy").alias("accuracy")).select(F.lit(-1).alias("horizon"), "accuracy"))


def weighted_logloss(df: DataFrame, weight: Column) -> DataFrame:
    """Mean weighted binary cross-entropy over unmasked targets; logs are bounded at -100."""

    def log(x: Column) -> Column:
        return F.when(x <= 0, -100.0).otherwise(F.greatest(F.log(x), F.lit(-100.0)))

    y = F.col("target").cast("double")
    loss = -(y * log(F.col("prob")) + (1 - y) * log(1 - F.col("prob")))
    return df.filter(F.col("target") != -1).agg(F.avg(weight * loss).alias("loss"), F.count(F.lit(1)).alias("frames"))


def window_hits(segments: DataFrame, frames: DataFrame, key: str, rate: float, threshold: float, collars: Sequence[float], skip: int = 5) -> DataFrame:
    """Per segment and collar: any score at the threshold inside it (after ``skip`` frames), and
    inside the collar after its end.

    ``segments``: folder, key, seg, start_s, end_s. The last segment of a key is left out unless
    its folder is a pause folder. The frame range of a segment is exploded into equi-join keys.
    """
    last = segments.groupBy(key).agg(F.max("seg").alias("_last"))
    seg = segments.join(last, key).filter(F.col("folder").contains("Pause") | (F.col("seg") < F.col("_last")))
    a, b = F.floor(F.col("start_s") * rate).cast("long"), F.floor(F.col("end_s") * rate).cast("long")
    reach = max(int(c * rate) for c in collars)
    seg = seg.select("folder", key, "seg", a.alias("_a"), b.alias("_b"))
    wide = seg.withColumn("idx", F.explode(F.when(F.col("_b") + reach > F.col("_a"), F.sequence("_a", F.col("_b") + reach - 1))))
    hit = wide.join(frames.filter(F.col("prob") >= threshold).select(key, "idx"), [key, "idx"])
    flags = hit.groupBy(key, "seg").agg(
        F.bool_or((F.col("idx") >= F.col("_a") + skip) & (F.col("idx") < F.col("_b"))).alias("early"),
        *[F.bool_or((F.col("idx") >= F.col("_b")) & (F.col("idx") < F.col("_b") + int(c * rate))).alias(f"_late{i}") for i, c in enumerate(collars)],
    )
    out = seg.join(flags, [key, "seg"], "left")
    late = F.array(*[F.struct(F.lit(float(c)).alias("collar_s"), F.coalesce(f"_late{i}", F.lit(False)).alias("late")) for i, c in enumerate(collars)])
    return out.select("folder", key, "seg", F.coalesce("early", F.lit(False)).alias("early"), F.explode(late).alias("l")).select("folder", key, "seg", "early", "l.*")


def pause_handling(hits: DataFrame) -> DataFrame:
    """Share of segments not cut early and share ended in time, per folder and collar, and overall."""
    return (
        hits.groupingSets([["collar_s"], ["folder", "collar_s"]], "folder", "collar_s")
        .agg(
            F.grouping("folder").alias("_all"), F.count(F.lit(1)).alias("segments"),
            (1 - F.avg(F.col("early").cast("double"))).alias("pause_accuracy"), F.avg(F.col("late").cast("double")).alias("late_rate"),
        )
        .withColumn("folder", F.when(F.col("_all") == 1, "overall").otherwise(F.col("folder")))
        .drop("_all")
    )


def trigger_policy(df: DataFrame, prob: Column, elapsed_s: Column, state: Column, threshold: float = 0.5, cooldown_s: float = 0.96) -> DataFrame:
    """Three gates: ``triggered`` when all pass, else the names of those that failed."""
    elapsed_ok = elapsed_s.isNull() | (elapsed_s >= cooldown_s)
    reasons = F.array_compact(F.array(
        F.when(~(prob >= threshold), "below_threshold"), F.when(~elapsed_ok, "cooldown"),
        F.when(state != "user_speaking", "blocked_by_conversation_state"),
    ))
    return df.withColumn("drop_reasons", reasons).withColumn("triggered", F.size("drop_reasons") == 0)


def common_keys(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Keys present in every table."""
    out = first
    for o in others:
        out = out.intersect(o)
    return out
