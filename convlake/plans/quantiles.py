"""Exact interpolating quantiles without holding a group's values in one task.

``percentile`` keeps every distinct value of a group in one reducer. Here one pass counts the values
of each group and takes a mergeable sketch of edges. A group of at most WINDOW_ROWS values is counted by
value and ranked in a window. Of larger ones the values between edges are counted, and only the ranges that
hold a wanted rank are kept; a range above the bound is cut again by a sketch of its own, until none
is larger or has two different values. So no window ranks more than WINDOW_ROWS values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.session import staged

RANGES = 256
WINDOW_ROWS = 1 << 20


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float], stats: dict[str, Column] | None = None) -> DataFrame:
    """One row per group with a column per entry of ``qs`` (linear interpolation) and of ``stats``.

    Null values are ignored; a group without values has null quantiles. Null keys form groups.
    ``stats`` are further aggregates of the group, from the same pass. Without ``keys``: one row.
    """
    keys, stats = list(keys), stats or {}
    # a struct is never null, so groups with null keys meet in plain joins
    rows = df.withColumn("_k", F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_all")))
    v = F.col(value)
    sketch = lambda c: F.array_distinct(F.percentile_approx(c, [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).alias("_edges")
    groups = staged(rows.groupBy("_k").agg(sketch(v), F.count(v).alias("_total"), *[c.alias(n) for n, c in stats.items()]))
    narrow = rows.where(v.isNotNull()).select("_k", v.alias("_v"))
    start = F.lit(0).cast("long").alias("_off")
    kept = narrow.join(groups.where((F.col("_total") > 0) & (F.col("_total") <= WINDOW_ROWS)).select("_k", "_total"), "_k").select("_k", start, "_total", "_v")
    large = groups.where(F.col("_total") > WINDOW_ROWS)
    if large.limit(1).count():
        kept = kept.union(_wanted_ranges(narrow, large.select("_k", start, "_edges", "_total"), sketch, list(qs.values())))
    counts = kept.groupBy("_k", "_off", "_v").agg(F.count(F.lit(1)).alias("_n"), F.first("_total").alias("_total"))
    upto = Window.partitionBy("_k", "_off").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_hi", F.sum("_n").over(upto) + F.col("_off") - 1).withColumn("_lo", F.col("_hi") - F.col("_n") + 1)
    aggs, out = [], []
    for name, q in qs.items():
        rank = F.lit(q) * (F.col("_total") - 1)
        for tag, place in (("f", F.floor(rank)), ("c", F.ceil(rank))):
            aggs.append(F.max(F.when((F.col("_lo") <= place) & (place <= F.col("_hi")), F.col("_v"))).alias(f"_{tag}_{name}"))
        lo, hi = F.col(f"_f_{name}"), F.col(f"_c_{name}")
        out.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    picked = ranked.groupBy("_k").agg(*aggs)
    names = [F.col(f"_k.{k}").alias(k) for k in keys]
    return groups.drop("_edges").join(picked, "_k", "left").select(*names, *stats, *out)


def _wanted_ranges(narrow: DataFrame, parts: DataFrame, sketch, qs: Sequence[float]) -> DataFrame:
    """The values of ``narrow`` (_k, _v) that may hold a wanted rank: _k, _off, _total, _v.

    A part is a group of ``parts``, or a range of one that begins at rank ``_off``.
    """
    held = staged(narrow.join(parts.select("_k", "_off"), "_k"))
    places = F.array(*[f(F.lit(q) * (F.col("_total") - 1)) for q in qs for f in (F.floor, F.ceil)])
    before = Window.partitionBy("_k", "_off").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        ranged = held.select("_k", "_off", "_v").join(parts, ["_k", "_off"]).select("_k", "_off", "_total", "_v", F.size(F.filter("_edges", lambda e: e < F.col("_v"))).alias("_r"))
        sizes = ranged.groupBy("_k", "_off", "_total", "_r").agg(F.count(F.lit(1)).alias("_rn"), (F.min("_v") < F.max("_v")).alias("_mixed"))
        at = F.col("_off") + F.coalesce(F.sum("_rn").over(before), F.lit(0))
        inside = F.exists(places, lambda x: (x >= F.col("_at")) & (x < F.col("_at") + F.col("_rn")))
        wanted = staged(sizes.withColumn("_at", at).where(inside).select("_k", "_off", "_r", "_rn", "_mixed", "_at"))
        kept = ranged.join(wanted, ["_k", "_off", "_r"]).select("_k", F.col("_at").alias("_off"), "_total", "_v")
        if not wanted.where(F.col("_mixed") & (F.col("_rn") > WINDOW_ROWS)).limit(1).count():
            return kept
        held = staged(kept)
        parts = held.groupBy("_k", "_off").agg(sketch(F.col("_v")), F.first("_total").alias("_total"))
