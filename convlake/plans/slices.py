"""Ordered computations over groups of any size.

A plain ``Window.partitionBy(key)`` puts a whole group into one task, which fails when one
user or conversation holds a large share of the table. Here every group is cut into slices
by a monotone function of its ordering (a day of events, a few thousand frames). Windows run
inside a slice; what has to cross a slice border is aggregated to one row per slice, scanned
over the slices of the group, and added to each slice as a row before its first or after its last.
The large side is shuffled once, on (group, slice), and not joined; null keys form groups. The scan
over slices is such a scan itself, in spans of SLICES_PER_SPAN slices, so no window ranges over all slices
of a group; only an input of at most PLAIN_BYTES by Spark's estimate is spared the two small shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
EDGE = "_edge"
BORDER = "_border"
ROWS_PER_SLICE = 4096
SLICES_PER_SPAN = 4096
# a span of rows by index covers 2^24 places, so a window over the spans of 10^12 rows has 60,000
SPAN_LEVELS = 1
# an input that Spark estimates to be no larger has so few slices that one window may hold those of a key
PLAIN_BYTES = 4 << 30
# ten minutes: a key with 30 TB of events in a month still gives slices of a few GB, and a key
# has at most 144 border rows per day however many events it has
SLICE_US = 600_000_000


@dataclass(frozen=True)
class Lag:
    """Value of ``expr`` in the previous row; ``default`` where there is none."""

    out: str
    expr: Column
    default: Column | None = None


@dataclass(frozen=True)
class Lead:
    """Value of ``expr`` in the next row; ``default`` where there is none."""

    out: str
    expr: Column
    default: Column | None = None


@dataclass(frozen=True)
class RunSum:
    """Sum of ``expr`` over the rows up to the current one (or up to the one before)."""

    out: str
    expr: Column
    inclusive: bool = True


@dataclass(frozen=True)
class RunMax:
    """Largest ``expr`` over the rows up to the current one (or up to the one before)."""

    out: str
    expr: Column
    inclusive: bool = True


@dataclass(frozen=True)
class LastValid:
    """Latest non-null ``expr`` up to the current row (or up to the one before)."""

    out: str
    expr: Column
    inclusive: bool = True


@dataclass(frozen=True)
class NextValid:
    """First non-null ``expr`` from the current row on (or from the next one on)."""

    out: str
    expr: Column
    inclusive: bool = True


@dataclass(frozen=True)
class AheadMax:
    """Largest ``expr`` over the rows from the current one on (or from the next one on)."""

    out: str
    expr: Column
    inclusive: bool = True


Spec = Lag | Lead | RunSum | RunMax | LastValid | NextValid | AheadMax


def by_index(col: str, rows: int = ROWS_PER_SLICE) -> Column:
    """Slice of a dense integer ordering."""
    return F.floor(F.col(col) / rows).cast("long")


def by_micros(col: str, width_us: int = SLICE_US) -> Column:
    """Slice of a time ordering given in microseconds."""
    return F.floor(F.col(col) / width_us).cast("long")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_expr: Column,
    specs: Sequence[Spec],
    keep_slice: bool = False,
) -> DataFrame:
    """Add one column per spec, computed over ``keys`` ordered by ``order``.

    ``order`` must be unique within a group and ``slice_expr``, a whole number, must not decrease along it.
    With ``keep_slice`` the column ``_slice`` stays, and with it the partitioning.
    """
    estimate = int(df._jdf.queryExecution().analyzed().stats().sizeInBytes())
    return _scan(df, list(keys), list(order), slice_expr, specs, keep_slice, SPAN_LEVELS if estimate > PLAIN_BYTES else 0)


def _scan(df: DataFrame, keys: list[str], order: list[str], slice_expr: Column, specs: Sequence[Spec], keep_slice: bool, levels: int) -> DataFrame:
    if SLICE not in df.columns:
        df = df.withColumn(SLICE, slice_expr)
    named = [f"_x{i}" for i in range(len(specs))]
    steps = [F.struct(s.expr.alias("v")) if isinstance(s, (Lag, Lead)) else s.expr for s in specs]
    df = df.select("*", *[x.alias(n) for x, n in zip(steps, named)])

    # one row per slice with what the slice hands on, then what each slice gets from the others
    position = F.struct(*order)
    aggs, between = [], []
    for i, (s, n) in enumerate(zip(specs, named)):
        x, handed = F.col(n), F.col(f"_b{i}")
        if isinstance(s, (RunSum, RunMax, AheadMax)):
            aggs.append((F.sum if isinstance(s, RunSum) else F.max)(x).alias(f"_b{i}"))
            between.append(type(s)(n, handed, inclusive=False))
        elif isinstance(s, (Lag, LastValid)):
            aggs.append(F.max_by(x, F.when(x.isNotNull(), position)).alias(f"_b{i}"))
            between.append(LastValid(n, handed, inclusive=False))
        else:
            aggs.append(F.min_by(x, F.when(x.isNotNull(), position)).alias(f"_b{i}"))
            between.append(NextValid(n, handed, inclusive=False))
    borders = df.groupBy(*keys, SLICE).agg(*aggs).withColumnRenamed(SLICE, BORDER)
    if levels:
        borders = _scan(borders, keys, [BORDER], F.floor(F.col(BORDER) / SLICES_PER_SPAN).cast("long"), between, False, levels - 1)
    else:
        borders = borders.select("*", *_over(between, Window.partitionBy(*keys).orderBy(BORDER)))
    borders = borders.select(*keys, F.col(BORDER).alias(SLICE), *named)

    # a slice's windows see what it gets as a row before its first and one after its last
    sums = {n: borders.schema[n].dataType for s, n in zip(specs, named) if isinstance(s, RunSum)}
    df = df.withColumns({n: F.col(n).cast(kind) for n, kind in sums.items()}).withColumn(EDGE, F.lit(0))
    ahead = [isinstance(s, (Lead, NextValid, AheadMax)) for s in specs]
    edges = [
        F.struct(*[(F.col(n) if a == (edge > 0) else F.lit(None).cast(borders.schema[n].dataType)).alias(n) for n, a in zip(named, ahead)], F.lit(edge).alias(EDGE))
        for edge in sorted({1 if a else -1 for a in ahead})
    ]
    # both from one reading of the borders, so that chained scans do not multiply the plan
    edges = borders.select(*keys, SLICE, F.explode(F.array(*edges)).alias("_e")).select(*keys, SLICE, "_e.*")
    df = df.unionByName(edges, allowMissingColumns=True)

    values = _over([replace(s, expr=F.col(n)) for s, n in zip(specs, named)], Window.partitionBy(*keys, SLICE).orderBy(EDGE, *order))
    rest = [c for c in df.columns if c not in (EDGE, *named) and (keep_slice or c != SLICE)]
    return df.select(*rest, EDGE, *values).where(F.col(EDGE) == 0).drop(EDGE)


def _over(specs: Sequence[Spec], ordered) -> list[Column]:
    """The column of each spec in plain windows; a lag or lead has structs, so that none is told from null."""
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    past = ordered.rowsBetween(Window.unboundedPreceding, -1)
    onward = ordered.rowsBetween(0, Window.unboundedFollowing)
    future = ordered.rowsBetween(1, Window.unboundedFollowing)
    out = []
    for s in specs:
        x = s.expr
        if isinstance(s, (Lag, Lead)):
            found = (F.lag if isinstance(s, Lag) else F.lead)(x).over(ordered)
            value = found["v"] if s.default is None else F.when(found.isNull(), s.default).otherwise(found["v"])
        elif isinstance(s, (NextValid, AheadMax)):
            frame = onward if s.inclusive else future
            value = F.max(x).over(frame) if isinstance(s, AheadMax) else F.first(x, ignorenulls=True).over(frame)
        else:
            frame = upto if s.inclusive else past
            value = F.coalesce(F.sum(x).over(frame), F.lit(0)) if isinstance(s, RunSum) else F.max(x).over(frame) if isinstance(s, RunMax) else F.last(x, ignorenulls=True).over(frame)
        out.append(value.alias(s.out))
    return out


def join_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece: Column, sep: str = "", first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """One row per group: its pieces joined in order, their number, and columns of its first and last rows.

    ``df`` has the column ``_slice`` (see ``scan``). Pieces are joined within slices, then the texts of
    slices, so an array holds a slice's pieces or one text per slice, never all pieces of a group.
    Null pieces are left out and not counted. Output: keys, first, last, text, pieces.
    """
    keys, order, place = list(keys), list(order), F.struct(*order)

    def joined(at: Sequence[str], text: str) -> Column:
        parts = F.sort_array(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(*at, text))))
        return F.array_join(F.transform(parts, lambda p: p[text]), sep)

    ends = [F.min_by(F.struct(*first), place).alias("_first")] * bool(first) + [F.max_by(F.struct(*last), place).alias("_last")] * bool(last)
    text = F.when(F.count("_piece") > 0, joined(order, "_piece")).alias("_text")
    per = df.withColumn("_piece", piece).groupBy(*keys, SLICE).agg(text, F.count("_piece").alias("_n"), *ends)
    ends = [F.min_by("_first", SLICE).alias("_first")] * bool(first) + [F.max_by("_last", SLICE).alias("_last")] * bool(last)
    out = per.groupBy(*keys).agg(joined([SLICE], "_text").alias("text"), F.sum("_n").alias("pieces"), *ends)
    return out.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in first], *[F.col(f"_last.{c}").alias(c) for c in last], "text", "pieces")


def neighbours(
    df: DataFrame, keys: Sequence[str], idx: str, specs: Sequence[Lag | Lead], rows: int = ROWS_PER_SLICE
) -> DataFrame:
    """``Lag``/``Lead`` over a dense integer ``idx``: one shuffle and no join.

    With a dense index the neighbour of a border row is known to lie in the next slice, so border
    rows are copied there. The column ``_slice`` stays, and with it the partitioning.
    """
    own, i = F.floor(F.col(idx) / rows).cast("long"), F.pmod(F.col(idx), F.lit(rows))
    homes = F.array_compact(F.array(own, F.when(i == rows - 1, own + 1), F.when(i == 0, own - 1)))
    df = df.withColumn("_own", own).withColumn(SLICE, F.explode(homes))
    w = Window.partitionBy(*keys, SLICE).orderBy(idx)
    cols = []
    for s in specs:
        found = (F.lag if isinstance(s, Lag) else F.lead)(F.struct(s.expr.alias("v"))).over(w)
        value = found["v"]
        cols.append((value if s.default is None else F.when(found.isNull(), s.default).otherwise(value)).alias(s.out))
    return df.select("*", *cols).filter(F.col("_own") == F.col(SLICE)).drop("_own")


def row_index(df: DataFrame, keys, order, slice_expr: Column, out: str) -> DataFrame:
    """Dense 0-based position of each row in its group."""
    indexed = scan(df, keys, order, slice_expr, [RunSum(out, F.lit(1).cast("long"))])
    return indexed.withColumn(out, F.col(out) - 1)
