"""Mixing sources to target weights by a low-discrepancy schedule.

Targets share all words of the corpus by the sources' weights; a source's target stops at ``most``
times its size, and what is over is shared anew among the others. A source's documents are put in a
shuffled order (by a digest) and its words, end to end, cut into blocks of equal length. Slot i of
the schedule has the point i times the golden ratio modulo 1, mapped through the sources' cumulative
numbers of slots. The k-th slot of a source takes its block k modulo the number of blocks, so a
source is passed over evenly, as often as its target asks; its last slot takes what is still missing.
Sources that the points have not yet given all their slots get them at the end.

Ranks of slots and places of words are computed in slices (ranges of slots; digest ranges of a
source) that are moved up by the sums of the slices before them, so a source that holds a third of
all rows is split over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convlake.llm.common import numbered, staged, word_count

HALF_BITS = 31  # points have twice as many
GOLDEN = (math.isqrt(5 << 4 * HALF_BITS) - (1 << 2 * HALF_BITS)) >> 1 | 1  # 2^62 divided by the golden ratio, odd: all points of a period differ
SLOTS = 1 << 16  # slots ranked at a time
BUCKET = 1 << 10  # slot numbers of a bucket that points are looked up in
DIGEST_BITS, SLICE_BITS = 60, 12  # a source is cut into 2^SLICE_BITS slices by digest
BEFORE = (W.unboundedPreceding, -1)


def shared_targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """``sources`` (size, weight) with target: the total size shared by weight, at most ``most`` sizes each.

    The common level is found by sharing anew what the full sources leave, until none is above.
    """
    total, weights = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    cap = F.col("size") * F.lit(float(most))
    level, full = total / weights if weights else 0.0, 0
    while True:
        n, held, light = sources.where(cap <= F.lit(level) * F.col("weight")).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n <= full or light == weights:
            break
        level, full = (total - most * held) / (weights - light), n
    return sources.withColumn("target", F.least(cap, F.lit(float(level)) * F.col("weight")))


def source_table(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, block: int = 2048, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row per source in code-point order, null last: no, size, weight, target, and its blocks and slots."""
    sizes = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("n")).groupBy("source").agg(F.sum("n").alias("size"))
    listed = numbered(sizes, [F.col("source").asc_nulls_last()], "no")
    listed = listed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int")))
    out = shared_targets(staged(listed, "sources"), most).withColumn("words", F.floor("target"))
    full = F.when(F.col("size") > 0, F.floor(F.col("words") / F.col("size"))).otherwise(0)
    out = out.withColumn("blocks", F.ceil(F.col("size") / block)).withColumn("full", full).withColumn("rest", F.col("words") - F.col("full") * F.col("size"))
    out = out.withColumn("slots", F.col("full") * F.col("blocks") + F.ceil(F.col("rest") / block))
    return staged(numbered(out, [F.col("no")], "first_slot", amount=F.col("slots")), "sources")


def placed(docs: DataFrame, sources: DataFrame, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with _size, _no, _source_size, _target and _at, the words of its source before it in shuffled order.

    (_no, _at) tells rows with words apart. Rows equal in id and text take neighbouring places.
    """
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")), 1, DIGEST_BITS // 4), 16, 10).cast("long")
    rows = docs.withColumns({"_size": word_count(F.col(text_col)), "_digest": digest, "_tie": F.xxhash64(text_col)})
    named = sources.select(F.col("source").alias("_source"), F.col("no").alias("_no"), F.col("size").alias("_source_size"), F.col("target").alias("_target"))
    rows = rows.join(named, F.col(source_col).eqNullSafe(F.col("_source")))
    rows = rows.withColumn("_slice", F.shiftright("_digest", DIGEST_BITS - SLICE_BITS))
    before = F.sum("_all").over(W.partitionBy("_no").orderBy("_slice").rowsBetween(*BEFORE))
    slices = rows.groupBy("_no", "_slice").agg(F.sum("_size").alias("_all")).select("_no", "_slice", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = W.partitionBy("_no", "_slice").orderBy("_digest", F.col(id_col), "_size", "_tie").rowsBetween(*BEFORE)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(slices, ["_no", "_slice"])
    return rows.withColumn("_at", F.col("_start") + F.col("_in")).drop("_digest", "_tie", "_slice", "_start", "_in", "_source")


def point(number: Column) -> Column:
    """``number`` (below 2^62) times GOLDEN modulo 2^62, in halves so that no product passes 63 bits."""
    low = lambda x: x.bitwiseAND(F.lit((1 << HALF_BITS) - 1))
    g_high, g_low = F.lit(GOLDEN >> HALF_BITS), F.lit(GOLDEN & (1 << HALF_BITS) - 1)
    middle = F.shiftright(number, HALF_BITS) * g_low + low(number) * g_high
    return (low(number) * g_low + F.shiftleft(low(middle), HALF_BITS)).bitwiseAND(F.lit((1 << 2 * HALF_BITS) - 1))


def schedule(sources: DataFrame) -> DataFrame:
    """The slots in order: slot, no, rank (of the slot in its source)."""
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    mapped = F.floor(point(F.col("slot") + 1) / float(1 << 2 * HALF_BITS) * total).cast("long")
    at = spark.range(total).withColumnRenamed("id", "slot").withColumn("v", F.least(mapped, F.lit(total - 1)))
    last = F.col("first_slot") + F.col("slots") - 1
    bucket = lambda c: F.floor(c / BUCKET)
    spans = sources.where("slots > 0").select("no", "slots", "first_slot", last.alias("last_slot"), F.explode(F.sequence(bucket(F.col("first_slot")), bucket(last))).alias("bucket"))
    hits = at.withColumn("bucket", bucket(F.col("v"))).join(spans, "bucket").where("v BETWEEN first_slot AND last_slot").withColumn("part", F.floor(F.col("slot") / SLOTS))
    parts = hits.groupBy("no", "part").agg(F.count("*").alias("n"))
    starts = parts.select("no", "part", F.coalesce(F.sum("n").over(W.partitionBy("no").orderBy("part").rowsBetween(*BEFORE)), F.lit(0)).alias("start"))
    rank = F.row_number().over(W.partitionBy("no", "part").orderBy("slot")) - 1
    ranked = hits.select("slot", "no", "part", "slots", rank.alias("inner")).join(starts, ["no", "part"]).select("slot", "no", (F.col("start") + F.col("inner")).alias("rank"), "slots").where("rank < slots")
    given = parts.groupBy("no").agg(F.sum("n").alias("given"))
    short = sources.join(given, "no", "left").select("no", "slots", F.least(F.coalesce("given", F.lit(0)), "slots").alias("given")).where("given < slots")
    behind = numbered(short, [F.col("no")], "before", amount=F.col("slots") - F.col("given"))
    rest = behind.select("no", "before", "given", F.explode(F.sequence(F.col("given"), F.col("slots") - 1)).alias("rank"))
    return ranked.select("slot", "no", "rank").union(rest.select((F.lit(total) + F.col("before") + F.col("rank") - F.col("given")).alias("slot"), "no", "rank"))


def taken_pieces(rows: DataFrame, sources: DataFrame, block: int = 2048) -> DataFrame:
    """What each slot takes: slot, pass, _no, _at (of the document), start and length in words."""
    cut = rows.where("_size > 0").select("_no", "_at", "_size", F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("_size") - 1) / block))).alias("block"))
    slots = schedule(sources).join(sources.select("no", "blocks", "full", "rest"), "no")
    slots = slots.select("slot", F.col("no").alias("_no"), F.floor(F.col("rank") / F.col("blocks")).alias("pass"), (F.col("rank") % F.col("blocks")).alias("block"), "full", "rest")
    met = slots.join(cut, ["_no", "block"])
    start = F.greatest(F.col("block") * block, "_at")
    end = F.least((F.col("block") + 1) * block, F.col("_at") + F.col("_size"), F.when(F.col("pass") == F.col("full"), F.col("rest")))
    return met.select("slot", "pass", "_no", "_at", (start - F.col("_at")).alias("start"), (end - start).alias("length")).where("length > 0")


def mixed_sizes(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, block: int = 2048, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per row: id, size, source_size, target (of its source) and taken, the words that the mix takes of it.

    Size is the number of words (null text: 0); rows without words take part with 0. A null source is
    a source. Repeated rows are taken like others. No words at all: all targets are 0.
    """
    sources = source_table(docs, weights, most, block, source_col, text_col)
    rows = placed(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), sources, id_col="id")
    rows = rows.select("id", "_no", "_at", "_size", "_source_size", "_target")
    taken = taken_pieces(rows, sources, block).groupBy("_no", "_at").agg(F.sum("length").alias("taken"), F.lit(True).alias("_has"))
    # rows without words share their place with the next row
    out = rows.withColumn("_has", F.col("_size") > 0).join(taken, ["_no", "_at", "_has"], "left")
    return out.select(F.col("id").alias(id_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, block: int = 2048, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: ``docs`` with a row for each pass that takes a document.

    A document whose last pass ends inside it has there its first words only, joined by one space.
    Rows without words are in no block and so not in the mix. Columns are those of ``docs``, whatever
    their names; rows equal in all columns are taken like others.

    Rows are placed by two hashes of all their columns. Texts meet what is taken of them in one join, a text
    of each set of equal rows with the counts of what is taken of these.
    """
    flat = [F.to_json(c) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    marked = [x for c in flat for x in (c.isNull(), c)]  # a hash skips nulls
    keys = [F.xxhash64(F.lit(salt), *marked).alias(f"k{salt}") for salt in (1, 2)]
    lean = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), *keys)
    sources = source_table(lean, weights, most, block)
    rows = placed(lean, sources, id_col="id").where("_size > 0").select("k1", "k2", "_no", "_at", "_size")
    rows = staged(rows, "placed")
    taken = taken_pieces(rows, sources, block).groupBy("_no", "_at", F.col("pass").alias("_pass")).agg(F.sum("length").alias("_taken"))
    counts = rows.join(taken, ["_no", "_at"]).groupBy("k1", "k2", F.nullif("_taken", "_size").alias("part")).agg(F.count("*").cast("int").alias("copies"))
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keys).dropDuplicates(["k1", "k2"])
    out = texts.join(staged(counts, "counts"), ["k1", "k2"]).select("row", "part", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    text = F.col("row")[text_col]
    cut = F.when(F.col("part").isNull(), text).otherwise(_first_words(text, F.col("part"))).alias(text_col)
    return out.select(*[cut if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def _first_words(text: Column, n: Column) -> Column:
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), " ")
