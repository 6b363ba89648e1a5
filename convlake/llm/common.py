"""What the operators of this folder share: staged tables, positions in an order, components."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convlake.session import shared_dir

_STAGED: list[str] = []


def staged(df: DataFrame, what: str = "t") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage, survives lost executors, and gives the planner the real size. The files stay
    until ``clear_staged``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Delete the tables that ``staged`` has written in this process; results that read them end here."""
    jvm = spark.sparkContext._jvm
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


BITMAP_BITS = 1 << 15  # of one of Spark's bitmaps
MOST_BITS = 1 << 26  # of all bitmaps of a set of keys, 8 MB


def perhaps_among(df: DataFrame, key: Column, keys: DataFrame, col: str) -> DataFrame:
    """Rows of ``df`` whose ``key``, a 64-bit hash, is in ``keys`` (a stored table), and a few others: one in sixteen at most,
    more only beyond four million keys.

    The keys are sent to all tasks as bitmaps of bounded size, so rows that a join would drop are dropped before it deals them.
    """
    bits = max(BITMAP_BITS, min(MOST_BITS, 1 << math.ceil(math.log2(max(1, 16 * keys.count())))))
    place = lambda k: F.pmod(k, F.lit(bits)) + 1
    of, part, held = (unused(df, x) for x in ("_of", "_part", "_held"))
    maps = keys.groupBy(F.bitmap_bucket_number(place(F.col(col))).alias(part)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(F.col(col)))).alias(held))
    at = F.bitmap_bit_position(F.col(of))
    byte = F.conv(F.hex(F.substring(F.col(held), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = df.withColumn(of, place(key)).join(F.broadcast(maps), F.bitmap_bucket_number(F.col(of)) == F.col(part))
    return near.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop(of, part, held)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Their number, as long."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def numbered(df: DataFrame, order: list[Column], name: str, amount: Column | None = None, partitions: int | None = None) -> DataFrame:
    """Adds each row's place (from 0) in the order of all rows, or the sum of ``amount`` over those before.

    Rows are dealt by range, numbered in their range, and moved up by the sums of the ranges before;
    the sums are one row per range. Equal rows get places in any order.
    """
    amount = F.lit(1) if amount is None else amount
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(df.repartitionByRange(parts, *order).withColumns({"_range": F.spark_partition_id(), "_amount": amount.cast("long")}), "ranged")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.sum("_amount").alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.coalesce(F.sum("_amount").over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        ranged.withColumn("_place", place)
        .join(F.broadcast(starts), "_range")  # one row per range
        .withColumn(name, F.col("_start") + F.col("_place"))
        .drop("_range", "_amount", "_place", "_start")
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """Least node reachable from each node of the undirected ``edges`` (a, b): rows (node, root).

    Alternates the large-star and small-star steps (Kiveris and others, 2014) on tables in the shared
    folder until nothing changes. Neighbours are met by joins with their least one, never gathered,
    so a hub's rows can be split. Nodes without edges are absent; loops are ignored.
    """
    edges = staged(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _state(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # stored, so that the join deals both sides anew and a hub's rows can be split
        least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")), "least")
        # every larger neighbour of a node points to the node's least neighbour
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every smaller neighbour of a node, and the node, point to the least of them
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(down, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = staged(small.where("a != b").distinct(), "edges")
        now = _state(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
