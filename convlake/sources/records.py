"""Record-level sources and sinks: chunks, incremental work lists, keyed upserts, tables."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

CHUNK_SCHEMA = TY.StructType(
    [TY.StructField(n, TY.StringType()) for n in ("chunk_id", "entity_type", "entity_id", "source_path", "source_field")]
    + [TY.StructField(n, TY.IntegerType()) for n in ("chunk_index", "token_count")]
    + [TY.StructField(n, TY.StringType()) for n in ("chunk_text", "embedding_text")]
)


def parse_chunk_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON lines to chunk records; blank lines are skipped."""
    return lines.filter(F.trim(line) != "").select(F.from_json(line, CHUNK_SCHEMA).alias("c")).select("c.*")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA).json(path)


def write_chunks(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """JSON lines, or a columnar format split by entity type."""
    writer = df.write.mode(mode)
    if fmt == "json":
        writer.json(path)
    else:
        writer.partitionBy("entity_type").format(fmt).save(path)


def pending_work(items: DataFrame, done: DataFrame, keys: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Items without an output yet, or all of them when outputs may be overwritten."""
    return items if overwrite else items.join(done.select(*keys), list(keys), "left_anti")


def split_sets(df: DataFrame, key: str, val: DataFrame, test: DataFrame) -> DataFrame:
    """Name the split of each row: held-out id lists for test and val, the rest train."""
    marks = val.select(key).distinct().withColumn("_val", F.lit(True))
    tests = test.select(key).distinct().withColumn("_test", F.lit(True))
    joined = df.join(marks, key, "left").join(tests, key, "left")
    return joined.withColumn("split", F.when(F.col("_test"), "test").when(F.col("_val"), "val").otherwise("train")).drop("_val", "_test")


def split_by_pattern(df: DataFrame, path: str, patterns: dict[str, str], default: str = "train") -> DataFrame:
    """Name the split by the first pattern the path matches."""
    out = F.lit(default)
    for name, pattern in reversed(patterns.items()):
        out = F.when(F.col(path).rlike(pattern), name).otherwise(out)
    return df.withColumn("split", out)


def _upsert(old: DataFrame, new: DataFrame, keys: list[str], null_overwrites: bool) -> DataFrame:
    """Full join on keys (null-safe) with the columns of both tables, the old ones first."""
    o = old.withColumn("_old", F.lit(True)).alias("o")
    n = new.withColumn("_new", F.lit(True)).alias("n")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    joined = o.join(n, functools.reduce(lambda a, b: a & b, same), "full_outer")
    out = [F.when(F.col("o._old"), F.col(f"o.{k}")).otherwise(F.col(f"n.{k}")).alias(k) for k in keys]
    for c in [*old.columns, *(c for c in new.columns if c not in old.columns)]:
        if c in keys:
            continue
        if c not in new.columns:
            out.append(F.col(f"o.{c}"))
        elif c not in old.columns:
            out.append(F.col(f"n.{c}"))
        elif null_overwrites:
            out.append(F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
    return joined.select(*out)


def upsert_nodes(old: DataFrame, new: DataFrame, key: str, null_overwrites: bool = False) -> DataFrame:
    """Create missing nodes; overwrite the properties a new row carries, keep the others.

    The result has the columns of both tables. A null in a new row keeps the old value unless
    ``null_overwrites``.
    """
    return _upsert(old, new, [key], null_overwrites)


def upsert_edges(
    old: DataFrame, new: DataFrame, keys: Sequence[str], src_nodes: DataFrame, dst_nodes: DataFrame, null_overwrites: bool = False
) -> DataFrame:
    """As for nodes, for edges whose two end points exist (columns ``src`` and ``dst``)."""
    ok = new.join(src_nodes.select(F.col("id").alias("src")), "src", "left_semi")
    ok = ok.join(dst_nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return _upsert(old, ok, list(keys), null_overwrites)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def submission_problems(df: DataFrame, license: str = "CC0", version: str = "1.0") -> DataFrame:
    """Problems that block the flat table: repeated nicknames, other licenses or versions.

    ``df``: one row per submission with a nested ``submission`` struct.
    """
    s = df.select("submission.*")
    repeated = s.groupBy("nickname").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (
        repeated.select(F.lit("nickname").alias("check"), F.col("nickname").alias("found"), "n")
        .unionByName(s.filter(F.col("license") != license).groupBy(F.col("license").alias("found")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("license").alias("check"), "found", "n"))
        .unionByName(s.filter(F.col("format_version") != version).groupBy(F.col("format_version").alias("found")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("format_version").alias("check"), "found", "n"))
    )


def flatten_submissions(df: DataFrame) -> DataFrame:
    """Nested submissions as a flat table."""
    return df.select(
        F.col("submission.verification_id").alias("verification_id"), "timestamp_str",
        F.col("submission.email").alias("email"), F.col("submission.nickname").alias("nickname"),
        F.col("verification.text").alias("verification_text"), "timestamp",
    )


def write_tsv(df: DataFrame, path: str, sort_by: str, mode: str = "errorifexists") -> None:
    """Tab-separated files whose name order is the order of ``sort_by`` (range partitioned)."""
    df.orderBy(sort_by).drop(sort_by).write.mode(mode).option("sep", "\t").option("header", True).csv(path)
