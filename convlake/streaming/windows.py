"""Stream operators that Spark's own windows express."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from convlake.session import shared_dir


def stream_events(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", glob: str = "*", files_per_batch: int | None = None, bytes_per_batch: int | None = None) -> DataFrame:
    """Event files as a stream; ``ts`` (NTZ or text) becomes a timestamp for watermarks.

    A micro-batch takes at most so many files, or files of so many bytes (one file at least).
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch and bytes_per_batch:
        raise ValueError("a batch is limited by files or by bytes")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.format(fmt).load(path).withColumn("ts", F.col("ts").cast("timestamp"))


def read_events(spark: SparkSession, path: str, schema: StructType, fmt: str = "json") -> DataFrame:
    """The same events as a table."""
    return spark.read.schema(schema).format(fmt).load(path).withColumn("ts", F.col("ts").cast("timestamp"))


END = "2200-01-01 00:00:00"  # within the range of pandas times


def run_to_end(events: DataFrame, operator: Callable[[DataFrame], DataFrame], name: str, partitions: int | None = None) -> DataFrame:
    """``run_to_table`` of ``operator(events)`` for input that ends: what is still open is closed too.

    Events are joined by a second, empty source. After all input has been read, the stream starts again
    from its checkpoint with one row there, null but for a late ``ts``; it moves the watermark
    past every window and timer, and stays open itself.
    """
    spark = events.sparkSession
    end = f"{shared_dir(spark)}/{name}-end-{uuid.uuid4().hex}"
    mark = spark.range(1).select(*[(F.lit(END) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    mark.limit(0).write.parquet(end)
    both = operator(events.union(spark.readStream.schema(mark.schema).parquet(end)))
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    run_to_table(both, name, partitions, base)
    mark.write.mode("append").parquet(end)
    return run_to_table(both, name, partitions, base)


def run_to_table(stream: DataFrame, name: str, partitions: int | None = None, base: str | None = None) -> DataFrame:
    """Run a stream over all available input into a table of the shared folder, and read it.

    The number of state partitions is fixed for the life of a stream's checkpoint; unless given it
    is the number of cores, not the shuffle setting of the session. ``base`` is the folder of a
    stream to go on with.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions or spark.sparkContext.defaultParallelism))
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/data").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def turn_sessions(events: DataFrame, keys: Sequence[str], gap: str, watermark: str, text: str) -> DataFrame:
    """Segments of one speaker that follow within the gap, as session windows."""
    parts = F.sort_array(F.collect_list(F.struct("ts", "event_id", text)))
    out = events.withWatermark("ts", watermark).groupBy(*keys, F.session_window("ts", gap)).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("pieces"), parts.alias("_p")
    )
    return out.select(*keys, "start_ts", "end_ts", "pieces", F.array_join(F.transform("_p", lambda p: p[text]), " ").alias("text"))


def live_histograms(events: DataFrame, keys: Sequence[str], value: str, edges: Sequence[float], width: str, watermark: str) -> DataFrame:
    """Cumulative bucket counts over tumbling windows."""
    v = F.col(value)
    return events.withWatermark("ts", watermark).groupBy(*keys, F.window("ts", width)).agg(
        F.count(v).alias("count"), F.sum(v).alias("sum"), *[F.count_if(v <= e).alias(f"le_{str(e).replace('.', '_')}") for e in edges]
    ).withColumn("start_ts", F.col("window.start")).drop("window")


def step_timeline(events: DataFrame, keys: Sequence[str], step: str, watermark: str, received: str, emitted: str, value: str) -> DataFrame:
    """Fixed steps with what was received and emitted in each.

    An event belongs to the step of its own time, so late text returns to its step as long as
    the watermark allows.
    """
    def side(kind: str):
        hit = F.col("event_type") == kind
        return F.struct(F.count_if(hit).alias("n"), F.max(F.when(hit, F.col(value))).alias("peak"))

    return events.withWatermark("ts", watermark).groupBy(*keys, F.window("ts", step)).agg(
        side(received).alias("received"), side(emitted).alias("emitted"), F.count_if(~F.col("event_type").isin(received, emitted)).alias("other_events")
    ).withColumn("start_ts", F.col("window.start")).drop("window")
