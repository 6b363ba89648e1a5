"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    # 10,000 long texts are too many for a Python worker, which holds a batch in several forms
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options that results or plans depend on (safe to call often)."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, so that its functions import there."""
    sc = spark.sparkContext
    if getattr(sc, "_convlake_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(os.path.join(root, "convlake")):  # not where it runs from an archive itself
        folder = tempfile.mkdtemp(prefix="convlake-")  # the driver serves the file while the application runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "convlake"), "zip", root, "convlake"))
    sc._convlake_shipped = True


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "convlake") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("CONVLAKE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shuffle_partitions(shuffled_bytes: int, target_bytes: int = 256 << 20, at_least: int = 200) -> int:
    """Value for spark.sql.shuffle.partitions so that a reduce task sorts about ``target_bytes``.

    Adaptive execution merges partitions that turn out small but cannot split plain ones, so the
    setting should follow the largest shuffle of a job.
    """
    return max(at_least, -(-shuffled_bytes // target_bytes))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to all cores, for costly work on the rows of files that make few tasks."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, named by the cluster in spark.checkpoint.dir.

    Only a local master, where no cluster folder exists, falls back to a temporary one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Cut the lineage at a result that several consumers read, through the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
