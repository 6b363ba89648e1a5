"""Streams replayed in several micro-batches give the rows of their batch twins."""

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from convlake import workloads
from convlake.streaming import signals as SG
from convlake.streaming import windows as SW
from convlake.streaming.ordered import PACKED_ROWS, Machine, OrderedProcessor, PackedProcessor, fold_sorted, run_stream

SCHEMA = "k string, ts_us long, id long, kind string, value double"


def write_events(spark, path, kinds, seed, n=240):
    """Events of three keys in six files; a key's rows are out of order inside a file."""
    rng = random.Random(seed)
    rows, at = [], 1_000_000_000
    for i in range(n):
        at += rng.randrange(1_000, 900_000)
        rows.append((rng.choice(["a", "a", "b", "c"]), at, i, rng.choice(kinds), rng.random()))
    step = n // 6
    for f in range(6):
        part = rows[f * step : (f + 1) * step]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
    return spark.createDataFrame(rows, SCHEMA), rows[-1][1]


def replay(spark, path, machine, name):
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))
    src = src.withColumn("ts", F.timestamp_micros("ts_us"))
    return SW.run_to_table(run_stream(src, machine, "k", watermark="300 seconds"), name)


CASES = {
    "pause": (["step", "step", "step", "word", "bot"], lambda: SG.pause_machine(0.05, 0.2, wait=3)),
    "trigger": (["prob", "prob", "word", "bot"], lambda: SG.anticipation_machine(0.3, 3_000_000)),
    "speculation": (["trigger", "chunk", "chunk", "pause", "interrupt"], lambda: SG.speculation_machine(960_000, 5_000_000)),
    "silence": (["waiting", "user"], lambda: SG.silence_machine(2_000_000)),
}


@pytest.mark.parametrize("name", CASES)
def test_stream_equals_fold(spark, tmp_path, name):
    kinds, make = CASES[name]
    table, last = write_events(spark, tmp_path / "in", kinds, seed=len(name))
    # a later row of another key moves the watermark past all others
    spark.createDataFrame([("zz", last + 10**10, 10**6, "none", 0.0)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in replay(spark, tmp_path / "in", make(), name).filter("k <> 'zz'").collect())
    want = sorted(tuple(r) for r in fold_sorted(table, make(), ["k"], until=last + 10**9).collect())
    assert [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got] == [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in want]
    assert want


def test_islands_equal_whole_streams(spark, tmp_path):
    table, last = write_events(spark, tmp_path / "in", CASES["pause"][0], seed=9)
    whole = fold_sorted(table, SG.pause_machine(0.05, 0.2, wait=30), ["k"]).collect()
    cut = fold_sorted(SG.message_islands(table, "k", ["ts_us", "id"]), SG.pause_machine(0.05, 0.2, wait=30), ["k", "island"]).drop("island").collect()
    key = lambda r: (r.k, r.id, r.kind, None if r.ema is None else round(r.ema, 9), r.pause)
    assert sorted(map(key, whole), key=str) == sorted(map(key, cut), key=str)
    fold = fold_sorted(table.withColumn("kind", F.when(F.col("kind") == "step", "prob").otherwise(F.col("kind"))), SG.anticipation_machine(0.3, 3_000_000), ["k"])
    scan = SG.anticipation_decisions(table.withColumn("kind", F.when(F.col("kind") == "step", "prob").otherwise(F.col("kind"))), "k", ["ts_us", "id"], 0.3, 3_000_000)
    assert sorted(map(tuple, fold.collect())) == sorted(map(tuple, scan.collect()))


def test_outcomes_equal_machine(spark, tmp_path):
    table, last = write_events(spark, tmp_path / "in", CASES["speculation"][0], seed=12)
    until = last + 10**9
    log = fold_sorted(table, SG.speculation_machine(960_000, 5_000_000), ["k"], until=until)
    final = log.groupBy("k", "attempt").agg(F.max_by(F.struct("status", "status_reason"), "seq").alias("s")).select("k", "attempt", "s.*")
    closed = SG.speculation_outcomes(table, "k", ["ts_us", "id"], 960_000, 5_000_000, until).select("k", "attempt", "status", "status_reason")
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, closed.collect()))


def test_word_stream(spark, tmp_path):
    text = "foo  bar\nbaz"
    rows = [("a", 10_000_000 + i * 1000, i, text[i : i + 3]) for i in range(0, len(text), 3)] + [("z", 10**9, 99, "x")]
    spark.createDataFrame(rows, "k string, ts_us long, id long, text string").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("k string, ts_us long, id long, text string").parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_micros("ts_us"))
    got = SW.run_to_table(run_stream(src, SG.words_machine(), "k"), "words").filter("k = 'a'").orderBy("word_idx").collect()
    assert [r.word for r in got] == ["foo", " bar", " baz"]


class Map(dict):
    """Map state that notes which buckets are read."""

    reads: list[int]

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        self.reads.append(key[0])
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Handle:
    def __init__(self):
        self.map, self.value, self.timers = Map(), Value(), set()
        self.map.reads = []

    def getMapState(self, *_):
        return self.map

    def getValueState(self, *_):
        return self.value

    def registerTimer(self, at):
        self.timers.add(at)


class At:
    def __init__(self, now, watermark):
        self.now, self.watermark = now, watermark

    def getExpiryTimeInMs(self):
        return self.now

    def getCurrentWatermarkInMs(self):
        return self.watermark


@pytest.mark.parametrize("bucket_ms", [50, 1000, 60_000])
@pytest.mark.parametrize("name", CASES)
def test_timers_read_due_buckets_only(name, bucket_ms):
    """Fifty batches of one key: each row is read from state by the firings of its bucket, never with the others."""
    kinds, make = CASES[name]
    rng, machine = random.Random(name), make()
    rows, at = [], 10**9
    for i in range(2000):
        at += rng.randrange(1_000, 400_000)
        rows.append((at, i, rng.choice(kinds), rng.random())[: len(machine.columns)])
    schema = StructType([StructField(c, LongType()) for c in machine.columns])
    names = [c.split()[0] for c in machine.output.split(", ")]
    processor, handle, got = OrderedProcessor(machine, "k", schema, names, bucket_ms), Handle(), []
    processor.init(handle)
    watermark, most = 0, 0
    for k in range(0, 2000, 40):
        batch = rows[k : k + 40]
        rng.shuffle(batch)
        list(processor.handleInputRows(("a",), iter([pd.DataFrame(batch, columns=machine.columns)]), None))
        watermark = max(r[0] for r in batch) // 1000 - 500 if k < 1960 else 10**12
        while handle.timers and min(handle.timers) <= watermark:
            now = min(handle.timers)
            handle.timers.remove(now)
            handle.map.reads.clear()
            for pdf in processor.handleExpiredTimer(("a",), At(now, watermark), At(now, watermark)):
                got += pdf.itertuples(index=False, name=None)
            most = max(most, len(set(handle.map.reads)))
        # what still waits has a timer of its bucket ahead
        assert all(any(t // bucket_ms == b[0] and t >= r[0] // 1000 for t in handle.timers) for b, v in handle.map.items() for r in v[0])
    state, want = dict(machine.initial), []
    for row in rows:
        want += machine.run(state, row)
    want += machine.tick(state, 10**15)
    assert [tuple(None if x != x else x for x in r[1:]) for r in got] == want and want
    # a firing reads its bucket, and for a deadline the buckets up to it
    assert most <= 2 + 5_000_000 // 1000 // bucket_ms and not handle.map


def test_a_firing_gives_two_columns_and_reads_its_bucket_once():
    """Spark converts a firing's frame column by column, and each read of state is a round trip."""
    machine, handle = SG.speculation_machine(1_000, 5_000_000), Handle()
    names = [c.split()[0] for c in machine.output.split(", ")]
    processor = PackedProcessor(machine, "k", StructType([StructField(c, LongType()) for c in machine.columns]), names, 60_000)
    processor.init(handle)
    asked, has = [], handle.map.containsKey
    handle.map.containsKey = lambda key: asked.append(key[0]) or has(key)
    # the last trigger's window ends after its row, within the bucket and before the watermark
    rows = [(10**9 + i, i, "chunk" if i % 2 else "trigger") for i in range(PACKED_ROWS)] + [(10**9 + 10**6, 10**6, "trigger")]
    list(processor.handleInputRows(("a",), iter([pd.DataFrame(rows, columns=machine.columns)]), None))
    now = max(handle.timers)
    asked.clear()
    (pdf,) = processor.handleExpiredTimer(("a",), At(now, now + 50), At(now, now + 50))
    state, want = dict(machine.initial), []
    for row in rows:
        want += machine.run(state, row)
    want += machine.tick(state, (now + 50) * 1000)
    assert list(pdf.columns) == ["k", "_rows"] and list(pdf["k"]) == ["a", "a"]
    assert [tuple(r.values()) for text in pdf["_rows"] for r in json.loads(text)] == want and len(want) > PACKED_ROWS
    assert asked == handle.map.reads == [rows[0][0] // 1000 // 60_000]


def test_odd_values_through_a_stream(spark, tmp_path):
    """Nulls, quotes, line ends, signs beyond 16 bits, wide integers and fractions arrive as they were put out."""
    texts = ['a "quoted" \\ text\n', "\U0001f600 ü \u2028", "", None, "\x00\x1f"]
    values = [0.1 + 0.2, None, -0.0, 1e-310, 1.7976931348623157e308]
    machine = Machine(
        lambda state, row: [((1 << 63) - 1 - row[1], values[row[1]], texts[row[1]], None if row[1] == 1 else row[1] > 2)],
        ["ts_us", "id"], "big bigint, value double, text string, flag boolean",
    )
    rows = [(2, 10**9 + i, i) for i in range(5)] + [(3, 10**12, 0)]
    spark.createDataFrame(rows, "k long, ts_us long, id long").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("k long, ts_us long, id long").parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_micros("ts_us"))
    got = SW.run_to_table(run_stream(src, machine, "k"), "odd").where("k = 2").orderBy(F.desc("big")).collect()
    assert [repr(tuple(r)) for r in got] == [repr((2, (1 << 63) - 1 - i, values[i], texts[i], None if i == 1 else i > 2)) for i in range(5)]


TWINS = {"t1_pause_ema": "t1_pause_ema_batch", "t2_anticipation_trigger": "t2_anticipation_batch", "t3_speculation_lifecycle": "t3_speculation_batch"}


@pytest.mark.parametrize("name", TWINS)
def test_twelve_batches_equal_the_twin(spark, tmp_path, monkeypatch, name):
    """The registered streams, fed by twelve files one at a time, give the rows of their batch twins."""
    base = "/root/testdata/sf0.001"
    whole = spark.read.parquet(f"{base}/events.parquet")
    in_files(whole, "ts", tmp_path / "in")

    def source(t):
        return SW.stream_events(t.spark, str(tmp_path / "in"), whole.schema, files_per_batch=1).withColumn("ts_us", F.unix_micros("ts"))

    monkeypatch.setattr(workloads.streams, "stream", source)
    rounded = lambda df: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.select(*sorted(df.columns)).collect())
    got = rounded(workloads.QUERIES[name](spark, base))
    assert got == rounded(workloads.QUERIES[TWINS[name]](spark, base)) and got


def in_files(df, order, path, n=12):
    """``df`` in ``n`` files by ranges of ``order``, written one after the other."""
    df.repartitionByRange(n, order).sortWithinPartitions(order).write.parquet(str(path))
    parts = sorted(path.glob("*.parquet"))
    assert len(parts) >= 10
    for k, part in enumerate(parts):  # a source reads files in the order of their times
        os.utime(part, (1_000_000 + k, 1_000_000 + k))


def test_words_in_twelve_batches(spark, tmp_path):
    rng = random.Random(4)
    rows, at = [], 10**9
    for i in range(600):
        at += rng.choice([1000, 30_000, 2_500_000])
        rows.append((rng.choice("abc"), at, i, "".join(rng.choices("xyz \n", k=rng.randrange(1, 8)))))
    schema = "k string, ts_us long, id long, text string"
    table = spark.createDataFrame(rows, schema)
    in_files(table, "ts_us", tmp_path / "in")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_micros("ts_us"))
    got = SW.run_to_end(src, lambda r: run_stream(r, SG.words_machine(), "k"), "words").collect()
    want = fold_sorted(table, SG.words_machine(), ["k"], until=10**15).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


@pytest.mark.parametrize("folder", [False, True])
def test_tables_as_files_or_folders(spark, tmp_path, folder):
    import pyarrow.parquet as pq

    for table, files in (("conversations", 3), ("events", 2)):
        data = pq.read_table(f"/root/testdata/sf0.001/{table}.parquet").slice(0, 60)
        (tmp_path / f"{table}.parquet").mkdir() if folder else pq.write_table(data, tmp_path / f"{table}.parquet")
        for i in range(files if folder else 0):
            pq.write_table(data.slice(i * 60 // files, 60 // files), tmp_path / f"{table}.parquet" / f"part-{i}.parquet")
    words = spark.read.parquet(f"{tmp_path}/conversations.parquet").select(F.explode(F.split(F.trim("text"), r"\s+")))
    assert workloads.QUERIES["t5_rechunk_stream"](spark, str(tmp_path)).count() == words.count() > 100
    got = workloads.QUERIES["t9_live_histograms"](spark, str(tmp_path)).agg(F.sum("count")).first()[0]
    assert got == 60
