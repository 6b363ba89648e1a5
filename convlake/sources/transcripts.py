"""Transcript sources: timed lines, dialogue logs, table-of-files corpora, timing traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.functions import text as T


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def parse_timed_lines(lines: DataFrame, fmt: str = "colon") -> DataFrame:
    """(path, value) lines to (path, start_s, end_s, speaker, text).

    ``colon``: ``start end SPK: text``, header lines start with ``#``. ``tab``: four columns.
    """
    v = F.col("value")
    if fmt == "colon":
        rows = lines.filter(~v.startswith("#") & (F.trim(v) != ""))
        p = F.split(v, " ", 4)
        speaker = F.trim(p[2], F.lit(":"))
    elif fmt == "tab":
        rows = lines.filter(F.trim(v) != "")
        p = F.split(v, "\t", 4)
        speaker = p[2]
    else:
        raise ValueError(f"unknown format {fmt}")
    return rows.select("path", F.round(p[0].cast("double"), 4).alias("start_s"), F.round(p[1].cast("double"), 4).alias("end_s"), speaker.alias("speaker"), T.strip(p[3]).alias("text"))


def read_timed_lines(spark: SparkSession, path: str, fmt: str = "colon") -> DataFrame:
    return parse_timed_lines(_lines(spark, path), fmt)


DIALOG = "struct<log:array<struct<tag:string,text:string,words:array<struct<BeginTime:double,EndTime:double>>>>>"


def read_dialog_turns(logs: DataFrame, id: str, body: str) -> DataFrame:
    """Nested dialogue logs (JSON text) to one segment per turn, times in seconds."""
    rows = logs.select(id, F.posexplode(F.from_json(body, DIALOG)["log"]).alias("seg", "u"))
    return rows.select(
        id, "seg", F.col("u.tag").alias("turn"), (F.col("u.words")[0]["BeginTime"] / 1000).alias("start_s"),
        (F.element_at("u.words", -1)["EndTime"] / 1000).alias("end_s"), F.col("u.text").alias("text"),
    )


def assemble_kaldi(text: DataFrame, segments: DataFrame, wav: DataFrame, drop_keyword: str, keep_keyword: str) -> DataFrame:
    """Join the three line files of a corpus (each a ``value`` column).

    ``text``: ``utt words…``; ``segments``: ``utt rec-CH start end``; ``wav``: a line whose
    last but one word is the recording path. Recordings whose path holds ``drop_keyword`` and
    utterances without ``keep_keyword`` in their id are left out.
    """
    v = F.col("value")
    t = text.select(F.substring_index(v, " ", 1).alias("utt"), F.regexp_replace(v, r"^\S+ ?", "").alias("text")).filter(F.col("utt").contains(keep_keyword))
    s = F.split(F.trim(v), r"\s+")
    g = segments.select(s[0].alias("utt"), F.split_part(s[1], F.lit("-"), F.lit(1)).alias("rec"), F.split_part(s[1], F.lit("-"), F.lit(-1)).alias("channel"), s[2].cast("double").alias("start_s"), s[3].cast("double").alias("end_s"))
    path = F.element_at(F.split(F.trim(v), r"\s+"), -2)
    w = wav.select(path.alias("audio")).filter(~F.col("audio").contains(drop_keyword))
    w = w.withColumn("rec", F.regexp_replace(F.substring_index("audio", "/", -1), r"\.[^.]*$", ""))
    return t.join(g, "utt").join(w, "rec").select("rec", "channel", "utt", "start_s", "end_s", "text", "audio")


TRACE = (
    "struct<generations:array<struct<generation_index:int,status:string,start_trigger:string,vad_pause_detected_sec:double,"
    "llm_generation_started_sec:double,llm_first_token_sec:double,tts_generation_started_sec:double,"
    "tts_first_token_received_sec:double,tts_first_audio_chunk_received_sec:double>>,"
    "speculation_attempts:array<struct<attempt_index:int,trigger_time_sec:double,status:string,status_reason:string,"
    "committed_time_sec:double,vad_pause_detected_sec:double,committed_prefix_drain_started_sec:double,"
    "committed_prefix_drain_finished_sec:double,buffered_audio_chunks:int,rag_top_k_output:array<struct<rank:int,score:double>>>>,"
    "vad_pause_detection_times_sec:array<double>>"
)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """One trace per file: (item, body) with the item named by the folder of the file."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.timings.json").text(path, wholetext=True)
    return files.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("item"), F.col("value").alias("body"))


TRACE_ROWS = {"generations": "generations", "attempts": "speculation_attempts", "pauses": "vad_pause_detection_times_sec"}


def trace_rows(traces: DataFrame) -> DataFrame:
    """(item, body) to (item, kind, pos, generations, attempts, pauses): the elements of all three lists from one reading.

    ``kind`` names the column that holds the element; the others are null.
    """
    t = traces.select("item", F.from_json("body", TRACE).alias("t"))
    kinds = {k: t.schema["t"].dataType[f].dataType.elementType for k, f in TRACE_ROWS.items()}

    def rows(kind: str):
        def row(x, pos):
            held = [(x if k == kind else F.lit(None).cast(of)).alias(k) for k, of in kinds.items()]
            return F.struct(F.lit(kind).alias("kind"), pos.alias("pos"), *held)

        return F.coalesce(F.transform(f"t.{TRACE_ROWS[kind]}", row), F.array())

    return t.select("item", F.explode(F.concat(*[rows(k) for k in kinds])).alias("r")).select("item", "r.*")


def explode_traces(traces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(item, body) to the tables generations, attempts, and pause times."""
    t = traces.select("item", F.from_json("body", TRACE).alias("t"))

    def rows(field: str) -> DataFrame:
        return t.select("item", F.posexplode(f"t.{field}").alias("pos", "r"))

    pauses = rows("vad_pause_detection_times_sec").select("item", "pos", F.col("r").alias("pause_s"))
    return rows("generations").select("item", "pos", "r.*"), rows("speculation_attempts").select("item", "pos", "r.*"), pauses


def compact_columns(traces: DataFrame, generation_keys: list[str], attempt_keys: list[str]) -> DataFrame:
    """Traces reduced to the named fields of each generation and attempt."""

    def cut(arr: str, names: list[str]):
        return F.transform(arr, lambda g: F.struct(*[g[n].alias(n) for n in names]))

    t = traces.select("item", F.from_json("body", TRACE).alias("t"))
    return t.select(
        "item", F.col("t.vad_pause_detection_times_sec").alias("vad_pause_detection_times_sec"),
        cut("t.generations", generation_keys).alias("generations"), cut("t.speculation_attempts", attempt_keys).alias("speculation_attempts"),
    )
