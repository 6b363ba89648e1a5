"""Field texts cut into overlapping token windows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.functions import text as T

PROFILES = ("basic", "basic_v2", "basic_ctx")

# fixed values: field names whose short texts are facts, and fields that are noise
SHORT_FACT_FIELDS = [
    r"^contact\.details\.(e_mail|room)$",
    r"^content\.language_of_instruction$",
    r"^metadata\.(code|course_name|semester)$",
    r"^content\.(lecturer|instructor|who_teaches|contact_person|code_expansion)$",
    r"^metadata\.agency$",
    r"^sections\.(type|publisher)\.text$",
    r"^year$",
]
NOISY_FIELDS = [r"^publicationresults\[\d+\]\.citation$", r"^sections\.publication_results\.text$"]


@dataclass(frozen=True)
class ChunkingConfig:
    chunk_impl: str = "basic"
    chunk_size: int = 384
    chunk_overlap: int = 64
    min_tokens: int = 20
    include_metadata_header: bool = False
    v2_short_field_min_tokens: int = 1
    v2_drop_noisy_fields: bool = True
    context_max_tokens: int = 48

    def __post_init__(self):
        if self.chunk_impl not in PROFILES:
            raise ValueError(f"unknown profile {self.chunk_impl}")
        if self.chunk_size <= 0:
            raise ValueError("chunk_size must be positive")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be in [0, chunk_size)")


def _matches(field: Column, patterns: list[str]) -> Column:
    return field.rlike("|".join(f"(?:{p})" for p in patterns))


def is_short_fact(field: Column) -> Column:
    return _matches(field, SHORT_FACT_FIELDS)


def is_noisy(field: Column) -> Column:
    return _matches(field, NOISY_FIELDS)


def classify_fields(df: DataFrame, field: str = "source_field") -> DataFrame:
    c = F.col(field)
    return df.withColumn("short_fact", is_short_fact(c)).withColumn("noisy", is_noisy(c))


def min_tokens(cfg: ChunkingConfig, field: Column) -> Column:
    """Smallest token count a field may have; lowered for short facts in the later profiles."""
    if cfg.chunk_impl == "basic":
        return F.lit(cfg.min_tokens)
    return F.when(is_short_fact(field), max(1, cfg.v2_short_field_min_tokens)).otherwise(cfg.min_tokens)


def min_token_filter(df: DataFrame, cfg: ChunkingConfig, text: str = "text", field: str = "source_field") -> DataFrame:
    return df.filter(F.size(T.tokens(F.col(text))) >= min_tokens(cfg, F.col(field)))


def window_count(n: Column, size: int, overlap: int) -> Column:
    stride = size - overlap
    return F.when(n <= 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / stride) + 1).cast("int")


def token_windows(df: DataFrame, tokens: str, size: int, overlap: int) -> DataFrame:
    """One row per window of ``size`` tokens; a row-local explode, no shuffle."""
    ChunkingConfig(chunk_size=size, chunk_overlap=overlap)
    n = window_count(F.size(tokens), size, overlap)
    windows = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.slice(tokens, i * (size - overlap) + 1, F.lit(size))
    )
    return df.filter(F.size(tokens) > 0).select("*", F.posexplode(windows).alias("chunk_index", "window")).drop(tokens)


def default_header(df: DataFrame) -> Column:
    return F.concat(
        F.lit("[ENTITY="), "entity_type", F.lit("] [ID="), "entity_id", F.lit("] [FIELD="), "source_field", F.lit("]")
    )


def entity_context(entity_type: Column, entity_id: Column, **pairs: Column) -> Column:
    """``k=v`` list joined by pipes; null values are skipped."""
    parts = [F.concat(F.lit("entity_type="), entity_type), F.concat(F.lit("entity_id="), entity_id)]
    parts += [F.concat(F.lit(f"{k}="), v) for k, v in pairs.items()]
    return F.concat_ws(" | ", *parts)


def build_chunks(
    records: DataFrame,
    cfg: ChunkingConfig = ChunkingConfig(),
    header: Callable[[DataFrame], Column] = default_header,
) -> DataFrame:
    """Field-text records to chunk records.

    ``records``: entity_type, entity_id, source_path, source_field, text, entity_context.
    Filters come before the windows; the whole plan is narrow.
    """
    df = records
    if cfg.chunk_impl != "basic" and cfg.v2_drop_noisy_fields:
        df = df.filter(~is_noisy(F.col("source_field")))
    # a one-element explode pins the tokens: filter and windows below read them, not the regex
    df = df.select("*", F.explode(F.array(T.tokens(F.col("text")))).alias("_tokens"))
    df = df.filter(F.size("_tokens") >= min_tokens(cfg, F.col("source_field")))
    df = token_windows(df, "_tokens", cfg.chunk_size, cfg.chunk_overlap)
    body = F.array_join("window", " ")
    if cfg.chunk_impl == "basic_ctx":
        ctx = T.strip(T.truncate_tokens(F.coalesce("entity_context", F.lit("")), cfg.context_max_tokens))
        prefix = F.concat(F.lit("[CONTEXT] "), ctx, F.lit(" [FIELD="), "source_field", F.lit("]\n"))
        body = F.when(ctx != "", F.concat(prefix, body)).otherwise(body)
    df = df.withColumn("chunk_text", body)
    embed = F.concat(header(df), F.lit("\n"), F.col("chunk_text")) if cfg.include_metadata_header else F.col("chunk_text")
    return df.select(
        F.concat_ws(":", F.lower("entity_type"), "entity_id", "source_field", F.col("chunk_index").cast("string")).alias("chunk_id"),
        "entity_type", "entity_id", "source_path", "source_field", "chunk_index",
        F.size("window").alias("token_count"), "chunk_text", embed.alias("embedding_text"),
    )


def chunk_summary(chunks: DataFrame, top_fields: int = 10) -> DataFrame:
    """Total, counts per entity type, and the most frequent fields as (section, name, chunks)."""
    base = chunks.groupBy("entity_type", "source_field").agg(F.count(F.lit(1)).alias("n"))
    total = base.agg(F.sum("n").alias("chunks")).select(F.lit("total").alias("section"), F.lit("all").alias("name"), "chunks")
    types = base.groupBy(F.col("entity_type").alias("name")).agg(F.sum("n").alias("chunks"))
    fields = base.groupBy(F.col("source_field").alias("name")).agg(F.sum("n").alias("chunks"))
    fields = fields.orderBy(F.desc("chunks"), "name").limit(top_fields)
    return total.unionByName(types.select(F.lit("entity_type").alias("section"), "name", "chunks")).unionByName(
        fields.select(F.lit("field").alias("section"), "name", "chunks")
    )


def duplicate_chunk_ids(chunks: DataFrame) -> DataFrame:
    """Ids carried by more than one chunk (two source files with one entity id)."""
    return chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def attach_chunks(hits: DataFrame, chunks: DataFrame, order: str) -> DataFrame:
    """Left join by chunk id; among chunks with one id the last in ``order`` counts.

    Chunks are cut to the ids that were hit before the duplicates are resolved.
    """
    rest = [c for c in chunks.columns if c not in ("chunk_id", order)]
    wanted = chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    last = wanted.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), order).alias("_c"))
    return hits.join(last, "chunk_id", "left").select(*hits.columns, *[F.col(f"_c.{c}").alias(c) for c in rest])


def run_manifest(chunks: DataFrame, cfg: ChunkingConfig, artifacts: dict[str, str], previous: DataFrame | None = None) -> DataFrame:
    """One row (config, artifacts, stats as maps); keys of a previous manifest are kept."""
    conf = F.create_map(*[F.lit(str(x)) for kv in sorted(asdict(cfg).items()) for x in kv])
    arts = F.create_map(*[F.lit(x) for kv in sorted(artifacts.items()) for x in kv])
    row = chunks.agg(
        F.count(F.lit(1)).alias("chunks_total"),
        F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens_total"),
    ).select(
        conf.alias("chunking"), arts.alias("artifacts"),
        F.create_map(F.lit("chunks_total"), "chunks_total", F.lit("tokens_total"), "tokens_total").alias("stats"),
    )
    if previous is None:
        return row

    def merged(new: str, old: str) -> Column:
        kept = F.map_filter(F.col(old), lambda k, v: ~F.map_contains_key(F.col(new), k))
        return F.coalesce(F.map_concat(kept, F.col(new)), F.col(new))

    old = previous.select(*[F.col(c).alias(f"_{c}") for c in ("artifacts", "stats")]).withColumn("_one", F.lit(1))
    both = row.withColumn("_one", F.lit(1)).join(old, "_one", "left")
    return both.select("chunking", merged("artifacts", "_artifacts").alias("artifacts"), merged("stats", "_stats").alias("stats"))
