"""Retrieval hit rates and answer grades, from per-question rows to report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.functions import text as T

RATES = ["entity_hit_rate", "field_hit_rate", "answer_hit_rate", "any_hit_rate", "entity_mrr"]


def question_hits(results: DataFrame, questions: DataFrame, ks: Sequence[int], techniques: Sequence[str]) -> DataFrame:
    """One row per (technique, question, k): hit flags and the first rank of a target entity.

    ``results``: technique, item_id, rank, entity_id, source_field, preview.
    ``questions``: item_id, dataset, entity_targets, answer_targets, answer_field. All questions
    of a technique count, also those without results.
    """
    q = questions.withColumn("hints", T.answer_field_hints(F.col("answer_field")))
    entity = T.match_normal_form(F.col("entity_id"))
    hit = results.filter(F.col("rank") <= max(ks)).join(q.select("item_id", "entity_targets", "answer_targets", "hints"), "item_id")
    hit = hit.select(
        "technique", "item_id", "rank",
        ((entity != "") & F.array_contains("entity_targets", entity)).alias("e"),
        T.field_hit(F.col("source_field"), F.col("hints")).alias("f"),
        T.answer_hit(F.col("preview"), F.col("entity_id"), F.col("source_field"), F.col("answer_targets")).alias("a"),
    )
    first = hit.groupBy("technique", "item_id").agg(
        *[F.min(F.when(F.col(c), F.col("rank"))).alias(f"{c}_rank") for c in "efa"]
    )
    base = q.select("item_id", "dataset", "entity_targets", F.explode(F.array(*[F.lit(x) for x in techniques])).alias("technique"))
    rows = base.join(first, ["technique", "item_id"], "left")
    rows = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))

    def within(c: str) -> Column:
        return F.coalesce(F.col(f"{c}_rank") <= F.col("k"), F.lit(False))

    return rows.select(
        "technique", "dataset", "item_id", "k", (F.size("entity_targets") > 0).alias("mapped"),
        within("e").alias("entity_hit"), within("f").alias("field_hit"), within("a").alias("answer_hit"),
        (within("e") | within("f") | within("a")).alias("any_hit"),
        F.when(within("e"), 1 / F.col("e_rank")).otherwise(0.0).alias("rr"),
    )


def _rate(c: str) -> Column:
    return F.avg(F.col(c).cast("double"))


def hit_rates(hits: DataFrame) -> DataFrame:
    """Rates per technique, k and dataset, and over all datasets (``overall``)."""
    return (
        hits.groupingSets([["technique", "k"], ["technique", "k", "dataset"]], "technique", "k", "dataset")
        .agg(
            F.grouping("dataset").alias("_all"), F.count(F.lit(1)).alias("questions"),
            _rate("entity_hit").alias("entity_hit_rate"), _rate("field_hit").alias("field_hit_rate"),
            _rate("answer_hit").alias("answer_hit_rate"), _rate("any_hit").alias("any_hit_rate"),
            F.avg("rr").alias("entity_mrr"),
        )
        .withColumn("dataset", F.when(F.col("_all") == 1, "overall").otherwise(F.col("dataset")))
        .drop("_all")
    )


def mapped_hit_rates(hits: DataFrame) -> DataFrame:
    """As ``hit_rates`` for entity and field, over questions that have a target entity."""

    def rate(c: str) -> Column:
        return F.avg(F.when(F.col("mapped"), F.col(c).cast("double")))

    return (
        hits.groupingSets([["technique", "k"], ["technique", "k", "dataset"]], "technique", "k", "dataset")
        .agg(
            F.grouping("dataset").alias("_all"), F.count(F.lit(1)).alias("total"), F.count_if("mapped").alias("mapped"),
            rate("entity_hit").alias("entity_hit_rate"), rate("field_hit").alias("field_hit_rate"), rate("rr").alias("entity_mrr"),
        )
        .withColumn("dataset", F.when(F.col("_all") == 1, "overall").otherwise(F.col("dataset")))
        .drop("_all")
    )


def bucket_macro_mean(rates: DataFrame, metrics: Sequence[str] = tuple(RATES)) -> DataFrame:
    """Unweighted mean of the dataset rates in each bucket; ``overall`` is the pooled rate."""
    named = rates.withColumn("bucket", F.when(F.col("dataset") == "overall", "overall").otherwise(T.dataset_bucket(F.col("dataset"))))
    return named.groupBy("technique", "k", "bucket").agg(*[F.avg(m).alias(m) for m in metrics])


def rate_table(macro: DataFrame, metric: str) -> DataFrame:
    """Technique and k by bucket, one column per bucket of the fixed list."""
    cols = ["overall", *T.DATASET_BUCKETS]
    return macro.groupBy("technique", "k").pivot("bucket", cols).agg(F.first(metric))


def judge_rows(rows: DataFrame) -> DataFrame:
    """Mean top-1 and top-5 scores per (generator, judge, bucket) and overall, in long form.

    ``rows``: generator, judge, dataset, top1_score, top5_score as text; scores that are not
    numbers are skipped.
    """
    long = rows.select(
        "generator", "judge", T.dataset_bucket(F.col("dataset")).alias("bucket"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("score_of"), F.col(c).try_cast("double").alias("score")) for n, c in (("top1", "top1_score"), ("top5", "top5_score"))])).alias("s"),
    ).select("generator", "judge", "bucket", "s.*").filter(F.col("score").isNotNull())
    keys = ["generator", "judge", "score_of"]
    return (
        long.groupingSets([keys, [*keys, "bucket"]], *keys, "bucket")
        .agg(F.grouping("bucket").alias("_all"), F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", F.when(F.col("_all") == 1, "overall").otherwise(F.col("bucket")))
        .drop("_all")
    )


def grade_answers(rows: DataFrame, answers: Sequence[str] = ("top1", "top5")) -> DataFrame:
    """Score every ``<a>_answer`` against ``expected_answer``; equal yes/no forms grade as 5."""
    out = rows
    for a in answers:
        ans, exp = F.col(f"{a}_answer"), F.col("expected_answer")
        out = out.withColumn(f"{a}_binary_override", T.binary_override(exp, ans))
        out = out.withColumn(f"{a}_score", F.when(F.col(f"{a}_binary_override"), 5.0).otherwise(T.lexical_grade(ans, exp)))
    return out


def grade_summary(graded: DataFrame) -> DataFrame:
    """Mean and population standard deviation per topic; the row ``overall`` adds macro means."""
    topics = graded.groupBy("topic").agg(
        F.count(F.lit(1)).alias("questions"),
        *[f(f"{a}_score").alias(f"{a}_{n}") for a in ("top1", "top5") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))],
    )
    macro = topics.agg(*[F.avg(f"{a}_mean").alias(f"{a}_macro_mean") for a in ("top1", "top5")]).withColumn("topic", F.lit("overall"))
    total = graded.agg(
        F.count(F.lit(1)).alias("questions"),
        *[f(f"{a}_score").alias(f"{a}_{n}") for a in ("top1", "top5") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))],
    ).withColumn("topic", F.lit("overall"))
    return topics.unionByName(total).join(macro, "topic", "left")


def category_scores(rows: DataFrame, prefix: str) -> DataFrame:
    """Count and means per dataset, per category derived from its name, and overall."""
    named = rows.withColumn("category", T.category_of(F.col("dataset"), prefix))
    return (
        named.groupingSets([["dataset"], ["category"], []], "dataset", "category")
        .agg(
            F.grouping("dataset").alias("_d"), F.grouping("category").alias("_c"), F.count(F.lit(1)).alias("n"),
            F.avg("top1_score").alias("top1_mean"), F.avg("top5_score").alias("top5_mean"),
        )
        .select(
            F.when(F.col("_d") == 0, "dataset").when(F.col("_c") == 0, "category").otherwise("overall").alias("level"),
            F.coalesce("dataset", "category", F.lit("all")).alias("name"), "n", "top1_mean", "top5_mean",
        )
    )


def benchmark_responses(items: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with their output text in both answer slots, items without an output)."""
    found = items.join(outputs, "item_id").withColumn("answer", T.strip(F.col("output_text")))
    responses = found.select(
        *items.columns, F.struct(F.col("answer").alias("top1_answer"), F.col("answer").alias("top5_answer")).alias("answers")
    )
    return responses, items.join(outputs, "item_id", "left_anti")


def explode_items(files: DataFrame, schema: str) -> DataFrame:
    """(path, body) of benchmark files to one row per item; an id in two files keeps the last.

    The dataset is the folder of the file, the fallback topic its stem.
    """
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.json$", "")
    rows = files.select(
        "path", F.element_at(parts, -2).alias("dataset"), stem.alias("json_type"),
        F.posexplode(F.from_json("body", f"struct<items:array<{schema}>>")["items"]).alias("pos", "item"),
    ).select("path", "pos", "dataset", "json_type", F.col("item.id").alias("item_id"), "item.question", "item.expected_answer", F.coalesce("item.type", "json_type").alias("topic"))
    rest = ["question", "expected_answer", "dataset", "topic", "json_type"]
    return rows.groupBy("item_id").agg(F.max_by(F.struct(*rest), F.struct("path", "pos")).alias("r")).select("item_id", "r.*")


def dedupe_by_question(items: DataFrame, order: str, question: str = "question") -> DataFrame:
    """One row per question text: place of its first item, content of its last."""
    rest = [c for c in items.columns if c not in (order, question)]
    return items.groupBy(question).agg(F.min(order).alias(order), F.max_by(F.struct(*rest), order).alias("_r")).select(question, order, *[F.col(f"_r.{c}").alias(c) for c in rest])


def format_context(hits: DataFrame, key: str, compact: bool = True) -> DataFrame:
    """Ranked context lines per key; ``compact`` cleans previews, drops repeats, renumbers.

    ``hits``: key, rank, score, source_path, preview, at most a top-k per key.
    """
    if compact:
        rows = hits.withColumn("line", T.clean_preview(F.trim("preview")))
        rows = rows.groupBy(key, "line").agg(F.min("rank").alias("rank"))
        lines = F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
        out = F.transform(lines, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x))
    else:
        line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] score="), F.col("score").cast("string"), F.lit(" source="), F.col("source_path"), F.lit(" :: "), F.trim("preview"))
        rows = hits.select(key, "rank", line.alias("line"))
        out = F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    return rows.groupBy(key).agg(F.array_join(out, "\n").alias("context"))


def reranker_gate(context: Column, error: Column, top_score: Column, threshold: float = 0.40) -> Column:
    """Null if the context can be used, else the reason why not."""
    return (
        F.when(error.isNotNull() & (error != ""), "rag_error")
        .when(F.coalesce(context, F.lit("")) == "", "empty_results")
        .when(F.coalesce(top_score, F.lit(0.0)) < threshold, "below_min_score")
    )
