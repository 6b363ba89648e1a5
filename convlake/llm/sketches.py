"""Document fingerprints as threshold-scaled sketches, in DataFrame functions only.

A sketch keeps every distinct shingle hash below a fixed fraction (1 / ``scale``) of the hash range,
so its size follows the text and two sketches compare over the same part of the range, however
unequal the texts. The share of a sketch's hashes that another holds estimates the containment of
its text. A text with shingles but none below the fraction keeps its least hash. The sketch of a
union of texts is ``merged`` from their sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.llm.common import numbered, words_of

LEAST = -(1 << 63)  # hashes are kept with the sign bit turned, so that signed order is their unsigned order


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _below(hashes: Column, scale: int) -> Column:
    low = F.filter(hashes, lambda h: h < F.lit(LEAST + (1 << 64) // scale))
    return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(low)


def sketch(text: Column, words: int = 5, scale: int = 8) -> Column:
    """Ascending distinct hashes (array of long) of the text's word shingles below the fraction.

    Shingles are ``words`` consecutive words ``[^\\x20\\x09-\\x0D]+``, joined by one space, of the text as
    it is; a shorter text is one shingle; null and texts without words have an empty sketch.
    """
    shingle = lambda w, i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(words)), " ")).bitwiseXOR(F.lit(LEAST))
    every = _with(words_of(text), lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1))), lambda i: shingle(w, i))).otherwise(F.array().cast("array<bigint>")))
    return _with(every, lambda hashes: _below(hashes, scale))


def merged(a: Column, b: Column, scale: int = 8) -> Column:
    """Sketch of the union of two texts' shingles."""
    return _with(F.concat(a, b), lambda hashes: _below(hashes, scale))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; an empty a is contained in an empty b only."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise((F.size(b) == 0).cast("double"))


def as_text(hashes: Column) -> Column:
    """The hashes as 16 hex digits each, in order."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h.bitwiseXOR(F.lit(LEAST)))), 16, "0")), "")


def with_next(docs: DataFrame, scale: int = 8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, text, n_chars and sketch with next_head and next_sketch, from the row after it.

    The order is by descending id, null last, rows of one id by two hashes of id and text; after the
    last comes the first. next_head are the first floor(n_chars / 3) characters of that row's text.
    Null texts are empty. Rows equal in id and text follow each other. Only ids and hashes are put in
    order; texts are dealt once by hash, and a text sends on no more than its head.
    """
    text, of = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("string")
    keyed = docs.select(F.xxhash64(F.lit(1), of, text).alias("k1"), F.xxhash64(F.lit(2), text, of).alias("k2"), F.col(id_col).alias("id"), text.alias("text"))
    short = keyed.select("k1", "k2", "id", F.length("text").alias("n_chars")).groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    line = numbered(short, [F.col("id").desc_nulls_last(), F.col("k1"), F.col("k2")], "place")
    last = line.agg(F.max("place")).first()[0]
    if last is None:
        last = 0
    after = line.select(F.when(F.col("place") == 0, F.lit(last)).otherwise(F.col("place") - 1).alias("place"), F.col("k1").alias("n1"), F.col("k2").alias("n2"))
    asked = line.select("place", "k1", "k2", "n_chars", "copies").join(after, "place").drop("place")
    # each distinct row once, as a struct, so that both joins below read the same columns and share one exchange
    once = keyed.withColumn("sketch", sketch(F.col("text"), words, scale)).groupBy("k1", "k2").agg(F.first(F.struct("id", "text", "sketch")).alias("row"))
    head = F.substring(F.col("row.text"), F.lit(1), F.floor(F.col("n_chars") / 3).cast("int")).alias("next_head")
    sent = once.withColumnsRenamed({"k1": "n1", "k2": "n2"}).join(asked, ["n1", "n2"]).select("k1", "k2", "n_chars", "copies", head, F.col("row.sketch").alias("next_sketch"))
    met = once.join(sent, ["k1", "k2"])
    # equal rows follow each other: all but the last have a copy of themselves as the next, made one row at a time
    out = met.select("row", "n_chars", "next_head", "next_sketch", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    is_last = F.col("copy") == 1
    nexts = [F.when(is_last, F.col("next_head")).otherwise(head).alias("next_head"), F.when(is_last, F.col("next_sketch")).otherwise(F.col("row.sketch")).alias("next_sketch")]
    return out.select(F.col("row.id").alias(id_col), F.col("row.text").alias(text_col), "n_chars", F.col("row.sketch").alias("sketch"), *nexts)
