"""Points where a user's own code plugs in: headers, embedders, query builders, answers, grades.

A hook is a plain callable on a batch; Spark partitions the rows and sends them as Arrow batches.
``make`` callables run once per task, so a model loads where it is used.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from convlake.functions import text as T


def embed_texts(df: DataFrame, id: str, text: str, make: Callable[[], Callable[[list[str]], np.ndarray]], normalise: bool = False) -> DataFrame:
    """(id, embedding) from a batch embedder; rows are scaled to length one if asked."""
    kind = dict(df.dtypes)[id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for pdf in batches:
            m = np.asarray(embed(pdf[text].tolist()), dtype=np.float32)
            if normalise and len(m):
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({id: pdf[id], "embedding": list(m)})

    return df.select(id, text).mapInPandas(run, f"{id} {kind}, embedding array<float>")


def build_queries(df: DataFrame, question: str, builder: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Add ``query``, built from the trimmed question; blank questions are skipped."""
    return df.withColumn("query", builder(T.strip(F.col(question)))).filter(F.col("query") != "")


def constant_answer(answer: str) -> Callable[[], Callable[[pd.DataFrame], pd.Series]]:
    """Stub generator that always gives the same answer."""
    return lambda: lambda pdf: pd.Series([answer] * len(pdf), index=pdf.index)


def add_column(df: DataFrame, name: str, kind: str, make: Callable[[], Callable[[pd.DataFrame], pd.Series]]) -> DataFrame:
    """Add what a batch function returns: generated answers, grades of a model."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{name}` {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make()
        for pdf in batches:
            yield pdf.assign(**{name: fn(pdf)})

    return df.mapInPandas(run, schema)


@udtf(returnType="source_field: string, text: string")
class JsonLeaves:
    """Table function: the string leaves of one JSON document, for SQL users."""

    def eval(self, body: str):
        stack = [("", json.loads(body))]
        while stack:
            path, v = stack.pop()
            if isinstance(v, str) and v.strip():
                yield path or "text", v.strip()
            elif isinstance(v, dict):
                stack += [(f"{path}.{k}" if path else k, x) for k, x in v.items()]
            elif isinstance(v, list):
                stack += [(f"{path}[{i}]", x) for i, x in enumerate(v)]
