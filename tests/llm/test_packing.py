"""Packing against the round trip of all ids."""

from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from convlake.llm import packing

JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))


def check(rows, pieces, width=2048):
    """Ids back per document, gapless sequences; returns padding and ids."""
    tokenizer = Tokenizer.from_file(JSON)
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        docs[p.doc_id].append((p.start, ids, p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
    want = defaultdict(list)
    for key, text in rows:
        want[key].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    assert set(want) == set(docs)
    for key, texts in want.items():
        if len(texts) == 1:
            at = 0
            for start, ids, total in sorted(docs[key]):
                assert start == at and ids == texts[0][at : at + len(ids)] and total == len(texts[0])
                at += len(ids)
            assert at == len(texts[0])
        else:
            assert sum(len(ids) for _, ids, _ in docs[key]) == sum(map(len, texts))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width
        padding += 0 if at & (at - 1) == 0 else width - at
    return padding, sum(len(x) for t in want.values() for x in t)


@pytest.mark.parametrize("parts", [1, 70])
def test_round_trip(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(parts)
    pieces = packing.pack(docs, RANKS).collect()
    padding, ids = check([(r.doc_id, r.text) for r in docs.collect()], pieces)
    assert padding <= 0.01 * ids


def test_odd_rows(spark):
    big = 2**60 + 1
    rows = [(None, "a b"), (big, None), (3, ""), (4, "x" * 9000 + "<|endoftext|> é  \t\t z"), (5, "same"), (5, "same"), (6, "word " * 30000), (7, "\U0001f600 we're 123")]
    docs = spark.createDataFrame([(k, t, "s", 1) for k, t in rows], "doc_id long, text string, ids string, task int").repartition(3)
    for vocabulary in (JSON, RANKS):
        assert check(rows, packing.pack(docs, vocabulary).collect())[0] == 0
    assert packing.pack(docs.limit(0), RANKS).count() == 0


def test_windows_fill_and_close():
    windows = packing.Windows(width=10, most=2, least_cut=3)
    sizes = [6, 5, 4, 7, 9, 3, 25]
    out = [w for k, n in enumerate(sizes) for w in windows.add(k, 0, np.arange(n, dtype=np.uint32), n)]
    assert len(windows.rest()) <= 2 and all(7 < sum(len(p[2]) for p in w) <= 10 for w in out)
    closed = list(packing.close(windows.rest(), 10))
    lengths = [sum(len(p[2]) for p in w) for w in out + closed]
    assert sum(lengths) == sum(sizes) and all(n == 10 or n & (n - 1) == 0 for n in lengths[len(out) :])


def test_digest(spark):
    assert spark.range(1).select(F.crc32(F.lit(bytearray(np.array([1, 2], "<u4").tobytes())))).first()[0] == __import__("zlib").crc32(b"\1\0\0\0\2\0\0\0")


def test_long_white_space(spark):
    rows = [(1, "a" + " " * 1_200_000 + "b"), (2, "c d"), (3, "e \t" * 70_000), (4, "f" + " " * 99_999 + "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert check(rows, packing.pack(docs, RANKS).collect())[0] == 0
