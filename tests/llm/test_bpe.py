"""BPE by replayed merges against the tiktoken library."""

import base64
import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from convlake.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def encoded(texts):
    return [ids(x) for x in bpe.Encoder(PATH, public_tokenizers.PATTERN).texts(texts)]


def test_query(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        got = np.array(library.encode_ordinary(r.text or ""), "<u4")
        want[r.doc_id] = (len(got), hashlib.sha256(got.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = queries.op11_byte_pair_encoding(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(docs)


def test_every_code_point(library):
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}{c} 1{c}\n" for c in points[k : k + 5000]) for k in range(0, len(points), 5000)]
    for text, got in zip(texts, encoded(texts)):
        assert got == library.encode_ordinary(text)


def test_random_letters(library):
    """Words in which merges make pairs of lower rank, and equal pairs overlap."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("aab", k=n)) for n in range(1, 120)]
    texts += ["".join(rnd.choices("the inrsaonéß日本語😀'\n\t .,;=0123", k=rnd.randrange(400))) for _ in range(400)]
    texts += ["".join(map(chr, rnd.choices(range(32, 0x250), k=60))).replace(" ", "") for _ in range(300)]
    known = bpe.vocabulary(PATH)
    long = [t for t in known.tokens if len(t) > 5]
    texts += [(rnd.choice(long)[1:] + rnd.choice(long)[:-1]).decode("utf-8", "ignore") for _ in range(4000)]
    assert encoded(texts) == [library.encode_ordinary(t) for t in texts]


def test_lower_ranks_are_replayed_first():
    """Merging bc makes the pair (a, bc), which has a lower rank than bc and takes part of the next bc's word first."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"cab": 257, b"bc": 258, b"abcb": 259}
    known = bpe.Vocabulary([t for t, _ in sorted(ranks.items(), key=lambda x: x[1])], ranks, {})
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            if token[:cut] in ranks and token[cut:] in ranks:
                known.pairs[ranks[token[:cut]] << bpe.SHIFT | ranks[token[cut:]]] = rank

    def plain(word):
        parts = [bytes([b]) for b in word]
        while True:
            found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    rnd = random.Random(1)
    words = ["".join(rnd.choices("abc", k=rnd.randrange(2, 15))).encode() for _ in range(500)]
    words = [w for w in dict.fromkeys(words) if w not in ranks]
    assert bpe.replay(words, known) == [plain(w) for w in words]


def test_odd_rows(spark, library):
    texts = [None, "", " ", "same", "same", "x" * 30_000, " " * 1_200_000 + "a", "<|endoftext|>", "word " * 200_000, "\x00\x1c\x85　é"]
    rows = [(k if k else None, t, "clash", "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, tokens string")
    one = bpe.ids_of(F.col("text"), PATH, public_tokenizers.PATTERN)
    got = df.withColumn("_ids", one).withColumn("_back", bpe.bytes_of(F.col("_ids"), PATH)).collect()
    assert len(got) == len(texts) and all(r.ids == "clash" for r in got)
    for r in got:
        assert bytes(r._back).decode() == (r.text or "")
        if not r.text or len(r.text) < 1_000_000:
            assert ids(r._ids) == library.encode_ordinary(r.text or "")
    assert df.limit(0).withColumn("_ids", one).count() == 0
    both = bpe.encoded(df, PATH, public_tokenizers.PATTERN)
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in both.collect()) == sorted((str(r.doc_id), bytes(r._ids), bytes(r._back)) for r in got)
    assert bpe.encoded(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    nothing = spark.createDataFrame([(None,), (bytearray(),)], "x binary").select(bpe.bytes_of(F.col("x"), PATH).alias("x")).collect()
    assert sorted((r.x is None, bytes(r.x or b"")) for r in nothing) == [(False, b""), (True, b"")]


def test_known_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 10)
    monkeypatch.setattr(bpe, "BLOCK", 8)
    texts = ["one two three", "two four", None, "one five six seven"]
    got = encoded(texts)
    monkeypatch.undo()
    assert got == encoded(texts)
