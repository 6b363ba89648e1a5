"""The corpus pipeline, stage by stage, against plain computations."""

import re

import pytest

import corpus_pipeline
from convlake.llm import common, langid, secrets
from test_mixing import plain as plain_mix
from test_packing import check as check_pieces
from test_secrets import plain as plain_spans
from test_simhash import similar_pairs

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain_masked(text):
    cuts = []
    for a, _, b, kind in plain_spans(text):
        if cuts and a < cuts[-1][1]:
            cuts[-1][1] = max(b, cuts[-1][1])
        else:
            cuts.append([a, b, kind])
    for a, b, kind in reversed(cuts):
        text = f"{text[:a]}<{kind}>{text[b:]}"
    return text


@pytest.fixture(scope="module")
def steps(spark):
    """The inputs and outputs of the stages, over documents with a few odd rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, "12 34 ### 56", "en", None, 12), (None, docs.first().text, "en", "src1", 5), (9004, "the thing with password=abc123def456 of it " * 9, "en", None, 1)]
    docs = common.staged(docs.union(spark.createDataFrame(odd * 2, docs.schema)))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(common.staged(stage(spark, out[-1], SF)))
    return out


def test_stages_keep_the_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(df.columns == COLUMNS for df in steps[:-1])


def test_language(steps, spark):
    model = langid.fit(steps[0], langid.remainder() != 2)
    want = []
    for r in rows_of(steps[0]):
        points = langid.letter_runs(r[1] or "")
        if len(points) and model.scores(points).max() >= model.least_score:
            want.append(r)
    assert rows_of(steps[1]) == want and not {9001, 9002, 9003} & {r[0] for r in want}
    assert len([r for r in want if r[0] is not None and r[0] < 9000]) >= 195


def test_near_copies_by_similarity(steps):
    rows = sorted(rows_of(steps[1]), key=lambda r: (r[0] is None, r[0] or 0, str(r)))
    rows = [r for k, r in enumerate(rows) if r not in rows[:k]]
    first = list(range(len(rows)))
    pairs = similar_pairs([r[1] for r in rows])
    before = None
    while before != first:
        before = first[:]
        for i, j in pairs:
            first[i] = first[j] = min(first[i], first[j])
    assert rows_of(steps[2]) == sorted((r for k, r in enumerate(rows) if first[k] == k), key=str)


def test_secrets(steps):
    assert rows_of(steps[3]) == sorted(((r[0], plain_masked(r[1]), *r[2:]) for r in rows_of(steps[2])), key=str)
    assert not any(plain_spans(r[1]) for r in rows_of(steps[3]))
    assert any("<assign>" in r[1] for r in rows_of(steps[3]))


def test_mixing(steps):
    words = {}
    for r in rows_of(steps[4]):
        words[str(r[0])] = words.get(str(r[0]), 0) + len(re.findall("[^\x20\x09-\x0d]+", r[1]))
    assert words == {k: taken for k, _, _, _, taken in plain_mix([(r[0], r[3], r[1]) for r in rows_of(steps[3])]) if taken}


def test_packing(steps):
    padding, ids = check_pieces([(r[0], r[1]) for r in rows_of(steps[4])], steps[5].collect())
    assert padding <= 0.01 * ids


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).select("doc_id", "sequence_id").count() > 0


def test_rules_have_names():
    assert len({rule.kind for rule in secrets.RULES}) == len(secrets.RULES)
