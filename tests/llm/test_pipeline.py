"""The stages, each against brute force over its own input."""

import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from strataform.llm import bpe, quality
from strataform.llm.shared import written

from .test_operators import brute_components, brute_fingerprint, norm

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], AT), f"test-{name}"))
    return out


def rows(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def test_all_but_the_last_keep_the_columns(stages):
    assert all(x.columns == stages[0].columns for x in stages[:-1])


def test_quality(spark, stages):
    docs, labels = stages[0], spark.read.parquet(f"{AT}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(docs.select("doc_id", "text"), labels)
    before = rows(docs)
    assert set(rows(stages[1])) == {i for i, t in before.items() if model.scores([t.encode()])[0] >= 0.5}


def test_exact(stages):
    by = defaultdict(list)
    for i, t in rows(stages[1]).items():
        by[norm(t)].append((-len(t), i))
    assert set(rows(stages[2])) == {min(v)[1] for v in by.values()}


def test_near(stages):
    before = rows(stages[2])
    ids = list(before)
    least = {}
    for i, r in zip(ids, brute_components([brute_fingerprint(before[i]) for i in ids]), strict=True):
        least[r] = min(i, least.get(r, i))
    assert set(rows(stages[3])) == set(least.values())


def test_leaks(spark, stages):
    """Whole items, whatever the case and the punctuation."""
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [plain(r["text"]) for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect()]
    want = {i for i, t in rows(stages[3]).items() if not any(f" {x} " in f" {plain(t)} " for x in items)}
    assert set(rows(stages[4])) == want


def test_tokens(stages):
    path, pattern = bpe.default_files()
    own = bpe.Codec(bpe.vocabulary(path), pattern).library
    texts = rows(stages[4])
    got = {r["doc_id"]: np.frombuffer(r["token_ids"], "<u4").tolist() for r in stages[5].collect()}
    assert got == {i: own.encode_ordinary(t) for i, t in texts.items()}
    assert corpus_pipeline.ORACLE_SQL is None
