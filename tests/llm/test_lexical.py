"""Ranked lexical search against a plain ranking of every document."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from moodlens.llm import lexical

from .conftest import frame

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k):
    words = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n, total = len(words), sum(len(w) for _, w in words)
    counts = [(i, Counter(w), len(w)) for i, w in words]
    df = Counter(t for _, c, _ in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, length in counts:
            m = 50 + (50 * length * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(5)
    vocabulary = [f"t{i}" for i in range(300)]
    p = 1 / np.arange(1, 301)
    docs = [(int(i), " ".join(rng.choice(vocabulary, size=rng.integers(1, 80), p=p / p.sum()))) for i in range(400)]
    docs += [(i, docs[7][1]) for i in range(1000, 1090)]  # many equal scores
    items = [(i, " ".join(rng.choice(vocabulary, size=12))) for i in range(15)] + [(99, docs[7][1].upper())]
    return docs, items


@pytest.mark.parametrize("blocks", [7, 16_384])
def test_equals_ranking_of_every_document(spark, made, monkeypatch, blocks):
    docs, items = made
    monkeypatch.setattr(lexical, "BLOCK", blocks)
    got = lexical.search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, ITEM), k=10)
    assert rows(got) == brute(docs, items, 10)


def test_unbroadcast_vocabulary_and_several_passes_change_nothing(spark, made, monkeypatch):
    docs, items = made
    monkeypatch.setattr(lexical, "MOST_TERMS", 5)
    monkeypatch.setattr(lexical, "PASS_TERMS", 40)
    got = lexical.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, ITEM), k=10)
    assert rows(got) == brute(docs, items, 10)


def test_odd_rows(spark):
    docs = [(r.doc_id, r.text) for r in frame(spark).collect()]
    items = [(1, "SAME text"), (1, "here"), (2, None), (3, ""), (None, "same"), (4, "中文 été"), (5, "word nowhere"), (6, "x" * 20_000), (7, "no id at all")]
    got = lexical.search(frame(spark), spark.createDataFrame(items, ITEM))
    assert rows(got) == brute(docs, items, 50)


def test_empty_tables(spark):
    none, item = frame(spark, []), spark.createDataFrame([(1, "a b")], ITEM)
    assert lexical.search(none, item).count() == 0
    assert lexical.search(frame(spark), spark.createDataFrame([], ITEM)).count() == 0


def test_accumulators_stop_and_lose_nothing():
    """A rare term that k documents hold ends the making of accumulators: of a
    term that all documents hold only the survivors are updated."""
    rare, common = np.arange(10), np.arange(1000)
    found, scores = lexical.accumulate([(9000, rare, np.full(10, 500_000)), (10, common, np.full(1000, 900_000))], 1000, 5, -1)
    assert found.tolist() == rare.tolist() and set(scores) == {9000 * 500_000 + 10 * 900_000}
    # a tie within reach: the rest equals the k-th partial score, so accumulators go on
    found, _ = lexical.accumulate([(10, rare, np.full(10, 100)), (10, common, np.full(1000, 100))], 1000, 5, -1)
    assert len(found) == 1000
