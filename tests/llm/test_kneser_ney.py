"""The toxicity models against Kneser-Ney bigrams counted in plain Python."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodlens.llm import toxicity
from moodlens.llm.wordhash import WordHash

from .conftest import frame


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(8)
    common, rude = ["the", "house", "river", "green", "walk", "table", "seven", "lamp", "été", "中文"], ["awful", "trash", "idiot"]
    texts = [(i, " ".join(rng.choice(common + (rude if i % 2 else []), rng.integers(3, 25))) + f" only{i}", "en", "a", 1) for i in range(120)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(120)], "doc_id bigint, quality int, toxic int")
    taken = toxicity.sample(docs, labels, toxicity.SAMPLE).where("fit").select("y", "text").collect()
    return toxicity.learn(docs, labels), [(r.y, bytes(r.text)) for r in taken]


def plainly(rows):
    """P(w | v) per class as a function, from counts of the documents that hold a bigram."""
    cache, pairs = WordHash(), (Counter(), Counter())
    for y, text in rows:
        p = toxicity.words(text, cache).tolist()
        pairs[y].update(set(zip(p, p[1:])))
    types = [Counter(w for _, w in c) for c in pairs]
    vocabulary = set(types[0]) | set(types[1])
    rest = 0.5 * 2 ** toxicity.WORD_BITS
    shared = {w: (sum(w in t for t in types) + 0.5) / (sum(len(t) for t in types) + rest) for w in vocabulary}
    models = []
    for c, t in zip(pairs, types, strict=True):
        rare = Counter(c.values())
        d = toxicity.discounts([rare[k] for k in (1, 2, 3, 4)])
        every, total, left = sum(t.values()), Counter(), Counter()
        for (v, _), n in c.items():
            total[v] += n
            left[v] += d[min(n, 3) - 1]
        kept = sum(max(n - toxicity.DISCOUNT, 0) for n in t.values())

        def chance(v, w, c=c, t=t, d=d, every=every, total=total, left=left, kept=kept):
            lower = max(t[w] - toxicity.DISCOUNT, 0) / every + (1 - kept / every) * shared[w]
            n = c[v, w]
            return lower if not total[v] else (max(n - d[min(n, 3) - 1], 0) if n else 0) / total[v] + left[v] / total[v] * lower

        models.append(chance)
    return models, sorted(vocabulary)


def test_probabilities_equal_plain_counts(fitted):
    model, rows = fitted
    chances, vocabulary = plainly(rows)
    v, w = (np.array(x) for x in zip(*[(a, b) for a in [0, *vocabulary] for b in vocabulary]))
    for c in (0, 1):
        want = [chances[c](a, b) for a, b in zip(v.tolist(), w.tolist(), strict=True)]
        assert np.allclose(toxicity.chances(model, c, v, w), want, rtol=1e-4)


def test_probabilities_after_a_word_sum_to_one(fitted):
    model, rows = fitted
    everything = np.arange(2 ** toxicity.WORD_BITS)
    for v in [0, *plainly(rows)[1][::7], 12_345]:
        for c in (0, 1):
            assert abs(toxicity.chances(model, c, np.full(len(everything), v), everything).sum() - 1) < 1e-3


def test_the_bound_on_bigrams_keeps_probabilities(spark, fitted, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_PAIRS", 60)
    texts = [(i, f"good day my friend{i}" if i % 2 else f"bad day you friend{i}", "en", "a", 1) for i in range(80)]
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(80)], "doc_id bigint, quality int, toxic int")
    model = toxicity.learn(frame(spark, texts), labels)
    assert len(model.keys) <= 61
    everything = np.arange(2 ** toxicity.WORD_BITS)
    starts = toxicity.words(b"good bad day you", WordHash())
    for v in starts:
        assert abs(toxicity.chances(model, 1, np.full(len(everything), v), everything).sum() - 1) < 1e-3
    got = toxicity.score(frame(spark, texts), model).groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.min("score").alias("low"), F.max("score").alias("high")).collect()
    by = {r.odd: r for r in got}
    assert by[0].low > by[1].high
