"""Toxicity, language profiles and the hidden Markov model."""

import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodlens.llm import language_id, lm, toxicity
from moodlens.llm.queries import QUERIES

from .conftest import SF, frame


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_toxic_texts_are_caught_and_clean_ones_left_alone(spark):
    got = QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.1")
    truth = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    n = {(r.toxic, r.predicted): r["count"] for r in got.where("held_out").join(truth, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.55 * (n[1, 1] + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.01 * (n[0, 0] + n.get((0, 1), 0))


def test_toxicity_of_odd_rows_and_without_labels(spark):
    docs = frame(spark)
    known = [(i, 1, i % 2) for i in (1, 2, 3, 4, 5, 6, 7, 8)] + [(5, 1, None), (None, 1, 1), (4, 1, 1)]
    assert toxicity.learn(docs, labels(spark, [])) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    model = toxicity.learn(docs, labels(spark, known))
    got = toxicity.score(docs, model)
    assert set(docs.columns) <= set(got.columns)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(frame(spark, []), model).count() == 0


def test_texts_toxic_by_phrase_alone(spark):
    rng, texts = np.random.default_rng(5), []
    for i in range(240):  # both kinds hold the same words; the order of two differs
        rest = list(rng.choice(["the", "house", "river", "green", "walk", "table", "seven", "lamp"], 10))
        at = rng.integers(10)
        texts.append((i, " ".join([*rest[:at], *(("get", "lost") if i % 2 else ("lost", "get")), *rest[at:]]), "en", "a", 1))
    docs = frame(spark, texts)
    model = toxicity.learn(docs, labels(spark, [(i, 1, i % 2) for i in range(160)]))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).where("doc_id >= 160").collect()}
    assert np.mean([s > 0.5 for i, s in got.items() if i % 2]) > 0.9 > 0.1 > np.mean([s > 0.5 for i, s in got.items() if not i % 2])


def test_held_out_rows_teach_nothing(spark):
    texts = [(i, ("awful rotten trash " if i % 2 else "good kind words ") * 5 + f"w{i} v{i}", "en", "a", 1) for i in range(90)]
    mine = labels(spark, [(i, 1, i % 2) for i in range(90)])
    used = toxicity.training_labels(mine)
    assert {r.doc_id for r in used.collect()} == {i for i in range(90) if zlib.crc32(str(i).encode()) % 3 != 1}
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, texts), toxicity.learn(frame(spark, texts), used)).collect()}
    assert min(s for i, s in got.items() if i % 2) > max(s for i, s in got.items() if not i % 2)


def test_languages_of_held_out_rows(spark):
    got = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    right = got.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_out_of_place_distance_against_brute_force(spark, documents):
    docs = [(d, t, la) for d, t, la, *_ in documents[:60]]

    def grams(text):
        marks = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        padded = " " + " ".join(marks.split()) + " "
        return Counter(padded[i:i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i:i + n].strip()) if padded.strip() else Counter()

    def rank(counts, size):
        order = lambda g: int("".join(f"{1 if c == ' ' else ord(c):021b}" for c in g), 2)
        return sorted(counts, key=lambda g: (-counts[g], order(g)))[:size]

    profiles = {}
    for la in {la for _, _, la in docs}:
        profiles[la] = rank(sum((grams(t) for _, t, x in docs if x == la), Counter()), 300)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df, language_id.learn(df)).collect()}
    for d, t, _ in docs:
        own = rank(grams(t), 300)
        if not own:
            continue
        far = {la: sum(abs(i - p.index(g)) if g in p else 300 for i, g in enumerate(own)) for la, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert got[d].lang_pred == best and got[d].score == pytest.approx(1 - far[best] / (300 * len(own)))


def test_language_of_odd_rows(spark):
    docs = frame(spark)
    profiles = language_id.learn(docs)
    rows = language_id.identify(docs, profiles).collect()
    assert len(rows) == docs.count()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 8)} == {"und"}
    assert {r.score for r in rows if r.lang_pred == "und"} == {0.0}
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}
    assert language_id.learn(frame(spark, [])) == {}


def test_rare_languages_are_learned(spark):
    rows = [(i, f"plain words of a common language number {i}", "en", "a", 1) for i in range(2500)] + [(2500, "καλημέρα σε όλους τους φίλους", "el", "a", 1)]
    profiles = language_id.learn(frame(spark, rows))
    assert set(profiles) == {"el", "en"}
    got = {r.doc_id: r for r in language_id.identify(frame(spark, [*rows[:3], (2500, "καλημέρα φίλους", None, None, 1)]), profiles).collect()}
    assert got[2500].lang_pred == "el" and got[2500].score >= language_id.LEAST_SCORE and got[0].lang_pred == "en"


def test_forward_recursion_and_expected_counts_by_enumeration():
    rng = np.random.default_rng(0)
    share = lambda *s: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(s))
    k, symbols = lm.STATES, 4
    emit = np.zeros((lm.SYMBOLS, k))
    emit[:symbols] = share(k, symbols).T
    m = lm.Hmm(share(k), share(k), share(k, k), emit)
    x = np.array([0, 3, 1, 1], np.uint16)
    total, first, moves = 0.0, np.zeros(k), np.zeros((k, k))
    for path in product(range(k), repeat=len(x)):
        p = m.start[path[0]] * emit[x[0], path[0]]
        for t in range(1, len(x)):
            p *= m.move[path[t - 1], path[t]] * emit[x[t], path[t]]
        total += p
        first[path[0]] += p
        for t in range(1, len(x)):
            moves[path[t - 1], path[t]] += p
    got = lm.likelihoods(m, [x, x[:2], np.array([], np.uint16), x])
    assert got[0] == pytest.approx(math.log10(total)) and got[0] == got[3] and got[2] == 0
    start, _, move, emitted = lm.expected(m, [x])
    assert start == pytest.approx(first / total) and move == pytest.approx(moves / total)
    assert emitted.sum() == pytest.approx(len(x)) and emitted[1].sum() == pytest.approx(2)


def test_long_sequences_neither_vanish_nor_depend_on_company():
    v = lm.Vocabulary([b""] * 1, np.array([5]), 0, 5, 1, np.ones(lm.HASHED, np.int64), np.ones(lm.HASHED, np.int64))
    m = lm.first_model(v)
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, lm.SYMBOLS, n).astype(np.uint16) for n in (3000, 1, 700, 17)]
    assert lm.likelihoods(m, texts) == pytest.approx([lm.likelihoods(m, [t])[0] for t in texts])
    assert np.isfinite(lm.likelihoods(m, texts)).all()


def base_scores(rows):
    low = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = Counter(w for d, t in rows if not held(d) for w in low(t))
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        own = low(t)
        out.append((d, held(d), len(own), sum(w in c for w in own), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)))
    return out


def test_base_scores_against_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 500)
    rows = [(d, t) for d, t, *_ in documents] + [(None, "no id"), (None, None), (3, "the the the")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score(df, 1).collect()), key=key)
    for a, b in zip(got, sorted(base_scores(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])


def test_training_raises_the_likelihood(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    at = [lm.score(df, n).where("NOT held_out").agg(F.sum("score")).first()[0] for n in (0, 3)]
    assert at[1] > at[0]


def test_states_part_so_that_held_out_texts_score_above_unigrams(spark):
    got = QUERIES["op2_lm_score"](spark, "/root/testdata/sf0.01").where("held_out")
    gain = got.agg((F.sum("score") - F.sum("base_score")) / F.sum("n_tokens")).first()[0]
    assert gain > 0.1  # log10 per token
    assert lm.score(frame(spark, [])).count() == 0


def test_the_start_counts_every_neighbour_of_all_training_texts(spark):
    texts = ["a b a", None, "b " * 3000 + "z z"] + ["c d"] * 40
    rows = lm.tagged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    v = lm.frequent(lm.count_words(rows.where("NOT held_out")))
    at = {w: i for i, w in enumerate(v.words)}
    want = Counter()
    for r in rows.where("NOT held_out").collect():
        own = [b"", *lm.tokens(bytes(r.text))]
        want.update((int(lm.context(np.array(at[x]))), at[y]) for x, y in zip(own, own[1:]))
    n = lm.pairs(lm.sequences(rows, v))
    assert {(int(i), int(k)): n[i, k] for i, k in zip(*np.nonzero(n))} == want and n.sum() == v.total
    m = lm.started(v, lm.sequences(rows, v))
    assert m.emit.sum(0) == pytest.approx(1) and m.move.sum(1) == pytest.approx(1) and m.start.sum() == pytest.approx(1)


def test_language_model_of_odd_rows(spark):
    docs = frame(spark)
    rows = lm.score(docs, 1).collect()
    assert len(rows) == docs.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert lm.score(frame(spark, []), 1).count() == 0
