"""Toxicity by class-conditional Kneser-Ney bigram models.

One interpolated Kneser-Ney model is fitted to labelled toxic texts and one to
labelled ordinary texts.  Bigrams back off to continuation counts of the class,
and these to a count that both classes share: in how many of the models a word
occurs.  So a rare expression has the same backoff in either.  All counted
bigrams are kept, with discounts that follow from how many are rare.  A
document's score is a logistic function of the differences of the two
log-likelihoods, those of the words alone and what bigrams add to them, each
normalised by length (per word, and per square root of the words).  Small
differences are taken for chance: the margins of both, and the weights, are those
with the least log loss on labelled rows that took no part in the counts,
weighted back to the labels' own frequencies.

The classifier is fitted on a bounded sample: the ``SAMPLE`` rows of each label
with the smallest hash of their id.  Words are hashed into ``2 ** WORD_BITS``
places; bigrams of places have exact counts, so a bigram that a class never saw
reads 0 and each model's probabilities after a word sum to 1.  At most ``MOST_PAIRS``
bigrams are collected and broadcast: if a sample holds more, the least frequent
are discounted whole (their weight goes to the backoff).  Counting is done by Spark
over the sample's whole texts; every document is scored as a whole.

Defined results: a null or empty text has no evidence and scores the
calibration's value for none.  Without labelled rows of both classes every
score is 0.  Rows without a label or id teach nothing.  A document with several
label rows counts as toxic if one says so; an id with several texts teaches the one
that is last in byte order.  Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, bucket, byte_lists, chunks, smallest, worker_state, written
from .wordhash import WordHash

SAMPLE = (24_000, 6_000)
WORD_BITS = 18
MOST_PAIRS = 1 << 22
DISCOUNT = 0.75
#: In log10: differences between the models from which a word may count; the held-out rows choose.
MARGINS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 1.2, 1.4, 1.6, 1.8, 2.0)
#: Score from which a document counts as toxic.
THRESHOLD = 0.7

EVIDENCE = T.StructType([T.StructField("llr", T.ArrayType(T.DoubleType())), T.StructField("n_words", T.LongType())])
FIELDS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

#: Letters, digits and bytes of other scripts stay, the rest separates words.
KEEP = bytes(i if chr(i).isalnum() and i < 128 or i >= 128 else 32 for i in range(256))


@dataclass
class Model:
    lower: np.ndarray   # log10 P(word) of the lower order: 2 x words
    back: np.ndarray    # weight of the lower order after each word: 2 x words
    keys: np.ndarray    # counted bigrams in order, as first << WORD_BITS | second, and a last key above all
    pair: np.ndarray    # their discounted counts: 2 x (pairs and a 0)
    total: np.ndarray   # occurrences of each word as context: 2 x words
    weights: tuple[float, ...] = (0.0,) * 5  # constant, of words per word and per root, of pairs per word and per root
    margins: tuple[float, float] = (0.0, 0.0)  # of words and pairs


def words(text: bytes, cache: WordHash) -> np.ndarray:
    """Places of a text's lower-cased words, after a start mark (0)."""
    found = text.lower().translate(KEEP).split()
    out = np.zeros(len(found) + 1, np.int64)
    out[1:] = cache.array(found) >> np.uint64(64 - WORD_BITS)
    return out


def chances(m: Model, c: int, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """P(w | v) in the model of class ``c``."""
    key = (v << WORD_BITS) | w
    at = np.searchsorted(m.keys, key)
    seen = np.where(m.keys[at] == key, m.pair[c][at], 0)
    return seen / np.maximum(m.total[c][v], 1) + m.back[c][v] * m.lower[c][w]


def sample(docs: DataFrame, labels: DataFrame, rows: tuple[int, int]) -> DataFrame:
    """(doc_id, y, fit, text): at most ``rows[y]`` documents of label ``y``."""
    marks = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
             .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y")))
    by_hash = [smallest(marks.where(F.col("y") == y), F.xxhash64("doc_id"), ["doc_id"], rows[y]) for y in (0, 1)]
    chosen = written(by_hash[0].unionByName(by_hash[1]), "toxicity-labels")
    return (docs.select("doc_id", F.col("text").cast("binary").alias("text"))
            .join(F.broadcast(chosen), "doc_id")  # at most sum(rows) ids
            .groupBy("doc_id", "y").agg(F.max(F.coalesce("text", F.lit(b""))).alias("text"))
            .withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) != 0))


def learn(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = SAMPLE) -> Model | None:
    """Fits the two models and the calibration; None without both labels."""
    spark = docs.sparkSession
    taken = written(sample(docs, labels, rows), "toxicity-sample")
    seen = taken.groupBy("y", "fit").count().collect()
    if len({(r.y > 0, r.fit) for r in seen if r["count"]}) < 4:
        return None

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in chunks(batches):
            ys = np.array(batch.column(0).to_pylist(), np.int64)
            places = [words(t, cache) for t in byte_lists(batch, "text")]
            key = np.concatenate([np.zeros(0, np.int64), *(np.unique((p[:-1] << (WORD_BITS + 1)) | (p[1:] << 1) | (y > 0)) for p, y in zip(places, ys, strict=True))])
            key, n = np.unique(key, return_counts=True)
            toxic = (key & 1) == 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(key >> (WORD_BITS + 1)), pa.array((key >> 1) & ((1 << WORD_BITS) - 1)),
                 pa.array(np.where(toxic, 0, n)), pa.array(np.where(toxic, n, 0))], names=["v", "w", "c0", "c1"])

    counted = (taken.where("fit").select("y", "text").mapInArrow(pairs, "v bigint, w bigint, c0 bigint, c1 bigint")
               .groupBy("v", "w").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
    counted = written(counted, "toxicity-pairs")
    has = lambda c: F.sum((F.col(c) > 0).cast("long"))

    def arrays(df: DataFrame, key: str, size: int, columns: list[str]) -> list[np.ndarray]:
        got = df.select(key, *columns).toArrow()
        at, out = got.column(0).to_numpy(), []
        for c in columns:
            x = np.zeros(size)
            x[at] = got.column(c).to_numpy()
            out.append(x)
        return out

    size = 1 << WORD_BITS
    n0, n1 = arrays(counted.groupBy("w").agg(has("c0").alias("n0"), has("c1").alias("n1")), "w", size, ["n0", "n1"])
    s0, s1 = arrays(counted.groupBy("v").agg(F.sum("c0").alias("s0"), F.sum("c1").alias("s1")), "v", size, ["s0", "s1"])
    rare = counted.agg(*[F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in ("c0", "c1") for k in (1, 2, 3, 4)]).first()
    discount = {c: discounts([rare[f"{c}_{k}"] for k in (1, 2, 3, 4)]) for c in ("c0", "c1")}
    less = lambda c: F.when(F.col(c) > 2, F.col(c) - discount[c][2]).when(F.col(c) == 2, 2 - discount[c][1]).when(F.col(c) == 1, 1 - discount[c][0]).otherwise(0.0)
    often = F.greatest("c0", "c1")
    rows_of = dict(sorted((r.n, r["count"]) for r in counted.groupBy(F.least(often, F.lit(10_000)).alias("n")).count().collect()))
    least_kept = next((n for n in rows_of if sum(r for k, r in rows_of.items() if k >= n) <= MOST_PAIRS), 10_001)
    pairs_less = counted.where(often >= least_kept).select("v", "w", *[less(c).alias(c) for c in ("c0", "c1")])
    k0, k1 = arrays(pairs_less.groupBy("v").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "v", size, ["c0", "c1"])

    got = pairs_less.select(F.expr(f"shiftleft(v, {WORD_BITS}) | w").alias("key"), *[F.col(c).cast("float").alias(c) for c in ("c0", "c1")]).toArrow()
    order = np.argsort(got.column(0).to_numpy())
    keys = np.append(got.column(0).to_numpy()[order], np.iinfo(np.int64).max)
    pair = np.zeros((2, len(keys)), np.float32)
    for c in (0, 1):
        pair[c, :-1] = got.column(1 + c).to_numpy()[order]
    models = (n0 > 0) + (n1 > 0) + 0.5  # the shared continuation count: in how many models a word occurs
    shared = models / models.sum()
    lower, back = [], []
    for n, s, k in ((n0, s0, k0), (n1, s1, k1)):
        every = max(n.sum(), 1.0)
        kept = np.maximum(n - DISCOUNT, 0)
        lower.append(kept / every + (1 - kept.sum() / every) * shared)
        back.append(np.where(s > 0, 1 - k / np.maximum(s, 1), 1.0))
    model = Model(np.array(lower, np.float32), np.array(back, np.float32), keys, pair, np.array((s0, s1), np.float32))
    held = evidence(taken.where("NOT fit").select("y", "text"), model).select("y", "llr", "n_words").toArrow()
    y = held.column("y").to_numpy() > 0
    of_all = labels.where("toxic IS NOT NULL").agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    n, llr = held.column("n_words").to_numpy(), np.array(held.column("llr").to_pylist()).reshape(-1, 2, len(MARGINS))
    least = np.inf
    for i, j in product(range(len(MARGINS)), repeat=2):
        x = features(llr[:, 0, i], llr[:, 1, j], n)
        weights = calibrate(x, y, of_all)
        off = loss(weights, x, y, of_all)
        if off < least:
            least, model.weights, model.margins = off, weights, (MARGINS[i], MARGINS[j])
    return model


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts of one, two, and three or more,
    from how many bigrams have counts of one to four; ``DISCOUNT`` where too few do."""
    if not all(n):
        return (DISCOUNT, DISCOUNT, DISCOUNT)
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))


def loss(weights: tuple[float, ...], x: np.ndarray, y: np.ndarray, prior: float) -> float:
    """Log loss, each class weighted to its share ``prior`` among all labels."""
    z = x @ np.array(weights)
    each = np.logaddexp(0, np.where(y, -z, z))
    return float(prior * each[y].mean() + (1 - prior) * each[~y].mean())


def calibrate(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, ...]:
    """Weights of a logistic regression (Newton steps, slight ridge), each
    class weighted to its share ``prior`` among all labels."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x = x / scale
    w = np.where(y, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-3] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta = beta + step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta / scale)


def features(of_words: np.ndarray, of_pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
    n = np.maximum(n, 1)
    return np.stack([np.ones(len(n)), of_words / n, of_words / np.sqrt(n), of_pairs / n, of_pairs / np.sqrt(n)], axis=1)


def differences(places: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each word's probability as toxic less that as ordinary: that of
    the lower order, and what its bigram adds to it."""
    v, w = places[:-1], places[1:]
    seen = [chances(m, c, v, w) for c in (0, 1)]
    of_words = np.log10(m.lower[1][w].astype(np.float64) / m.lower[0][w])
    return of_words, np.log10(seen[1].astype(np.float64) / seen[0]) - of_words


def ratio(each: np.ndarray, margin: float) -> float:
    """The sum of differences beyond the margin of each."""
    return float((np.sign(each) * np.maximum(np.abs(each) - margin, 0)).sum())


def evidence(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``llr`` (log10 likelihood ratio, of words and of pairs for each of ``MARGINS``) and ``n_words``."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def each():
        m, cache = Model(**shared.value), worker_state("toxicity").setdefault("toxicity-words", WordHash())

        def one(texts: list[bytes]) -> list:
            places = [words(t, cache) for t in texts]
            each = [differences(p, m) for p in places]
            return [[[ratio(x, k) for x in both for k in MARGINS] for both in each], [len(p) - 1 for p in places]]

        return one

    return append(docs, text, EVIDENCE, each)


def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1: toxic)."""
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))  # executors need not import Model

    def each():
        m, cache = shared.value and Model(**shared.value), worker_state("toxicity").setdefault("toxicity-words", WordHash())

        def one(texts: list[bytes]) -> list:
            if m is None:
                return [[0.0] * len(texts), [0] * len(texts)]
            places = [words(t, cache) for t in texts]
            found = [[ratio(x, k) for x, k in zip(differences(p, m), m.margins, strict=True)] for p in places]
            x = features(*np.array(found).reshape(-1, 2).T, np.array([len(p) - 1 for p in places]))
            p = 1 / (1 + np.exp(-np.clip(x @ np.array(m.weights), -30, 30)))
            return [p, (p >= threshold).astype(np.int32)]

        return one

    return append(docs, text, FIELDS, each)


def training_labels(labels: DataFrame) -> DataFrame:
    """The label rows of documents that op3 may learn from."""
    return labels.where(bucket("doc_id", 3) != 1)
