"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent character n-grams (one to three characters;
letters lower-cased, every run of other characters is one separator) in
falling order of frequency.  Each learned language has a profile over all its
training texts.  A document's profile is compared to each of them by the
out-of-place distance: the sum, over the document's n-grams, of how far their
ranks lie apart, with the profile's length for an n-gram that is absent.

Counts are made per Arrow batch, summed by Spark, and ranked per language.
Every language of the training rows is learned, however rare.  What is broadcast
are the entries of the profiles by n-gram, at most ``PROFILE`` a language: it
grows with the number of languages, not with the rows.

Defined results: a null or empty text, or one without a letter, is ``und``
with score 0; so is every text if nothing could be learned.  Ties go to the
n-gram with the smaller code and the language that sorts first.  Repeated rows
give repeated rows.  Columns besides those named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, chunks, worker_state

PROFILE = 300
#: Score under which the pipeline takes a document for no known language:
#: text of random letters lies near 0.1, whole sentences over 0.3.
LEAST_SCORE = 0.12

FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def letter_table() -> np.ndarray:
    """For each code point itself if it is a letter, else 1, the separator."""
    state = worker_state("language")
    if "letters" not in state:
        state["letters"] = np.fromiter((i if chr(i).isalpha() else 1 for i in range(0x110000)), np.int64, 0x110000)
    return state["letters"]


def ngrams(text: bytes, letters: np.ndarray) -> np.ndarray:
    """All one- to three-character n-grams as integers (21 bits a character)."""
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.ones(len(points) + 2, np.int64)
    c[1:-1] = letters[points]
    kept = np.ones(len(c), bool)
    kept[1:] = (c[1:] != 1) | (c[:-1] != 1)  # a run of separators counts as one
    c = c[kept]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    two = (c[:-1] << 21) | c[1:]
    return np.concatenate([c[c != 1], two, (two[:-1] << 21) | c[2:]])


def ranked(text: bytes, letters: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first."""
    grams, n = np.unique(ngrams(text, letters), return_counts=True)
    if len(grams) > size:  # only what ties with the last place or beats it
        least = np.partition(n, len(n) - size)[len(n) - size]
        grams, n = grams[n >= least], n[n >= least]
    return grams[np.lexsort((grams, -n))][:size]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", profile: int = PROFILE) -> dict[str, list[int]]:
    """Profiles from all rows of ``docs`` with a language: language -> n-grams in rank order."""
    rows = docs.where(F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in chunks(batches, 512):
            by_lang: dict[str, list[bytes]] = {}
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(k, []).append(t)
            for k, texts in by_lang.items():
                grams, n = np.unique(np.concatenate([ngrams(t, letters) for t in texts]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))],
                                                 names=["lang", "gram", "n"])

    counts = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranks = (counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
             .where(F.col("rank") <= profile).select("lang", "rank", "gram").toArrow())
    out: dict[str, list[tuple[int, int]]] = {}
    for k, rank, gram in zip(*(c.to_pylist() for c in ranks.columns), strict=True):
        out.setdefault(k, []).append((rank, gram))
    return {k: [g for _, g in sorted(v)] for k, v in sorted(out.items())}


def identify(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", profile: int = PROFILE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    score: 1 less the smallest distance as a share of the largest possible
    one (every n-gram absent).
    """
    names = sorted(profiles)
    sizes = [len(profiles[k]) for k in names]
    grams = np.array([g for k in names for g in profiles[k]], np.int64)
    order = np.argsort(grams, kind="stable")
    known, first = np.unique(grams[order], return_index=True)
    first = np.append(first, len(grams))  # entries of known[i]: first[i] to first[i + 1]
    langs = np.repeat(np.arange(len(names), dtype=np.int32), sizes)[order]
    ranks = np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in sizes)])[order]
    shared = docs.sparkSession.sparkContext.broadcast((names, known, first, langs, ranks))

    def each():
        names, known, first, of, ranks = shared.value
        letters = letter_table()

        def score(texts: list[bytes]) -> list:
            langs, scores = [], []
            for t in texts:
                grams = ranked(t, letters, profile)
                if not len(grams) or not names or not len(known):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                own = np.flatnonzero(known[at] == grams)
                begin, n = first[at[own]], first[at[own] + 1] - first[at[own]]
                entry = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
                # how much less than the profile's length each n-gram adds to a language's distance
                less = np.bincount(of[entry], profile - np.abs(ranks[entry] - np.repeat(own, n)), len(names))
                best = int(less.argmax())
                langs.append(names[best])
                scores.append(float(less[best]) / (profile * len(grams)))
            return [langs, scores]

        return score

    return append(docs, text, FIELDS, each)
