"""Ranked lexical search: term at a time with limited accumulators.

Documents become blocks of an inverted index that holds the terms of the items
alone.  Within a block an item's terms come rarest first.  A document gets an
accumulator when a term finds it; no more are created once what the remaining
terms could add at most (their weights times the largest impact in the block)
stays under the k-th largest partial score, or under the k-th largest score of
the blocks that the task has seen before.  A document left out can't reach that
score, so nothing is lost.  The remaining terms go on updating the survivors
exactly.  A task hands over the k best of each item; these are ranked over all
tasks.

Weights come from document counts over all documents.  Items are answered in
passes of at most ``PASS_TERMS`` terms (one item at least), each broadcast to
all tasks.  A vocabulary of more than ``MOST_TERMS`` terms isn't broadcast: the
index then holds every term of the documents, with equal results.

Defined results: a null text or one without terms is no document (it isn't
counted and can't be found); every other row is a document of its own, also
where ids repeat or are null (a null id comes last among equal scores).  Rows of
one item id make up one item; an item without id or terms has no rows.  A term
that no document holds adds nothing.  Sums are 64-bit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Documents and postings of a block of the index.
BLOCK = 16_384
BLOCK_POSTINGS = 2_000_000
PASS_TERMS = 200_000
MOST_TERMS = 1_000_000
#: Bytes that are no part of a term become spaces, A-Z become a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
INDEX = ("terms array<string>, counts array<int>, places binary, tfs binary, ids binary, known binary, lengths binary, "
         "n_docs bigint, n_terms bigint")


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def item_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """(item_id, term): the terms of each item, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own = set(terms_of(t or b""))
                ids += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary()).cast(pa.string())], names=["item_id", "term"])

    given = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, "item_id bigint, term string").distinct()


class Block:
    """An inverted index in the making."""

    def __init__(self) -> None:
        self.postings: dict[bytes, tuple[list[int], list[int]]] = {}
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.size = 0

    def add(self, doc_id: int | None, words: list[bytes], vocabulary: frozenset[bytes] | None) -> None:
        counts = Counter(words)
        place = len(self.ids)
        for term in counts.keys() if vocabulary is None else counts.keys() & vocabulary:
            places, tfs = self.postings.setdefault(term, ([], []))
            places.append(place)
            tfs.append(counts[term])
            self.size += 1
        self.ids.append(doc_id)
        self.lengths.append(len(words))

    def full(self) -> bool:
        return len(self.ids) >= BLOCK or self.size >= BLOCK_POSTINGS

    def row(self) -> pa.RecordBatch:
        order = sorted(self.postings)
        flat = lambda k: np.fromiter((x for t in order for x in self.postings[t][k]), np.int32, self.size).tobytes()
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        known = np.array([i is not None for i in self.ids], bool)
        values = [pa.array([[t.decode() for t in order]], pa.list_(pa.string())),
                  pa.array([[len(self.postings[t][0]) for t in order]], pa.list_(pa.int32())),
                  *(pa.array([x], pa.binary()) for x in (flat(0), flat(1), ids.tobytes(), known.tobytes(), np.array(self.lengths, np.int64).tobytes())),
                  pa.array([len(self.ids)], pa.int64()), pa.array([sum(self.lengths)], pa.int64())]
        return pa.RecordBatch.from_arrays(values, names=["terms", "counts", "places", "tfs", "ids", "known", "lengths", "n_docs", "n_terms"])


def index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Blocks of the inverted index over ``docs`` (doc_id, text), in scan order."""
    few = vocabulary.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(r.term.encode() for r in vocabulary.collect()) if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                words = terms_of(text.as_py() or b"")
                if words:
                    block.add(doc_id, words, shared.value)
                if block.full():
                    yield block.row()
                    block = Block()
        if block.ids:
            yield block.row()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, INDEX)


def weights(blocks: DataFrame) -> tuple[DataFrame, int, int]:
    """(term, df, w) over all documents, and the numbers of documents and terms."""
    total = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    pairs = blocks.select(F.inline(F.arrays_zip("terms", "counts")))
    df = pairs.groupBy(F.col("terms").alias("term")).agg(F.sum("counts").cast("bigint").alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(total.n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    return df.withColumn("w", w), total.n, total.l


def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m), m = 100 - 50 + (50 length n) div total."""
    tf = tf.astype(np.int64)
    if 50 * int(length.max(initial=0)) * n < 1 << 63:
        m = 50 + (50 * length * n) // total
    else:  # 64 bits don't hold the product
        m = np.array([50 + (50 * int(x) * n) // total for x in length], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest score; -1 where there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -1


def accumulate(postings: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the survivors of one item in one block.

    ``postings``: (weight, places, impacts) per term, rarest first; ``least``: a
    score that k documents elsewhere have already (or -1)."""
    scores, live = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool)
    rest = sum(w * int(f.max()) for w, _, f in postings)
    creating, bar = True, least
    for w, places, f in postings:
        if creating:
            if rest >= bar and scores.max(initial=0) > rest:  # only then may the k-th exceed it
                bar = max(bar, kth(scores[live], k))
            creating = rest >= bar
        if creating:
            live[places] = True
            scores[places] += w * f
        else:
            held = live[places]
            scores[places[held]] += w * f[held]
        rest -= w * int(f.max())
    found = np.flatnonzero(live & (scores > 0))
    return found, scores[found]


def best(scores: np.ndarray, known: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest scores, equal ones by id, null ids last."""
    if len(scores) > k:
        held = scores >= kth(scores, k)
        scores, known, ids = scores[held], known[held], ids[held]
    order = np.lexsort((ids, ~known, -scores))[:k]
    return scores[order], known[order], ids[order]


def candidates(blocks: DataFrame, queries: dict[int, list[tuple[str, int]]], n: int, total: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): per task, the k best of each item."""
    shared = blocks.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        held = {item: none for item in queries}
        for b in batches:
            for row in b.to_pylist():
                ends = np.cumsum(row["counts"])
                place_of = {t: i for i, t in enumerate(row["terms"])}
                places = np.frombuffer(row["places"], np.int32)
                ids, known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
                f = impacts(np.frombuffer(row["tfs"], np.int32), np.frombuffer(row["lengths"], np.int64)[places], n, total)
                for item, terms in queries.items():
                    own = [(w, slice(ends[i] - row["counts"][i], ends[i])) for t, w in terms if (i := place_of.get(t)) is not None]
                    if not own:
                        continue
                    scores, *_ = held[item]
                    found, new = accumulate([(w, places[s], f[s]) for w, s in own], len(ids), k, int(scores[-1]) if len(scores) == k else -1)
                    held[item] = best(*(np.concatenate(x) for x in zip(held[item], (new, known[found], ids[found]), strict=True)), k)
        for item, (scores, known, ids) in held.items():
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids, mask=~known), pa.array(scores)],
                                                 names=["item_id", "doc_id", "score"])

    given = blocks.select("terms", "counts", "places", "tfs", "ids", "known", "lengths")
    return given.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score for every item."""
    asked = written(item_terms(items), "lexical-items")
    blocks = written(index(docs, asked.select("term").distinct()), "lexical-index")
    w, n, total = weights(blocks)
    # a weight of 0 adds nothing to any document
    weighted = written(asked.join(w.where("w > 0"), "term"), "lexical-weights")
    passes = max(1, -(-weighted.count() // PASS_TERMS))
    found = None
    for p in range(passes):
        rows = weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p)
        queries: dict[int, list[tuple[str, int]]] = {}
        for r in sorted(rows.collect(), key=lambda r: (r.df, r.term)):  # rarest first
            queries.setdefault(r.item_id, []).append((r.term, r.w))
        part = candidates(blocks, queries, n, total, k)
        if passes > 1:
            part = written(part, "lexical-found")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
