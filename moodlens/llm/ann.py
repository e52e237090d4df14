"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are centred on their mean, scaled to length one, and turned by a random
orthonormal matrix into ``BITS_PER_DIMENSION`` coordinates per dimension, of which
a code keeps the signs.  With a code go two scalars: the vector's
distance from the centre, and the inner product of the turned vector with its
own code.  From them follow an unbiased estimate of its inner product with any
query and, from the known spread of that estimate, a lower and an upper bound of
the distance (``EPSILON`` standard errors).  A query first measures, on original
vectors, the k rows of a block with the smallest upper bounds; then just those
whose lower bound doesn't exceed the k-th distance it knows by then, from this
block and those that its task has gone through before.

Every vector is coded.  Codes lie in blocks of ``BLOCK`` vectors with these;
queries come in blocks too.  A task takes a block of queries through a stripe of
blocks of codes and hands over k rows per query, so what it writes doesn't grow with the
rows it looked at, and the work spreads over as many tasks as there are stripes.  Equal vectors have equal
distances, and ties go to the smaller id: of each group of equal vectors only the
``k + 1`` smallest ids can be among anyone's k nearest, and only these are coded.

Defined results: rows without an id, and vectors that are null, zero, hold null
or non-finite components, or aren't of the most common length, take no part,
neither as query nor as candidate.  Repeated rows (same id, same vector) count
once; a candidate with the query's id is its own row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 4096
QUERIES = 1024
#: Blocks of codes that one task goes through with a block of queries, about.
STRIPE = 16
#: Queries whose bounds are held at a time, and rows that are measured at a time.
STEP = 128
MEASURED = 16_384
EPSILON = 3.0
LEAST_BITS = 256
BITS_PER_DIMENSION = 16
#: Relative error of a squared distance.
ROUNDING = 1e-12


def valid(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the rows that take part, as doubles."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (df.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
            .where(F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (lengths.d if lengths else 0))


def matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)


def centre(rows: DataFrame) -> np.ndarray:
    """Mean of all vectors; per task one partial sum per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for b in batches:
            if b.num_rows:
                total, n = total + matrix(b, 0).sum(axis=0), n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), n))], names=["i", "s", "n"])

    sums = rows.select("v").mapInArrow(run, "i int, s double, n bigint").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m")).orderBy("i").collect()
    return np.array([r.m for r in sums])


def rotation(dimensions: int, bits: int, seed: int = 3) -> np.ndarray:
    """``dimensions`` random orthonormal rows of ``bits`` coordinates."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, dimensions)))
    return q.T.copy()


def code(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, distance from the centre, inner product with the own code."""
    rest = x - mean
    far = np.sqrt((rest * rest).sum(axis=1))
    turned = (rest / np.maximum(far, 1e-300)[:, None]) @ turn
    return np.packbits(turned > 0, axis=1), far, np.maximum(np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1]), 1e-9)


def bounds(queries: np.ndarray, codes: np.ndarray, far: np.ndarray, own: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances (queries x codes)."""
    bits = turn.shape[1]
    rest = queries - mean
    away = np.sqrt((rest * rest).sum(axis=1))
    turned = ((rest / np.maximum(away, 1e-300)[:, None]) @ turn).astype(np.float32)
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32)
    # sum over ones less sum over zeros, as signs are +-1
    inner = (2 * (turned @ signs.T) - turned.sum(axis=1, keepdims=True)) / (np.sqrt(bits) * own)
    error = EPSILON * np.sqrt(np.maximum(1 - own * own, 0) / (own * own) / (bits - 1))
    middle = far * far + (away * away)[:, None] - 2 * far * away[:, None] * inner
    width = 2 * far * away[:, None] * error + 1e-6 * (far * far + (away * away)[:, None])  # and single precision
    return middle - width, middle + width


def index(rows: DataFrame, mean: np.ndarray, turn: np.ndarray) -> DataFrame:
    """Blocks of codes and original vectors: (block, ids, codes, far, own, raw)."""
    shared = rows.sparkSession.sparkContext.broadcast((mean, turn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, turn = shared.value
        part, n, ids, held = TaskContext.get().partitionId() << 32, 0, [], []

        def close() -> pa.RecordBatch:
            own = np.concatenate(ids)
            columns = [np.concatenate([h[i] for h in held]) for i in range(4)]
            return pa.RecordBatch.from_arrays([pa.array([part + n], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (own, *columns))],
                                              names=["block", "ids", "codes", "far", "own", "raw"])

        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                own = b.slice(i, BLOCK)
                ids.append(own.column(0).to_numpy())
                x = matrix(own, 1)
                held.append((*code(x, mean, turn), x))
                if sum(map(len, ids)) >= BLOCK:
                    yield close()
                    n, ids, held = n + 1, [], []
        if ids:
            yield close()

    return rows.select("vec_id", "v").mapInArrow(run, "block bigint, ids binary, codes binary, far binary, own binary, raw binary")


def query_blocks(queries: DataFrame, n: int) -> DataFrame:
    """``n`` blocks of queries, dealt by a hash of the id: (q, query_ids, vectors)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        b = group.to_batches()[0]
        return pa.table({"q": pa.array([b.column(0)[0].as_py()], pa.int64()), "query_ids": pa.array([b.column(1).to_numpy().tobytes()], pa.binary()),
                         "vectors": pa.array([matrix(b, 2).tobytes()], pa.binary())})

    return (queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("q"), "vec_id", "v")
            .groupBy("q").applyInArrow(run, "q bigint, query_ids binary, vectors binary"))


def first_of(held: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k nearest of every owner, and what is as near as the last to within
    rounding: (owner, squared distance, id) by owner, distance, id."""
    order = np.lexsort((held[2], held[1], held[0]))
    owner, far, ids = (x[order] for x in held)
    start = np.searchsorted(owner, owner)
    last = np.minimum(start + k - 1, np.searchsorted(owner, owner, side="right") - 1)
    kept = (np.arange(len(owner)) - start < k) | (far <= far[last] * (1 + ROUNDING))
    return [owner[kept], far[kept], ids[kept]]


def cuts(held: list[np.ndarray], n: int, k: int) -> np.ndarray:
    """The k-th smallest squared distance of each of n owners (infinite with fewer)."""
    out = np.full(n, np.inf)
    start, end = np.searchsorted(held[0], np.arange(n)), np.searchsorted(held[0], np.arange(n), side="right")
    enough = end - start >= k
    out[enough] = held[1][start[enough] + k - 1]
    return out


def rerank(x: np.ndarray, query_ids: np.ndarray, block: dict, held: list[np.ndarray], mean: np.ndarray, turn: np.ndarray, k: int) -> tuple[list[np.ndarray], int]:
    """Queries meet a block: the k rows with the smallest upper bounds are measured
    on original vectors first; then, of the others, those whose lower bound
    doesn't exceed the k-th distance that is known by then.  Returns what is held
    and how many rows were measured."""
    low, high = bounds(x, block["codes"], block["far"], block["own"], mean, turn)
    other = query_ids[:, None] != block["ids"]
    high[~other] = np.inf
    first = np.zeros(high.shape, bool)
    n = min(k, high.shape[1])
    np.put_along_axis(first, np.argpartition(high, n - 1, axis=1)[:, :n], True, axis=1)
    measured = 0
    for ask in (lambda: first & other, lambda: ~first & other & (low <= cuts(held, len(x), k)[:, None])):
        at, which = np.nonzero(ask())
        for i in range(0, len(at), MEASURED):
            a, w = at[i:i + MEASURED], which[i:i + MEASURED]
            rest = x[a] - block["vectors"][w]
            held = first_of([np.concatenate(z) for z in zip(held, (a, (rest * rest).sum(axis=1), block["ids"][w]), strict=True)], k)
        measured += len(at)
    return held, measured


def nearest_in_stripes(blocks: DataFrame, queries: DataFrame, n: int, mean: np.ndarray, turn: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id): per block of queries and stripe of blocks of codes, the k nearest of every query."""
    shared = blocks.sparkSession.sparkContext.broadcast((mean, turn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, turn = shared.value
        key, query_ids, x, held = None, None, None, []

        def none() -> list[np.ndarray]:
            return [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]

        def close() -> Iterator[pa.RecordBatch]:
            for i, part in enumerate(held):
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[i * STEP + part[0]]), pa.array(part[2])], names=["query_id", "vec_id"])

        for b in batches:
            for row in range(b.num_rows):
                q, stripe, ids, codes, far, own, raw, asked, given = (b.column(i)[row].as_py() for i in range(9))
                if key != (q, stripe):
                    if key is not None:
                        yield from close()
                    key, query_ids = (q, stripe), np.frombuffer(asked, np.int64)
                    x = np.frombuffer(given).reshape(len(query_ids), -1)
                    held = [none() for _ in range(0, len(x), STEP)]
                ids = np.frombuffer(ids, np.int64)
                block = {"ids": ids, "codes": np.frombuffer(codes, np.uint8).reshape(len(ids), -1), "far": np.frombuffer(far), "own": np.frombuffer(own),
                         "vectors": np.frombuffer(raw).reshape(len(ids), -1)}
                for i in range(len(held)):
                    part = slice(i * STEP, (i + 1) * STEP)
                    held[i], _ = rerank(x[part], query_ids[part], block, held[i], mean, turn, k)
        if key is not None:
            yield from close()

    stripe = F.pmod(F.xxhash64("block"), F.lit(max(1, -(-blocks.count() // STRIPE)))).alias("stripe")
    # every pair of blocks is a row; the pairs of a stripe are one after the other in a task
    pairs = blocks.select("*", stripe, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("q"))
    joined = (pairs.join(queries, "q").repartition("q", "stripe").sortWithinPartitions("q", "stripe", "block")
              .select("q", "stripe", "ids", "codes", "far", "own", "raw", "query_ids", "vectors"))
    return joined.mapInArrow(run, "query_id bigint, vec_id bigint")


def distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def search(df: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every query row, by Euclidean distance."""
    rows = written(valid(df, vector), "ann-vectors")
    mean = centre(rows)
    bits = max(LEAST_BITS, -(-BITS_PER_DIMENSION * len(mean) // 64) * 64)
    turn = rotation(max(1, len(mean)), bits)
    mean = mean if len(mean) else np.zeros(1)
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    coded = written(rows.distinct().withColumn("place", place).where(F.col("place") <= k + 1).select("vec_id", "v"), "ann-coded")
    queries = written(rows.where(is_query).distinct(), "ann-queries")
    blocks = written(index(coded, mean, turn), "ann-index")
    n = max(1, -(-queries.count() // QUERIES))
    asked = written(query_blocks(queries, n), "ann-asked")
    found = written(nearest_in_stripes(blocks, asked, n, mean, turn, k), "ann-found")
    # the measure itself, for the few that are left
    scored = (found.join(coded.withColumnRenamed("v", "b"), "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("a")), "query_id")
              .select("query_id", "vec_id", distance("a", "b").alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
