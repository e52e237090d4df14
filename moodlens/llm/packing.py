"""Best-fit packing of documents into sequences by bin completion.

A document longer than a sequence is cut into pieces; all but its first piece
fill a sequence.  What remains is bin packing of lengths below the capacity.
How lengths combine depends on nothing but how many pieces have each length:
a table of at most ``capacity`` rows, whatever the corpus.  Branch and bound
runs on that table.  Around the largest open length it enumerates the fillings
that no other dominates, takes each as often as the counts allow, bounds every
branch by the waste it may still have, and keeps the best plan so far; the
first such incumbent is best-fit decreasing.  Spark then deals pieces to the
plan's places: a piece's rank among those of its length (counted per written
part, then summed up) gives its sequence and offset, so no length, however
common, meets in one task.

Defined results: a null or empty text is the end id alone.  Repeated rows are
packed each.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_lists, chunks, written
from .tokens import encoder

CAPACITY = 1024
END_ID = 2
#: Branches that the search may open before it settles for the incumbent.
NODES = 3000
#: Fillings that are tried at a branch.
WIDTH = 4

Plan = list[tuple[tuple[int, ...], int]]


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, place): the pieces of
    all documents.  ``place`` counts pieces of one length within a part."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    schema = "piece int, start bigint, length bigint, ids_crc32 bigint, part int, place bigint" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part, places = TaskContext.get().partitionId(), Counter()
        for batch in chunks(batches):
            at, out = [], [[] for _ in range(7)]
            for i, ids in enumerate(encode(byte_lists(batch, "text"))):
                ids += end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    stop = start + capacity if k else first
                    own = ids[4 * start:4 * stop]
                    at.append(i)
                    for column, v in zip(out, (k, start, stop - start, zlib.crc32(own), part, places[stop - start], own), strict=True):
                        column.append(v)
                    places[stop - start] += 1
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()][:7 if with_ids else 6]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(out, kinds, strict=False))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place", "ids"][:8 if with_ids else 7])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, {schema}")


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of ``b`` can be dealt to places of the sizes in ``a``."""
    if not b:
        return True
    tried = set()
    for i, room in enumerate(a):
        if room >= b[0] and room not in tried:
            tried.add(room)
            if dominates((*a[:i], room - b[0], *a[i + 1:]), b[1:]):
                return True
    return False


def fillings(room: int, counts: list[int], width: int = WIDTH) -> list[tuple[int, ...]]:
    """Undominated multisets of available lengths that fit in ``room``, least
    waste first: all of one and two items by falling sum, with a third and
    fourth where small lengths can still fill a gap; at most ``width``."""
    if room <= 0:
        return [()]
    top = min(room, len(counts) - 1)
    if counts[top] and top == room:
        return [(room,)]  # one item that fills the room dominates all else
    there = [v for v in range(top, 0, -1) if counts[v]]
    if not there:
        return [()]
    smallest, known = there[-1], set(there)
    found: set[tuple[int, ...]] = set()

    def close(items: tuple[int, ...], left: int) -> None:
        """Adds best-fitting further items until none fits."""
        while left >= smallest:
            for v in there:
                if v <= left and counts[v] > items.count(v):
                    items, left = (*items, v), left - v
                    break
            else:
                break
        found.add(tuple(sorted(items, reverse=True)))

    close((there[0],), room - there[0])
    exact = 0
    for a in there:
        rest = room - a
        if rest in known and counts[rest] > (rest == a):
            found.add((max(a, rest), min(a, rest)))
            exact += 1
        if exact >= width or rest > a:
            break
    if not exact:
        for a in there[:64]:
            close((a,), room - a)
            for b in there:  # with an item between: three items may fill exactly
                rest = room - a - b
                if b <= a and rest > 0 and rest in known and rest <= b and counts[rest] > (rest == a) + (rest == b) and counts[b] > (a == b):
                    found.add((a, b, rest))
                    exact += 1
                    break
            if exact >= width:
                break
    ranked = sorted(found, key=lambda f: (room - sum(f), len(f), tuple(-x for x in f)))[:4 * width]
    kept: list[tuple[int, ...]] = []
    for f in ranked:
        if not any(dominates(k, f) for k in kept):
            kept.append(f)
    return kept[:width]


def best_fit(counts: list[int], capacity: int) -> Plan:
    """Best-fit decreasing, on counts: the largest open length, then always the
    largest that still fits, as often as the counts allow."""
    counts, plan = list(counts), []
    for v in range(capacity, 0, -1):
        while counts[v]:
            items, left = [v], capacity - v
            while left:
                w = next((w for w in range(min(left, v), 0, -1) if counts[w] > items.count(w)), 0)
                if not w:
                    break
                items.append(w)
                left -= w
            plan.append(take(counts, tuple(items)))
    return plan


def take(counts: list[int], items: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    own = Counter(items)
    times = min(counts[v] // n for v, n in own.items())
    for v, n in own.items():
        counts[v] -= n * times
    return items, times


def solve(lengths: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """[(lengths of a sequence, how many such sequences)] for all pieces."""
    counts = [0] * (capacity + 1)
    for v, n in lengths.items():
        counts[v] += n
    total = sum(v * n for v, n in enumerate(counts))
    best = best_fit(counts, capacity)
    fewest, bound = sum(t for _, t in best), -(-total // capacity)
    budget = nodes
    # depth first; a branch: counts, plan so far, sequences, tokens left
    stack: list[tuple[list[int], Plan, int, int]] = [(counts, [], 0, total)]
    while stack and fewest > bound and budget > 0:
        now, plan, used, left = stack.pop()
        while True:
            if used + -(-left // capacity) >= fewest:  # its waste alone already costs a sequence too many
                break
            largest = next((v for v in range(capacity, 0, -1) if now[v]), 0)
            if not largest:
                best, fewest = plan, used
                break
            budget -= 1
            now[largest] -= 1
            options = fillings(capacity - largest, now)
            now[largest] += 1
            for f in reversed(options[1:]):
                other = list(now)
                step = take(other, (largest, *f))
                stack.append((other, [*plan, step], used + step[1], left - step[1] * (largest + sum(f))))
            now, plan = list(now), list(plan)
            step = take(now, (largest, *options[0]))
            plan.append(step)
            used, left = used + step[1], left - step[1] * (largest + sum(options[0]))
    return best


def places(plan: Plan) -> dict[str, np.ndarray]:
    """The plan by length and rank: rows (length, first rank, items of that
    length in a sequence, first sequence, offset in it), sorted."""
    ranks, rows, sequence = Counter(), [], 0
    for items, times in plan:
        offset = 0
        for v, n in sorted(Counter(items).items(), reverse=True):
            rows.append((v, ranks[v], n, sequence, offset))
            ranks[v] += n * times
            offset += v * n
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T, strict=True))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])."""
    spark = docs.sparkSession
    pieces = written(cut(docs, tokenizer, capacity, end_id, with_ids), "packing-pieces")
    # per part and length; a part's pieces are bounded by the size of a split
    counted = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "packing-counts")
    lengths = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    shared = spark.sparkContext.broadcast(places(solve(lengths, capacity)))
    before = counted.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = (pieces.join(before, ["length", "part"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("before")).alias("rank"), *["ids"] * with_ids))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        step = int(t["rank"].max(initial=0)) + 1
        keys = t["length"] * step + t["rank"]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(keys, length * step + np.minimum(rank, step - 1), "right") - 1
            own = rank - t["rank"][at]
            sequence = t["sequence"][at] + own // t["each"][at]
            offset = t["offset"][at] + own % t["each"][at] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset), *b.columns[6:]],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids])

    kind = dict(pieces.dtypes)["doc_id"]
    return ranked.mapInArrow(deal, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids)
