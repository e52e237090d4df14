"""Hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by direction (k-means on the sphere, fitted on a bounded
sample of anchors) and dealt into groups of one cluster.  Candidates lie in
blocks, in the order of their cells (the nearest centre).  For a group and a block the
candidates are sorted once, by an upper bound of their inner product with any
member of the group: length times the cosine of the angle to the centre less the
group's widest angle.  Every member walks that list until the bound times its own
length falls below the score that it still needs; what follows can't count, so
results are exact.

1. *First look*: per cluster the ``FIRST_BLOCKS`` blocks with the largest bounds
   are walked; the k-th best score of each anchor is the least it needs.
2. *Positives*: blocks whose bound reaches what some member of the cluster needs
   are walked for the k best of the anchor's label.
3. *Negatives*: the same walk for rows of other labels, per positive within
   ``low/100`` to 1 times the positive's score.

A block is met by the groups of the clusters that it can matter to, a bounded
number of centres, so block and cluster are matched without pairs of rows.  Pairs
are dealt to tasks by group and stripe (about ``STRIPE`` blocks), and a task
hands over k rows per anchor (and positive), ranked over all stripes after that.

Of equal vectors with equal labels only the ``k + 1`` smallest ids can be among
anyone's first k: equal scores go to smaller ids, and an anchor leaves out itself
alone.  So a vector that many rows share costs no more than those.

Scores are exact integers: in double precision while it holds them, with
Python's integers beyond; a score outside 64 bits counts as the nearest long.

Defined results: rows with a null id, label or vector, with null or non-finite
components, or not of the most common length take no part.  Of several rows with
one id the first by label, then vector, takes part; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ann import matrix
from .common import discard, written

BLOCK = 4096
GROUP = 1024
#: Centres of anchors and cells: at most so many, and anchors they are fitted on.
CENTRES = 256
SAMPLE = 20_000
ROUNDS = 8
STRIPE = 16
FIRST_BLOCKS = 2
#: Candidates of a list that are scored between looks at the bound.
STEP = 512
#: Relative slack of bounds against rounding (an angle near 0 is exact to about 1e-8).
SLACK = 1e-7
#: Doubles hold a hundredfold of integers below this; larger scores are Python's integers.
EXACT = 2.0**46
LONG = np.iinfo(np.int64)
GROUPS = "grp bigint, cluster int, ids binary, labels binary, vectors binary, needs binary, wide double, far double, least double, upper binary"
BLOCKS = "block bigint, n int, ids binary, labels binary, raw binary"
PAIRS = "block bigint, cluster int, bound double"


def valid(df: DataFrame, vector: str, label: Column) -> DataFrame:
    """(vec_id, label, v): one row per id that takes part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (df.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.col(vector).alias("v"))
            .where(F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    one = rows.where(F.size("v") == (lengths.d if lengths else 0)).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return one.select("vec_id", "r.label", "r.v")


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """The integer vectors whose inner products are the scores."""
    return np.floor(scale * x)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths (a zero vector has no direction)."""
    length = np.sqrt((x * x).sum(axis=1))
    return x / np.maximum(length, 1e-300)[:, None], length


def centres(anchors: DataFrame, scale: float) -> np.ndarray | None:
    """Centres of the anchors' directions, fitted on about ``SAMPLE`` anchors at
    most; none without anchors."""
    count = anchors.count()
    share = min(1.0, SAMPLE / max(1, count))
    picked = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else anchors
    rows = picked.orderBy("vec_id").toArrow()
    if rows.num_rows == 0:
        return None
    x, _ = unit(whole(matrix(rows.select(["v"]).combine_chunks().to_batches()[0], 0), scale))
    n = int(min(CENTRES, max(1, round(np.sqrt(count / 8)))))
    centre = x[np.random.default_rng(7).choice(len(x), size=min(n, len(x)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (x @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, nearest, x)
        centre = np.where((np.abs(sums).sum(axis=1) > 0)[:, None], unit(sums)[0], centre)
    return centre


def located(rows: DataFrame, centre: np.ndarray, scale: float) -> DataFrame:
    """(vec_id, label, v, cell): the nearest centre of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(centre)
    schema = rows.select("vec_id", "label", "v").schema.add("cell", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = (unit(whole(matrix(b, 2), scale))[0] @ shared.value.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=["vec_id", "label", "v", "cell"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, schema)


def angles(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angles of directions to one centre; 0 for a zero vector, whose bound is 0 anyway."""
    return np.arccos(np.clip(x @ centre, -1, 1))


def anchor_groups(anchors: DataFrame, centre: np.ndarray, scale: float) -> DataFrame:
    """Groups of at most about ``GROUP`` anchors of one cluster; ``wide`` is the
    widest angle to the centre, ``far`` the greatest length."""
    shared = anchors.sparkSession.sparkContext.broadcast(centre)
    sizes = anchors.groupBy("cell").count().select("cell", F.ceil(F.col("count") / GROUP).cast("bigint").alias("parts"))
    dealt = (anchors.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
             .select("cell", "part", "vec_id", "label", "v"))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        b = group.combine_chunks().sort_by("vec_id").combine_chunks().to_batches()[0]
        cluster, x = key[0].as_py(), whole(matrix(b, 4), scale)
        turn, length = unit(x)
        ids, labels = b.column(2).to_numpy(), b.column(3).to_numpy()
        values = [key[1].as_py() * len(shared.value) + cluster, cluster, ids.tobytes(), labels.tobytes(), x.tobytes(), np.full((len(x), 1), -np.inf).tobytes(),
                  float(angles(turn, shared.value[cluster]).max()), float(length.max()), -np.inf, b""]
        return pa.table({f.split()[0]: [v] for f, v in zip(GROUPS.split(", "), values, strict=True)}).cast(pa.schema([
            ("grp", pa.int64()), ("cluster", pa.int32()), *((n, pa.binary()) for n in ("ids", "labels", "vectors", "needs")),
            *((n, pa.float64()) for n in ("wide", "far", "least")), ("upper", pa.binary())]))

    return dealt.groupBy("cell", "part").applyInArrow(run, GROUPS)


def candidate_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of at most ``BLOCK`` candidates, with their vectors as given;
    ``rows`` come sorted by cell within their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, held, n = TaskContext.get().partitionId() << 32, [], 0

        def close(group: pa.Table) -> pa.RecordBatch:
            b = group.combine_chunks().to_batches()[0]
            flat = b.column(2).flatten()
            values = (b.column(0).to_numpy(), b.column(1).to_numpy(), flat.to_numpy(zero_copy_only=False) if pa.types.is_float32(flat.type) else matrix(b, 2))
            return pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([b.num_rows], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in values)],
                                              names=["block", "n", "ids", "labels", "raw"])

        for b in batches:
            held, n = [*held, b], n + b.num_rows
            while n >= BLOCK:
                group = pa.Table.from_batches(held)
                yield close(group.slice(0, BLOCK))
                place, held, n = place + 1, group.slice(BLOCK).to_batches(), n - BLOCK
        if n:
            yield close(pa.Table.from_batches(held))

    return rows.select("vec_id", "label", "v").mapInArrow(run, BLOCKS)


def vectors(raw: bytes, n: int, d: int, scale: float) -> np.ndarray:
    """The integer vectors of a block."""
    x = np.frombuffer(raw, np.float32 if len(raw) == 4 * n * d else np.float64).reshape(n, d)
    return whole(x.astype(np.float64), scale)


def reach(blocks: DataFrame, groups: DataFrame, centre: np.ndarray, scale: float) -> DataFrame:
    """(block, cluster, bound): the clusters of which some member may still need
    a row of the block, by the bound of its best row with any member."""
    stats = groups.groupBy("cluster").agg(F.max("wide").alias("wide"), F.max("far").alias("far"), F.min("least").alias("least")).collect()  # one row a centre
    shared = blocks.sparkSession.sparkContext.broadcast((centre, [tuple(r) for r in stats]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, stats = shared.value
        for b in batches:
            for i in range(b.num_rows):
                turn, length = unit(vectors(b.column(2)[i].as_py(), b.column(1)[i].as_py(), centre.shape[1], scale))
                found = []
                for cluster, wide, far, least in stats:
                    top = far * (length * np.cos(np.clip(angles(turn, centre[cluster]) - wide, 0, np.pi))).max()
                    # a negative bound holds for the shortest member, so it is 0 for all
                    top = max(top, 0.0)
                    if top + SLACK * (1 + abs(top)) >= least:
                        found.append((cluster, top))
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(found), pa.int64()), pa.array([c for c, _ in found], pa.int32()),
                                                  pa.array([t for _, t in found], pa.float64())], names=["block", "cluster", "bound"])

    return blocks.select("block", "n", "raw").mapInArrow(run, PAIRS)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= EXACT:
        s = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
        return np.clip(s, LONG.min, LONG.max)
    return a @ b.T


def merge(held: list[np.ndarray], found: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> list[np.ndarray]:
    """The k best of each owner: (owner, score, id) sorted by owner, score downwards, id."""
    owner, score, ids = (np.concatenate(x) for x in zip(held, found, strict=True))
    order = np.lexsort((ids, -score, owner)) if score.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (owner[i], -score[i], ids[i])), np.int64)
    owner, score, ids = owner[order], score[order], ids[order]
    start = np.searchsorted(owner, owner)  # first place of the owner
    first = np.arange(len(owner)) - start < k
    return [owner[first], score[first], ids[first]]


def bars(held: list[np.ndarray], needs: np.ndarray, k: int) -> np.ndarray:
    """What each owner needs: its k-th best score, once it has k."""
    out = needs.copy()
    owner, score, _ = held
    for o in np.flatnonzero(np.bincount(owner, minlength=len(needs)) >= k) if len(owner) else ():
        least = float(score[np.searchsorted(owner, o, side="right") - 1])
        out[o] = max(out[o], least if abs(least) < EXACT else least - abs(least) * SLACK)
    return out


def walk(group: dict, block: dict, held: list[np.ndarray], centre: np.ndarray, k: int, low: int) -> list[np.ndarray]:
    """Every member of a group walks the block's list, sorted by the shared bound.

    Without ``low`` an owner is an anchor and looks for rows of its label; with
    it an owner is an anchor's positive and looks for rows of other labels within
    ``low/100`` to 1 times its score."""
    turn, length = unit(block["vectors"])
    bound = length * np.cos(np.clip(angles(turn, centre[group["cluster"]]) - group["wide"], 0, np.pi))
    order = np.argsort(-bound, kind="stable")
    bound = bound[order]
    needs = group["needs"]
    per = needs.shape[1]
    own_length = group["length"]
    for i in range(0, len(order), STEP):
        bar = bars(held, needs.ravel(), k).reshape(needs.shape)
        top = own_length * bound[i] if bound[i] > 0 else np.zeros(len(own_length))
        active = np.flatnonzero(top + SLACK * (1 + np.abs(top)) >= bar.min(axis=1))
        if not len(active):
            break
        part = order[i:i + STEP]
        s = scores(group["vectors"][active], block["vectors"][part])
        same = group["labels"][active][:, None] == block["labels"][part]
        ids = block["ids"][part]
        if low:
            for p in range(per):
                upper = group["upper"][active, p][:, None].astype(s.dtype)
                fits = ~same & (100 * s <= 100 * upper) & (100 * s >= low * upper) & (s >= bar[active, p][:, None])
                a, c = np.nonzero(fits)
                if len(a):
                    held = merge(held, (active[a] * per + p, s[a, c], ids[c]), k)
        else:
            fits = same & (group["ids"][active][:, None] != ids) & (s >= bar[active, 0][:, None])
            a, c = np.nonzero(fits)
            if len(a):
                held = merge(held, (active[a], s[a, c], ids[c]), k)
    return held


def walked(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, centre: np.ndarray, scale: float, k: int, low: int = 0) -> DataFrame:
    """(anchor_id, slot, score, id): per group and stripe the k best of every owner.

    A group goes to each of its stripes once, ahead of the stripe's blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, group, held = shared.value, None, []

        def close() -> pa.RecordBatch:
            owner, score, ids = held
            per = group["needs"].shape[1]
            return pa.RecordBatch.from_arrays([pa.array(group["ids"][owner // per]), pa.array(owner % per, pa.int32()), pa.array(score.astype(np.int64)), pa.array(ids)],
                                              names=["anchor_id", "slot", "score", "id"])

        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                if row["head"]:
                    if group is not None:
                        yield close()
                    x = np.frombuffer(row["vectors"]).reshape(len(ids), -1)
                    needs = np.frombuffer(row["needs"]).reshape(len(ids), -1)
                    group = {"cluster": row["cluster"], "wide": row["wide"], "ids": ids, "labels": labels, "vectors": x, "length": unit(x)[1], "needs": needs,
                             "upper": np.frombuffer(row["upper"], np.int64).reshape(needs.shape) if row["upper"] else None}
                    held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
                else:
                    block = {"ids": ids, "labels": labels, "vectors": vectors(row["vectors"], len(ids), centre.shape[1], scale)}
                    held = walk(group, block, held, centre, k, low)
        if group is not None:
            yield close()

    stripes = F.pmod(F.xxhash64("block"), F.lit(max(1, -(-blocks.count() // STRIPE)))).alias("stripe")
    met = pairs.join(groups.select("grp", "cluster"), "cluster").select("block", "grp", stripes, "bound")
    none = {n: F.lit(None).cast(t) for n, t in (("cluster", "int"), ("needs", "binary"), ("wide", "double"), ("upper", "binary"))}
    order = ["grp", "stripe", "head", "bound", "block"]
    rest = ["cluster", "ids", "labels", "vectors", "needs", "wide", "upper"]
    heads = (met.select("grp", "stripe").distinct().join(groups, "grp")
             .select("grp", "stripe", F.lit(True).alias("head"), F.lit(None).cast("double").alias("bound"), F.lit(None).cast("bigint").alias("block"), *rest))
    members = met.join(blocks, "block").withColumnRenamed("raw", "vectors").withColumns(none).withColumn("head", F.lit(False)).select(*order, *rest)
    dealt = (heads.unionByName(members).repartition("grp", "stripe")
             .sortWithinPartitions("grp", "stripe", F.desc("head"), F.desc("bound"), "block").select("head", *rest))
    return dealt.mapInArrow(run, "anchor_id bigint, slot int, score bigint, id bigint")


def ranked(found: DataFrame, k: int, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def needing(groups: DataFrame, best: DataFrame, k: int, low: int = 0) -> DataFrame:
    """Groups with what their members need: of ``best`` (anchor_id, rank, score)
    the k-th score, or with ``low`` a window per positive (none without positives)."""
    places = groups.select("grp", F.col("ids").alias("a"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = np.frombuffer(b.column(1)[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), b.column(0)[i].as_py())), pa.array(ids)], names=["grp", "anchor_id"])

    members = places.mapInArrow(opened, "grp bigint, anchor_id bigint")
    lists = members.join(best.select("anchor_id", "rank", "score"), "anchor_id").groupBy("grp").agg(F.collect_list(F.struct("anchor_id", "rank", "score")).alias("best"))  # k a member
    names = [f.split()[0] for f in GROUPS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                ids = np.frombuffer(row["ids"], np.int64)
                # a window is empty below a negative score, as it is without a positive
                upper = np.full((len(ids), k), -1 if low else LONG.min)
                for x in row.pop("best") or []:
                    upper[np.searchsorted(ids, x["anchor_id"]), x["rank"] - 1] = x["score"]
                least = upper * (low / 100) if low else upper[:, k - 1:].astype(float)
                needs = np.where(np.abs(least) < EXACT, least, least - np.abs(least) * SLACK)
                if low:
                    needs = np.where(upper >= 0, needs * (1 - SLACK), np.inf)  # the window itself is exact
                    row["upper"] = upper.tobytes()
                row["needs"] = needs.tobytes()
                row["least"] = float(needs.min())
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([(f.name, f.type) for f in b.schema if f.name != "best"]))

    return groups.join(lists, "grp", "left").select(*names, "best").mapInArrow(run, GROUPS)


def mine(df: DataFrame, is_anchor: Column, label: Column, vector: str = "embedding", k: int = 5, scale: float = 256.0, low: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows = written(valid(df, vector, label), "negatives-rows")
    anchors = rows.where(is_anchor)
    centre = centres(anchors, scale)
    if centre is None:
        return df.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    place = F.row_number().over(Window.partitionBy("v", "label").orderBy("vec_id"))
    first = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    # a cell's rows spread over salted keys, so that no cell is one task's
    salted = located(first, centre, scale).repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(64))).sortWithinPartitions("cell", "vec_id")
    blocks = written(candidate_blocks(salted), "negatives-blocks")
    groups = written(anchor_groups(located(anchors, centre, scale), centre, scale), "negatives-groups")
    discard(rows)

    def best_of(pairs: DataFrame, groups: DataFrame, keys: list[str], low: int = 0) -> DataFrame:
        return written(ranked(walked(pairs, groups, blocks, centre, scale, k, low), k, keys), "negatives-best")

    pairs = written(reach(blocks, groups, centre, scale), "negatives-reach")
    nearest = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("bound"), "block"))
    seen = best_of(pairs.withColumn("r", nearest).where(F.col("r") <= FIRST_BLOCKS).drop("r"), groups, ["anchor_id"])
    asking = written(needing(groups, seen, k), "negatives-needs")
    positives = best_of(reach(blocks, asking, centre, scale), asking, ["anchor_id"])
    windows = written(needing(groups, positives, k, low), "negatives-windows")
    found = best_of(reach(blocks, windows, centre, scale), windows, ["anchor_id", "slot"], low)
    discard(blocks, groups, pairs, seen, asking, windows)
    own = positives.select(F.col("anchor_id").alias("a"), (F.col("rank") - 1).alias("s"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (found.join(own, (F.col("anchor_id") == F.col("a")) & (F.col("slot") == F.col("s")))
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
