"""Near-duplicate documents by b-bit MinHash, links confirmed on full sets.

A document's set holds the hashes of its distinct word shingles.  ``HASHES``
minima give ``BANDS`` band keys (of ``ROWS`` minima each) and a packed signature
of their lowest ``BITS`` bits.  Documents with equal sets become one node first.
Candidates share a band key; a pair is looked at further if the sizes allow the
similarity and the signatures' matching fields, counted on the packed bits and
corrected for chance matches, come within five standard errors of it.  At a
similarity of 0.8 a pair is in no common band once in 7 million, and lost by its
estimate once in 3 million.  That doesn't hold for very small sets, in which chance
matches depend on each other, so under ``SMALL`` shingles no estimate is asked.  What is left is confirmed on both full sets.

No bucket is expanded into its pairs.  Every node of a bucket is first paired
with the bucket's smallest node only, and in ``PICKED`` bands with one that a
hash picks, another in each; confirmed links make components.  A bucket whose
nodes are all in one component is then done with, as nothing in it can change
the result: so a third of all rows in one group of near copies costs a few pairs
each, also where many of the copies aren't that similar to its smallest node.

In other buckets nodes of different components are compared.  Where one
component has ``CROWD`` nodes of a bucket or more, the bucket's other nodes are
compared exactly with all of that component and with each other, in cells of
``CELL`` by ``CELL`` sets that yield confirmed links alone: copies that nearly
reach the similarity come in numbers that grow with the square of the group.
In smaller mixed buckets a join compares signatures and passes on only the pairs
that come near.  Components are found by spreading the least
label and jumping along labels, on written tables.

Defined results: a null or empty text, or one without words, has no shingles
and is linked with nothing.  Rows with equal ids are apart, but share their
component if their sets are linked; a null id never names a component unless
all its ids are null.  Columns besides ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_lists, chunks, discard, worker_state, written
from .wordhash import WordHash, mix, shingles

BANDS, ROWS, BITS = 40, 5, 2
HASHES = BANDS * ROWS
LONGS = -(-HASHES * BITS // 64)
PERCENT = 80
#: Shingles under which a set is compared in full whatever its signature says.
SMALL = 30
CELL = 512
#: Nodes of one component in a bucket from which the others meet it in cells.
CROWD = 32
#: Bands in which a second node of each bucket is paired with all others.
PICKED = 12
#: Places of the bitmap that tells a scan which texts may be needed: 8 MB, whatever the corpus.
PLACES = 1 << 26


def least_matches(percent: int) -> int:
    """Matching fields that a pair of that similarity has, less five standard errors."""
    p = percent / 100 + (1 - percent / 100) / 2 ** BITS
    return int(HASHES * p - 5 * (HASHES * p * (1 - p)) ** 0.5)


def permutations(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 31, HASHES, np.uint32) * 2 + 1)[:, None].astype(np.uint32), rng.integers(0, 1 << 32, HASHES, np.uint32)[:, None]


def minima(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (mix(items) >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        out = np.minimum(out, (x[None, i:i + 2048] * a + b).min(axis=1))
    return out


def bands(least: np.ndarray) -> np.ndarray:
    """One key per band, of its minima and its number."""
    x = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        x = mix(x * np.uint64(0x9DDFEA08EB382D69) + column)
    return x.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The lowest ``BITS`` bits of each minimum, as longs."""
    fields = (least[:, None] >> np.arange(BITS, dtype=np.uint32)) & 1
    return np.frombuffer(np.packbits(fields.astype(np.uint8)).tobytes().ljust(8 * LONGS, b"\0"), np.int64)


def word_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    cache = worker_state("minhash").setdefault("minhash-words", WordHash())
    return [shingles(cache.array(t.lower().split()), n) for t in texts]


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(row, doc_id, text_hash, n_shingles, set_id, bands, signature) per row."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"row bigint, doc_id {kind}, text_hash bigint, n_shingles bigint, set_id binary, bands array<bigint>, signature array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations()
        row = TaskContext.get().partitionId() << 33
        for batch in chunks(batches):
            sets = word_sets(byte_lists(batch, "text"), n)
            least = [minima(s, a, b) if len(s) else None for s in sets]
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + size)), batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array([None if m is None else bands(m) for m in least], pa.list_(pa.int64())),
                 pa.array([None if m is None else packed(m) for m in least], pa.list_(pa.int64()))],
                names=["row", "doc_id", "text_hash", "n_shingles", "set_id", "bands", "signature"])
            row += size

    return keyed(docs).mapInArrow(run, schema)


def near(x: str, y: str, percent: int) -> Column:
    """Whether sizes and signatures of two nodes allow the similarity."""
    mask = 0x5555555555555555
    differ = []
    for i in range(LONGS):
        z = F.get(f"{x}.signature", F.lit(i)).bitwiseXOR(F.get(f"{y}.signature", F.lit(i)))
        differ.append(F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(mask))))
    a, b = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    estimate = reduce(lambda p, q: p + q, differ) <= HASHES - least_matches(percent)
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((F.least(a, b) < SMALL) | estimate)


def maybe_needed(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose text_hash has its place in a bitmap of those of ``needed``.

    All rows that are needed pass, and few others while ``PLACES`` is well above the number
    needed; so the join that follows shuffles little else.  The bitmap has at most
    ``PLACES`` / 32,768 rows of 4 KB.
    """
    place = F.pmod("text_hash", F.lit(PLACES)) + 1
    part, bit = F.bitmap_bucket_number(place).alias("__part"), F.bitmap_bit_position(place).alias("__bit")
    bitmap = needed.select(part, bit).distinct().repartition("__part").groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("__bitmap"))
    byte = F.conv(F.hex(F.expr("substring(__bitmap, CAST(__bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    return (texts.select("*", part, bit).join(F.broadcast(bitmap), "__part")
            .where(F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1)
            .select(*texts.columns))


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, items): the full sets of the nodes in ``wanted``, as a written table."""
    needed = written(wanted.select("node").distinct().join(nodes.select("node", "doc_id", "text_hash"), "node"), "minhash-needed")
    texts = maybe_needed(keyed(docs), needed).alias("t").join(needed.alias("k"), F.expr("t.text_hash = k.text_hash AND t.doc_id <=> k.doc_id")).select("k.node", "t.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal rows (same id, same text) count once in a task
        for batch in chunks(batches):
            fresh = [x not in seen and not seen.add(x) for x in batch.column(0).to_pylist()]
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            sets = word_sets(byte_lists(batch, "text"), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "items"])

    return written(texts.mapInArrow(run, "node bigint, items array<bigint>"), "minhash-sets")


def confirm(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked for."""
    one = lambda c: sets.select(F.col("node").alias(c), F.col("items").alias(f"items_{c}"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    every = F.size("items_a") + F.size("items_b") - both
    return pairs.join(one("a"), "a").join(one("b"), "b").where(100 * both >= percent * every).select("a", "b").distinct()


def nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))


def similar(asking: list[np.ndarray], crowd: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Places (asking, crowd) of the sets that are as similar as asked for."""
    items, place = np.unique(np.concatenate(crowd), return_inverse=True)
    size = np.array([len(c) for c in crowd])
    first, out = np.cumsum(size) - size, []
    mark = np.zeros(len(items), np.int32)
    for i, a in enumerate(asking):
        at = np.searchsorted(items, a)
        at = at[(at < len(items)) & (items[np.minimum(at, len(items) - 1)] == a)]
        mark[at] = 1
        both = np.add.reduceat(mark[place], first)
        mark[at] = 0
        out += [(i, int(j)) for j in np.flatnonzero(100 * both >= percent * (len(a) + size - both))]
    return out


def crowded(asks: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the nodes of ``asks`` (label, node), and from them
    to the nodes of that label.  Sets meet in cells of bounded size."""
    members = labels.join(asks.select("label").distinct(), "label").select("label", "node").union(asks.select("label", "node"))
    count = lambda df, c: df.groupBy("label").agg(F.ceil(F.count("*") / CELL).cast("int").alias(c))
    cells = written(count(members, "across").join(count(asks, "down"), "label"), "minhash-cells")
    block = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    crowd = members.join(cells, "label").select("label", block("across").alias("i"), every("down").alias("j"), "node", F.lit(False).alias("asks"))
    asking = asks.join(cells, "label").select("label", every("across").alias("i"), block("down").alias("j"), "node", F.lit(True).alias("asks"))
    rows = crowd.union(asking).join(sets, "node").select("label", "i", "j", "node", "asks", "items")

    def run(cell: pa.Table) -> pa.Table:
        node, asks = cell.column("node").to_numpy(), cell.column("asks").to_numpy()
        items = [x.values.to_numpy() for x in cell.column("items")]
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        found = similar([items[i] for i in a], [items[i] for i in b], percent) if len(a) and len(b) else []
        pairs = [(max(x, y), min(x, y)) for x, y in ((int(node[a[i]]), int(node[b[j]])) for i, j in found) if x != y]
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})

    return rows.groupBy("label", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of an edge can reach."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")), "minhash-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "minhash-labels")
    while True:
        seen = (both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("around")))
        spread = labels.join(seen, "node").select("node", F.least("label", "around").alias("label"), F.col("label").alias("old"))
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = written(spread.join(jump, "label", "left").select("node", F.least("label", "further").alias("label"), "old"), "minhash-labels")
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = PERCENT) -> DataFrame:
    """(row, doc_id, text_hash, n_shingles, component_id, first) of every row.

    ``component_id`` is the smallest id of the component; ``first`` marks the one
    row that stands for it: its smallest id's first row.
    """
    rows = written(signatures(docs, n), "minhash-signatures")
    named = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("row").alias("node"))
    named = written(named, "minhash-sets-named")
    nodes = rows.join(named.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node").drop("set_id")
    in_band = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    pick = F.min(F.when(F.col("band") < PICKED, F.struct(F.xxhash64("node", "key").alias("h"), "node")))["node"]
    buckets = (in_band.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), pick.alias("pick"))
               .where("least < most").select("key", "least", "pick"))
    members = written(in_band.select("node", "key").join(buckets, "key"), "minhash-members")
    info = nodes.select("node", "n_shingles", "signature")

    def close(pairs: DataFrame) -> DataFrame:
        return (pairs.join(info.alias("x"), F.col("a") == F.col("x.node")).join(info.alias("y"), F.col("b") == F.col("y.node"))
                .where(near("x", "y", percent)).select("a", "b"))

    to = F.explode(F.array_distinct(F.array_compact(F.array("least", "pick")))).alias("to")
    stars = (members.select("node", to).where("node <> to")
             .select(F.greatest("node", "to").alias("a"), F.least("node", "to").alias("b")).distinct())
    stars = written(close(stars), "minhash-stars")
    sets = full_sets(docs, nodes, nodes_of(stars), n)
    spent = [members, stars, sets]  # tables that the result doesn't read
    edges = written(confirm(sets, stars, percent), "minhash-links")
    labels = components(edges)
    label = F.coalesce("label", "node").alias("label")
    marked = members.join(labels, "node", "left").select("key", "node", label)
    shares = marked.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = (shares.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("most"))
             .where("labels > 1").select("key", "size", "most.n", F.col("most.label").alias("crowd")))
    mixed = written(mixed, "minhash-mixed")
    # crowds: the others of a bucket against a whole component
    asks = written(marked.join(mixed.where(F.col("n") >= CROWD), "key").where("label <> crowd")
                   .select(F.col("crowd").alias("label"), "node").distinct(), "minhash-asks")
    # the rest: pairs of different components with signatures that come near
    few = mixed.where(F.col("n") < CROWD).select("key", F.ceil(F.col("size") / CELL).cast("int").alias("cells"))
    open_ = (marked.join(few, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
             .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label").join(info, "node"))
    open_ = written(open_, "minhash-open")
    x, y = open_.alias("x"), open_.alias("y")
    crossing = (x.join(y, [F.col("x.key") == F.col("y.key"), F.col("x.i") == F.col("y.i"), F.col("x.j") == F.col("y.j"),
                           F.col("x.label") < F.col("y.label"),
                           (F.col("x.block") != F.col("y.block")) | (F.col("x.i") == F.col("x.j")), near("x", "y", percent)])
                .select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
                .join(stars, ["a", "b"], "left_anti"))  # those are decided
    crossing = written(crossing, "minhash-crossing")
    discard(open_)
    wanted = asks.select("node").union(nodes_of(crossing)).distinct().join(sets, "node", "left_anti")
    wanted = written(wanted, "minhash-wanted")
    if not wanted.isEmpty():
        others = full_sets(docs, nodes, wanted, n)
        spent.append(others)
        sets = sets.union(others)
    more = confirm(sets, crossing, percent).union(crowded(asks, labels, sets, percent))
    more = written(more, "minhash-links")
    spent += [mixed, asks, crossing, wanted, more]
    if not more.isEmpty():
        labels = components(written(edges.union(more), "minhash-links"))
    discard(*spent)
    # each set's component, and each component's smallest id
    sets = named.join(labels, "node", "left").select("set_id", label)
    placed = rows.select("row", "doc_id", "text_hash", "n_shingles", "set_id").join(sets, "set_id", "left")
    placed = placed.withColumn("label", F.coalesce("label", "row"))
    heads = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"),
                                        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("head"))
    return placed.join(heads, "label").select("row", "doc_id", "text_hash", "n_shingles", "component_id", (F.col("row") == F.col("head")).alias("first"))
