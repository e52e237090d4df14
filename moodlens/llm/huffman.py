"""Token ids in files, by canonical length-limited Huffman coding.

One code book serves all files.  It comes from the ids' global counts (at most
one row per id of the vocabulary reaches the driver) by package-merge, which
gives the best code whose words have at most ``LIMIT`` bits; being canonical,
it is kept as the lengths alone.

A file set is a folder with ``book`` and ``blocks``.  ``blocks`` has one folder
per range of ``doc_id`` (``part=0, 1, ...``, ascending), whose rows are blocks in
ascending order: whole documents, closed at ``BLOCK`` ids or more.  A block's
payload starts with the number of ids and of checkpoints, then the bit offset
of every ``STEP``-th id, then the code words.  Any block decodes by itself, and
all its checkpoints at once: a table of ``2 ** LIMIT`` entries gives the next id
and its length for each of them in every step.

Documents are ordered by doc_id, null first, then by a hash of the text; so a
repeated id spreads over parts, and its rows come in a fixed order.  Defined
results: a null or empty text is the end id alone; repeated rows stay; an empty
table makes an empty file set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodlens.session import scratch_path

from .common import byte_lists, chunks
from .tokens import encoder

LIMIT = 18
BLOCK = 65_536
STEP = 256
END_ID = 0

LISTED = "part int, block int, doc_ids array<bigint>, lengths array<bigint>"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol with a count above 0 (0 for the others), by package-merge."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, items, is_leaf = [], leaves, np.ones(len(leaves), bool)
    for _ in range(limit):
        levels.append(is_leaf)
        even = items[:len(items) // 2 * 2]
        merged = np.concatenate([leaves, even[::2] + even[1::2]])
        by = np.argsort(merged, kind="stable")
        items, is_leaf = merged[by], by < len(leaves)
    take, bits = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        bits[:n] += 1
        take = 2 * (min(take, len(is_leaf)) - n)
    out[order] = bits
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words in order of length, then id."""
    codes, code, last = np.zeros(len(lengths), np.int64), 0, 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[s]:
            code <<= int(lengths[s]) - last
            last = int(lengths[s])
            codes[s] = code
            code += 1
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For every ``limit`` bits the id that they begin with, and its bits: ``id << 5 | bits``."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    filled = np.repeat((order << 5) | lengths[order], 1 << (limit - lengths[order]))
    return np.concatenate([filled, np.zeros((1 << limit) - len(filled), np.int64)])


def pack_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    bits = lengths[ids]
    at = np.cumsum(bits) - bits
    total = int(at[-1] + bits[-1]) if len(ids) else 0
    # a word of up to 25 bits lies in four bytes from the one it begins in
    word = codes[ids] << (32 - bits - (at & 7))
    first, size = at >> 3, (total + 7) // 8 + 4
    out = np.zeros(size)
    for i in range(4):
        out += np.bincount(first + i, (word >> (24 - 8 * i)) & 255, size)
    marks = at[::STEP].astype("<u4")
    return np.array([len(ids), len(marks)], "<u4").tobytes() + marks.tobytes() + out.astype(np.uint8).tobytes()


def unpack_blocks(payloads: list[bytes], table: np.ndarray, limit: int = LIMIT) -> list[np.ndarray]:
    """Ids of each block; the checkpoints of all of them advance together."""
    sizes, starts, data, base = [], [], [], 0
    for p in payloads:
        n, marks = np.frombuffer(p, "<u4", 2).tolist()
        sizes.append(n)
        starts.append(np.frombuffer(p, "<u4", marks, 8).astype(np.int64) + 8 * base)
        data.append(p[8 + 4 * marks:])
        base += len(data[-1])
    raw = np.frombuffer(b"".join(data) + bytes(4), np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = np.concatenate([np.zeros(0, np.int64), *starts])
    out = np.empty((STEP, len(at)), np.int32)
    last, cut = len(window) - 1, np.uint32(32 - limit)
    for i in range(STEP):  # beyond a block's last id the lanes read on, unheeded
        entry = table[(window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> cut]
        out[i] = entry >> 5
        at += entry & 31
    found, lane, lanes = [], 0, out.T
    for n, s in zip(sizes, starts, strict=True):
        found.append(np.ascontiguousarray(lanes[lane:lane + len(s)]).reshape(-1)[:n])
        lane += len(s)
    return found


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Blocks of ids in ascending order of doc_id: LISTED and ``ids``."""
    keys = ["doc_id", "__tie"]
    rows = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
            .withColumn("__tie", F.xxhash64("text")).repartitionByRange(*keys).sortWithinPartitions(*keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part, block, size, doc_ids, lengths, held = TaskContext.get().partitionId(), 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            ids = ids.astype("<u2") if ids.max(initial=0) < 1 << 16 else ids
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())),
                 pa.array([lengths], pa.list_(pa.int64())), pa.array([ids.tobytes()], pa.binary())], names=["part", "block", "doc_ids", "lengths", "ids"])

        for batch in chunks(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), encode(byte_lists(batch, "text")), strict=True):
                doc_ids.append(doc)
                lengths.append(len(ids) // 4 + 1)
                held.append(ids + end)
                size += lengths[-1]
                if size >= BLOCK:
                    yield close()
                    block, size, doc_ids, lengths, held = block + 1, 0, [], [], []
        if held:
            yield close()

    return rows.mapInArrow(run, LISTED + ", ids binary")


def block_ids(ids: bytes, lengths: list[int]) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * sum(lengths) else "<u4").astype(np.int64)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Writes all documents' ids as a file set."""
    spark = docs.sparkSession
    scratch = scratch_path(spark, "huffman-ids")
    tokenised(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(scratch)
    blocks = spark.read.schema(LISTED + ", ids binary").parquet(scratch)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in chunks(batches, 16):
            for ids, lengths in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = np.bincount(block_ids(ids, lengths))
                if len(n) > len(total):
                    total, n = n, total
                total[:len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counts = blocks.select("ids", "lengths").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    by_id = np.zeros(int(max(counts.column(0).to_pylist(), default=-1)) + 1, np.int64)
    by_id[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    lengths = code_lengths(by_id)
    spark.createDataFrame([(bytearray(lengths.astype(np.uint8).tobytes()),)], "lengths binary").write.parquet(f"{folder}/book")
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths)))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, codes = shared.value
        for b in chunks(batches, 16):
            payload = [pack_block(block_ids(ids, n), bits, codes) for ids, n in zip(b.column(4).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(payload, pa.binary())], names=["part", "block", "doc_ids", "lengths", "payload"])

    (blocks.mapInArrow(squeeze, LISTED + ", payload binary").sortWithinPartitions("part", "block")
     .write.partitionBy("part").option("compression", "none").parquet(f"{folder}/blocks"))


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from a file set."""
    book = spark.read.parquet(f"{folder}/book").first().lengths
    shared = spark.sparkContext.broadcast(decoding_table(np.frombuffer(bytes(book), np.uint8).astype(np.int64)))
    blocks = spark.read.schema("block int, doc_ids array<bigint>, lengths array<bigint>, payload binary, part int").parquet(f"{folder}/blocks")
    schema = "part int, block int, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in chunks(batches, 8):
            found = unpack_blocks(b.column(4).to_pylist(), table)
            out: list[list] = [[] for _ in range(7)]
            for i, ids in enumerate(found):
                data, at = ids.astype("<u4").tobytes(), 0
                for doc, n in zip(b.column(2)[i].as_py(), b.column(3)[i].as_py(), strict=True):
                    own = data[4 * at:4 * (at + n)]
                    for column, v in zip(out, (b.column(0)[i].as_py(), b.column(1)[i].as_py(), doc, at, n, zlib.crc32(own), own), strict=True):
                        column.append(v)
                    at += n
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)][:6 + with_ids],
                                             names=["part", "block", "doc_id", "inner", "n_tokens", "ids_crc32", "ids"][:6 + with_ids])

    docs = blocks.select("part", "block", "doc_ids", "lengths", "payload").mapInArrow(decode, schema)
    own = blocks.select("part", "block", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    parts = own.groupBy("part").agg(F.sum("n").alias("n"))  # one row per part of the files
    ahead = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    starts = (own.withColumn("before", F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n"))
              .join(ahead, "part").select("part", "block", (F.col("before") + F.col("ahead")).alias("first")))
    return docs.join(starts, ["part", "block"]).select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
