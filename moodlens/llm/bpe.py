"""Byte-level BPE by ranks, in two tiers, and back.

The first tier is a minimal perfect hash over the vocabulary: a pre-token that
is a token resolves by one hash, one displacement and one comparison.  A miss
goes to the second tier, which merges the pre-token's bytes by rank with a heap
over a linked list, in ``n log n`` steps however long it is.  Bounded caches
spare repeated pre-tokens both.

The hash is built once on the driver (its size is the vocabulary's) and
broadcast.  Defined results: a null or empty text has no ids and decodes to
empty bytes; bytes that aren't UTF-8 encode as U+FFFD; repeated rows give
repeated rows; a column of the input that has a result's name gives way to it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, worker_state
from .pieces import Pieces
from .wordhash import mix

#: Unicode's white space, which the pattern means by \s (Python's \s has four more).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
KEYS_PER_BUCKET = 2
#: Displacements that are tried at a time.
TRIES = 64

IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])
DECODED = T.StructType([T.StructField("decoded", T.BinaryType())])
DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def read_ranks(file: str) -> list[bytes]:
    """The vocabulary by rank."""
    with open(file, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """A minimal perfect hash by displacement.

    Keys fall into buckets; each bucket gets, largest first, the first
    displacement that sends all its keys to free slots.  The buckets of one key
    take what is left directly, as ``-1 - slot``.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // KEYS_PER_BUCKET)
        h = self.hashes(keys)
        order = np.argsort(h % np.uint64(self.buckets), kind="stable")
        which, first, size = np.unique(h[order] % np.uint64(self.buckets), return_index=True, return_counts=True)
        self.shift = np.zeros(self.buckets, np.int32)
        self.key_at = np.full(self.n, -1, np.int32)
        single = []
        for b in np.argsort(-size, kind="stable"):
            own = order[first[b]:first[b] + size[b]]
            if size[b] == 1:
                single.append((which[b], own[0]))
                continue
            d, slots = 1, None
            while slots is None:
                tried = self.slots(h[own][None, :], np.arange(d, d + TRIES)[:, None])
                good = (self.key_at[tried] < 0).all(axis=1)
                for i in np.flatnonzero(good).tolist():
                    if len(set(tried[i].tolist())) == len(own):
                        d, slots = d + i, tried[i]
                        break
                else:
                    d += TRIES
            self.key_at[slots] = own
            self.shift[int(which[b])] = d
        for (b, key), slot in zip(single, np.flatnonzero(self.key_at < 0), strict=False):
            self.key_at[slot] = key
            self.shift[int(b)] = -1 - slot

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))

    def slots(self, h: np.ndarray, shift: np.ndarray | int) -> np.ndarray:
        return (mix(h + np.uint64(0x9E3779B97F4A7C15) * np.asarray(shift).astype(np.uint64)) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """For each key the number of the only key of the set that it can be."""
        h = self.hashes(keys)
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return self.key_at[np.where(shift < 0, -1 - shift, self.slots(h, np.maximum(shift, 0)))]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: always merges the pair of lowest rank, leftmost first."""
    n = len(word)
    parts: list[bytes | None] = [word[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        left, j = parts[i], after[i]
        if left is None or j >= n or len(left) + len(parts[j]) != size:
            continue  # one of the two has been merged since
        left += parts[j]
        parts[i], parts[j] = left, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(left + parts[k])) is not None:
                heapq.heappush(heap, (r, i, size + len(parts[k])))
        h = before[i]
        if h >= 0 and (r := ranks.get(parts[h] + left)) is not None:
            heapq.heappush(heap, (r, h, size + len(parts[h])))
    return [ranks[p] for p in parts if p is not None]


class Coder:
    """Encodes lists of texts (UTF-8) to ids as unsigned 32-bit bytes and decodes them."""

    def __init__(self, vocabulary: list[bytes], hashed: PerfectHash, pattern: str):
        self.vocabulary, self.hashed = vocabulary, hashed
        self.ranks = {t: i for i, t in enumerate(vocabulary)}
        self.pattern = regex.compile(pattern.replace(r"[^\s", "[^" + SPACE).replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.pieces = Pieces(self.new, self.general)

    def new(self, words: list[bytes]) -> list[bytes]:
        found = self.hashed.find(words).tolist()
        ids = [[i] if self.vocabulary[i] == w else merge(w, self.ranks) for w, i in zip(words, found, strict=True)]
        return [struct.pack(f"<{len(x)}I", *x) for x in ids]

    def general(self, text: bytes) -> bytes:
        found = self.pattern.findall(text.decode("utf-8", "replace"))
        own = list(dict.fromkeys(found))
        ids = dict(zip(own, self.new([p.encode("utf-8", "replace") for p in own]), strict=True)) if own else {}
        return b"".join(map(ids.__getitem__, found))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return self.pieces.encode(texts)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def coder(spark, file: str, pattern: str):
    """A broadcast vocabulary and hash; returns what gives a task its Coder."""
    vocabulary = read_ranks(file)
    hashed = PerfectHash(vocabulary)
    shared = spark.sparkContext.broadcast((vocabulary, vars(hashed), pattern))

    def get() -> Coder:
        state = worker_state("bpe")
        if ("bpe", file, pattern) not in state:
            words, parts, p = shared.value
            table = PerfectHash.__new__(PerfectHash)
            table.__dict__.update(parts)
            state["bpe", file, pattern] = Coder(words, table, p)
        return state["bpe", file, pattern]

    return get


def encode(docs: DataFrame, file: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``."""
    get = coder(docs.sparkSession, file, pattern)

    def each():
        c = get()
        return lambda texts: [[np.frombuffer(x, "<u4").astype(np.int32) for x in c.encode(texts)]]

    return append(docs, text, IDS, each)


def decode(df: DataFrame, file: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes of the column ``ids``."""
    get = coder(df.sparkSession, file, pattern)
    # ids travel as text, so that one row-wise helper serves all columns
    listed = df.withColumn("__ids", F.array_join(F.col(ids).cast("array<string>"), ","))

    def each():
        c = get()
        return lambda rows: [[c.decode([int(i) for i in r.split(b",") if i]) for r in rows]]

    return append(listed, "__ids", DECODED, each)


def digests(docs: DataFrame, file: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with the number and digest of each text's ids, and the digest
    of what they decode to."""
    get = coder(docs.sparkSession, file, pattern)

    def each():
        c = get()
        state = worker_state("bpe")
        if "decimal" not in state or len(state["decimal"]) < len(c.vocabulary):
            state["decimal"] = [b"%d" % i for i in range(len(c.vocabulary))]
        decimal = state["decimal"].__getitem__
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def one(texts: list[bytes]) -> list:
            rows = [np.frombuffer(x, "<u4").tolist() for x in c.encode(texts)]
            return [[len(r) for r in rows], [sha(b",".join(map(decimal, r))) for r in rows], [sha(c.decode(r)) for r in rows]]

        return one

    return append(docs, text, DIGESTS, each)
