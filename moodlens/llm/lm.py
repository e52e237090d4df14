"""A hidden Markov language model, and exact log-likelihoods of whole texts.

Tokens are the words of a text (ASCII letters lower-cased, split at ASCII white
space) and an end.  A word's probability in a state is that of its symbol times
that of the word among the symbol's words.  The most frequent words are symbols
of their own; the others share hashed symbols, within which a word has
``(c + 0.1) / (N_s + 0.1 (V_s + 1))``, c its count, N_s and V_s those of the
symbol.  So the states, and what an executor needs of them, have a fixed size
while the word counts cover the whole corpus.

Word counts are a Spark aggregate and stay a table.  At most ``HEAD`` frequent
words are broadcast (the count from which a word is frequent is found from a
histogram, so the bound holds at any size); the other words of each text meet
their counts by a join on the word, in which no word is hot: the rarer a word,
the fewer rows it has.

Baum-Welch: every iteration computes expected counts over all training texts
(in segments of ``SEGMENT`` tokens that advance together), aggregates them by
Spark as fixed-point numbers, so that their sum is the same in any order, and
re-estimates, until the relative gain of the summed training log-likelihood
falls to ``TOLERANCE``.  Near a random start the states hardly differ, and there a
small gain isn't convergence; so the iterations start from the counts of all
neighbouring symbols of the training texts (a Spark aggregate of fixed size), to which
``FIRST_STARTS`` models are fitted (to ``FIRST_TOLERANCE``); the likeliest is the start.  The score of a text is the scaled forward recursion over all
of its tokens.

Defined results: a null or empty text is the end alone.  A null id counts as an
empty one in the choice of held-out rows.  Repeated rows are scored each (and
counted each).  Without training rows all tokens are unknown.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, byte_lists, chunks, written

STATES = 6
HEAD = 200_000
OWN = 4096
HASHED = 1024
SYMBOLS = OWN + HASHED
#: Relative gains of the training log-likelihood under which an iteration is the last.
TOLERANCE, FIRST_TOLERANCE = 1e-4, 1e-5
#: Random starts on the pair counts, and contexts that these tell apart.
FIRST_STARTS, CONTEXTS = 4, 256
SEGMENT = 256
SMOOTH = 0.1
FIXED = 1 << 16
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 300_000
END = b""  # no word is empty


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()  # ASCII only, on bytes
    words.append(END)
    return words


def count_words(training: DataFrame) -> DataFrame:
    """(word, c): counts of all tokens of ``training`` (text binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for batch in chunks(batches):
            for text in byte_lists(batch, "text"):
                seen.update(tokens(text))
            if len(seen) >= HELD_WORDS:
                yield out()
                seen.clear()
        yield out()

    return training.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    words: list[bytes]      # the frequent words, most frequent first, after the end
    counts: np.ndarray
    least: int              # every word with this count or more is among them
    total: int              # N
    distinct: int           # V
    symbol_n: np.ndarray    # per hashed symbol: occurrences and words
    symbol_v: np.ndarray


def frequent(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """The frequent words and the totals of a table of word counts."""
    level = F.floor(8 * F.log2("c"))
    levels = {r.level: r.n for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}  # a few hundred
    least, n = max(levels, default=0) + 1, 0
    for k in sorted(levels, reverse=True):
        n += levels[k]
        if n > head:
            break
        least = k
    rows = counts.where((level >= least) | (F.col("word") == END)).toArrow()
    words, c = rows.column(0).to_pylist(), rows.column(1).to_numpy()
    order = sorted(range(len(words)), key=lambda i: (words[i] != END, -c[i], words[i]))
    words, c = [words[i] for i in order], c[order] if len(order) else np.zeros(0, np.int64)
    if not words or words[0] != END:
        words, c = [END, *words], np.concatenate([[0], c])
    totals = counts.agg(F.sum("c"), F.count("*")).first()
    hashed = F.pmod(F.crc32("word"), F.lit(HASHED))
    symbol_n, symbol_v = np.zeros(HASHED, np.int64), np.zeros(HASHED, np.int64)
    for r in counts.groupBy(hashed.alias("s")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # HASHED rows
        symbol_n[r.s], symbol_v[r.s] = r.n, r.v
    for w, k in zip(words[:OWN], c[:OWN], strict=True):
        symbol_n[zlib.crc32(w) % HASHED] -= int(k)
        symbol_v[zlib.crc32(w) % HASHED] -= int(k) > 0
    return Vocabulary(words, np.asarray(c, np.int64), int(least), totals[0] or 0, totals[1], symbol_n, symbol_v)


class Head(dict):
    """Places of the frequent words; -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


def sequences(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """One row per text: its symbols, what is known of its frequent words, and
    the others with their counts in the text."""
    symbol = np.array([i if i < OWN else OWN + zlib.crc32(w) % HASHED for i, w in enumerate(v.words)], np.uint16)
    within = -np.log10(v.symbol_n + 0.1 * (v.symbol_v + 1))
    shared = docs.sparkSession.sparkContext.broadcast((v.words, symbol, np.log10(v.counts + 0.1), v.counts > 0, within))
    kind = dict(docs.dtypes)["doc_id"]
    schema = (f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, logs double, own_logs double, "
              "symbols binary, others array<struct<word: binary, n: int>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, symbol, logs, known, within = shared.value
        place, row = Head(zip(words, range(len(words)), strict=True)), TaskContext.get().partitionId() << 33
        symbol, logs, known = np.append(symbol, 0), np.append(logs, 0.0), np.append(known, False)  # place -1
        other = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
        for batch in chunks(batches):
            out: list[list] = [[] for _ in range(7)]
            for text in byte_lists(batch, "text"):
                own = tokens(text)
                at = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
                s, far = symbol[at], np.flatnonzero(at < 0).tolist()
                rare = [own[i] for i in far]
                if far:
                    s[far] = [OWN + zlib.crc32(w) % HASHED for w in rare]
                # the words of hashed symbols: log10 of their share's denominator, and of the frequent ones' counts
                hashed = s >= OWN
                inside = within[s[hashed] - OWN].sum() + logs[at[hashed]].sum()
                for column, x in zip(out, (len(own), int(known[at].sum()), float(logs[at].sum()), float(inside), s.astype("<u2").tobytes(),
                                           [{"word": w, "n": n} for w, n in Counter(rare).items()]), strict=False):
                    column.append(x)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column(0), batch.column(1),
                 *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), other), strict=False))],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "logs", "own_logs", "symbols", "others"])
            row += n

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


@dataclass
class Hmm:
    start: np.ndarray   # states
    inner: np.ndarray   # states, where a segment goes on
    move: np.ndarray    # states x states
    emit: np.ndarray    # symbols x states


def first_model(v: Vocabulary, seed: int = 11) -> Hmm:
    """Unigram frequencies, perturbed far apart for each state."""
    rng = np.random.default_rng(seed)
    share = np.full(SYMBOLS, SMOOTH)
    n = min(OWN, len(v.counts))
    share[:n] += v.counts[:n]
    share[OWN:] += v.symbol_n
    emit = share[:, None] * (rng.gamma(0.3, 1, (SYMBOLS, STATES)) + 0.01)
    move = rng.gamma(0.3, 1, (STATES, STATES)) + 0.01
    flat = np.full(STATES, 1 / STATES)
    return Hmm(flat, flat, move / move.sum(1, keepdims=True), emit / emit.sum(0))


def expected(m: Hmm, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts (start, inner, move, emit) over texts of symbols."""
    return judged(m, texts)[:4]


def judged(m: Hmm, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts, and the log-likelihood of the texts' segments."""
    parts = [(x[i:i + SEGMENT], i == 0) for x in texts for i in range(0, len(x), SEGMENT)]
    parts.sort(key=lambda p: -len(p[0]))
    size = np.array([len(p) for p, _ in parts])
    steps, lanes = int(size[0]), len(parts)
    symbols = np.zeros((steps, lanes), np.int64)
    for i, (p, _) in enumerate(parts):
        symbols[:len(p), i] = p
    active = np.searchsorted(-size, -np.arange(steps), "left")  # lanes longer than t
    is_first = np.array([f for _, f in parts])
    ahead, scale = np.zeros((steps, lanes, STATES)), np.ones((steps, lanes))
    a = np.where(is_first[:, None], m.start, m.inner)
    for t in range(steps):
        n = active[t]
        a = (a if t == 0 else a[:n] @ m.move) * m.emit[symbols[t, :n]]
        c = a.sum(1)
        a = a / c[:, None]
        ahead[t, :n], scale[t, :n] = a, c
    start, inner, move = np.zeros(STATES), np.zeros(STATES), np.zeros((STATES, STATES))
    back = np.ones((lanes, STATES))
    for t in range(steps - 1, -1, -1):
        if t + 1 < steps:
            n = active[t + 1]
            w = m.emit[symbols[t + 1, :n]] * back[:n] / scale[t + 1, :n, None]
            move += ahead[t, :n].T @ w
            back[:n] = w @ m.move.T
        n = active[t]
        g = ahead[t, :n] * back[:n]
        ahead[t, :n] = g / g.sum(1, keepdims=True)
    start += ahead[0][is_first].sum(0)
    flat = symbols.ravel()
    emit = np.stack([np.bincount(flat, ahead[:, :, k].ravel(), SYMBOLS) for k in range(STATES)], axis=1)  # idle lanes weigh 0
    inner += emit.sum(0)
    return start, inner, move * m.move, emit, float(np.log(scale).sum())


def estimate(start: np.ndarray, inner: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Hmm:
    """The model of expected counts."""
    move, emit = move + SMOOTH, emit + SMOOTH
    share = lambda x: (x + SMOOTH) / (x + SMOOTH).sum()
    return Hmm(share(start), share(inner), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def settled(before: float, now: float, tolerance: float) -> bool:
    """Whether the log-likelihood gains no more than ``tolerance`` of itself."""
    return now - before <= tolerance * abs(now)


def context(symbols: np.ndarray) -> np.ndarray:
    """The context that a symbol is to the one after it: its own, or a shared one."""
    return np.where(symbols < CONTEXTS // 2, symbols, CONTEXTS // 2 + symbols % (CONTEXTS // 2))


def pairs(seqs: DataFrame) -> np.ndarray:
    """Contexts x symbols: counts of all neighbours in the training rows of
    ``seqs``; a text's first symbol comes after an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CONTEXTS * SYMBOLS, np.int64)
        for batch in chunks(batches, 1024):
            joined = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2").astype(np.int64)  # each text ends with an end, symbol 0
            total += np.bincount(context(np.append(0, joined[:-1])) * SYMBOLS + joined, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["i", "n"])

    rows = seqs.where("NOT held_out").select("symbols").mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(CONTEXTS * SYMBOLS)
    flat[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return flat.reshape(CONTEXTS, SYMBOLS)


def parted(n: np.ndarray, m: Hmm) -> tuple[float, Hmm]:
    """A model fitted to the pair counts alone (EM on the states of the two
    neighbours, until their log-likelihood gains ``FIRST_TOLERANCE`` or less), and
    that log-likelihood."""
    of = context(np.arange(SYMBOLS))
    e, before = m.emit, -np.inf
    both = m.move / STATES
    while True:
        c = np.zeros((CONTEXTS, STATES))
        np.add.at(c, of, e)
        p = c @ both @ e.T
        now = float((n * np.log(p)).sum())
        r = n / p
        here, there = c * (r @ (e @ both.T)), e * (r.T @ (c @ both))  # expected states of contexts and of the symbols after them
        if settled(before, now, FIRST_TOLERANCE):
            break
        before, both = now, both * (c.T @ r @ e) + SMOOTH
        both /= both.sum()
        e = there + (here / c)[of] * e + SMOOTH
        e = e / e.sum(0)
    first = e * (r[0][:, None] * (c[0] @ both))
    return now, estimate(first.sum(0), there.sum(0), both * (c[1:].T @ r[1:] @ e), there)


def started(v: Vocabulary, seqs: DataFrame) -> Hmm:
    """The likeliest of ``FIRST_STARTS`` models of the training rows' pair counts."""
    n = pairs(seqs)
    if not n.any():
        return first_model(v)
    return max((parted(n, first_model(v, seed)) for seed in range(FIRST_STARTS)), key=lambda x: x[0])[1]


def improve(m: Hmm, seqs: DataFrame) -> tuple[Hmm, float]:
    """One Baum-Welch iteration over all training rows of ``seqs``, and their
    log-likelihood before it."""
    shared = seqs.sparkSession.sparkContext.broadcast(vars(m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = Hmm(**shared.value), None
        for batch in chunks(batches, 1024):
            found = judged(m, [np.frombuffer(x, "<u2") for x in batch.column(0).to_pylist()])
            flat = np.concatenate([np.ravel(x) for x in found])
            total = flat if total is None else total + flat
        if total is not None:
            n = np.round(total * FIXED).astype(np.int64)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["i", "n"])

    rows = (seqs.where("NOT held_out").select("symbols").mapInArrow(run, "i int, n bigint").groupBy("i")
            .agg(F.sum(F.col("n").cast("decimal(38,0)")).cast("double").alias("n")).toArrow())  # at most the model's size
    flat = np.zeros(2 * STATES + STATES * STATES + SYMBOLS * STATES + 1)
    flat[rows.column(0).to_numpy()] = rows.column(1).to_numpy() / FIXED
    start, inner, move, emit = np.split(flat[:-1], [STATES, 2 * STATES, 2 * STATES + STATES * STATES])
    return estimate(start, inner, move.reshape(STATES, STATES), emit.reshape(SYMBOLS, STATES)), float(flat[-1])


def converged(v: Vocabulary, seqs: DataFrame) -> Hmm:
    """Baum-Welch over all training rows until the log-likelihood settles."""
    m, before = started(v, seqs), -np.inf
    while True:
        after, now = improve(m, seqs)
        if settled(before, now, TOLERANCE):  # also without training rows
            return m
        before, m = now, after


def likelihoods(m: Hmm, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence of symbols: the scaled forward
    recursion, over all sequences at once, the finished ones dropping out."""
    out = np.zeros(len(texts))
    order = np.argsort([-len(x) for x in texts], kind="stable")
    size = np.array([len(texts[i]) for i in order])
    if not len(size) or not size[0]:
        return out
    joined, first = np.concatenate([texts[i] for i in order]), np.cumsum(size) - size
    active = np.searchsorted(-size, -np.arange(size[0]), "left")
    logs, scale = np.zeros(len(size)), np.ones(len(size))
    a = np.tile(m.start, (len(size), 1))
    for t in range(int(size[0])):
        n = active[t]
        a = (a[:n] if t == 0 else a[:n] @ m.move) * m.emit[joined[first[:n] + t]]
        c = a.sum(1)
        a /= c[:, None]
        scale[:n] *= c
        if t % 16 == 15 or n < 64:  # sixteen factors, none below 1e-15, stay a normal number
            logs[:n] += np.log10(scale[:n])
            scale[:n] = 1
    out[order] = logs + np.log10(scale)
    return out


def forward(m: Hmm, seqs: DataFrame) -> DataFrame:
    """(row, hmm): log10 likelihood of each row's symbols."""
    shared = seqs.sparkSession.sparkContext.broadcast(vars(m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Hmm(**shared.value)
        for b in batches:
            found = likelihoods(m, [np.frombuffer(x, "<u2") for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=["row", "hmm"])

    return seqs.select("row", "symbols").mapInArrow(run, "row bigint, hmm double")


def tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, text as bytes) of every row."""
    return docs.select("doc_id", (bucket("doc_id", 10) == 0).alias("held_out"),
                       F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def score(docs: DataFrame, iterations: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``iterations``: that many from the random start, else until convergence.
    """
    rows = tagged(docs)
    counts = written(count_words(rows.where("NOT held_out")), "lm-counts")
    v = frequent(counts)
    seqs = written(sequences(rows, v), "lm-sequences")
    m = converged(v, seqs) if iterations is None else first_model(v)
    for _ in range(iterations or 0):
        m, _ = improve(m, seqs)
    rare = counts.where((F.floor(8 * F.log2("c")) < v.least) & (F.col("word") != END))
    others = (seqs.select("row", F.inline("others")).join(rare, "word", "left").groupBy("row")
              .agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("rare_logs"),
                   F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known")))
    every = float(np.log10(v.total + 0.1 * (v.distinct + 1)))
    rest = F.coalesce("rare_logs", F.lit(0.0))
    return (seqs.drop("symbols", "others").join(forward(m, seqs), "row").join(others, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
                    F.lit(v.total).cast("long").alias("train_tokens"),
                    (F.col("logs") + rest - F.col("n_tokens") * every).alias("base_score"),
                    (F.col("hmm") + F.col("own_logs") + rest).alias("score")))
