"""Secret scans: base rules, and a character convolutional network over every
other candidate.

Base rules find assignments, access keys and hexadecimal strings (leftmost,
non-overlapping per kind; spans in code points, end exclusive).  Every run of
at least ``LEAST`` characters of ``[A-Za-z0-9+/_.=-]`` that no base finding
covers is a candidate, and so is such a part of a run beside base findings.  The network reads a candidate as windows of up to ``BODY``
characters, all of them however long it is, each with ``CONTEXT`` characters
before and after; a candidate scores what its best window does.  It is one
convolution over one-hot characters (in the candidate or beside it), the
greatest response of each filter, and a logistic output.

It is trained on labelled findings: a given table of (doc_id, start, end,
label), or by default labels that differ from the rules.  Then the secrets are
the values of base findings with the rule hidden (no key name, no ``AKIA``), and
keys drawn from ``ALPHABETS``, in lengths, prefixes and settings of many kinds;
ordinary are the candidates of the corpus that are surely so (``plain``: words,
addresses, versions, paths, dates), and more of these kinds put together from their
words.  All stand in the contexts of ordinary candidates, so a context tells
nothing.  Candidates that are neither teach nothing.  The fit takes at most
``SAMPLE`` findings of each label, those with the smallest hash, one window of
each, any with equal chance.  A fifth of them calibrates the output (Platt scaling)
and sets the threshold: the highest at which at least ``RECALL`` of the held-out
secrets that no base rule matches are found; ``Network.rates`` holds the share
found and the share of held-out ordinary ones that reach it.  Keys of
letters of one case alone can't be told from words and aren't looked for.

Defined results: a null or empty text has no findings.  Without an ordinary
candidate (or, for given labels, without both) nothing is added to the base
findings.  Repeated rows give repeated rows, and their equal findings are equal to
the fit.  Columns besides doc_id and the text aren't looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, byte_lists, chunks, written

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
NAMES = (b"passw", b"secret", b"token", b"key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
RUN = re.compile(rb"[A-Za-z0-9+/_.=-]{12,}")
LEAST = 12
KINDS = ("assign", "access", "hex", "model")
MODEL = 3

BODY, CONTEXT, WIDTH, FILTERS = 48, 24, 5, 32
SPAN = BODY + 2 * CONTEXT
RECORD = SPAN + 2  # and two bytes: how long the context before and the body are
SAMPLE = 4000
RECALL = 0.98
#: Mini-batches of the fit, and their size.
STEPS, BATCH = 2400, 64

#: Alphabets of the keys drawn for the fit: letters and digits, base 64 and its form for addresses,
#: one case with digits, hexadecimal in capitals.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_", UPPER + DIGITS, LOWER + DIGITS, DIGITS + "ABCDEF")
KEY_LENGTHS = (16, 64)
#: A candidate that is surely no secret: words (also run together as in camelCase), numbers, words with a short number, joined by marks.
PLAIN = re.compile(rb"[+/_.=-]*(?:(?:[A-Z]?[a-z]{2,}(?:[A-Z][a-z]+)*|[A-Z]+|[a-z]|(?:[A-Z]?[a-z]+|[A-Z]+)?[0-9]{1,4}|[0-9]{2}T[0-9]{2,6}|[0-9]{5,10})(?:[+/_.=-]+|$))+")

#: Character classes: padding, each ASCII letter, digit and mark, control characters, bytes of other scripts.
CLASS = np.array([1 if i < 32 or i == 127 else 2 if i > 127 else i - 29 for i in range(256)])
CLASSES = int(CLASS.max()) + 1

FOUND = "kinds array<int>, starts array<bigint>, ends array<bigint>, windows array<binary>"


def windows(raw: bytes, start: int, end: int) -> bytes:
    """Fixed-size records of a candidate's windows."""
    out = []
    for a in range(start, end, BODY):
        b = min(a + BODY, end)
        a = max(start, b - BODY)  # the last one is as long as the others
        before = raw[max(0, a - CONTEXT):a]
        out.append(bytes((len(before), b - a)) + (before + raw[a:b] + raw[b:b + CONTEXT]).ljust(SPAN, b"\0"))
    return b"".join(out)


def scan(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, in order: base findings and candidates."""
    base: list[tuple[int, int, int]] = []
    lower = raw.lower()
    if any(n in lower for n in NAMES):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 12]
    runs = [m.span() for m in RUN.finditer(raw)]
    for s, e in runs:  # the other kinds' matches lie within such runs
        if e - s >= 16:
            if e - s >= 18 and raw.find(b"AKIA", s, e) >= 0:
                base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw, s, e) if m.end() - m.start() >= 18]
            base += [(m.start(), 2, m.end()) for m in HEX.finditer(raw, s, e) if m.end() - m.start() >= 16]
    base.sort()
    out, i, reach = list(base), 0, 0
    for s, e in runs:
        while i < len(base) and base[i][0] < e:
            begin = max(s, reach)
            if base[i][0] - begin >= LEAST:  # the part before a base finding
                out.append((begin, MODEL, base[i][0]))
            reach = max(reach, base[i][2])
            i += 1
        begin = max(s, reach)
        if e - begin >= LEAST:
            out.append((begin, MODEL, e))
    return sorted(out)


def points(raw: bytes, offsets: list[int]) -> list[int]:
    """Byte offsets as code point offsets."""
    if raw.isascii() or not offsets:
        return offsets
    ahead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return ahead[offsets].tolist()


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, kinds, starts, ends, windows): findings and candidates of each row."""
    rows = docs.select("doc_id", F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out: list[list] = [[], [], [], []]
            for raw in byte_lists(batch, "text"):
                spans = scan(raw)
                at = points(raw, [s for s, _, _ in spans] + [e for _, _, e in spans])
                for column, v in zip(out, ([k for _, k, _ in spans], at[:len(spans)], at[len(spans):], [windows(raw, s, e) for s, _, e in spans]), strict=True):
                    column.append(v)
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))],
                                             names=["doc_id", "kinds", "starts", "ends", "windows"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {FOUND}")


class Network:
    """The network's weights, its calibration and threshold."""

    def __init__(self, taps: np.ndarray, bias: np.ndarray, out: np.ndarray, scale: tuple[float, float] = (1.0, 0.0), threshold: float = 0.5,
                 rates: tuple[float, float] = (0.0, 0.0)):
        self.taps, self.bias, self.out, self.scale, self.threshold, self.rates = taps, bias, out, scale, threshold, rates

    @staticmethod
    def symbols(records: np.ndarray) -> np.ndarray:
        """Records (n x RECORD bytes) as symbols: the class, apart for characters inside the candidate."""
        x, place = records[:, 2:], np.arange(SPAN)
        ahead, body = records[:, :1].astype(int), records[:, 1:2].astype(int)
        inside = (place >= ahead) & (place < ahead + body)
        return np.where(x == 0, 0, CLASS[x]) + CLASSES * inside

    def respond(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest response of each filter, and where it is."""
        n = SPAN - WIDTH + 1
        total = self.taps[0][symbols[:, :n]]
        for k in range(1, WIDTH):
            total += self.taps[k][symbols[:, k:k + n]]
        at = total.argmax(axis=1)
        return np.maximum(np.take_along_axis(total, at[:, None], 1)[:, 0] + self.bias, 0), at

    def logits(self, records: np.ndarray) -> np.ndarray:
        out = np.zeros(len(records))
        for i in range(0, len(records), 256):
            out[i:i + 256] = self.respond(self.symbols(records[i:i + 256]))[0] @ self.out[:-1] + self.out[-1]
        return out

    def probability(self, candidates: list[bytes]) -> np.ndarray:
        """Calibrated probability of each candidate: that of its best window."""
        if not candidates:
            return np.zeros(0)
        counts = np.array([len(c) // RECORD for c in candidates])
        z = self.logits(np.frombuffer(b"".join(candidates), np.uint8).reshape(-1, RECORD))
        best = np.maximum.reduceat(z, np.cumsum(counts) - counts)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * best + self.scale[1], -30, 30)))


def fit(records: np.ndarray, y: np.ndarray, ruled: np.ndarray | None = None, seed: int = 7, steps: int = STEPS) -> Network:
    """Trains on window records by Adam; a fifth is held out for calibration and threshold.
    Secrets marked in ``ruled`` are found by a rule anyway and take no part in the threshold."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = order[:max(1, len(y) // 5)], order[max(1, len(y) // 5):]
    net = Network(rng.normal(0, 0.2, (WIDTH, 2 * CLASSES, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, FILTERS + 1).astype(np.float32))
    weights = [net.taps, net.bias, net.out]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    symbols = net.symbols(records)
    filters = np.arange(FILTERS)
    for t in range(1, steps + 1):
        b = rng.choice(own, min(BATCH, len(own)), replace=False)
        pooled, at = net.respond(symbols[b])
        error = (1 / (1 + np.exp(-np.clip(pooled @ net.out[:-1] + net.out[-1], -30, 30))) - y[b]) / len(b)
        back = error[:, None] * net.out[:-1] * (pooled > 0)  # only the greatest response learns
        grads = [np.zeros_like(net.taps), back.sum(axis=0), np.append(pooled.T @ error, error.sum())]
        for k in range(WIDTH):
            np.add.at(grads[0][k], (np.take_along_axis(symbols[b], at + k, 1), filters[None, :]), back)
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= 0.01 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    z = net.logits(records[held])
    net.scale = platt(z, y[held])
    hidden = (y[held] > 0) & (True if ruled is None else ~ruled[held])
    found = np.sort(z[hidden])
    if len(found):
        at = found[int(np.floor((1 - RECALL) * len(found)))]
        net.threshold = float(1 / (1 + np.exp(-np.clip(net.scale[0] * at + net.scale[1], -30, 30))))
        net.rates = (float((found >= at).mean()), float((z[y[held] <= 0] >= at).mean()) if (y[held] <= 0).any() else 0.0)
    return net


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and constant of the calibrated logit, with Platt's smoothed targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, [((target - p) * z).sum(), (target - p).sum()])
        a, b = max(a + step[0], 1e-3), b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def body(record: bytes) -> bytes:
    return record[2 + record[0]:2 + record[0] + record[1]]


def plain(candidate: bytes) -> bool:
    """Whether a candidate is surely no secret."""
    return PLAIN.fullmatch(candidate) is not None


def drawn_key(rng: np.random.Generator) -> bytes:
    """A key of a drawn alphabet and length, with digits at two places or more."""
    letters = list(ALPHABETS[rng.integers(len(ALPHABETS))])
    while True:
        key = "".join(rng.choice(letters, rng.integers(*KEY_LENGTHS)))
        if sum(c.isdigit() for c in key) >= 2 and any(c.isalpha() for c in key):
            return key.encode()


def in_setting(key: bytes, words: list[bytes], rng: np.random.Generator) -> bytes:
    """A key alone, after a prefix or name, or as a part of a path."""
    word = words[rng.integers(len(words))][:8]
    forms = (key, key, key, word[:4] + b"_" + key, word[:3] + b"-" + key, word + b"=" + key, b"/" + word + b"/" + key, key + b"=", key + b"/" + word, key[:20] + b"." + key)
    return forms[rng.integers(len(forms))]


def drawn_plain(words: list[bytes], rng: np.random.Generator) -> bytes:
    """Something ordinary of a drawn kind, of the words of the corpus and drawn numbers."""
    word = lambda: words[rng.integers(len(words))][:int(rng.integers(3, 14))].lower()
    number = lambda top: b"%d" % rng.integers(top)
    date = b"%d-%02d-%02d" % (rng.integers(1970, 2040), rng.integers(1, 13), rng.integers(1, 29))
    several = [word() for _ in range(rng.integers(2, 6))]
    kinds = (b".".join(number(256) for _ in range(4)), b"v" + b".".join(number(40) for _ in range(3)) + b"-" + word(), date + b"T" + number(24),
             b"/".join(several), b"/" + b"/".join(several) + b"." + word()[:3], b"_".join(several), b"-".join(several), b"-".join(several) + b"-" + number(10_000),
             b"".join(w.title() for w in several), several[0] + b"".join(w.title() for w in several[1:]), b"_".join(several).upper(), b".".join(several),
             word() + number(10_000) + b"." + word(), b"//www." + word() + b"." + word()[:3] + b"/" + date.replace(b"-", b"/") + b"/" + word(),
             number(10 ** 9) + b"." + number(10 ** 6), several[0] + several[1] + b"." + number(100), word().upper() + b"-" + number(10_000) + b"-" + number(100))
    while True:
        made = kinds[rng.integers(len(kinds))]
        if len(made) >= LEAST:
            return made
        kinds = (*kinds, b"_".join(several) + b"_" + word() + b"_" + word())


def value(finding: bytes, kind: int) -> bytes:
    """A base finding's value, with what the rule goes by left out."""
    if kind == 0:
        named = ASSIGN.match(finding)
        return named[2] if named else finding
    return finding.removeprefix(b"AKIA") if kind == 1 else finding


def teaching(rows: list[tuple[int, bytes]], sample: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(records, labels, whether a rule matches) from (kind, record) rows of base findings and plain candidates."""
    rng = np.random.default_rng(seed)
    ordinary = [r for k, r in rows if k == MODEL and plain(body(r))]
    if not ordinary:
        return None
    contexts = [(r[2:2 + r[0]], r[2 + r[0] + r[1]:].rstrip(b"\0")) for r in ordinary if r[1] < BODY] or [(b" ", b" ")]
    words = sorted({w for r in ordinary for w in re.findall(rb"[a-z]{3,}", body(r).lower())}) or [b"some", b"word", b"here"]

    def placed(text: bytes) -> bytes:
        before, after = contexts[rng.integers(len(contexts))]
        whole = windows(before + text + after, len(before), len(before) + len(text))
        at = RECORD * int(rng.integers(len(whole) // RECORD))
        return whole[at:at + RECORD]

    of_rules = [v for v in (value(body(r), k) for k, r in rows if k != MODEL) if len(v) >= LEAST][:sample // 4]
    keys = [in_setting(drawn_key(rng), words, rng) for _ in range(sample - len(of_rules))]
    ordinary += [placed(drawn_plain(words, rng)) for _ in range(sample // 2)]
    secret = [placed(v) for v in of_rules + keys]
    ruled = [bool(HEX.search(body(r)) and max(map(len, HEX.findall(body(r)))) >= 16) for r in secret]
    records = np.frombuffer(b"".join(secret + ordinary), np.uint8).reshape(-1, RECORD)
    y = np.array([1.0] * len(secret) + [0.0] * len(ordinary), np.float32)
    return records, y, np.array(ruled + [False] * len(ordinary))


def learn(found: DataFrame, labelled: DataFrame | None = None, sample: int = SAMPLE) -> Network | None:
    """Fits the network on findings of ``find``; None without both labels."""
    each = (found.select("doc_id", F.posexplode(F.arrays_zip("kinds", "starts", "ends", "windows")).alias("i", "f"))
            .select("doc_id", F.col("f.kinds").alias("kind"), F.col("f.starts").alias("start"), F.col("f.ends").alias("end"), F.col("f.windows").alias("windows")))
    if labelled is None:
        each = each.withColumn("label", (F.col("kind") != MODEL).cast("int"))
    else:
        each = each.join(labelled.select("doc_id", "start", "end", F.col("label").cast("int").alias("label")).dropDuplicates(["doc_id", "start", "end"]), ["doc_id", "start", "end"])
    # any window may stand for a long finding in the fit; equal records teach the same, and the hash decides which are taken
    window = F.pmod(F.xxhash64("windows"), (F.length("windows") / RECORD).cast("long")).cast("int")
    one = each.select("label", "kind", F.substring("windows", window * RECORD + 1, F.lit(RECORD)).alias("record"))
    taken = []
    for y in (0, 1):
        own = one.where(F.col("label") == y)
        about = own.agg(F.approx_count_distinct("record", 0.02)).first()[0]
        share = min(1.0, 1.5 * (sample + 64) / max(about, 1))  # of the hashes' range: a little more than is wanted
        few = own.where(F.shiftright(F.xxhash64("record"), 11) <= int(share * 2 ** 53) - 2 ** 52).groupBy("label", "record").agg(F.min("kind").alias("kind"))
        taken.append(few.orderBy(F.xxhash64("record"), "record").limit(sample).collect())
    rows = [(r.kind, bytes(r.record)) for part in taken for r in part]
    if labelled is None:
        found_by = teaching(rows, sample)
        return found_by and fit(*found_by)
    if not all(taken):
        return None
    records = np.frombuffer(b"".join(r for _, r in rows), np.uint8).reshape(-1, RECORD)
    return fit(records, np.array([r.label for part in taken for r in part], np.float32))


def judged(net: Network | None, kinds: list[list[int]], candidates: list[list[bytes]]) -> list[list[bool]]:
    """For each row which spans count: base findings, and candidates that reach the threshold."""
    ask = [w for ks, ws in zip(kinds, candidates, strict=True) for k, w in zip(ks, ws, strict=True) if k == MODEL]
    yes = iter((net.probability(ask) >= net.threshold).tolist() if net else [False] * len(ask))
    return [[k != MODEL or next(yes) for k in ks] for ks in kinds]


def report(found: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans) of the rows of ``find``."""
    shared = found.sparkSession.sparkContext.broadcast(net and vars(net))
    schema = f"doc_id {dict(found.dtypes)['doc_id']}, n_assign bigint, n_access bigint, n_hex bigint, n_model bigint, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value and Network(**shared.value)
        for b in chunks(batches):
            kinds, starts, ends, records = (b.column(i).to_pylist() for i in range(1, 5))
            out: list[list] = [[] for _ in range(6)]
            for ks, ss, es, ok in zip(kinds, starts, ends, judged(own, kinds, records), strict=True):
                spans = [(k, f"{KINDS[k]}:{s}:{e}") for k, s, e, y in zip(ks, ss, es, ok, strict=True) if y]
                base = ",".join(t for k, t in spans if k != MODEL)
                counts = [sum(k == i for k, _ in spans) for i in range(4)]
                for column, v in zip(out, (*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(t for _, t in spans)), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in out[:4]), *(pa.array(c, pa.string()) for c in out[4:])],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"])

    return found.mapInArrow(run, schema)


def redact(docs: DataFrame, net: Network | None, text: str = "text", mask: bytes = b"[secret]") -> DataFrame:
    """``docs`` with ``redacted``: the text, every finding masked (overlapping ones as one)."""
    shared = docs.sparkSession.sparkContext.broadcast(net and vars(net))

    def each():
        own = shared.value and Network(**shared.value)

        def one(texts: list[bytes]) -> list:
            spans = [scan(t) for t in texts]
            kinds = [[k for _, k, _ in s] for s in spans]
            records = [[windows(t, s, e) if k == MODEL else b"" for s, k, e in found] for t, found in zip(texts, spans, strict=True)]
            out = []
            for t, found, ok in zip(texts, spans, judged(own, kinds, records), strict=True):
                parts, end = [], 0
                for (s, _, e), y in zip(found, ok, strict=True):
                    if y:
                        if s >= end:
                            parts += [t[end:s], mask]
                        end = max(end, e)
                out.append(b"".join([*parts, t[end:]]).decode("utf-8", "replace"))
            return [out]

        return one

    return append(docs, text, T.StructType([T.StructField("redacted", T.StringType())]), each)


def scan_table(docs: DataFrame) -> tuple[DataFrame, Network | None]:
    """The findings of all rows as a written table, and the network fitted on them."""
    found = written(find(docs), "secrets-found")
    return found, learn(found)
