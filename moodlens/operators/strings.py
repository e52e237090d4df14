"""Sets of byte strings held as arrays (no object a string), met by whole tokens and by parts of them.

Strings are found by a 64-bit hash and decided by their bytes.  The hash of a string
follows from that of its prefix, so all parts of a token are looked up from each of its
bytes on, as long as the part begins some string of the set.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Travels to the executors by value: they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE, MIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
#: Flags of a hash: that of a string, that of what a longer string begins with.
WHOLE, BEGINS = np.uint8(1), np.uint8(2)
MOST_BITS = 25
#: Bytes of texts that are taken apart at a time.
PIECE = 8 << 20
#: Rows of an array that are made of these at a time.
AT_ONCE = 1 << 20


#: ASCII as ``functions.text`` takes it apart: lower case, separators as spaces; other bytes as they are.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[:128] = [ord(c.lower()) if c.isalnum() or c == "'" else ord(" ") for c in map(chr, range(128))]


def sent(value: object) -> tuple[bytes, list[bytes]]:
    """``value`` with its classes, and its arrays apart, for a broadcast."""
    arrays: list[pickle.PickleBuffer] = []
    return cloudpickle.dumps(value, protocol=5, buffer_callback=arrays.append), [bytes(a.raw()) for a in arrays]


def received(shared: tuple[bytes, list[bytes]]) -> object:
    """What was sent; its arrays are those of the broadcast, not copies."""
    return pickle.loads(shared[0], buffers=shared[1])


def flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array without nulls."""
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    strings = strings.cast(pa.large_binary())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``first[k], first[k] + 1, ...``, ``sizes[k]`` of them, for each k in turn."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(first - before, sizes) + np.arange(int(sizes.sum()))


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted and without repeats."""
    keys = np.sort(keys)
    return keys[np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))] if len(keys) else keys


def hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sizes = np.diff(offsets)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max(initial=0)), BASE)]))
    after = np.repeat(offsets[1:], sizes) - np.arange(len(data)) - 1
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[after])])
    return total[offsets[1:]] - total[offsets[:-1]]


class Hashes:
    """64-bit hashes by their places: flags by their upper bits, then the hashes in order."""

    def __init__(self, found: np.ndarray, begun: list[np.ndarray] = ()):
        self.order = np.argsort(found).astype(np.int32)
        self.hashes = found[self.order]
        self.high = np.uint64(64 - max(len(found).bit_length(), 1))
        self.bins = np.searchsorted((self.hashes >> self.high).astype(np.int64), np.arange((1 << (64 - int(self.high))) + 1)).astype(np.int32)
        entries = len(found) + sum(map(len, begun))
        self.shift = np.uint64(64 - min(max(entries.bit_length() + 3, 10), MOST_BITS))
        self.flags = np.zeros(1 << (64 - int(self.shift)), np.uint8)
        self.flags[(found >> self.shift).astype(np.int64)] = WHOLE
        for some in begun:
            self.flags[(some >> self.shift).astype(np.int64)] |= BEGINS

    def flags_of(self, found: np.ndarray) -> np.ndarray:
        return self.flags[(found >> self.shift).astype(np.int64)]

    def equal_to(self, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in ``found`` and places of equal hashes, all of them in turn."""
        high = (found >> self.high).astype(np.int64)
        left, at, ends = np.arange(len(found)), self.bins[high], self.bins[high + 1]
        while True:
            more = np.flatnonzero(at < ends)
            if not len(more):
                return
            left, at, ends = left[more], at[more], ends[more]
            met = np.flatnonzero(self.hashes[at] == found[left])
            yield left[met], self.order[at[met]].astype(np.int64)
            at = at + 1


class Strings:
    """The distinct strings of an array by their places in it."""

    def __init__(self, strings: pa.Array, within: bool):
        """``within``: they are looked for within tokens too."""
        self.data, offsets = flat(strings)
        self.first, self.sizes = offsets[:-1], np.diff(offsets).astype(np.int32)
        self.data = self.data.copy()  # not all that the array is part of
        self.hashes = Hashes(hashes(self.data, offsets) * MIX, self._begun() if within else [])

    def __len__(self) -> int:
        return len(self.first)

    def _begun(self) -> list[np.ndarray]:
        """Distinct hashes of the strings' proper prefixes, by length."""
        left, out, n = np.flatnonzero(self.sizes > 1), [], 0
        found = np.zeros(len(left), np.uint64)
        while len(left):
            found = found * BASE + self.data[self.first[left] + n] + np.uint64(1)
            n += 1
            out.append(distinct(found * MIX))
            longer = self.sizes[left] > n + 1
            left, found = left[longer], found[longer]
        return out

    def _equal(self, data: np.ndarray, first: np.ndarray, n: int, places: np.ndarray) -> np.ndarray:
        """Whether ``n`` bytes from each place of ``data`` are that string."""
        ok = self.sizes[places] == n
        for k in range(n):
            ok[ok] = data[first[ok] + k] == self.data[self.first[places[ok]] + k]
        return ok

    def find(self, parts: pa.Array) -> np.ndarray:
        """The string that each part is, or -1."""
        data, offsets = flat(parts)
        out, found, sizes = np.full(len(parts), -1, np.int64), hashes(data, offsets) * MIX, np.diff(offsets)
        likely = np.flatnonzero(self.hashes.flags_of(found) & WHOLE)
        for met, places in self.hashes.equal_to(found[likely]):
            which = likely[met]
            for n in np.unique(sizes[which]):
                some = np.flatnonzero(sizes[which] == n)
                some = some[self._equal(data, offsets[which[some]], int(n), places[some])]
                out[which[some]] = places[some]
        return out

    def held(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many distinct strings each token contains, and these one after the other."""
        data, offsets = flat(tokens)
        sizes, every = np.diff(offsets), max(len(self), 1)
        ends, token = np.repeat(offsets[1:], sizes), np.repeat(np.arange(len(tokens)), sizes)
        at, found, n, pairs = np.arange(len(data)), np.zeros(len(data), np.uint64), 0, [np.zeros(0, np.int64)]
        while len(at):
            found = found * BASE + data[at + n] + np.uint64(1)
            n += 1
            mixed = found * MIX
            flags = self.hashes.flags_of(mixed)
            likely = np.flatnonzero(flags & WHOLE)
            for met, places in self.hashes.equal_to(mixed[likely]):
                first = at[likely[met]]
                ok = self._equal(data, first, n, places)
                pairs.append(token[first[ok]] * every + places[ok])
            more = np.flatnonzero(((flags & BEGINS) > 0) & (at + n < ends[at]))
            at, found = at[more], found[more]
        met = distinct(np.concatenate(pairs))
        return np.bincount(met // every, minlength=len(tokens)), met % every


class HeldOnce:
    """What tokens contain of a set of strings, kept for so many tokens."""

    def __init__(self, strings: Strings, kept: int):
        self.strings, self.kept = strings, kept
        self._begin()

    def _begin(self) -> None:
        self.tokens = pa.array([], pa.binary())
        self.first, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def of(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``flat`` the strings of each of these distinct tokens begin, and how many they are."""
        at = pc.index_in(tokens, value_set=self.tokens)
        if len(self.tokens) and len(self.tokens) + at.null_count > self.kept:
            self._begin()
            at = pc.index_in(tokens, value_set=self.tokens)
        new = tokens.filter(at.is_null())
        sizes, held = self.strings.held(new)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, held.astype(np.int32)])
        known = len(self.tokens)
        self.tokens = pa.concat_arrays([self.tokens, new])
        places = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        places[places < 0] = known + np.arange(len(new))
        return self.first[places], self.sizes[places]

    def in_texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Row and string (row times their number plus place) wherever a text's token
        contains it: once each, sorted, whole rows at a time."""
        rows, codes, parts = tokens(texts)
        first, sizes = self.of(parts)
        met = distinct(rows * max(len(parts), 1) + codes)
        rows, codes = met // max(len(parts), 1), met % max(len(parts), 1)
        for some in whole_rows(rows, sizes[codes]):
            n = sizes[codes[some]]
            yield distinct(np.repeat(rows[some] * len(self.strings), n) + self.flat[spread(first[codes[some]], n)])


class Runs:
    """Runs of tokens (each joined by spaces) by their places: a run's first token,
    then one more token a step, each step a look-up of what is met so far and that token."""

    def __init__(self, runs: pa.Array):
        rows, codes, parts = split(runs)
        self.parts, self.width = Strings(parts, False), max(len(parts), 1)
        sizes = np.bincount(rows, minlength=len(runs))
        first, left, depth, states = np.cumsum(sizes) - sizes, np.arange(len(runs)), 1, len(parts)
        state, self.steps = codes[first], []
        while len(left):
            ends = sizes[left] == depth
            whole, longer = np.full(states, -1, np.int32), np.zeros(states, bool)
            whole[state[ends]], longer[state[~ends]] = left[ends], True
            self.steps.append((whole, longer))
            left, state = left[~ends], state[~ends]
            keys = state * self.width + codes[first[left] + depth]
            known = distinct(keys)
            state, states, depth = np.searchsorted(known, keys), len(known), depth + 1
            if len(left):
                self.steps.append(Hashes(known.astype(np.uint64) * MIX))

    def met(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and runs that their tokens have."""
        rows, codes, parts = tokens(texts)
        part = self.parts.find(parts)[codes]
        at = np.flatnonzero(part >= 0)
        state, n = part[at], 0
        for step in self.steps:
            if isinstance(step, Hashes):
                n += 1
                at, state = at[at + n < len(part)], state[at + n < len(part)]
                on = np.flatnonzero((rows[at + n] == rows[at]) & (part[at + n] >= 0))
                at, keys = at[on], (state[on] * self.width + part[at[on] + n]).astype(np.uint64) * MIX
                likely = np.flatnonzero(step.flags_of(keys) & WHOLE)
                found = [(likely[met], places) for met, places in step.equal_to(keys[likely])]  # keys times an odd number: equal if the keys are
                at, state = (np.concatenate(x) for x in zip((at[:0], state[:0]), *((at[met], places) for met, places in found)))
            else:
                whole, longer = step
                ends = np.flatnonzero(whole[state] >= 0)
                yield rows[at[ends]], whole[state[ends]]
                at, state = at[longer[state]], state[longer[state]]


class RuleIndex:
    """A part of the rule index as arrays, for the texts of a task."""

    def __init__(self, index: pa.Table):
        emoji, item = index.column("emoji"), index.column("item").cast(pa.binary())
        word = item.filter(pc.invert(emoji)).combine_chunks().dictionary_encode()
        sign = pc.replace_substring(item.filter(emoji), b" ", b"").combine_chunks().dictionary_encode()
        self.runs, self.signs = Runs(word.dictionary), Strings(sign.dictionary, within=True)
        self.words, self.items = len(word.dictionary), len(word.dictionary) + len(sign.dictionary)
        # what each item is of: rule, language (-1: any), whether it is excluded
        at = np.empty(len(index), np.int64)
        at[emoji.to_numpy()] = self.words + sign.indices.to_numpy()
        at[~emoji.to_numpy()] = word.indices.to_numpy()
        by = np.argsort(at, kind="stable")
        self.sizes = np.bincount(at, minlength=self.items).astype(np.int32)
        self.first = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        lang = index.column("lang").combine_chunks().dictionary_encode()
        self.langs, self.lang = lang.dictionary, lang.indices.fill_null(-1).to_numpy()[by]
        self.place, self.veto = index.column("place").to_numpy()[by].astype(np.int32), index.column("veto").to_numpy()[by].astype(np.int8)
        self.rules = int(self.place.max(initial=0)) + 1

    def hits(self, piece: pa.RecordBatch, held: HeldOnce) -> Iterator[pa.RecordBatch]:
        lang = pc.index_in(piece.column("_lang"), value_set=self.langs, skip_nulls=True).fill_null(-2).to_numpy()
        met = [rows * self.items + runs for rows, runs in self.runs.met(piece.column("_t"))]
        if len(self.signs):
            met += [found // len(self.signs) * self.items + self.words + found % len(self.signs) for found in held.in_texts(piece.column("_s").fill_null(b""))]
        met = distinct(np.concatenate([np.zeros(0, np.int64), *met]))
        rows, items = met // max(self.items, 1), met % max(self.items, 1)
        for some in whole_rows(rows, self.sizes[items]):
            n = self.sizes[items[some]]
            row, entry = np.repeat(rows[some], n), spread(self.first[items[some]], n)
            ok = (self.lang[entry] < 0) | (self.lang[entry] == lang[row])
            row, entry = row[ok], entry[ok]
            found = distinct((row * 2 + self.veto[entry]) * self.rules + self.place[entry])
            row, place = found // self.rules, pa.array((found % self.rules).astype(np.int32))
            each, veto = distinct(row // 2), row % 2 == 1
            lists = (pa.ListArray.from_arrays(pa.array(np.concatenate([np.searchsorted(row[mine] // 2, each), [mine.sum()]]).astype(np.int32)), place.filter(pa.array(mine)))
                     for mine in (~veto, veto))
            yield pa.RecordBatch.from_arrays([piece.column("post_id").take(pa.array(each)), piece.column("_hash").take(pa.array(each)), *lists], names=["post_id", "_hash", "_held", "_vetoed"])


def whole_rows(rows: np.ndarray, sizes: np.ndarray) -> Iterator[slice]:
    """Parts of sorted ``rows``, each about ``AT_ONCE`` in ``sizes``, that take no row apart."""
    if not len(rows):
        return
    ends = np.concatenate([np.flatnonzero(rows[1:] != rows[:-1]) + 1, [len(rows)]])
    share = np.cumsum(sizes)[ends - 1] // AT_ONCE
    cuts = [0, *ends[:-1][share[1:] != share[:-1]], len(rows)]
    yield from (slice(a, b) for a, b in zip(cuts, cuts[1:]))


def pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``PIECE`` bytes in a column."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PIECE
    edges = [0, *(np.flatnonzero(total[1:] != total[:-1]) + 1), len(total)]
    return (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a)


def split(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The strings' parts between spaces: row, place in the distinct parts, and these."""
    lists = pc.split_pattern(strings, pattern=b" ")
    return (_rows(lists), *_encoded(lists.flatten()))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Like ``split`` for texts whose ASCII is as it was written and whose other
    characters are lower-cased letters and digits: the parts are those of ``functions.text.tokens``."""
    data, offsets = flat(texts)
    plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(PLAIN[data])])
    lists = pc.split_pattern(plain, pattern=b" ")
    rows, parts = _rows(lists), lists.flatten().cast(pa.binary())
    # a run of separators is one; what is empty before the first and after the last stays
    edge = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, bool)
    kept = (pc.binary_length(parts).to_numpy(zero_copy_only=False) > 0) | edge | np.roll(edge, -1)
    return (rows[kept], *_encoded(parts.filter(pa.array(kept))))


def _rows(lists: pa.Array) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def _encoded(parts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    parts = parts.dictionary_encode()
    return parts.indices.to_numpy(zero_copy_only=False).astype(np.int64), parts.dictionary
