"""Encoding whole texts through a bounded cache of their pre-tokens.

In texts of plain characters (ASCII and Latin-1 letters; line feed and space as
white space) where a pre-token of the byte-level vocabularies begins depends on
the kinds of three neighbouring bytes, but for the suffixes after an apostrophe.
So the pre-tokens of many texts are found at once, in arrays; each distinct one
of them costs a look-up, and a repeated one an index.  Texts with other
characters take the general way over the whole text.  Both give equal ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: ASCII characters that the short way knows.
PLAIN = bytes([10, *range(32, 127)])
#: Second bytes of the Latin-1 letters (all but the signs for times and division) after 0xC3.
LATIN = frozenset(range(0x80, 0xC0)) - {0x97, 0xB7}
#: Stands before and after each text while many are split at once; no plain text has it.
BOUND = b"\0"
#: Bytes of text that are split at a time.
SPLIT = 4_000_000

END, BLANK, LINE, LETTER, DIGIT, SIGN = range(6)
KIND = np.full(256, END, np.uint8)
KIND[33:127] = SIGN
KIND[[*range(65, 91), *range(97, 123), 0xC3, *LATIN]] = LETTER
KIND[48:58], KIND[32], KIND[10] = DIGIT, BLANK, LINE

# whether a byte begins a pre-token, by the kinds of the byte before, its own and that of the byte after
_before, _own, _after = np.indices((6, 6, 6))
BEGINS = np.where(_own >= LETTER, (_before != _own) & (_before != BLANK),  # a blank belongs to what follows
                  (_before == END) | (_before >= LETTER) | (_after >= LETTER)).ravel()  # white space, all but its last, is one
BEGINS[(_own == END).ravel()] = True


def plain(text: bytes) -> bool:
    rest = text.translate(None, PLAIN)
    return not rest or (set(rest[::2]) == {0xC3} and set(rest[1::2]) <= LATIN and len(rest) % 2 == 0)


def pretoken_starts(data: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of plain texts begin; each BOUND is one of its own."""
    kind = KIND[data]
    key = kind * np.uint8(6)
    key[1:] += kind[:-1] * np.uint8(36)
    key[:-1] += kind[1:]
    begins = BEGINS[key]
    quotes = np.flatnonzero(data == 39)
    quotes = quotes[begins[quotes]]
    if len(quotes):  # 's 't 'm 'd 're 've 'll end where they end, also within letters
        a, b = data[quotes + 1], data[np.minimum(quotes + 2, len(data) - 1)]
        one = np.isin(a, list(b"stmd"))
        two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
        begins[quotes[one | two] + 1] = False
        begins[quotes[one] + 2] = True
        begins[quotes[two] + 3] = True
    return np.flatnonzero(begins)


class Pieces:
    """Encodes texts to bytes: those of all pre-tokens, joined.

    ``new(list of pre-tokens)`` gives the values of pre-tokens that the cache
    doesn't hold; ``general(text)`` that of a text that isn't plain.  The cache
    has two generations: when the young one exceeds ``limit`` entries it becomes
    the old one, whose entries survive only if they are met again.
    """

    def __init__(self, new: Callable, general: Callable, limit: int = 300_000):
        self.new, self.general, self.limit = new, general, limit
        self.young: dict[bytes, bytes] = {BOUND: b""}
        self.old: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        short = list(map(plain, texts))
        split = self.split([t for t, s in zip(texts, short, strict=True) if s])
        return [next(split) if s else self.general(t) for t, s in zip(texts, short, strict=True)]

    def split(self, texts: list[bytes]) -> Iterator[bytes]:
        """The values of plain texts, a bounded part of them at a time."""
        own, size = [], 0
        for t in texts:
            own.append(t)
            size += len(t) + 1
            if size >= SPLIT:
                yield from self.joined(own)
                own, size = [], 0
        if own:
            yield from self.joined(own)

    def joined(self, texts: list[bytes]) -> list[bytes]:
        data = BOUND.join([b"", *texts, b""])
        raw = np.frombuffer(data, np.uint8)
        starts = pretoken_starts(raw)
        bounds = np.flatnonzero(raw[starts] == 0)
        offsets = np.append(starts, len(raw)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        _, ends, words = found.dictionary.buffers()
        words, ends = words.to_pybytes(), np.frombuffer(ends, np.int32, len(found.dictionary) + 1).tolist()
        values = self.values([words[a:b] for a, b in zip(ends, ends[1:], strict=False)])
        _, ends, ids = pa.array(values, pa.large_binary()).take(found.indices).buffers()
        ends = np.frombuffer(ends, np.int64)[bounds].tolist()
        ids = b"" if ids is None else memoryview(ids)
        return [bytes(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def values(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self.young.get, words))
        missing = [w for w, v in zip(words, found, strict=True) if v is None]
        if missing:
            met = {w: v for w, v in zip(missing, map(self.old.get, missing), strict=True) if v is not None}
            fresh = [w for w in missing if w not in met]
            if fresh:
                met.update(zip(fresh, self.new(fresh), strict=True))
            if len(self.young) + len(met) > self.limit:
                self.young, self.old = {BOUND: b""}, self.young
            self.young.update(met)
            found = [met[w] if v is None else v for w, v in zip(words, found, strict=True)]
        return found
