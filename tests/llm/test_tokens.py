"""Tokenisation, packing, Huffman files and byte-level BPE."""

import base64
import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from moodlens.llm import bpe, huffman, packing, pieces, tokens
from moodlens.session import scratch_path

from .conftest import ODD, frame

FILE = tokens.path("byte_bpe_50k.json")
RANKS = tokens.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", " ", "a", "  two", "a  b", "a \n b", "a\n \n b", "a\n\n b\n", "\n", " lead", "trail ", "it's we'll 'twas", "x=1;y=22 #!?", "é ÈÙ ×÷ ß", "中文 text\t\r\n",
         "a\x1cb\x85c\xa0d", "<|endoftext|> here", "don't  stop\n \nnow", "İIı", "👍🏽 ok", "word, word. (word)"]
MIXED = st.text(st.sampled_from("ab'sré \n\t×1.中"), max_size=40)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    words = bpe.read_ranks(RANKS)
    return bpe.Coder(words, bpe.PerfectHash(words), public_tokenizers.PATTERN)


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_ids_are_the_librarys(library, documents):
    texts = TEXTS + [t for _, t, *_ in documents]
    got = tokens.encoder(FILE)([t.encode() for t in texts])
    assert [ids(x) for x in got] == [library(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(MIXED)
def test_ids_of_mixed_white_space(library, text):
    assert ids(tokens.encoder(FILE)([text.encode()])[0]) == library(text)


def test_small_caches_change_nothing(library, documents):
    encode = tokens.encoder(FILE)
    own = encode.__self__
    limit, own.limit = own.limit, 50
    try:
        for t in [t for _, t, *_ in documents][:30]:
            assert ids(encode([t.encode()])[0]) == library(t)
    finally:
        own.limit = limit


def counted(own):
    """``own`` with lists of the pre-tokens that were new and of the texts that went the general way."""
    new, general, fresh, whole = own.new, own.general, [], []
    own.new = lambda words: (fresh.extend(words), new(words))[1]
    own.general = lambda text: (whole.append(text), general(text))[1]
    return own, fresh, whole


@pytest.fixture
def own_pieces():
    used = tokens.encoder(FILE).__self__
    return counted(pieces.Pieces(used.new, used.general, 40))


def test_touching_white_space_goes_the_short_way(own_pieces, library):
    own, fresh, whole = own_pieces
    texts = ["two  blanks", "line\n \nline", "trail \n", "  ", "it's 'tis we'll'd x'red \n'm o'sé 's\n", "été d'été"]
    assert [ids(x) for x in own.encode([t.encode() for t in texts])] == [library(t) for t in texts]
    assert not whole


def test_the_library_gets_a_pretoken_once(own_pieces):
    own, fresh, _ = own_pieces
    own.encode([b"one word, one word; one word\n", b"more word, one"])
    assert sorted(fresh) == sorted({b"one", b" word", b",", b" one", b";", b"\n", b"more"})


def test_words_that_come_back_stay_cached(own_pieces):
    own, fresh, _ = own_pieces
    for i in range(30):  # ten rare words a text: the young generation of 40 gives way many times
        own.encode([b"the same words " + b" ".join(b"rare%dx" % (10 * i + k) for k in range(10))])
    assert all(fresh.count(w) == 1 for w in (b"the", b" same", b" words"))
    assert len(own.young) <= 41 + 23 and len(own.old) <= 41 + 23


def test_many_texts_at_once_stay_apart(own_pieces, library, monkeypatch):
    own, _, _ = own_pieces
    monkeypatch.setattr(pieces, "SPLIT", 200)
    rng = random.Random(3)
    texts = ["".join(rng.choices(["'", "s", "re", "ll", "é", " ", "\n", "7", ".", "word", "中", "\0"], [4, 3, 2, 2, 2, 4, 2, 2, 2, 2, .1, .1], k=rng.randrange(30)))
             for _ in range(3000)]
    assert [ids(x) for x in own.encode([t.encode() for t in texts])] == [library(t) for t in texts]
    assert own.encode([]) == [] and own.encode([b"", b""]) == [b"", b""] and own.encode([b"\xc3", b"a\xbf"]) == [own.general(b"\xc3"), own.general(b"a\xbf")]


@pytest.mark.parametrize("change", [{"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
                                    {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}},
                                    {"normalizer": {"type": "Lowercase"}}])
def test_other_pretokens_are_the_librarys(tmp_path, change):
    file = str(tmp_path / "other.json")
    with open(FILE, encoding="utf-8") as own, open(file, "w", encoding="utf-8") as other:
        json.dump(json.load(own) | change, other)
    t = Tokenizer.from_file(file)
    texts = ["Some words, Other words", "it's\nÉté  2"]
    assert [ids(x) for x in tokens.encoder(file)([x.encode() for x in texts])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_bpe_is_the_reference_and_decodes(coder, reference, documents):
    texts = TEXTS + [t for _, t, *_ in documents] + ["a" * 5000, "ab" * 3000 + "é" * 999]
    for t, x in zip(texts, coder.encode([t.encode() for t in texts]), strict=True):
        assert ids(x) == reference.encode_ordinary(t)
        assert coder.decode(ids(x)) == t.encode()


@settings(max_examples=300, deadline=None)
@given(MIXED)
def test_bpe_of_mixed_white_space(coder, reference, text):
    assert ids(coder.encode([text.encode()])[0]) == reference.encode_ordinary(text)


def test_perfect_hash_is_minimal(coder):
    words = coder.vocabulary
    assert sorted(coder.hashed.key_at.tolist()) == list(range(len(words)))
    assert coder.hashed.find(words).tolist() == list(range(len(words)))


def test_bpe_of_odd_rows(spark, reference):
    docs = frame(spark)
    rows = bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = sorted((str(d), len(e := reference.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in ODD)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    assert bpe.digests(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


# packing


def test_plans_use_every_piece_once_and_fill_sequences():
    rng = random.Random(3)
    for lengths in ({}, {1: 1}, {1024: 5}, {512: 3}, {700: 10, 324: 9, 1: 4}, {n: rng.randint(0, 40) for n in range(1, 1024)},
                    {n: rng.randint(1, 9) for n in range(400, 700, 3)}, {i: 100 for i in (601, 400, 23, 300)}):
        plan = packing.solve(lengths)
        used = {}
        for items, times in plan:
            assert sum(items) <= 1024 and times > 0
            for v in items:
                used[v] = used.get(v, 0) + times
        assert used == {v: n for v, n in lengths.items() if n}
        assert sum(t for _, t in plan) <= sum(t for _, t in packing.best_fit([lengths.get(i, 0) for i in range(1025)], 1024))


def test_plans_are_optimal_on_small_cases():
    def fewest(items, bins=()):
        if not items:
            return len(bins)
        best = fewest(items[1:], (*bins, items[0]))
        for i in range(len(bins)):
            if bins[i] + items[0] <= 20:
                best = min(best, fewest(items[1:], (*bins[:i], bins[i] + items[0], *bins[i + 1:])))
        return best

    rng = random.Random(5)
    for _ in range(60):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 7))]
        plan = packing.solve({v: items.count(v) for v in items}, 20)
        assert sum(t for _, t in plan) == fewest(tuple(sorted(items, reverse=True)))


def test_dominance():
    assert packing.dominates((7,), (4, 3)) and packing.dominates((5, 4), (4, 4)) and not packing.dominates((4, 4), (5,)) and packing.dominates((3,), ())


def check_packed(rows, docs, library, capacity=1024):
    want = sorted((str(d), [*library(t), 2]) for d, t in docs)
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault(str(r.doc_id), []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, own in {d: [x for e, x in want if e == d] for d, _ in want}.items():
        pieces = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d])
        expected = []
        for x in own:
            first = (len(x) - 1) % capacity + 1
            for k, (a, b) in enumerate(zip([0, *range(first, len(x), capacity)], [*range(first, len(x) + 1, capacity)], strict=True)):
                expected.append((k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())))
        assert pieces == sorted(expected)
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(sequences) >= -(-sum(len(x) for _, x in want) // capacity)
    return len(sequences), sum(len(x) for _, x in want)


def test_packed_documents(spark, library, documents):
    rows = [(d, t, "", "", 0) for d, t, *_ in documents]
    n, total = check_packed(packing.pack(frame(spark, rows), FILE).collect(), [r[:2] for r in rows], library)
    assert n <= -(-total // 1024) + 1
    check_packed(packing.pack(frame(spark), FILE).collect(), [r[:2] for r in ODD], library)
    assert packing.pack(frame(spark, []), FILE).count() == 0


def test_packed_sequences_hold_the_ids(spark, library):
    rows = packing.pack(frame(spark), FILE, with_ids=True).collect()
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length


# Huffman


def test_code_lengths_are_best_and_bounded():
    import heapq

    rng = np.random.default_rng(2)
    for n in (2, 3, 50, 400):
        counts = rng.integers(1, 1000, n)
        heap = [int(c) for c in counts]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        bits = huffman.code_lengths(counts, 30)
        assert int((bits * counts).sum()) == cost and sum(2.0 ** -b for b in bits) == pytest.approx(1)
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    bits = huffman.code_lengths(np.array(fib))
    assert bits.max() <= huffman.LIMIT and sum(2.0 ** -b for b in bits) <= 1
    assert huffman.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5), 2)


def test_blocks_round_trip():
    rng = np.random.default_rng(4)
    blocks = [np.minimum(rng.geometric(0.02, n), 3000).astype(np.int64) for n in (1, 255, 256, 257, 5000)] + [np.zeros(0, np.int64), np.full(700, 3)]
    bits = huffman.code_lengths(np.bincount(np.concatenate(blocks)))
    codes = huffman.canonical(bits)
    table = huffman.decoding_table(bits)
    packed = [huffman.pack_block(b, bits, codes) for b in blocks]
    for own, got in zip(blocks, huffman.unpack_blocks(packed, table), strict=True):
        assert (own == got).all() and len(own) == len(got)
    assert (huffman.unpack_blocks([packed[4]], table)[0] == blocks[4]).all()  # any block by itself


def test_token_files(spark, library, documents, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK", 3000)
    rows = [(d, t, "", "", 0) for d, t, *_ in documents] + ODD
    folder = scratch_path(spark, "test-huffman")
    huffman.write(frame(spark, rows), folder, FILE)
    got = huffman.read(spark, folder, with_ids=True).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    end = 0
    for r in got:
        assert r.start == end and len(r.ids) == 4 * r.n_tokens and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        end += r.n_tokens
    assert sorted((str(r.doc_id), ids(bytes(r.ids))) for r in got) == sorted((str(d), [*library(t), 0]) for d, t, *_ in rows)


def test_empty_token_files(spark):
    folder = scratch_path(spark, "test-huffman")
    huffman.write(frame(spark, []), folder, FILE)
    assert huffman.read(spark, folder).count() == 0
