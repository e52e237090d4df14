"""Ids of the ``tokenizers`` library for whole texts, as little-endian bytes."""

from __future__ import annotations

import codecs
import json
import os
from array import array
from collections.abc import Callable

import numpy as np

from .common import worker_state
from .pieces import Pieces

#: Pre-tokens that a generation of a worker's cache holds.
CACHED = 600_000
#: Byte-level vocabularies spell each byte as a character: itself if it is a sign of Latin-1, else one from U+0100 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLED = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in SHOWN)}
#: The same as a decoding table; 0xFF, which no text in UTF-8 has, becomes a blank and parts words.
SPELLING = "".join(SPELLED[b] for b in range(255)) + " "


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def spelled(words: list[bytes]) -> str:
    """Words of valid UTF-8 in the characters of the vocabulary, parted by blanks."""
    return codecs.charmap_decode(b"\xff".join(words), "strict", SPELLING)[0]


def byte_level(file: str) -> bool:
    """Whether the tokenizer in ``file`` parts texts by the pattern that Pieces follows, and does nothing else to them."""
    with open(file, encoding="utf-8") as f:
        own = json.load(f)
    by = own.get("pre_tokenizer") or {}
    return (by.get("type") == "ByteLevel" and by.get("use_regex", True) and not by["add_prefix_space"]
            and not any(own.get(k) for k in ("normalizer", "truncation", "padding")) and all(t["special"] for t in own.get("added_tokens", [])))


def encoder(file: str) -> Callable[[list[bytes]], list[bytes]]:
    """A function from texts (UTF-8) to their ids as unsigned 32-bit bytes.
    Strings of special tokens in a text are ordinary text.  The tokenizer and
    its caches live as long as the Python worker."""
    state = worker_state("tokens")
    if ("tokens", file) not in state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(file)
        tokenizer.encode_special_tokens = True
        tokenize = tokenizer.model.tokenize

        def new(pretokens: list[bytes]) -> list[bytes]:
            # the library's model directly: what it would do to find the pre-tokens has been done
            return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in spelled(pretokens).split(" ")]

        def general(text: bytes) -> bytes:
            return np.array(tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

        state["tokens", file] = Pieces(new, general, CACHED).encode if byte_level(file) else lambda texts: list(map(general, texts))
    return state["tokens", file]
