"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import json
import re
import sys
from array import array
from functools import cached_property

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CACHED_CHUNKS, CACHED_LENGTH = 50_000, 32
_SPACED = re.compile(r" \s|\s ")
_UNCOMMON = re.compile("[^\x00-\u024f]")
_NATIVE = sys.byteorder == "little" and array("I").itemsize == 4
_open: dict[tuple[str, str | None], "TextTokenizer"] = {}


class TextTokenizer:
    """Ids of a text as little-endian 32-bit bytes.

    `path` is the tokenizer file. `ranks` may name the same vocabulary as byte ranks: they encode texts
    of Latin letters at several times the speed with the same ids (a test holds them against the file for
    every such character). Other texts are encoded by the file. The vocabulary's pattern never joins what
    stands on both sides of a lone space into one token, except for the space itself, which goes to the
    right; so such a text is the concatenation of its chunks, and short ones that repeat are kept.
    """

    def __init__(self, path: str, ranks: str | None) -> None:
        self.path = path
        with open(path, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]
        self.ranked = _ranked(ranks) if ranks and _NATIVE else None
        self.chunks: dict[str, bytes] = {}

    @cached_property
    def whole(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _ordinary(self, text: str) -> bytes:
        if self.ranked is None or _UNCOMMON.search(text):
            return self._encode(text)
        return array("I", self.ranked.encode_ordinary(text)).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        ids = self.chunks.get(chunk)
        if ids is None:
            ids = self._ordinary(f" {chunk}")
            if len(chunk) <= CACHED_LENGTH:
                if len(self.chunks) >= CACHED_CHUNKS:
                    self.chunks.clear()
                self.chunks[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._encode(text)
        if self.ranked is not None and not _UNCOMMON.search(text):
            return array("I", self.ranked.encode_ordinary(text)).tobytes()
        if _SPACED.search(text) or text[-1:].isspace():
            return self._encode(text)
        first, *rest = text.split(" ")
        return self._encode(first) + b"".join(map(self._chunk, rest))


def _ranked(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer(path: str = TOKENIZER, ranks: str | None = RANKS) -> TextTokenizer:
    """The worker's tokenizer; opened once per process."""
    if (path, ranks) not in _open:
        _open[path, ranks] = TextTokenizer(path, ranks)
    return _open[path, ranks]
