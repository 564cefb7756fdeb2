"""Token ids of a lower-casing word BPE, cached by white-space chunk.

The tokenizer drops white space and never joins tokens across it, so a text's
ids are its chunks' ids in a row. Chunks of plain Latin letters, digits and
ASCII signs go word by word to the BPE model; all others, and texts that hold a
special token or rare white space, go whole to the tokenizer.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Bytes, by estimate, of one of a worker process's two generations of cached chunks, and of its cached words, if no other bound is given.
CACHE_BYTES = 96_000_000
#: What an entry takes beside its letters and ids: two objects and its place in the table.
_ENTRY = 200

_LOWER = "a-zß-öø-įı-ž"
_UPPER = "A-ZÀ-ÖØ-Þ"
_PLAIN = re.compile(f"[!-~{_UPPER}{_LOWER}]*")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LOWER}]+|[0-9]|[^0-9{_LOWER}]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE: itself where printable, else the next free letter from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(free)) for b in range(256)}


_BYTES = _byte_letters()


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Chunks(dict):
    """Little-endian 32-bit ids by chunk, computed when first asked for.

    When this generation is full it becomes the old one; what is asked for again moves on to the next.
    """

    def __init__(self, path: str, bound: int):
        super().__init__()
        self.bound = bound
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = self.held_words = 0

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, w: str) -> bytes:
        named = w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES)
        found = self.words[w] = _packed([t.id for t in self.model.tokenize(named)])
        self.held_words += _ENTRY + len(w) + len(found)
        return found

    def __missing__(self, chunk: str) -> bytes:
        if self.held >= self.bound:
            self.old = dict(self)
            self.clear()
            self.held = 0
        if self.held_words >= self.bound:
            self.words.clear()
            self.held_words = 0
        found = self.old.get(chunk)
        if found is None:
            got = self.words.get
            if chunk.isascii() and chunk.isalpha():  # most chunks: one word
                w = chunk.lower()
                found = got(w) or self.word(w)
            elif _PLAIN.fullmatch(chunk):
                found = b"".join([got(w) or self.word(w) for w in _PIECES.findall(chunk.lower())])
            else:
                found = self.whole(chunk)
        if len(chunk) < 200:
            self[chunk] = found
            self.held += _ENTRY + len(chunk) + len(found)
        return found


@lru_cache(maxsize=4)
def _chunks(path: str, bound: int) -> _Chunks:
    return _Chunks(path, bound)


def token_bytes(text: str | None, path: str | None = None, cache_bytes: int = CACHE_BYTES) -> bytes:
    """The ids of ``encode(text, add_special_tokens=False)`` as little-endian 32-bit numbers; null counts as empty."""
    chunks = _chunks(path or public_tokenizers.path(DEFAULT_TOKENIZER), cache_bytes)
    if not text:
        return b""
    if "<|" in text or _ODD_SPACE.search(text):
        return chunks.whole(text)
    return b"".join(map(chunks.__getitem__, text.split()))


def forget() -> None:
    """Empty this process's caches; tasks do so when they end, for the next ones need not be of this kind."""
    if _chunks.cache_info().currsize:
        _chunks.cache_clear()
