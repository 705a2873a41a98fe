"""Token ids of whole texts, with the ids of a word computed once.

Both vocabularies split a text into words before the merges, and a word's ids depend on the word alone. So the ids of a
word are looked up in a bounded cache, and only new words go to the ``tokenizers`` model. A text that holds anything
but tab, line ends, ASCII and Latin-1 letters and marks, or what may be a special token, goes to the library whole.
"""

from __future__ import annotations

import re
from functools import cache
from struct import Struct

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: Entries of a cache that stay and of its younger part, and how often that is filled until all is forgotten. Longer keys aren't kept, so a cache's bytes are bounded too.
CACHE, YOUNGER, TURNS = 250_000, 100_000, 50
LONGEST = 48
_STOPS = frozenset(".,;:!?")
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBER = "0-9²³¹¼-¾"
_TAIL = rf"[^\s{_LETTER}{_NUMBER}]+"
_SPLIT = {
    BYTE_BPE: re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?{_TAIL}|\s+(?!\S)|\s+"),
    WORD_BPE: re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|{_TAIL}"),
}
_PLAIN = b"\t\n\r" + bytes(range(0x20, 0x7F)) + bytes(range(0xA1, 0xAD)) + bytes(range(0xAE, 0x100))
_SPACE_BEFORE_SPACE = re.compile(r"[\t\n\r ] ")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next free code point from 256."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
_SPACE = _byte_letters()[0x20]
_PACKS = [Struct(f"<{n}I").pack for n in range(64)]


class _Cache(dict):
    """The first CACHE keys stay, as frequent ones come early; others pass through a younger cache. After TURNS of that all is forgotten, for texts of another kind."""

    def __init__(self) -> None:
        super().__init__()
        self.younger: dict[str, bytes] = {}
        self.turns = 0

    def made(self, key: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, key: str) -> bytes:
        out = self.younger.get(key)
        if out is not None:
            return out
        out = self.made(key)
        if len(key) > LONGEST:
            return out
        if len(self) < CACHE:
            self[key] = out
            return out
        self.younger[key] = out
        if len(self.younger) >= YOUNGER:
            self.younger = {}
            self.turns += 1
            if self.turns == TURNS:
                self.turns = 0
                self.clear()
        return out


class _Pieces(_Cache):
    """Piece of the split to its ids, little-endian unsigned 32-bit."""

    def __init__(self, model) -> None:
        super().__init__()
        self.tokenize = model.tokenize

    def made(self, key: str) -> bytes:
        if key.isascii() and key.isprintable():  # printing ASCII stands for itself
            letters = key.replace(" ", _SPACE)
        else:
            letters = key.encode().decode("latin-1").translate(_LETTERS)
        ids = [t.id for t in self.tokenize(letters)]
        return _PACKS[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()


class _Units(_Cache):
    """What stands between spaces to its ids; head is put before it."""

    def __init__(self, pieces: _Pieces, split: re.Pattern, head: str) -> None:
        super().__init__()
        self.pieces, self.split, self.head, self.mark = pieces, split, head, _SPACE if head else ""
        self.tokenize = pieces.tokenize

    def made(self, key: str) -> bytes:
        if key.isalpha():
            ids = [t.id for t in self.tokenize(self.mark + (key if key.isascii() else key.encode().decode("latin-1").translate(_LETTERS)))]
            return _PACKS[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()
        if key[-1:] in _STOPS and key[:-1].isalpha():  # the word is cached more often than the word with its stop
            return self[key[:-1]] + self.pieces[key[-1]]
        return b"".join(map(self.pieces.__getitem__, self.split.findall(self.head + key)))


class Encoder:
    def __init__(self, file: str) -> None:
        self.file = file
        self.library = Tokenizer.from_file(public_tokenizers.path(file))
        self.pieces, self.split = _Pieces(self.library.model), _SPLIT[file]
        self.first, self.spaced = _Units(self.pieces, self.split, ""), _Units(self.pieces, self.split, " ")

    def plain(self, text: str) -> bool:
        if "<|" in text:
            return False
        try:
            return not text.encode("latin-1").translate(None, _PLAIN)
        except UnicodeEncodeError:
            return False

    def ids(self, text: str) -> bytes:
        """Ids without special tokens, as little-endian unsigned 32-bit."""
        if not self.plain(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.file == WORD_BPE:
            return b"".join(map(self.first.__getitem__, text.lower().split()))
        if _SPACE_BEFORE_SPACE.search(text):
            return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))
        first, *rest = text.split(" ")
        return self.first[first] + b"".join(map(self.spaced.__getitem__, rest))


@cache
def encoder(file: str) -> Encoder:
    """One a process."""
    return Encoder(file)
