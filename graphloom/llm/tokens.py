"""Exact token ids by the tokenizers library, with a cache of what words encode to.

A tokenizer that splits its input before merging never merges across a split,
so a text's ids are the ids of its pieces in a row. Pieces are cut only where
the tokenizer itself always splits; texts in which that isn't certain are cut
by the slower general rule. Invented and natural prose repeat their words, so
most pieces are looked up. A cache holds a bounded number of pieces of at
most 64 characters, some tens of MB.

Strings of special tokens in a text are that token, as the library has it by
default, or ordinary text where ``special=False``; texts that hold one go to
the library whole.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array
from functools import lru_cache

#: Entries of one generation of a cache, of which there are two, by kind of tokenizer: runs with their space, as byte-level ones have them, are more.
WORD_CACHE, BYTE_CACHE = 100_000, 250_000
#: Characters that Python counts as white space and the tokenizers don't.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_BYTE_PIECES = re.compile("(?: ?[^{0}]+|[{0}]+(?![^{0}])|[{0}]+)".format("\t-\r \x85\xa0  -     　"))


#: Latin characters that stand for themselves under NFC, whose lower case depends on nothing beside them, and common white space.
_PLAIN = [c for c in map(chr, [9, 10, 13, *range(32, 127), *range(161, 592)]) if c not in "\xadİ"]
_LATIN = re.compile(f"[{re.escape(''.join(_PLAIN))}]*").fullmatch
_LETTERS, _NUMBERS = (re.escape("".join(c for c in _PLAIN if unicodedata.category(c)[0] == k)) for k in "LN")
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def _byte_chars() -> dict[int, int]:
    """Byte-level BPE's rule: printable bytes stand for themselves, the others, in order, for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_CHARS = _byte_chars()
_BYTE_SPACE = chr(_BYTE_CHARS[32])
_SHOWN = re.compile("[!-~]*").fullmatch


class _Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers, made by ``make``.

    Two generations: a full one becomes the old one, from which pieces that
    are asked for again come back.
    """

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if _LITTLE else b"".join(i.to_bytes(4, "little") for i in ids)


class _Runs:
    """Texts of plain Latin characters, split into runs by the tokenizer's own rules.

    The runs go to the tokenizer's merge model one by one, which is several
    times faster than the whole chain. Such characters need no normalisation
    but lower case.
    """

    def __init__(self, tokenizer, pattern: str, lower: bool, size: int):
        self.tokenize, self.lower = tokenizer.model.tokenize, lower
        self.find = re.compile(pattern.format(L=_LETTERS, N=_NUMBERS)).findall
        self.of = _Pieces(self._merge, size).__getitem__

    def _merge(self, run: str) -> bytes:
        if run[0] == " " and _SHOWN(run, 1):
            run = _BYTE_SPACE + run[1:]
        elif not _SHOWN(run):
            run = run.encode().decode("latin-1").translate(_BYTE_CHARS)
        return _packed([t.id for t in self.tokenize(run)])

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.of, self.find(text.lower() if self.lower else text)))


class WordEncoder:
    """For tokenizers that drop white space (``word_bpe``): other texts are cut into words."""

    def __init__(self, tokenizer):
        self.runs = _Runs(tokenizer, r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\s{L}{N}]+", True, WORD_CACHE)
        self.words = _Pieces(lambda w: _packed(tokenizer.encode(w, add_special_tokens=False).ids), WORD_CACHE)

    def __call__(self, text: str) -> bytes:
        if _LATIN(text):
            return self.runs(text)
        words = [w for w in _SPACE.split(text) if w] if _ODD.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, words))


class ByteEncoder:
    """For byte-level BPE with the usual split rule: in other texts a piece starts at a space before a non-space."""

    def __init__(self, tokenizer):
        self.runs = _Runs(tokenizer, r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+", False, BYTE_CACHE)
        self.pieces = _Pieces(lambda s: _packed(tokenizer.encode(s, add_special_tokens=False).ids), BYTE_CACHE)

    def __call__(self, text: str) -> bytes:
        if _LATIN(text):
            return self.runs(text)
        return b"".join(map(self.pieces.__getitem__, _BYTE_PIECES.findall(text)))


@lru_cache(maxsize=1)
def encoder(path: str, special: bool = True):
    """The encoder for a tokenizer file; a Python worker keeps the last one between tasks."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special
    encode = (ByteEncoder if type(tokenizer.pre_tokenizer).__name__ == "ByteLevel" else WordEncoder)(tokenizer)
    tokens = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    if not special or not tokens:
        return encode
    named = re.compile("|".join(map(re.escape, tokens))).search
    return lambda text: _packed(tokenizer.encode(text, add_special_tokens=False).ids) if named(text) else encode(text)


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
