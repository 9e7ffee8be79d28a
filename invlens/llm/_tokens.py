"""Whole-text encoding with the tokenizers library, each distinct word once per task.

Both vocabularies cut a text into pieces that never cross certain places (see
``WordEncoder``), and the ids of a text are the ids of those pieces in order.
A task keeps the ids of the pieces it has met, in two generations of bounded
size, so a frequent word is looked up and only new words are encoded; it
forgets them at its end, as the worker process stays for all steps after it.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

#: White space on which Python and the tokenizers library may differ; such texts are encoded whole.
_ODD = re.compile("[\x1c-\x1f\x85᠎​  ﻿]")
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
#: All ASCII punctuation but the apostrophe, with which contractions begin.
_MARKS = r"[!-&(-/:-@\[-`{-~]"
_ENDED = rf"(?={_MARKS}*(?:\s|\Z))"
_SPACED = re.compile(rf" ?{_LETTERS}{_ENDED}|{_MARKS}+(?!\S)| ?\S+|\s+(?!\S)|\s+")
_BARE = re.compile(rf"{_LETTERS}{_ENDED}|{_MARKS}+(?!\S)|\S+")
_PLAIN = re.compile(f" ?{_LETTERS}")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Ids of pieces as little-endian 32-bit integers. A new piece is encoded when it is first asked for."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class WordEncoder:
    """Encodes texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    Byte-level vocabulary (``byte_level=True``): its pre-tokenizer always
    breaks before a run of non-space characters with at most one space in
    front, and inside runs of white space as the pattern ``_SPACED`` does.
    Lower-casing vocabulary: white space is dropped and always breaks. Both
    break between a run of letters and the punctuation that ends the piece.
    Pieces of plain Latin letters go to the vocabulary's own model directly;
    all other pieces go through the whole tokenizer.
    """

    def __init__(self, path: str, byte_level: bool, limit: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.byte_level = self.tokenizer.model, byte_level
        self.table = byte_alphabet()
        self.known = _Known(self._piece, limit)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not _PLAIN.fullmatch(piece):
            return self._whole(piece)
        if not self.byte_level and (low := piece.lower()) != piece:
            return self.known[low]
        if piece.isascii():
            mapped = self.table[32] + piece[1:] if piece[0] == " " else piece
        else:
            mapped = piece.encode().decode("latin-1").translate(self.table)
        return array("I", [x.id for x in self.model.tokenize(mapped)]).tobytes()

    def forget(self) -> None:
        """Drops the pieces met; the vocabulary stays loaded."""
        self.known.clear()
        self.known.old = {}

    def ids(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        if _ODD.search(text) or any(s in text for s in self.special):
            return self._whole(text)
        get = self.known.__getitem__
        return b"".join(map(get, (_SPACED if self.byte_level else _BARE).findall(text)))


@lru_cache(maxsize=4)
def encoder(path: str, byte_level: bool) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    return WordEncoder(path, byte_level)
