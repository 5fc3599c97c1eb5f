"""Whole-text encoding with a public tokenizer, each different piece of text encoded once per worker.

Both vocabularies used here cut a text before their merges, and never merge over a cut. So the ids of a text are the ids
of its pieces, one after the other, as long as the pieces end at such cuts. The tokenizers library encodes each
different piece, and a dictionary of bounded size keeps its ids as bytes; a text is then a join of byte strings.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable

from factloom.llm.common import held

#: A text with these goes to the library whole: strings of special tokens, and controls that only Python takes for space.
WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "\x85")
LONGEST = 64
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Cuts at which each kind of pre-tokenizer also cuts: words of Latin letters, the full stop or comma after them, the rest.
PIECES: dict[str, Callable[[str], list[str]]] = {
    "words": re.compile(rf"[{LETTERS}]+(?=[.,]?(?:\s|$))|[.,](?=\s|$)|\S+").findall,  # white space is dropped
    "bytes": re.compile(rf" ?[{LETTERS}]+(?=[.,]?(?:\s|$))|[.,](?=\s|$)| ?\S+|\s+(?!\S)|\s+").findall,  # one space goes with the next word
}
WORD = re.compile(rf"[{LETTERS}]+")
PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


def _printable() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class _Known(dict):
    """Piece to ids; a new piece is encoded once. Bounded: when full, it starts anew and fetches from its predecessor what recurs."""

    def __init__(self, encode: Callable[[str], bytes], keep: int):
        self.encode, self.keep, self.before = encode, keep, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.keep:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """``encode(texts)``: the ids of each text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pieces: str | None, keep: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.cut = Tokenizer.from_file(path), pieces, PIECES[pieces] if pieces else None
        self.known = _Known(self._piece, keep)
        self.letters = str.maketrans({chr(b): c for b, c in _printable().items()})
        self.space = _printable()[ord(" ")]

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        """A word of Latin letters is one piece for the pre-tokenizer too, so it goes to the library's merges at once."""
        word = piece[1:] if piece[0] == " " else piece
        if not (word.isascii() and word.isalpha() or WORD.fullmatch(word)) or self.kind == "words" and not word.islower():
            return self._whole(piece)
        lead = self.space if piece[0] == " " else ""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenizer.model.tokenize(lead + word)]
        return PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _text(self, text: str) -> bytes:
        if self.cut is None or any(mark in text for mark in WHOLE):
            return self._whole(text)
        if self.kind == "words" and "\u03a3" not in text:  # the capital sigma alone gets its lower case from what follows it in Python
            text = text.lower()
        return b"".join(map(self.known.__getitem__, self.cut(text)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self._text(text or "") for text in texts]


def encoder(path: str, pieces: str | None, keep: int = 450_000) -> Encoder:
    """One encoder per worker process."""
    return held(("tokens", path, pieces, keep), lambda: Encoder(path, pieces, keep))
