"""Token ids by the tokenizers library, a piece at a time.

The vocabulary's pre-tokenizer cuts a text into pieces (runs of letters, of punctuation, digits) and no token reaches
over a cut, so a text's ids are the ids of its pieces one after another. Texts of ASCII or Latin-1 letters, ASCII
punctuation, spaces and line ends are cut here, by the same rule; each piece goes to the library's model once and is
kept in a bounded table, whatever its case and the punctuation beside it. Other texts are cut at white space, and
their words that hold anything else go through the library's whole pipeline, also once.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessera.llm.common import texts

MEMO = 200_000
_EASY = re.compile("[ \n!-;=-~À-ÖØ-öø-ÿ]*")  # no "<": special tokens start with it
_PIECES = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:[stmd]|re|ve|ll)|[!-/:-@\\[-`{-~]+")
_loaded: dict[str, Encoder] = {}


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if it is printable, else 256 and up in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in shown else chr(256 + extra))
        extra += b not in shown
    return out


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder(dict):
    """Piece of a word to the bytes of its ids, unsigned 32-bit little-endian.

    Of the last MEMO to 2 * MEMO pieces none is lost: a full table becomes the older one, from which what is asked
    for again is taken over.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.size = self.tokenizer.get_vocab_size()
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            shown = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            out = _bytes([t.id for t in self.model(shown)])
        if len(piece) < 60:
            if len(self) >= MEMO:
                self.older = dict(self)
                super().clear()
            self[piece] = out
        return out

    def clear(self) -> None:
        super().clear()
        self.older = {}
        self.words = {}

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _PIECES.findall(text.lower())))

    def _word(self, word: str) -> bytes:
        if _EASY.fullmatch(word):
            return self._plain(word)
        out = self.words.get(word)
        if out is None:
            out = _bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
            if len(word) < 60:
                if len(self.words) >= MEMO:
                    self.words = {}
                self.words[word] = out
        return out

    def ids(self, text: str) -> bytes:
        if _EASY.fullmatch(text):
            return self._plain(text)
        return b"".join(map(self._word, text.replace("\n", " ").split(" ")))


def encoder(path: str) -> Encoder:
    """One for each Python worker; its tables are emptied after a task, unless that keeps them."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int, keep: bool = False) -> Iterator[tuple[int | None, bytes]]:
    """Key and ids with the end id of each row of (key, text). keep: leave the tables to the worker's next task."""
    enc, tail = encoder(path), np.array([end], "<u4").tobytes()
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            for key, text in zip(part.column(0).to_pylist(), texts(part.column(1)).to_pylist(), strict=True):
                yield key, enc.ids(text) + tail
    if not keep:
        enc.clear()
