"""Words of many texts at once: positions, document bounds and 64-bit hashes, by numpy over the UTF-8 bytes.

No Python object is made for a word. A word is hashed eight bytes a step, each step mixed into all bits before the
next, and by a cryptographic digest beyond LONG bytes. The hash of a run of words is built from those of its parts,
of 1, 2, 4, ... words, mixed likewise at each step. Nothing is a plain sum, so texts with a regular structure
(Thue-Morse words, say) don't cancel out; the same run has the same hash wherever it stands.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
LONG = 256
_LEFT, _RIGHT, _START = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0x2545F4914F6CDD1D)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)

#: True for the bytes that end a word: U+0020 and U+0009 to U+000D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Words of digits, ASCII letters and all that is not ASCII.
NOT_TERM = np.zeros(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    NOT_TERM[_lo : _hi + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash of two in this order."""
    x = left * _LEFT
    x += right * _RIGHT
    return mix(x)


def _double(values: np.ndarray, span: int) -> np.ndarray:
    """Hashes of runs of twice the span."""
    return _join(values[:-span], values[span:])


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair; the same values give the same hash wherever they stand."""
    size, at, span = end - start, start.copy(), 1
    out = mix(size.astype(U) + _START)
    while len(size) and span <= int(size.max()):
        some = np.flatnonzero(size & span)
        out[some] = _join(out[some], values[at[some]])
        at[some] += span
        values, span = _double(values, span), 2 * span
    return out


def run_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """The same for every run of k values."""
    n, at, span = max(len(values) - k + 1, 0), 0, 1
    out = np.full(n, mix(np.array([k], U) + _START)[0])
    while n and span <= k:
        if k & span:
            out = _join(out, values[at : at + n])
            at += span
        values, span = _double(values, span), 2 * span
    return out


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span."""
    size = end - start
    out = mix(size.astype(U) + _START)
    if not len(start):
        return out
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    rest, done = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(rest):
        out[rest] = _join(out[rest], eight[start[rest] + done] & _MASKS[np.minimum(size[rest] - done, 8)])
        done += 8
        rest = rest[size[rest] > done]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


@dataclass
class Words:
    data: np.ndarray  #: bytes of all texts
    bounds: np.ndarray  #: byte offset at which each text starts, and the end
    start: np.ndarray  #: byte offset of each word, and of its end
    end: np.ndarray
    first: np.ndarray  #: number of words before each text, and of all
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sum over each document's words."""
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of k words that lies within one text."""
        at = self.starts(k)
        return at, run_hashes(self.hash, k)[at]

    def starts(self, k: int) -> np.ndarray:
        """Index of the first word of every such run."""
        return np.flatnonzero(np.arange(len(self.start)) + k <= np.repeat(self.first[1:], np.diff(self.first)))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array without nulls, and each text's bounds in them."""
    kind = np.int64 if column.type == pa.large_string() else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def split(column: pa.Array, separators: np.ndarray = SPACES, lower: bool = False, hashes: bool = True) -> Words:
    data, bounds = bytes_of(column)
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = bounds[:-1][(bounds[:-1] < bounds[1:])]
    begins[cuts] = inside[cuts]  # a text's first byte starts a word even if the text before ends in one
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, bounds, start, end, np.searchsorted(start, bounds), byte_hashes(data, start, end) if hashes else np.empty(0, U))
