"""Packing of documents into sequences by best-fit decreasing.

A document is first cut into full windows; what is left of each is placed, longest first, into the open sequence
with the least room that still takes it. A segment tree indexed by remaining capacity finds that sequence. Each
task packs the documents it has read, so only lengths are held and no ids are shuffled. Sequences that a task leaves
with more than LOOSE of their room empty are taken apart again, and their pieces (rows of a few numbers) packed a
second time in tasks of at least REPACK sequences, so the fill doesn't depend on how the input is split.

Defined cases: a null text is the empty one, which has the end id alone; equal rows are packed one by one; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import docs_of, map_arrow, materialize
from tessera.llm.tokenization import encoded

#: The share of a sequence that may stay empty after the first pass, and the sequences of a task of the second.
LOOSE, REPACK = 0.005, 8192
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class OpenWindows:
    """Open sequences by remaining capacity; each tree node counts those below it."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, window: int) -> None:
        self.at[room].append(window)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out a window of the least capacity that is at least need: that capacity and the window."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                node += not self.count[node]
        room = node - self.leaves
        self._change(room, -1)
        return room, self.at[room].pop()


def best_fit(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """Window and offset of each length (1 to size), given in descending order."""
    tree, out, windows = OpenWindows(size), [], 0
    for n in lengths:
        found = tree.tightest(n)
        if found is None:
            found, windows = (size, windows), windows + 1
        room, window = found
        out.append((window, size - room))
        if room > n:
            tree.add(room - n, window)
    return out


def _packed(pieces: list[array], size: int, base: int, loose: float) -> Iterator[pa.RecordBatch]:
    """Rows for pieces (columns: key, start, length, checksum, ids of the document, whether there is a key) with their places; whether the sequence is loose."""
    cuts = np.stack([np.frombuffer(x, np.int64) for x in pieces]) if pieces[0] else np.empty((6, 0), np.int64)
    cuts = cuts[:, np.lexsort((cuts[3], cuts[1], cuts[0], cuts[5], -cuts[2]))]
    placed = np.array(best_fit(cuts[2].tolist(), size), np.int64).reshape(-1, 2)
    room = size - np.bincount(placed[:, 0], weights=cuts[2])
    for lo in range(0, cuts.shape[1], 1 << 16):
        part, where = cuts[:, lo : lo + (1 << 16)], placed[lo : lo + (1 << 16)]
        keys = pa.array(part[0], mask=part[5] == 0)
        yield pa.RecordBatch.from_arrays([keys, *map(pa.array, part[1:5]), pa.array(where[:, 0] + base), pa.array(where[:, 1]), pa.array(room[where[:, 0]] > loose)], [*NAMES, "loose"])


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 1) -> DataFrame:
    """One row for each piece: its document's part and its place."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [array("q") for _ in range(6)]
        for key, ids in encoded(batches, tokenizer, end):
            n = len(ids) // 4
            for at in range(0, n, size):
                for column, value in zip(pieces, (key or 0, at, min(size, n - at), zlib.crc32(ids[4 * at : 4 * (at + size)]), n, key is not None), strict=True):
                    column.append(value)
        yield from _packed(pieces, size, TaskContext.get().partitionId() << 32, LOOSE * size)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [array("q") for _ in range(6)]
        for batch in batches:
            for column, values in zip(pieces, [batch.column(0).fill_null(0), *batch.columns[1:5], batch.column(0).is_valid().cast(pa.int64())], strict=True):
                column.frombytes(values.to_numpy(zero_copy_only=False).astype(np.int64).tobytes())
        yield from _packed(pieces, size, 1 << 62 | TaskContext.get().partitionId() << 32, size)

    schema = f"{SCHEMA}, loose boolean"
    once = materialize(map_arrow(docs_of(docs), first, schema), "packed")
    loose = once.where("loose")
    ids = loose.agg(F.sum("length")).first()[0] or 0
    twice = map_arrow(loose.repartition(max(1, ids // (size * REPACK))), again, schema)
    return once.where("not loose").unionByName(twice).select(*NAMES)
