"""Benchmark decontamination by a prefix-filtered set join.

A window is WINDOW consecutive words of an item (all its words, if it has fewer). Its set is its shingles of
SHINGLE words. Shingles are ordered by rarity, counted over all documents; as all of a window's shingles must be
in the document (containment 1), the rarest alone is a sufficient prefix. Every place of a document where a
prefix shingle stands gives a candidate: the window has to start as many words before as the shingle's place in
it says (positional bound) and to end within the document (length bound). Candidates are verified word by word.

Items of up to BLOCKS blocks of BLOCK_BYTES of text are indexed block by block; an index is sent to the executors, and
documents pass all of them without a shuffle. More items are joined by a shuffle on the prefix shingle: rarity is counted
in slots of hashes, in one pass for all items; of a document's places those whose slot no prefix has are left out, and
the others go to the join with the words around them, so that candidates are verified where they meet.

Defined cases: null or empty texts have no words; an item without words has no window; equal items count once
for each item_id, a null item_id as "null"; equal documents give equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm import words as w
from tessera.llm.common import docs_of, map_arrow, materialize, release, slices, texts

WINDOW = 13
SHINGLE = 3
BLOCK_BYTES = 4 << 20
BLOCKS = 4
SLICE_BYTES = 2 << 20
_SLOTS = 1 << 20
#: Slots in which rarity is counted, and slots of prefix shingles that documents are filtered by.
RARITY_SLOTS, FILTER_SLOTS = 1 << 16, 1 << 22

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _words(column: pa.Array) -> w.Words:
    return w.split(column, w.NOT_TERM, lower=True)


def _lists(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of lists with these lengths."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Windows:
    """The distinct windows of a block of items, with their words, items and shingles."""

    def __init__(self, ids: list[str], column: pa.Array) -> None:
        found = _words(column)
        n = np.diff(found.first)
        length = np.minimum(n, WINDOW)
        per_item = np.where(n > 0, n - length + 1, 0)
        item = np.repeat(np.arange(len(n)), per_item)
        at = found.first[:-1][item] + _lists(per_item)
        size = length[item]
        key = w.mix(w.span_hashes(found.hash, at, at + size) ^ size.astype(w.U))
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([which, item], 1), axis=0) if len(item) else np.empty((0, 2), np.int64)
        self.items = [ids[i] for i in pairs[:, 1]]
        self.item_from = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        self.size = size[first]
        self.k = np.minimum(self.size, SHINGLE)
        steps = np.arange(WINDOW)
        self.words = np.where(steps < self.size[:, None], found.hash[np.minimum(at[first][:, None] + steps, max(len(found.hash) - 1, 0))], w.U(0)) if len(first) else np.empty((0, WINDOW), w.U)
        counts = self.size - self.k + 1
        self.window = np.repeat(np.arange(len(first)), counts)
        self.place = _lists(counts)
        start = at[first][self.window] + self.place
        self.shingle = w.span_hashes(found.hash, start, start + self.k[self.window])
        self.vocabulary = np.unique(self.shingle)

    def prefixes(self, frequency: np.ndarray) -> Prefixes:
        order = np.lexsort((self.place, self.shingle, frequency[np.searchsorted(self.vocabulary, self.shingle)], self.window))
        rarest = order[np.concatenate([[True], self.window[order][1:] != self.window[order][:-1]])] if len(order) else order
        return Prefixes(self, rarest)


class Lookup:
    """Which of many hashes are in a sorted set; a table of low bits settles most of them."""

    def __init__(self, sorted_hashes: np.ndarray) -> None:
        self.hashes = sorted_hashes
        self.table = np.zeros(_SLOTS, bool)
        self.table[sorted_hashes & w.U(_SLOTS - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the hashes that are in the set, and their places there."""
        maybe = np.flatnonzero(self.table[hashes & w.U(_SLOTS - 1)])
        place = np.searchsorted(self.hashes, hashes[maybe])
        good = self.hashes[np.minimum(place, len(self.hashes) - 1)] == hashes[maybe] if len(self.hashes) else np.zeros(0, bool)
        return maybe[good], place[good]


class Prefixes:
    """Rarest shingle to the windows that have it, and its place in them."""

    def __init__(self, of: Windows, rarest: np.ndarray) -> None:
        self.size, self.words, self.items, self.item_from = of.size, of.words, of.items, of.item_from
        self.by_k = {}
        for k in np.unique(of.k).tolist():
            mine = rarest[of.k[of.window[rarest]] == k]
            mine = mine[np.argsort(of.shingle[mine], kind="stable")]
            hashes, begin, counts = np.unique(of.shingle[mine], return_index=True, return_counts=True)
            self.by_k[k] = (Lookup(hashes), begin, counts, of.window[mine], of.place[mine])

    def matches(self, found: w.Words) -> tuple[np.ndarray, np.ndarray]:
        """Start (word index) and window of every occurrence."""
        starts, windows, n = [], [], len(found.hash)
        doc = found.doc
        for k, (lookup, begin, counts, window, place) in self.by_k.items():
            at, runs = found.runs(k)
            here, there = lookup.find(runs)
            many = counts[there]
            entry = np.repeat(begin[there], many) + _lists(many)
            shingle_at = np.repeat(at[here], many)
            start, which = shingle_at - place[entry], window[entry]
            in_doc = np.repeat(doc[at[here]], many)
            fits = (start >= found.first[in_doc]) & (start + self.size[which] <= found.first[in_doc + 1])
            start, which = start[fits], which[fits]
            same = np.ones(len(start), bool)
            for i in range(WINDOW):
                same &= (self.size[which] <= i) | (found.hash[np.minimum(start + i, n - 1)] == self.words[which, i])
            starts.append(start[same])
            windows.append(which[same])
        empty = np.empty(0, np.int64)
        return np.concatenate([empty, *starts]), np.concatenate([empty, *windows])


def _frequencies(docs: DataFrame, of: Windows) -> np.ndarray:
    """How often each shingle of the block occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast((of.vocabulary, np.unique(of.k).tolist()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, sizes = shared.value
        lookup, total = Lookup(vocabulary), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            column = texts(batch.column(1))
            for lo, hi in slices(column, SLICE_BYTES):
                found = _words(column.slice(lo, hi - lo))
                for k in sizes:
                    total += np.bincount(lookup.find(found.runs(k)[1])[1], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], ["shingle", "n"])

    out = np.zeros(len(of.vocabulary), np.int64)
    for row in map_arrow(docs, count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect():  # a row for each shingle of the block at most
        out[row.shingle] = row.n
    return out


def _blocks(items: DataFrame, blocks: int) -> Iterator[tuple[list[str], pa.Array]]:
    """The items in so many blocks."""
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        table = dealt.where(F.col("block") == block).select("item_id", "text").toArrow()
        if table.num_rows:
            yield [x if x is not None else "null" for x in table.column(0).to_pylist()], texts(table.column(1))


def _step(docs: DataFrame, prefixes: Prefixes, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None, schema: str | StructType) -> DataFrame:
    """Add the words hit and the items found of one block; finish makes the result of what the last block leaves."""
    shared = docs.sparkSession.sparkContext.broadcast(prefixes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            whole = texts(batch.column(1))
            for lo, hi in slices(whole, SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                found = _words(whole.slice(lo, hi - lo))
                start, window = index.matches(found)
                n = len(found.hash)
                depth = np.bincount(start, minlength=n + 1) - np.bincount(start + index.size[window], minlength=n + 1)
                hit = np.cumsum(depth[:n]) > 0
                items: list[set[str]] = [set(x or ()) for x in part.column(4).to_pylist()]
                for d, x in set(zip(found.doc[start].tolist(), window.tolist(), strict=True)):
                    items[d].update(index.items[index.item_from[x] : index.item_from[x + 1]])
                marks = []
                for d, before in enumerate(part.column(3).to_pylist()):
                    own = hit[found.first[d] : found.first[d + 1]]
                    if before is not None:
                        own = own | np.unpackbits(np.frombuffer(before, np.uint8), count=len(own)).astype(bool)
                    marks.append(np.packbits(own).tobytes() if own.any() else None)
                out = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(found.first)), pa.array(marks, pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), *part.columns[5:]], part.schema.names)
                yield finish(out) if finish else out

    return map_arrow(docs, rows, schema)


def _verdicts(batch: pa.RecordBatch) -> tuple[list[int], list[bool]]:
    """Words hit and whether that is too many, from columns n_words and hit at 2 and 3."""
    hits = [0 if x is None else int.from_bytes(x, "big").bit_count() for x in batch.column(3).to_pylist()]
    return hits, [h > 0 and 20 * h >= n for h, n in zip(hits, batch.column(2).to_pylist(), strict=True)]


def _result(batch: pa.RecordBatch) -> pa.RecordBatch:
    hits, bad = _verdicts(batch)
    items = batch.column(4).to_pylist()
    sums = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(hits, pa.int64()), pa.array(list(map(len, items)), pa.int64()), pa.array(sums), pa.array(bad)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _clean(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(pa.array([not bad for bad in _verdicts(batch)[1]]))


def _searched(docs: DataFrame, benchmark: DataFrame, finish: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | None, *rest: Column) -> DataFrame:
    """What finish makes of (doc_id, text, n_words, hit, items, ...) after all blocks of items."""
    items = benchmark.select(F.col("`item_id`").cast("string").alias("item_id"), F.col("`text`").cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(2 * size / BLOCK_BYTES))
    key, text = F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text")
    out = docs.select(key, text, F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("items"), *rest)
    if count > 2 * BLOCKS:
        return _finished(_joined(out, items), finish, schema or out.schema)
    blocks = [*_blocks(items, count)] or [([], pa.array([], pa.string()))]
    for i, (ids, column) in enumerate(blocks):
        windows, last = Windows(ids, column), i + 1 == len(blocks)
        out = _step(out, windows.prefixes(_frequencies(docs_of(docs), windows)), finish if last else None, schema if last and schema else out.schema)
    return out


# items of any size: a join by shuffle


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words, item_id) for each window of each item."""
    for batch in batches:
        column = texts(batch.column(1))
        for lo, hi in slices(column, SLICE_BYTES):
            names = [x if x is not None else "null" for x in batch.column(0).slice(lo, hi - lo).to_pylist()]
            found = Windows(names, column.slice(lo, hi - lo))
            counts = np.diff(found.item_from)
            blobs = [found.words[i, : found.size[i]].tobytes() for i in range(len(found.size))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, n in zip(blobs, counts.tolist(), strict=True) for _ in range(n)], pa.binary()), pa.array(found.items, pa.string())], ["words", "item_id"])


def _rarity(docs: DataFrame) -> np.ndarray:
    """How often the shingles of each slot occur in all documents, for one, two and three words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY_SLOTS, np.int64)
        for batch in batches:
            column = texts(batch.column(1))
            for lo, hi in slices(column, SLICE_BYTES):
                found = _words(column.slice(lo, hi - lo))
                for k in range(1, SHINGLE + 1):
                    total += np.bincount((found.runs(k)[1] & w.U(RARITY_SLOTS - 1)).astype(np.int64), minlength=RARITY_SLOTS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["slot", "n"])

    out = np.zeros(RARITY_SLOTS, np.int64)
    table = map_arrow(docs, count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # RARITY_SLOTS rows at most
    out[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    return out


def _prefix_rows(windows: DataFrame, rarity: np.ndarray) -> DataFrame:
    """(shingle, place, words, items): each window under its rarest shingle."""
    shared = windows.sparkSession.sparkContext.broadcast(rarity)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles, places = [], []
            for blob in batch.column(0).to_pylist():
                own = np.frombuffer(blob, w.U)
                runs = w.run_hashes(own, min(len(own), SHINGLE))
                place = int(np.lexsort((runs, shared.value[(runs & w.U(RARITY_SLOTS - 1)).astype(np.int64)]))[0])
                shingles.append(int(runs[place].view(np.int64)))
                places.append(place)
            yield pa.RecordBatch.from_arrays([pa.array(shingles, pa.int64()), pa.array(places, pa.int32()), batch.column(0), batch.column(1)], ["shingle", "place", "words", "items"])

    return map_arrow(windows, rows, "shingle long, place int, words binary, items array<string>")


def _place_rows(docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """(shingle, doc_id, version, at, from, around): a document's places that may be a prefix's, with the words around them."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(slots))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            column = texts(batch.column(1))
            for lo, hi in slices(column, SLICE_BYTES):
                found = _words(column.slice(lo, hi - lo))
                doc = found.doc
                for k in range(1, SHINGLE + 1):
                    at, runs = found.runs(k)
                    good = np.flatnonzero(wanted[(runs & w.U(FILTER_SLOTS - 1)).astype(np.int64)])
                    for part in range(0, len(good), 20_000):
                        some = good[part : part + 20_000]
                        here, of = at[some], doc[at[some]]
                        first, last = np.maximum(here - WINDOW, found.first[of]), np.minimum(here + WINDOW, found.first[of + 1])
                        around = [found.hash[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                        keys = (batch.column(i).slice(lo, hi - lo).take(pa.array(of)) for i in (0, 2))
                        yield pa.RecordBatch.from_arrays([pa.array(runs[some].view(np.int64)), *keys, pa.array(here - found.first[of]), pa.array(here - first), pa.array(around, pa.binary())], ["shingle", "doc_id", "version", "at", "before", "around"])

    return map_arrow(docs, rows, "shingle long, doc_id long, version long, at long, before long, around binary")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (doc_id, version, at, before, around, place, words, items) that are occurrences: their spans and items."""
    for batch in batches:
        keep, low, high = [], [], []
        for i, (at, before, around, place, words) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(2, 7)), strict=True)):
            start = before - place
            if start >= 0 and around[8 * start : 8 * start + len(words)] == words:
                keep.append(i)
                low.append(at - place)
                high.append(at - place + len(words) // 8)
        chosen = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen), pa.array(low, pa.int64()), pa.array(high, pa.int64()), batch.column(7).take(chosen)], ["doc_id", "version", "low", "high", "items"])


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text, ..., spans, items) for documents, by the join on prefix shingles."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    windows = map_arrow(items, _window_rows, "words binary, item_id string").groupBy("words").agg(F.collect_set("item_id").alias("items"))
    prefixes = materialize(_prefix_rows(windows, _rarity(keyed)), "prefixes")
    slots = np.zeros(FILTER_SLOTS, bool)
    slots[prefixes.select(F.pmod("shingle", F.lit(FILTER_SLOTS)).alias("slot")).distinct().toArrow().column("slot").to_numpy()] = True  # FILTER_SLOTS rows at most
    candidates = _place_rows(keyed, slots).join(prefixes, "shingle").select("doc_id", "version", "at", "before", "around", "place", "words", "items")
    met = map_arrow(candidates, _met, "doc_id long, version long, low long, high long, items array<string>")
    found = materialize(met.groupBy("doc_id", "version").agg(F.collect_set(F.struct("low", "high")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("found")), "met")
    release(prefixes)
    marked = docs.withColumn("__version", F.xxhash64("text"))
    back = found.select(F.col("doc_id").alias("__key"), F.col("version").alias("__found"), "spans", "found")
    return marked.join(back, F.col("doc_id").eqNullSafe(F.col("__key")) & (F.col("__version") == F.col("__found")), "left").drop("__key", "__found", "__version")


def _finished(found: DataFrame, finish: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """What finish makes of documents with their spans and items."""
    names = found.columns[:-2]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = texts(batch.column(1))
            for lo, hi in slices(whole, SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                n_words = np.diff(_words(whole.slice(lo, hi - lo)).first)
                marks = []
                for n, spans in zip(n_words.tolist(), part.column(len(names)).to_pylist(), strict=True):
                    own = np.zeros(n, bool)
                    for x in spans or ():
                        own[x["low"] : x["high"]] = True
                    marks.append(np.packbits(own).tobytes() if spans else None)
                items = pa.array([x or [] for x in part.column(len(names) + 1).to_pylist()], pa.list_(pa.string()))
                yield finish(pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n_words), pa.array(marks, pa.binary()), items, *part.columns[5 : len(names)]], names))

    return map_arrow(found, rows, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: its words, those hit, the items found in it and the verdict."""
    return _searched(docs, benchmark, _result, SCHEMA)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all their columns, that aren't contaminated."""
    clean = _searched(docs, benchmark, _clean, None, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest"))
    return clean.select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns))
