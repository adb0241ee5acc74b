"""Substring deduplication with a compressed FM-index per shard.

A window is WINDOW consecutive words. Its anchor is the least of the GRAM-word hashes in it, where hashes of crowded
slots come last, so equal windows have equal anchors and windows that merely touch a common line are anchored
beside it. Consecutive windows with the same anchor form a segment. Segments whose anchor occurs in one document
alone can repeat nowhere and are done; the others go to the shard of their anchor, each different one once, with the smallest
document that has it.

A shard's segments are one text. Its Burrows-Wheeler transform is kept as a wavelet matrix of packed bits, and
nothing of the text itself. Segments stream through the index from right to left: a backward step adds a word on the
left, an interval that has reached the window's length is first widened to the words it shares with the next, and
an interval that runs empty starts anew at the next possible end. That gives the matching statistics cut at WINDOW;
wherever they reach it, the smallest document in the interval has the window. Every occurrence is then compared with that.

A shard with more than SHARD_WORDS words, as a crowded anchor has one, is dealt to parts by the segments' digests.
Each part is an index of its own, and the segments of the other parts stream past it, so a task holds one part's
index however many segments share an anchor.

Defined cases: null or empty text has no words and keeps none; texts shorter than a window keep everything; equal
rows (the same key twice) don't remove each other's words, nor do different texts under one key, whose words are told
apart by a hash of the text; a row without a key keeps everything and removes nothing
elsewhere; other columns are ignored. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as w
from tessera.llm.common import brief_shuffles, docs_of, map_arrow, release, settle, slices, texts
from tessera.llm.suffixes import ranks

WINDOW = 50
GRAM = 10
LONGEST = 64  # windows of a segment
SLICE_BYTES = 2 << 20
SHARD_WORDS = 500_000
SLOTS = 1 << 14
#: Spans are broadcast up to this many (about 40 bytes each); beyond, a shuffle join takes their place.
BROADCAST_ROWS = 1_000_000
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _grams(words: w.Words) -> np.ndarray:
    """Hash of the GRAM words from each word on, over document bounds too."""
    return w.run_hashes(words.hash, GRAM)


def _crowds(docs: DataFrame) -> np.ndarray:
    """How crowded each slot of gram hashes is over all documents, in half powers of two above the mean."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            column = texts(batch.column(1))
            for lo, hi in slices(column, SLICE_BYTES):
                total += np.bincount((w.split(column.slice(lo, hi - lo)).runs(GRAM)[1] & w.U(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["slot", "n"])

    counts = np.zeros(SLOTS)
    for row in map_arrow(docs, count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # SLOTS rows at most
        counts[row.slot] = row.n
    return np.clip(2 * np.log2(np.maximum(counts / max(counts.mean(), 1), 1)), 0, 15).astype(w.U)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    span, out = 1, values
    while 2 * span <= width:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(column: pa.Array, crowds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, first word in it, number of windows, anchor and digest of each segment."""
    words = w.split(column)
    at = words.starts(WINDOW)
    if not len(at):
        return (at, at, at, np.empty(0, w.U), np.empty(0, w.U))
    grams = _grams(words)
    order = crowds[(grams & w.U(SLOTS - 1)).astype(np.int64)] << w.U(60) | grams >> w.U(4)
    anchor = _least(order, WINDOW - GRAM + 1)[at]
    doc = words.doc[at]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(first, np.diff(np.concatenate([first, [len(at)]])))
    first = np.flatnonzero(since % LONGEST == 0)
    size = np.diff(np.concatenate([first, [len(at)]]))
    start = at[first]
    return doc[first], start - words.first[doc[first]], size, anchor[first], w.span_hashes(words.hash, start, start + size + WINDOW - 1)


def _segment_rows(docs: DataFrame, crowds: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(crowds)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch.column(1))
            for lo, hi in slices(column, SLICE_BYTES):
                doc, start, size, anchor, digest = segments(column.slice(lo, hi - lo), shared.value)
                keys, versions = (batch.column(i).slice(lo, hi - lo).take(pa.array(doc)) for i in (0, 2))
                yield pa.RecordBatch.from_arrays([keys, versions, pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64))], ["doc_id", "version", "start", "size", "anchor", "digest"])

    return settle(docs, "segments", rows, "doc_id long, version long, start int, size int, anchor long, digest long")


def _with_lists(docs: DataFrame, rows: DataFrame, struct: list[str], name: str, how: str) -> DataFrame:
    """Documents with an array of the rows of each; the arrays are broadcast if there are few, else joined by shuffle."""
    with brief_shuffles(docs.sparkSession):
        bounded = rows.count() <= BROADCAST_ROWS
    lists = rows.groupBy("doc_id", "version").agg(F.collect_list(F.struct(*struct)).alias(name))
    return docs.join(F.broadcast(lists) if bounded else lists, ["doc_id", "version"], how)


def _words_of(docs: DataFrame, different: DataFrame) -> DataFrame:
    """The words of each different segment, from the document it is taken from."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch.column(1))
            for lo, hi in slices(column, SLICE_BYTES):
                words = w.split(column.slice(lo, hi - lo))
                keys, anchors, digests, sizes, blobs = [], [], [], [], []
                for d, wanted in enumerate(batch.column(2).slice(lo, hi - lo).to_pylist()):
                    for x in wanted:
                        at = int(words.first[d]) + x["start"]
                        keys.append(batch.column(0)[lo + d].as_py())
                        anchors.append(x["anchor"])
                        digests.append(x["digest"])
                        sizes.append(x["size"])
                        blobs.append(words.hash[at : at + x["size"] + WINDOW - 1].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(anchors, pa.int64()), pa.array(digests, pa.int64()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "anchor", "digest", "size", "words"])

    joined = _with_lists(docs, different, ["start", "size", "anchor", "digest"], "wanted", "inner")
    return map_arrow(joined.select("doc_id", "text", "wanted"), rows, "doc_id long, anchor long, digest long, size int, words binary").dropDuplicates(["anchor", "digest"])


class Bits:
    """Packed bits with the number of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(w.U)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        mask = (w.U(1) << (at & 63).astype(w.U)) - w.U(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class FMIndex:
    """Backward search over segments (arrays of word hashes), each with its document."""

    def __init__(self, segments_: list[np.ndarray], documents: np.ndarray) -> None:
        lengths = np.array([len(t) for t in segments_])
        self.symbols, ids = np.unique(np.concatenate(segments_), return_inverse=True)
        ends = np.cumsum(lengths + 1) - 1
        n = int(ends[-1]) + 1
        text = np.zeros(n, np.int32)  # 0 ends a segment
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = ids + 1
        unlike = text + len(segments_)
        unlike[ends] = np.arange(len(segments_))  # ends differ, so a suffix never reaches over one
        levels, _ = ranks(unlike)
        order = np.empty(n, np.int32)
        order[levels[-1]] = np.arange(n, dtype=np.int32)
        self.n, now = n, text[order - 1]
        counts = np.bincount(text, minlength=len(self.symbols) + 1)
        self.first = np.cumsum(counts) - counts
        self.depth = max(1, len(self.symbols).bit_length())
        self.levels: list[Bits] = []
        for level in range(self.depth - 1, -1, -1):
            bit = (now >> level) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        symbols, at = np.unique(now, return_index=True)
        self.bottom = np.zeros(len(counts), np.int64)
        self.bottom[symbols] = at
        self.wide = self._groups(levels, order, WINDOW - 1)
        self.owner = np.append(np.repeat(documents, lengths + 1)[order], 0)
        self.known, self.least = np.zeros(n, bool), np.zeros(n, np.int64)

    @staticmethod
    def _groups(levels: list[np.ndarray], order: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end, for each place of the suffix order, of those that share their first symbols."""
        n, level = len(order), min(depth.bit_length() - 1, len(levels) - 1)
        rank, rest = levels[level], depth - (1 << level)
        p, q = order[:-1], order[1:]
        same = (rank[p] == rank[q]) & (np.maximum(p, q) + rest < n)
        same &= rank[np.minimum(p + rest, n - 1)] == rank[np.minimum(q + rest, n - 1)]
        new = np.concatenate([[True], ~same])
        start = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
        cuts = np.flatnonzero(new)
        return start, np.repeat(np.append(cuts[1:], n), np.diff(np.append(cuts, n))).astype(np.int32)

    def _step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after each symbol is put before."""
        m = len(symbol)
        at, both = np.concatenate([low, high]), np.concatenate([symbol, symbol])
        for level, bits in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            ones = bits.ones(at)
            at = np.where((both >> level) & 1, bits.zeros + ones, at - ones)
        at += self.first[both] - self.bottom[both]
        return at[:m], at[m:]

    def _smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest document in each interval of a window; windows' intervals don't overlap, so each is looked through once."""
        new, at = np.unique(low[~self.known[low]], return_index=True)
        if len(new):
            edges = np.stack([new, high[~self.known[low]][at]], 1).ravel()
            self.least[new] = np.minimum.reduceat(self.owner, edges)[::2]
            self.known[new] = True
        return self.least[low]

    def first_documents(self, stream: list[np.ndarray], absent: int) -> list[np.ndarray]:
        """For each streamed segment and window in it, the smallest document of the index that has the window, or absent."""
        lengths = np.array([len(t) for t in stream])
        words = np.concatenate(stream)
        ids = np.minimum(np.searchsorted(self.symbols, words), len(self.symbols) - 1)
        text = np.where(self.symbols[ids] == words, ids + 1, 0)  # 0: a word that the index doesn't have
        starts = np.cumsum(lengths) - lengths
        m, out = len(stream), np.full(len(text), absent, np.int64)
        end = lengths.copy()
        place, low, high, length = end - 1, np.zeros(m, np.int64), np.full(m, self.n), np.zeros(m, np.int64)
        active = np.flatnonzero(end >= WINDOW)
        while len(active):
            a = active
            full = a[length[a] == WINDOW]
            low[full], high[full], length[full] = self.wide[0][low[full]], self.wide[1][low[full]], WINDOW - 1
            symbol = text[starts[a] + place[a]]
            lo, hi = self._step(symbol, low[a], high[a])
            good = (lo < hi) & (symbol > 0)
            g = a[good]
            low[g], high[g] = lo[good], hi[good]
            length[g] += 1
            done = g[length[g] == WINDOW]
            out[starts[done] + place[done]] = self._smallest(low[done], high[done])
            place[g] -= 1
            b = a[~good]
            end[b] = np.where(symbol[~good] == 0, place[b], np.where(length[b] == WINDOW - 1, place[b] + WINDOW - 1, end[b] - 1))
            place[b], low[b], high[b], length[b] = end[b] - 1, 0, self.n, 0
            active = a[(place[a] >= 0) & (end[a] >= WINDOW)]
        return [out[s : s + n - WINDOW + 1] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]


def _parts(segments_: DataFrame) -> DataFrame:
    """Segments (doc_id, anchor, digest, size, words) with the shards and parts whose index they go to or stream past."""
    words = F.sum(F.col("size") + (WINDOW - 1)).alias("all")
    shards = max(1, math.ceil((segments_.agg(words).first()[0] or 0) / SHARD_WORDS))
    segments_ = segments_.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    loads = segments_.groupBy("shard").agg(words).select("shard", F.ceil(F.col("all") / SHARD_WORDS).cast("int").alias("parts"))
    home = F.pmod(F.xxhash64("digest", "anchor"), F.col("parts")).cast("int")
    return segments_.join(loads, "shard").withColumn("home", home).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("shard", "part", (F.col("part") != F.col("home")).alias("foreign"), "doc_id", "anchor", "digest", "words")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _parts() in order: a part's own segments make its index and stream through it, then do the foreign ones."""
    now, index, held, words = None, None, [], 0

    def found() -> pa.RecordBatch:
        nonlocal index, words
        texts_ = [np.frombuffer(x[3], w.U) for x in held]
        if index is None:
            index = FMIndex(texts_, np.array([x[0] for x in held], np.int64))
        firsts = index.first_documents(texts_, np.iinfo(np.int64).max)
        out = pa.RecordBatch.from_arrays([pa.array([x[1] for x in held], pa.int64()), pa.array([x[2] for x in held], pa.int64()), pa.array([x.tobytes() for x in firsts], pa.binary())], ["anchor", "digest", "firsts"])
        held.clear()
        words = 0
        return out

    for batch in batches:
        for shard, part, foreign, *row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if held and ((shard, part) != now or foreign and (index is None or words >= SHARD_WORDS)):
                yield found()
            if (shard, part) != now:
                now, index = (shard, part), None
            held.append(row)
            words += len(row[3]) // 8
    if held:
        yield found()


def _removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of words that windows of earlier documents cover."""
    for batch in batches:
        keys, versions, lows, highs = [], [], [], []
        for key, version, start, firsts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            bad = np.flatnonzero(np.frombuffer(firsts, np.int64) < key)
            if len(bad):
                cuts = np.flatnonzero(np.diff(bad) > 1)
                for lo, hi in zip(bad[np.concatenate([[0], cuts + 1])].tolist(), bad[np.concatenate([cuts, [len(bad) - 1]])].tolist(), strict=True):
                    keys.append(key)
                    versions.append(version)
                    lows.append(start + lo)
                    highs.append(start + hi + WINDOW)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(versions, pa.int64()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32())], ["doc_id", "version", "low", "high"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, sums = [], [], []
        for text, spans in zip(texts(batch.column(1)).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = text.encode().split()
            total.append(len(own))
            if spans:
                out, at = [], 0
                for span in sorted((x["low"], x["high"]) for x in spans):
                    out += own[at : span[0]]
                    at = max(at, span[1])
                out += own[at:]
            else:
                out = own
            removed.append(len(own) - len(out))
            sums.append(hashlib.sha256(b" ".join(out)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(removed), pa.array(sums)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _versions(docs: DataFrame) -> DataFrame:
    """Key, text and a hash of the text."""
    return docs_of(docs).withColumn("version", F.xxhash64("text"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, version, low, high): spans of words that occur in a document with a smaller key, as whole windows."""
    docs = _versions(docs).where("doc_id is not null")
    segments_ = _segment_rows(docs, _crowds(docs))
    shared = segments_.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    rows = settle(segments_.join(shared, "anchor"), "shared")
    release(segments_)
    different = settle(rows.groupBy("anchor", "digest").agg(F.min(F.struct("doc_id", "version", "start", "size")).alias("x")).select("x.*", "anchor", "digest"), "different")
    wanted = settle(_words_of(docs, different), "words")
    release(different)
    dealt = _parts(wanted).repartition("shard", "part").sortWithinPartitions("shard", "part", "foreign")
    firsts = settle(dealt, "firsts", _search, "anchor long, digest long, firsts binary")
    release(wanted)
    found = rows.select("doc_id", "version", "start", "anchor", "digest").join(firsts, ["anchor", "digest"])
    out = settle(map_arrow(found.select("doc_id", "version", "start", "firsts"), _removals, "doc_id long, version long, low int, high int").distinct(), "spans")
    release(rows, firsts)
    return out


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row for each document: its words, those removed and a digest of what is kept."""
    with brief_shuffles(docs.sparkSession):
        spans = repeated_spans(docs)
    joined = _with_lists(_versions(docs), spans, ["low", "high"], "spans", "left")
    return map_arrow(joined.select("doc_id", "text", "spans"), _kept, SCHEMA)
