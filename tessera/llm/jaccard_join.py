"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more.

1. Every document's set is hashed and dealt to buckets of hashes, as blobs of numbers; a bucket marks what occurs
   in two documents or more. A shingle that several documents of a slice share is settled there and dealt once, so a
   line that all documents have costs a bucket one number for each slice of SLICE_BYTES. A document with fewer than
   three quarters of shared shingles can have no partner (its overlap with any other set is too small) and is done.
   Equal sets are joined by a digest of the set, and one of each goes on.
2. Sets that are left are indexed by their prefix, the first quarter in an order that puts shingles of crowded
   hash slots last: partners share a prefix shingle. Pairs are bounded by their sizes, by the place of the shingle in
   both, and by hashed parity bitmaps: each bit in which two differ is one shingle at least that only one has, so
   the bit count bounds the overlap from above.
3. What is left is verified by intersecting the sorted arrays.

Step 2 and 3 run twice. First each document is compared with the smallest one of its prefix shingles alone, by a join
with these, which joins most of each family. Then the documents of a prefix shingle whose components differ form tiles:
they are banded by size, so that partners are in one band or the next, and a band with more than TILE documents
is dealt to blocks; a tile is two blocks, and a task holds one tile at a time however common the shingle is. A link
within a component would change nothing, so no link between components is lost and a large family doesn't cost all of
its pairs.

Defined cases: null or empty text has no shingles and is linked with nothing; with fewer than five words the whole
sequence is the one shingle; equal rows are rows of their own with the same component; rows of one key with different
sets are documents of their own, each linked by its own text; a row without a key gets no component; other columns are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as w
from tessera.llm.common import docs_of, map_arrow, release, settle, slices, texts
from tessera.llm.components import components

SHINGLE = 5
PER_CENT = 75
SLICE_BYTES = 2 << 20
SLICE_ROWS = 50_000
BUCKETS = 256
BUCKET_SIZE = 500_000
SLOTS = 1 << 14
TILE = 256
#: Shingles of a block of documents that are verified together.
TILE_SHINGLES = 1 << 16
#: In the place of a document: a shingle that its slice has settled.
SETTLED = (1 << 16) - 1
#: Ids are broadcast up to this many (16 bytes each); beyond, a shuffle join takes their place.
BROADCAST_ROWS = 2_000_000
#: Bitmaps are broadcast up to this size, and shuffled beyond.
BROADCAST_BYTES = 32 << 20


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of the distinct shingles of each text."""
    words = w.split(column, lower=True)
    at, runs = words.runs(SHINGLE)
    doc = words.doc
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    whole = w.span_hashes(words.hash, words.first[short], words.first[short] + n[short]) if len(short) else runs[:0]
    docs, runs = np.concatenate([doc[at] if len(at) else at, short]), np.concatenate([runs, whole])
    _, first = np.unique(w.mix(runs ^ w.mix(docs.astype(w.U))), return_index=True)
    first.sort()
    return docs[first], runs[first]


def _digest(docs: np.ndarray, runs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    out = []
    for salt in (0x51ED270B7F14A3C5, 0x2545F4914F6CDD1D):
        sums = np.zeros(n_docs, w.U)
        np.add.at(sums, docs, w.mix(runs ^ w.U(salt)))
        out.append(sums.view(np.int64))
    return out[0], out[1]


def _dealt(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """For each slice of documents: a row with their keys, sizes and digests, and a row for each bucket of hashes."""
    number = TaskContext.get().partitionId() << 32
    names = ["bucket", "slice", "a", "b"]
    for batch in batches:
        column = texts(batch.column(1))
        for low, high in slices(column, SLICE_BYTES):
            for lo in range(low, high, SLICE_ROWS):
                hi = min(high, lo + SLICE_ROWS)
                docs, runs = shingles(column.slice(lo, hi - lo))
                keys = batch.column(0).slice(lo, hi - lo)
                given = np.asarray(keys.is_valid(), np.int64)
                digests = _digest(docs, runs, hi - lo)
                order = np.lexsort((runs, (runs >> w.U(32)) % w.U(buckets)))
                who, runs = docs[order].astype(np.uint16), runs[order]
                new = np.concatenate([[True], runs[1:] != runs[:-1]])[: len(runs)]
                alone = new & np.concatenate([new[1:], [True]])[: len(runs)]
                info = np.stack([keys.fill_null(0).to_numpy(zero_copy_only=False), given, np.bincount(docs, minlength=hi - lo), *digests, np.bincount(who[~alone], minlength=hi - lo)])
                rest, who = runs[new], np.where(alone, who, SETTLED).astype(np.uint16)[new]
                cuts = np.searchsorted((rest >> w.U(32)) % w.U(buckets), np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                rest, who = rest.astype(np.uint32).tobytes(), who.tobytes()
                a = [info.astype("<i8").tobytes(), *(rest[4 * cuts[i] : 4 * cuts[i + 1]] for i in full)]
                b = [b"", *(who[2 * cuts[i] : 2 * cuts[i + 1]] for i in full)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1 - number % 997], full]), pa.int64()), pa.array([number] * len(a), pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names)
                number += 1


def _marked(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    """For each slice of a bucket: how many of each document's hashes occur elsewhere too."""
    rest = np.frombuffer(b"".join(a for _, a, _ in rows), np.uint32).astype(w.U)
    key = np.sort(rest << w.U(32) | np.arange(len(rest), dtype=w.U))
    value = key >> w.U(32)
    same = value[1:] == value[:-1]
    shared = np.zeros(len(rest), bool)
    shared[(key[np.concatenate([same, [False]]) | np.concatenate([[False], same])] & w.U(0xFFFFFFFF)).astype(np.int64)] = True
    out, at = [], 0
    for _, a, b in rows:
        who = np.frombuffer(b, np.uint16)[shared[at : at + len(a) // 4]]
        at += len(a) // 4
        out.append(who[who != SETTLED].tobytes())
    keep = [i for i, x in enumerate(out) if x]
    return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in keep], pa.int64()), pa.array([None] * len(keep), pa.binary()), pa.array([out[i] for i in keep], pa.binary())], ["slice", "info", "shared"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: one bucket at a time is held."""
    now, held = None, []
    for batch in batches:
        for bucket, number, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if bucket < 0:
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([a], pa.binary()), pa.array([b""], pa.binary())], ["slice", "info", "shared"])
                continue
            if bucket != now and held:
                yield _marked(held)
                held = []
            now = bucket
            held.append((number, a, b))
    if held:
        yield _marked(held)


def _summed(table: pa.Table) -> pa.Table:
    """A slice's documents with their sizes, digests and numbers of shared shingles."""
    info = np.frombuffer(next(x for x in table.column("info").to_pylist() if x is not None), "<i8").reshape(6, -1)
    who = np.frombuffer(b"".join(table.column("shared").to_pylist()), np.uint16)
    keys = pa.array(info[0], mask=info[1] == 0)
    return pa.table([keys, pa.array(info[2]), pa.array(info[3]), pa.array(info[4]), pa.array(info[5] + np.bincount(who, minlength=info.shape[1]))], ["doc_id", "n", "digest", "digest2", "shared"])


def _measured(docs: DataFrame) -> DataFrame:
    """Size, digest and number of shared shingles of every document."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, int(size / 6 / BUCKET_SIZE))
    dealt = map_arrow(docs, lambda batches: _dealt(batches, buckets), "bucket long, slice long, a binary, b binary")
    marked = map_arrow(dealt.repartition("bucket").sortWithinPartitions("bucket"), _buckets, "slice long, info binary, shared binary")
    return settle(marked.groupBy("slice").applyInArrow(_summed, "doc_id long, n long, digest long, digest2 long, shared long"), "sizes")


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose key is in ids (doc_id, distinct)."""
    bounded = ids.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if bounded else ids, "doc_id", "left_semi")


def _bits(n: int) -> int:
    """Length of a set's bitmap: a power of two not below twice its size, 64 to 131072."""
    return min(1 << 17, max(64, 1 << (2 * int(n) - 1).bit_length()))


def _parity(runs: np.ndarray) -> bytes:
    bits = _bits(len(runs))
    return np.packbits((np.bincount((runs & w.U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = texts(batch.column(1))
        for lo, hi in slices(column, SLICE_BYTES):
            docs, runs = shingles(column.slice(lo, hi - lo))
            order = np.lexsort((runs, docs))
            docs, runs = docs[order], runs[order]
            cuts = np.searchsorted(docs, np.arange(hi - lo + 1))
            own = [runs[cuts[i] : cuts[i + 1]] for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(cuts)), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([_parity(x) for x in own], pa.binary())], ["doc_id", "n", "runs", "bitmap"])


def _slot_classes(sets: DataFrame) -> np.ndarray:
    """How crowded each slot of hashes is, in half powers of two above the mean."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.bincount((np.frombuffer(x, w.U) & w.U(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["slot", "n"])

    counts = np.zeros(SLOTS)
    for row in map_arrow(sets.select("runs"), count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # SLOTS rows at most
        counts[row.slot] = row.n
    return np.clip(2 * np.log2(np.maximum(counts / max(counts.mean(), 1), 1)), 0, 15).astype(w.U)


def _prefix_rows(sets: DataFrame) -> DataFrame:
    """(token, doc_id, n, place): the shingles that stand first in the common order."""
    shared = sets.sparkSession.sparkContext.broadcast(_slot_classes(sets))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                tokens, lengths = [], []
                for x in part.column(2).to_pylist():
                    runs = np.frombuffer(x, w.U)
                    order = shared.value[(runs & w.U(SLOTS - 1)).astype(np.int64)] << w.U(60) | runs >> w.U(4)
                    n = len(runs)
                    first = n - -(-PER_CENT * n // 100) + 1
                    tokens.append(np.sort(np.partition(order, first - 1)[:first] if first < n else order).view(np.int64))
                    lengths.append(len(tokens[-1]))
                of = np.repeat(np.arange(len(part)), lengths)
                place = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of)), pa.array(place)], ["token", "doc_id", "n", "place"])

    return map_arrow(sets.select("doc_id", "n", "runs"), rows, "token long, doc_id long, n long, place long")


def _least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest overlap that reaches the threshold for these sizes."""
    return -(-PER_CENT * (a + b) // (100 + PER_CENT))


def _near(n: Column, place: Column, other: Column, other_place: Column) -> Column:
    """Whether sets of these sizes, with a shingle at these places of their prefixes, can reach the threshold."""
    need = F.ceil((n + other) * PER_CENT / (100 + PER_CENT))
    return (1 + F.least(n - place - 1, other - other_place - 1) >= need) & (F.least(n, other) * 100 >= F.greatest(n, other) * PER_CENT)


def _number(bitmap: bytes) -> tuple[int, int]:
    """A bitmap as a number, and its length in bytes."""
    return int.from_bytes(bitmap, "big"), len(bitmap)


def _differ(one: tuple[int, int], other: tuple[int, int]) -> int:
    """Bits in which two bitmaps differ, at the length of the shorter; folding by exclusive or keeps parities true."""
    (x, size), (y, least) = (one, other) if one[1] >= other[1] else (other, one)
    while size > least:
        size //= 2
        x = (x >> 8 * size) ^ (x & ((1 << 8 * size) - 1))
    return (x ^ y).bit_count()


def _shared_bitmaps(sets: DataFrame) -> Broadcast | None:
    """All bitmaps by key, if they are small together."""
    bitmaps = sets.select("doc_id", "bitmap")
    size = bitmaps.agg(F.sum(F.octet_length("bitmap") + 16)).first()[0] or 0
    if size > BROADCAST_BYTES:
        return None
    table = bitmaps.toArrow()
    return sets.sparkSession.sparkContext.broadcast(dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)))


PAIR = "a long, b long, na long, nb long"


def _star(rows: DataFrame, sets: DataFrame, shared: Broadcast | None) -> DataFrame:
    """Pairs of each document and the smallest one of a prefix shingle that pass the bounds."""
    good = (F.col("doc_id") > F.col("h.doc_id")) & _near(F.col("n"), F.col("place"), F.col("h.n"), F.col("h.place"))
    pairs = rows.where(good).select(F.col("h.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("h.n").alias("na"), F.col("n").alias("nb")).distinct()
    if shared is None:
        one, other = (sets.select(F.col("doc_id").alias(x), F.col("bitmap").alias(f"m{x}")) for x in "ab")
        pairs = pairs.join(one, "a").join(other, "b").select("a", "b", "na", "nb", "ma", "mb")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if shared is None:
                maps = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            else:
                maps = ((shared.value[x], shared.value[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True))
            differ = np.fromiter((_differ(_number(x), _number(y)) for x, y in maps), np.int64, len(a))
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "na", "nb"]).filter(pa.array((na + nb - differ) // 2 >= _least_overlap(na, nb)))

    return map_arrow(pairs, bounded, PAIR)


def _tiles(rows: DataFrame) -> DataFrame:
    """Rows (token, doc_id, n, place, component) dealt to the tiles they take part in: (..., tile, side).

    All documents of a shingle with at most TILE of them are one tile. The others are banded by size, a band
    being as wide as the threshold lets partners differ, and each band is dealt to blocks of about TILE documents.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / PER_CENT))).cast("int")
    rows = rows.withColumn("band", band)
    blocks = rows.groupBy("token", "band").agg(F.count("*").alias("count"))
    crowded = blocks.groupBy("token").agg(F.sum("count").alias("all"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("count") / TILE).cast("int").alias("k")))).alias("k")).where(F.col("all") > TILE).select("token", "k")  # bands are few: the logarithm of the largest size
    crowded = settle(crowded, "crowded")
    columns = ["token", "doc_id", "n", "place", "component"]
    none = F.lit(None).cast("struct<band:int,block:int>")
    small = rows.join(crowded, "token", "left_anti").select(*columns, none.alias("one"), none.alias("two"), F.lit(0).alias("side"))
    if not crowded.limit(1).count():
        return small
    dealt = rows.join(crowded, "token").withColumn("own", F.struct("band", F.expr("pmod(xxhash64(doc_id), k[band])").cast("int").alias("block")))
    others = F.expr("flatten(transform(array(band - 1, band, band + 1), b -> if(map_contains_key(k, b), transform(sequence(0, k[b] - 1), j -> named_struct('band', b, 'block', j)), array())))")
    dealt = dealt.withColumn("other", F.explode(others))
    first = F.least("own", "other")
    return small.unionByName(dealt.select(*columns, first.alias("one"), F.greatest("own", "other").alias("two"), F.when(F.col("own") == first, 0).otherwise(1).alias("side")))


def _tile(left: list[tuple], right: list[tuple], same: bool) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of rows (key, size, place, component, bitmap) of two blocks that pass the bounds, with their sizes."""
    ids, n, place, group = (np.array(x) for x in list(zip(*left, strict=True))[:4])
    ids2, n2, place2, group2 = (np.array(x) for x in list(zip(*right, strict=True))[:4])
    need = _least_overlap(n[:, None], n2)
    good = (1 + np.minimum((n - place - 1)[:, None], (n2 - place2 - 1)) >= need) & (np.minimum(n[:, None], n2) * 100 >= PER_CENT * np.maximum(n[:, None], n2)) & (group[:, None] != group2)
    if same:
        good &= np.triu(np.ones(good.shape, bool), 1)
    maps, maps2 = ([_number(x[4]) for x in side] for side in (left, right))
    for i, j in np.argwhere(good).tolist():
        if (int(n[i] + n2[j]) - _differ(maps[i], maps2[j])) // 2 >= need[i, j]:
            a, b = (i, ids, n), (j, ids2, n2)
            if ids[i] > ids2[j]:
                a, b = b, a
            yield int(a[1][a[0]]), int(b[1][b[0]]), int(a[2][a[0]]), int(b[2][b[0]])


def _all_pairs(rows: DataFrame, sets: DataFrame, shared: Broadcast | None) -> DataFrame:
    """Pairs of documents of a prefix shingle and different components that pass the bounds."""
    if shared is None:
        rows = _tiles(rows).join(sets.select("doc_id", "bitmap"), "doc_id")
    else:
        rows = _tiles(rows).withColumn("bitmap", F.lit(None).cast("binary"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])
        found: set[tuple[int, int, int, int]] = set()

        def ended() -> None:
            if sides[0]:
                same = not sides[1] and (now[1] is None or now[1] == now[2])
                if sides[1] or same:
                    found.update(_tile(sides[0], sides[0] if same else sides[1], same))

        def out() -> pa.RecordBatch:
            pairs = np.array([*found], np.int64).reshape(-1, 4)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(4)], ["a", "b", "na", "nb"])

        for batch in batches:
            for token, one, two, side, *row, bitmap in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                tile = (token, one and (one["band"], one["block"]), two and (two["band"], two["block"]))
                if tile != now:
                    ended()
                    now, sides = tile, ([], [])
                    if len(found) > 200_000:
                        yield out()
                sides[side].append((*row, shared.value[row[0]] if shared is not None else bitmap))
        ended()
        yield out()

    dealt = rows.select("token", "one", "two", "side", "doc_id", "n", "place", "component", "bitmap").repartition("token", "one", "two").sortWithinPartitions("token", "one", "two")
    return map_arrow(dealt, runs, PAIR).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, star: bool) -> DataFrame:
    """Pairs (a, b, na, nb) whose sets reach the threshold, by exact intersection; (a, b).

    An array travels once for each tile, not for each pair. In a star each document has few partners of a smaller key: a
    tile is one of these, followed by a part of its partners, and only two arrays are held. Otherwise the documents
    that pairs connect are dealt to blocks of about TILE_SHINGLES shingles, and a tile is two blocks.
    """
    pairs = settle(pairs, "pairs")
    if star:
        size = pairs.groupBy("a").agg(F.sum("nb").alias("size"))
        part = F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / TILE_SHINGLES).cast("long"))
        tiled = pairs.join(size, "a").select(F.col("a").alias("component"), part.alias("low"), F.lit(-1).cast("long").alias("high"), "a", "b")
        done: list[DataFrame] = []
    else:
        families = components(pairs.select("a", "b"))
        sizes = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("na").alias("n")), F.struct(F.col("b").alias("node"), F.col("nb").alias("n")))).alias("x")).select("x.*").distinct()
        sized = families.join(sizes, "node")
        size = sized.groupBy("component").agg(F.sum("n").alias("size"))
        placed = settle(sized.join(size, "component").select("node", "component", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / TILE_SHINGLES).cast("long")).alias("block")), "placed")
        a, b = (placed.select(F.col("node").alias(x), F.col("component"), F.col("block").alias(f"block_{x}")) for x in "ab")
        tiled = pairs.join(a, "a").join(b.drop("component"), "b").select("component", F.least("block_a", "block_b").alias("low"), F.greatest("block_a", "block_b").alias("high"), "a", "b")
        done = [families, placed]
        tiled = settle(tiled, "tiled")
    tile = ["component", "low", "high"]
    whole = sets.select("doc_id", "runs")
    if star:
        heads = tiled.select(*tile, F.col("a").alias("doc_id")).distinct().join(whole, "doc_id").select(*tile, F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "runs")
        both = heads.unionByName(tiled.join(whole.withColumnRenamed("doc_id", "b"), "b").select(*tile, "a", "b", "runs"))
    else:
        wanted = tiled.select(*tile, F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        arrays = wanted.join(whole, "doc_id").select(*tile, F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "runs")
        both = arrays.unionByName(tiled.withColumn("runs", F.lit(None).cast("binary")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            links: tuple[list[int], list[int]] = ([], [])
            for component, low, high, a, b, x in zip(*batch.columns, strict=True):
                key = (component.as_py(), low.as_py(), high.as_py())
                if key != now:
                    now, held = key, {}
                a, b = a.as_py(), b.as_py()
                if b is None:
                    held[a] = np.frombuffer(x.as_py(), w.U)
                    continue
                one, other = held[a], np.frombuffer(x.as_py(), w.U) if star else held[b]
                common = len(np.intersect1d(one, other, assume_unique=True))
                if 100 * common >= PER_CENT * (len(one) + len(other) - common):
                    links[0].append(a)
                    links[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], ["a", "b"])

    dealt = both.select(*tile, "a", "b", "runs").repartition(*tile).sortWithinPartitions(*tile, F.col("b").asc_nulls_first())
    out = settle(map_arrow(dealt, rows, "a long, b long"), "links")
    release(pairs, tiled, *done)
    return out


def _mixed(sizes: DataFrame) -> bool:
    """Whether a key has different sets."""
    of = F.struct("n", "digest", "digest2")
    return bool(sizes.where("doc_id is not null").groupBy("doc_id").agg(F.min(of).alias("low"), F.max(of).alias("high")).where("not (low <=> high)").limit(1).count())


def _node() -> Column:
    """A number for each key and text."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _apart(docs: DataFrame) -> DataFrame:
    """(node, doc_id, n_shingles, family, component_id): each key and text as a document of its own; families are named by nodes."""
    nodes = docs.select(_node().alias("doc_id"), "text")
    found = settle(_linked(nodes, _measured(nodes)), "apart").select(F.col("doc_id").alias("node"), "n_shingles", F.col("component_id").alias("family"))
    keys = docs.where("doc_id is not null").select(_node().alias("node"), "doc_id").distinct()
    found = settle(found.join(keys, "node", "left"), "named")
    least = found.where("node is not null").groupBy("family").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "family", "left")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """One row for each document: the size of its set and the smallest key that links lead to."""
    docs = docs_of(docs)
    sizes = _measured(docs)
    return _apart(docs).select("doc_id", "n_shingles", "component_id") if _mixed(sizes) else _linked(docs, sizes)


def _linked(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The join where each key has one set."""
    known = sizes.where("doc_id is not null and n > 0")
    classes = settle(known.groupBy("n", "digest", "digest2").agg(F.min("doc_id").alias("leader"), F.min("shared").alias("shared")), "classes")
    ids = classes.where(F.col("shared") * 100 >= F.col("n") * PER_CENT).select(F.col("leader").alias("doc_id")).distinct()
    sets = settle(map_arrow(only(docs.where("doc_id is not null"), ids), _sets, "doc_id long, n long, runs binary, bitmap binary").dropDuplicates(["doc_id"]), "sets")
    shared = _shared_bitmaps(sets)
    prefixes = settle(_prefix_rows(sets), "prefixes")
    heads = prefixes.groupBy("token").agg(F.min(F.struct("doc_id", "n", "place")).alias("h"), F.max("doc_id").alias("high")).where("h.doc_id < high").select("token", "h")
    rows = settle(prefixes.join(heads, "token"), "rows")
    release(prefixes)
    links = _verified(_star(rows, sets, shared), sets, star=True)
    found = components(links)
    bounded = found.count() <= BROADCAST_ROWS
    names = found.select(F.col("node").alias("doc_id"), "component")
    named = rows.drop("h").join(F.broadcast(names) if bounded else names, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    left = settle(named.join(mixed, "token", "left_semi"), "mixed")
    release(rows)
    more = _verified(_all_pairs(left, sets, shared), sets, star=False)
    one, other = (found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    between = more.join(one, "a", "left").join(other, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    merged = components(between)  # components of components
    onward = merged.select(F.col("node").alias("component"), F.col("component").alias("final"))
    final = found.join(onward, "component", "left").select("node", F.coalesce("final", "component").alias("component"))
    final = settle(final.unionByName(merged.join(found, "node", "left_anti").select("node", "component")), "components")
    release(left, sets, links, more, found, merged)
    found = final
    leaders = classes.select("n", "digest", "digest2", "leader").join(found.select(F.col("node").alias("leader"), "component"), "leader", "left")
    leaders = leaders.select("n", "digest", "digest2", F.coalesce("component", "leader").alias("component"))
    out = sizes.join(leaders, ["n", "digest", "digest2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, without those linked with a document of a smaller key.

    Of rows with one key one stays, or one of each family if their texts differ; a row without a key stays.
    """
    narrow = docs_of(docs)
    sizes = _measured(narrow)
    if _mixed(sizes):
        members = _apart(narrow).where("node is not null")
        first = settle(members.groupBy("family").agg(F.min(F.struct("doc_id", "node")).alias("x")).select(F.col("x.node").alias("__node")), "first")
        kept = docs.withColumn("__node", _node()).join(first, "__node", "left_semi").dropDuplicates(["__node"])
        return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))
    found = settle(_linked(narrow, sizes).where("doc_id is not null"), "members")
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    again = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    bounded = gone.count() <= BROADCAST_ROWS
    left = docs.join(F.broadcast(gone) if bounded else gone, "doc_id", "left_anti").select(docs.columns)
    if not again.limit(1).count():
        return left
    return left.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))
