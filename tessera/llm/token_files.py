"""Token ids as flat binary files.

Layout: each part has files of a name of its own. NAME.bin holds ids as little-endian unsigned integers, 2 bytes
each if the vocabulary allows it and else 4; NAME.idx holds, for each document and the end, the number of ids before
it in that part as unsigned 64-bit integers; NAME.doc holds the keys as signed 64-bit integers and NAME.nul a byte for
each, 1 where the key is null (and .doc has 0). manifest.json lists the parts in order with their names, numbers of
documents and ids and the sums of those before, so that a part's place in the whole is known without reading any
other. Documents stand in ascending order of their key, null keys first, over all parts.

A task writes under names that no other attempt uses and reports them when all is written. The manifest names the
files of the attempts that counted, so no two attempts are ever mixed; what others left is deleted after it is written. Readers map
local files into memory and read ranges of others.

Defined cases: a null text is the empty one, which has the end id alone; rows with equal keys follow each other, by
text; a null key is an error unless null_keys is set, as the query does; other columns are ignored; an empty table
gives a manifest without parts.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import docs_of, map_arrow, qualified, store
from tessera.llm.tokenization import encoded, encoder

PART = "part long, name string, n_docs long, n_ids long"
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 1, null_keys: bool = False) -> dict:
    """Write all documents below path (on storage that executors and driver share); returns the manifest."""
    width = 2 if max(encoder(tokenizer).size, end + 1) <= 1 << 16 else 4
    path = qualified(docs.sparkSession, path)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(path)
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        keys, ends = array("q"), array("Q", [0])
        nulls = bytearray()
        out = None
        for key, ids in encoded(batches, tokenizer, end, keep=True):  # tasks are short, as they follow a shuffle
            if key is None and not null_keys:
                raise ValueError("a document has no key")
            out = out or fs.open_output_stream(f"{base}/{name}.bin", buffer_size=1 << 20)
            out.write(np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes())
            keys.append(key or 0)
            nulls.append(key is None)
            ends.append(ends[-1] + len(ids) // 4)
        if not keys:
            return
        out.close()
        for kind, values in (("idx", np.array(ends, "<u8")), ("doc", np.array(keys, "<i8")), ("nul", nulls)):
            with fs.open_output_stream(f"{base}/{name}.{kind}") as f:
                f.write(bytes(values) if kind == "nul" else values.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), *(pa.array([x], pa.int64()) for x in (len(keys), ends[-1]))], ["part", "name", "n_docs", "n_ids"])

    ordered = docs_of(docs).repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    listed, docs_before, ids_before = [], 0, 0
    for row in sorted(map_arrow(ordered, parts, PART).collect()):  # a row for each part
        listed.append({"name": row.name, "n_docs": row.n_docs, "n_ids": row.n_ids, "docs_before": docs_before, "ids_before": ids_before})
        docs_before, ids_before = docs_before + row.n_docs, ids_before + row.n_ids
    manifest = {"width": width, "n_docs": docs_before, "n_ids": ids_before, "parts": listed}
    fs, base = store(path)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    known = {p["name"] for p in listed}
    for file in fs.get_file_info(pafs.FileSelector(base)):
        if file.base_name.startswith("part-") and file.base_name.rpartition(".")[0] not in known:
            fs.delete_file(file.path)
    return manifest


class Part:
    """One part, mapped into memory where it is a local file."""

    def __init__(self, path: str, name: str, width: int) -> None:
        self.fs, base = store(path)
        self.width, self.name = width, f"{base}/{name}"
        keys, nulls, self.ends = (np.frombuffer(self._whole(kind), form) for kind, form in (("doc", "<i8"), ("nul", "u1"), ("idx", "<u8")))
        self.keys = pa.array(keys, pa.int64(), mask=nulls.astype(bool))
        if isinstance(self.fs, pafs.LocalFileSystem):
            self.all, self.file = np.memmap(f"{self.name}.bin", f"<u{width}", "r"), None
        else:
            self.all, self.file = None, self.fs.open_input_file(f"{self.name}.bin")

    def _whole(self, kind: str) -> bytes:
        with self.fs.open_input_stream(f"{self.name}.{kind}") as f:
            return f.read()

    def ids(self, i: int) -> np.ndarray:
        lo, hi = int(self.ends[i]), int(self.ends[i + 1])
        if self.all is not None:
            return self.all[lo:hi]
        return np.frombuffer(self.file.read_at((hi - lo) * self.width, lo * self.width), f"<u{self.width}")


def read_back(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    """One row for each document, from the files: its place in the whole, its length and the checksum of its ids."""
    width, path = manifest["width"], qualified(spark, path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                part = Part(path, name, width)
                sums = [zlib.crc32(part.ids(i).astype("<u4").tobytes()) for i in range(len(part.keys))]
                yield pa.RecordBatch.from_arrays([part.keys, pa.array(part.ends[:-1].astype(np.int64) + before), pa.array(np.diff(part.ends).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = [(p["name"], p["ids_before"]) for p in manifest["parts"]]
    frame = spark.createDataFrame(parts, "name string, ids_before long")
    return map_arrow(frame.repartition(max(1, len(parts))), rows, SCHEMA)
