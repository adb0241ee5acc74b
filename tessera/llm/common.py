"""What the text operators share: reading tables, scratch space on shared storage, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of a row group that settle() writes.
GROUP_BYTES = 8 << 20

_local_base: str | None = None
_written: set[str] = set()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _hadoop_path(spark: SparkSession, path: str):  # noqa: ANN202
    """Path and its file system as Spark resolves them; without a scheme, the default file system's."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, so that executors reach what Spark does."""
    found, fs = _hadoop_path(spark, path)
    return str(fs.makeQualified(found).toString())


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where that is unset, which only one machine can share."""
    global _local_base
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return qualified(spark, named).rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _local_base is None:
        _local_base = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _local_base


def scratch_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/tessera-{what}-{uuid.uuid4().hex[:12]}"
    _written.add(path)
    return path


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_written):
        with contextlib.suppress(Exception):
            if spark is None:
                fs, at = store(path)
                fs.delete_dir(at)
            else:
                _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    found, fs = _hadoop_path(spark, path)
    fs.delete(found, True)
    _written.discard(path)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df to shared storage and read it back: cuts lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def settle(df: DataFrame, what: str, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str | None = None) -> DataFrame:
    """materialize() where Python workers write, if the shared folder is a path of the local file system.

    For such a path Hadoop starts a chmod for each folder, file and checksum file, in the JVM that writes, and a JVM
    that starts a process counts twice in memory until that process runs. What attempts wrote that didn't count is
    left aside and goes with the table. With rows and schema, as for map_arrow(), that table is written; rows runs in
    the worker that writes, so a task has one worker, not two.
    """
    spark = df.sparkSession
    if not shared_dir(spark).startswith("file:"):
        return materialize(map_arrow(df, rows, schema) if rows else df, what)
    path = scratch_path(spark, what)
    fs, base = store(path)
    fs.create_dir(f"{base}/table", recursive=True)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet"
        with contextlib.ExitStack() as opened:
            out, held, size = None, [], 0
            for batch in rows(batches) if rows else batches:
                if not batch.num_rows:
                    continue
                out = out or opened.enter_context(pq.ParquetWriter(f"{base}/{name}", batch.schema, store_schema=False))
                held.append(batch)
                size += batch.nbytes
                if size > GROUP_BYTES:
                    out.write_table(pa.Table.from_batches(held))
                    held, size = [], 0
            if held:
                out.write_table(pa.Table.from_batches(held))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    for row in map_arrow(df, written, "name string").collect():  # a row for each task
        fs.move(f"{base}/{row.name}", f"{base}/table/{row.name}")
    out = spark.read.schema(schema or df.schema).parquet(f"{path}/table")
    out._scratch = path
    return out


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed inside go as it ends; else they stay until the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once all that is read from them is written itself."""
    for df in tables:
        if path := df.__dict__.pop("_scratch", None):
            _remove(df.sparkSession, path)


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Let Arrow batches of the session be at most this large; smaller ones stay. Queries call it, operators don't."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def _give_back() -> None:
    """Return free memory to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow in a worker that holds no memory between tasks."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        _give_back()

    return df.mapInArrow(tidy, schema)


def docs_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key (bigint) and the text, so that other columns, whatever their names, never interfere."""
    return df.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").cast("string").alias(text))


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one plain string array; null becomes the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string() and column.type != pa.large_string():
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def slices(column: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most max_bytes of text each; a longer text is a range of its own."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False)
    lo, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > lo and total + n > max_bytes:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(column):
        yield lo, len(column)
