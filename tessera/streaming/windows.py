"""Event-time windows over a stream, and the same over a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(df: DataFrame, at: str, size: str, *aggregates: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Fixed windows without overlap; window_start and window_end come first."""
    return _shaped(df.groupBy(F.window(at, size).alias("w"), *keys).agg(*aggregates), keys)


def sliding(df: DataFrame, at: str, size: str, slide: str, *aggregates: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    return _shaped(df.groupBy(F.window(at, size, slide).alias("w"), *keys).agg(*aggregates), keys)


def session(df: DataFrame, at: str, gap: str, *aggregates: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Windows that end when nothing comes for a gap."""
    return _shaped(df.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(*aggregates), keys)


def _shaped(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    rest = [c for c in df.columns if c not in ("w", *keys)]
    return df.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *rest)


def file_stream(spark: SparkSession, path: str, schema: object) -> DataFrame:
    """New files of a folder, as they come."""
    return spark.readStream.schema(schema).parquet(path)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what is there and stop; a later call goes on where this one ended."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
