"""Rows that are computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The same rows whenever they are read: written below spark.checkpoint.dir, or cached where that is unset."""
    if df.sparkSession.conf.get("spark.checkpoint.dir", None):
        return df.checkpoint()
    out = df.cache()
    out.count()
    return out
