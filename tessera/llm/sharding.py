"""Hierarchical weighted hash tree: rows go to shards by weighted hash draws at region, rack and shard level.

At each level a child draws -ln(u)/weight with u hashed from (key, child), and the smallest draw takes the row.
If a subtree's weight changes, only rows that enter or leave that subtree move. The first 24 shards are 2 regions
of 3 racks of 4; each further shard is mounted as a region of its own, so that growing by one shard moves rows
into the new shard only. Everything is built-in DataFrame functions.

Defined cases: a null text has size 8 and the checksum of no bytes; a null key is hashed as such; rows that are
repeated go to the same shard and get slots of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import docs_of, materialize

#: Shards of each rack of each region.
BASE = ((4, 4, 4), (4, 4, 4))


def topology(shards: int) -> list[list[list[int]]]:
    """Regions, each a list of racks, each a list of shard numbers."""
    tree, number = [], 0
    for region in BASE:
        racks = []
        for size in region:
            racks.append([n for n in range(number, number + size) if n < shards])
            number += size
        if any(racks):
            tree.append([rack for rack in racks if rack])
    return tree + [[[n]] for n in range(number, shards)]


def _least(what: str, path: list[Column], keys: list[Column], weights: list[Column]) -> Column:
    """Index of the child with the smallest draw; a child of weight 0 isn't there."""
    draws = []
    for i, weight in enumerate(weights):
        h = F.xxhash64(F.lit(what), *path, F.lit(i), *keys)
        u = (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        draws.append(F.when(weight > 0, F.struct((-F.log(u) / weight).alias("draw"), F.lit(i).alias("child"))))
    return F.least(*draws)["child"] if len(draws) > 1 else F.lit(0)


def _table(values: list[int], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at)


def with_shard(rows: DataFrame, keys: list[str], shards: int, name: str) -> DataFrame:
    """Add a column with the shard number, found level by level from the top of the tree."""
    tree, columns = topology(shards), [F.col(k) for k in keys]
    racks, width = max(map(len, tree)), max(len(rack) for region in tree for rack in region)
    region, rack = F.col(f"{name}_region"), F.col(f"{name}_rack")
    sizes = [len(r[i]) if i < len(r) else 0 for r in tree for i in range(racks)]
    firsts = [r[i][0] if i < len(r) else -1 for r in tree for i in range(racks)]
    place = region * racks + rack
    rows = rows.withColumn(f"{name}_region", _least("region", [], columns, [F.lit(sum(map(len, r))) for r in tree]))
    rows = rows.withColumn(f"{name}_rack", _least("rack", [region], columns, [_table(sizes, region * racks + i) for i in range(racks)]))
    member = _least("shard", [region, rack], columns, [(_table(sizes, place) > i).cast("int") for i in range(width)])
    return rows.withColumn(name, _table(firsts, place) + member).drop(f"{name}_region", f"{name}_rack")


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row for each document: size, checksum, shard, slot in it and the shard after growth by one.

    Slots come from prefix sums: each task's rows of a shard are numbered on their own and start where those of
    the tasks before end, so that neither a shard nor a key ever has to meet in one task.
    """
    binary = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs_of(docs).select(
        "doc_id",
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + F.lit(8)).cast("long").alias("size"),
        F.crc32(binary).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    for name, n in (("shard", shards), ("grown_shard", shards + 1)):
        rows = with_shard(rows, ["doc_id"], n, name)
    rows = materialize(rows, "shards").withColumn("task", F.shiftright("place", 33))
    counts = rows.groupBy("shard", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("shard", "task", F.coalesce(before, F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("shard", "task").orderBy("place"))
    numbered = rows.withColumn("local", local).join(bases, ["shard", "task"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("local") - 1).alias("slot"), "grown_shard")
