"""INSERT, UPDATE, DELETE and MERGE as transformations: a new table and the OUTPUT rows.

Tables are immutable here: every statement returns the new table and, where asked for, images of the changed rows with
columns inserted_x and deleted_x.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import EngineError


@dataclass
class Changed:
    table: DataFrame
    output: DataFrame


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> Changed:
    """INSERT of rows by column name: converted to the target's types; what is left out gets its default or null."""
    defaults = defaults or {}
    new = rows.select(*[(F.col(c) if c in rows.columns else defaults.get(c, F.lit(None))).cast(table.schema[c].dataType).alias(c) for c in table.columns])
    return Changed(table.unionByName(new), new.select(*[F.col(c).alias(f"inserted_{c}") for c in table.columns]))


def _one_each(source: DataFrame, keys: list[str]) -> DataFrame:
    """One source row for each target key: the least by all columns, so that the choice is the same each time."""
    w = Window.partitionBy(*keys).orderBy(*[c for c in source.columns if c not in keys] or keys)
    return source.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def update(table: DataFrame, sets: dict[str, Column], where: Column | None = None, source: DataFrame | None = None, keys: list[str] | None = None, how: str = "inner") -> Changed:
    """UPDATE [FROM]: sets and where may use the source's columns as s_<name>; rows join on keys.

    how "left" is an outer join from the target: rows without a source row are updated too.
    """
    joined, columns = table, table.columns
    hit = F.lit(True)
    if source is not None:
        renamed = _one_each(source, keys).select(*[F.col(c).alias(f"s_{c}") for c in source.columns], F.lit(True).alias("__hit"))
        condition = F.lit(True)
        for k in keys:
            condition = condition & (F.col(k) == F.col(f"s_{k}"))
        joined = table.join(renamed, condition, "left")
        hit = F.col("__hit").isNotNull() if how == "inner" else F.lit(True)
    changed = F.coalesce(hit & (where if where is not None else F.lit(True)), F.lit(False))
    marked = joined.withColumn("__changed", changed)
    new = {c: F.when(F.col("__changed"), sets[c].cast(table.schema[c].dataType)).otherwise(F.col(c)) if c in sets else F.col(c) for c in columns}
    both = marked.select("__changed", *[F.col(c).alias(f"__old_{c}") for c in columns], *[new[c].alias(c) for c in columns])
    output = both.where("__changed").select(*[F.col(f"__old_{c}").alias(f"deleted_{c}") for c in columns], *[F.col(c).alias(f"inserted_{c}") for c in columns])
    return Changed(both.select(*columns), output)


def delete(table: DataFrame, where: Column | None = None, source: DataFrame | None = None, keys: list[str] | None = None) -> Changed:
    """DELETE [FROM]: rows that satisfy where, or have a source row of the same keys."""
    if source is not None:
        rows = source.select(*keys).distinct()
        gone, left = table.join(rows, keys, "left_semi"), table.join(rows, keys, "left_anti")
        if where is not None:
            test = F.coalesce(where, F.lit(False))
            gone, left = gone.where(test), left.unionByName(table.join(rows, keys, "left_semi").where(~test))
        gone, left = gone.select(*table.columns), left.select(*table.columns)
    else:
        test = F.coalesce(where if where is not None else F.lit(True), F.lit(False))
        gone, left = table.where(test), table.where(~test)
    return Changed(left, gone.select(*[F.col(c).alias(f"deleted_{c}") for c in table.columns]))


def truncate(table: DataFrame) -> DataFrame:
    return table.limit(0)


@dataclass
class Arm:
    """A WHEN of MERGE: which rows (matched, by_target: only in the source, by_source: only in the target), what to do."""

    when: Literal["matched", "by_target", "by_source"]
    action: Literal["update", "delete", "insert"]
    values: dict[str, Column] | None = None
    condition: Column | None = None


def merge(table: DataFrame, source: DataFrame, keys: list[str], arms: list[Arm], check: bool = True) -> Changed:
    """MERGE on equal keys; conditions and values use the target's columns and the source's as s_<name>.

    The first arm that fits a row acts. If check is set, a target row that several source rows would change is an error (8672).
    """
    columns = table.columns
    right = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns], F.lit(True).alias("__s"))
    left = table.withColumn("__t", F.monotonically_increasing_id())
    condition = F.lit(True)
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"s_{k}"))
    joined = left.join(right, condition, "full")
    kind = F.when(F.col("__t").isNotNull() & F.col("__s").isNotNull(), "matched").when(F.col("__s").isNotNull(), "by_target").otherwise("by_source")
    chosen = F.lit(-1)
    for i, arm in reversed([*enumerate(arms)]):
        test = F.col("__kind") == arm.when
        chosen = F.when(F.coalesce(test & arm.condition if arm.condition is not None else test, F.lit(False)), i).otherwise(chosen)
    marked = joined.withColumn("__kind", kind).withColumn("__arm", chosen)
    changing = [i for i, a in enumerate(arms) if a.when == "matched"]
    if check and changing:
        # rows of the source alone are no target row's, and are spread by numbers of their own
        w = Window.partitionBy(F.coalesce("__t", -1 - F.monotonically_increasing_id()))
        several = F.sum((F.col("__arm").isin(changing)).cast("int")).over(w) > 1
        fault = F.when(several & F.col("__arm").isin(changing), F.raise_error(F.lit("tessera-error-8672: MERGE would change a row more than once")).cast("int")).otherwise(F.col("__arm"))
        marked = marked.withColumn("__arm", fault)
    out = {}
    for c in columns:
        value = F.col(c)
        for i, arm in enumerate(arms):
            if arm.action in ("update", "insert"):
                given = (arm.values or {}).get(c)
                new = given.cast(table.schema[c].dataType) if given is not None else (F.col(c) if arm.action == "update" else F.lit(None).cast(table.schema[c].dataType))
                value = F.when(F.col("__arm") == i, new).otherwise(value)
        out[c] = value
    names = F.when(F.col("__arm") < 0, F.lit(None).cast("string"))
    for i, arm in enumerate(arms):
        names = names.when(F.col("__arm") == i, arm.action.upper())
    both = marked.withColumn("__action", names).select("__t", "__arm", "__action", *[F.col(c).alias(f"__old_{c}") for c in columns], *[out[c].alias(c) for c in columns])
    kept = both.where((F.coalesce(F.col("__action"), F.lit("")) != "DELETE") & (F.col("__t").isNotNull() | (F.col("__action") == "INSERT")))
    kept = kept.select(*columns)
    deleted = [F.when(F.col("__action") != "INSERT", F.col(f"__old_{c}")).alias(f"deleted_{c}") for c in columns]
    inserted = [F.when(F.col("__action") != "DELETE", F.col(c)).alias(f"inserted_{c}") for c in columns]
    output = both.where("__action IS NOT NULL").select(F.col("__action").alias("action"), *deleted, *inserted)
    return Changed(kept, output)


def check_key(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in more than one row: what PRIMARY KEY and UNIQUE reject (2627)."""
    return table.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def check_reference(table: DataFrame, columns: list[str], other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose foreign key isn't in the other table (547); nulls pass."""
    renamed = other.select(*[F.col(k).alias(c) for k, c in zip(keys, columns, strict=True)]).distinct()
    given = F.lit(True)
    for c in columns:
        given = given & F.col(c).isNotNull()
    return table.where(given).join(renamed, columns, "left_anti")


def check_condition(table: DataFrame, condition: Column) -> DataFrame:
    """Rows that a CHECK rejects (547): those for which it is false; unknown passes."""
    return table.where(~F.coalesce(condition, F.lit(True)))


def identity(rows: DataFrame, name: str, seed: int = 1, increment: int = 1, *order: str) -> DataFrame:
    """Adds an IDENTITY column in the order given: numbers by ranges, so that no task gets all rows."""
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    w = Window.partitionBy("__p").orderBy(*order)
    local = numbered.withColumn("__i", F.row_number().over(w))
    sizes = local.groupBy("__p").agg(F.max("__i").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__p", before.alias("__b"))
    return local.join(F.broadcast(starts), "__p").withColumn(name, F.lit(seed).cast("long") + (F.col("__b") + F.col("__i") - 1) * increment).drop("__p", "__i", "__b")
