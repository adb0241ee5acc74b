"""Row limits, lateral joins, set operations, recursion, series and reshaping."""

from __future__ import annotations

import functools
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import EngineError
from tessera.types import common_type


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """TOP (n)."""
    if n is None or n < 0:
        raise EngineError(1014, "TOP takes a number that isn't negative")
    return (df.orderBy(*order) if order else df).limit(n)


def top_with_ties(df: DataFrame, n: int, *order: tuple[str, str]) -> DataFrame:
    """TOP (n) WITH TIES; order is (column, "asc" or "desc").

    A bounded top-n finds the last row's keys; rows with those keys come from a semi join, so the input is never
    sorted as a whole.
    """
    if not order:
        raise EngineError(1062, "WITH TIES needs ORDER BY")
    directed = [F.col(c).desc() if d == "desc" else F.col(c).asc() for c, d in order]
    best = df.orderBy(*directed).limit(n)
    place = F.row_number().over(Window.orderBy(*directed))
    last = best.withColumn("__r", place).orderBy(F.desc("__r")).limit(1).select(*[F.col(c).alias(f"__k{i}") for i, (c, _) in enumerate(order)])
    same = F.lit(True)
    for i, (c, _) in enumerate(order):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return best.join(F.broadcast(last), same, "left_anti").unionByName(df.join(F.broadcast(last), same, "left_semi"))


def top_percent(df: DataFrame, percent: float, *order: Column) -> DataFrame:
    """TOP (p) PERCENT: p per cent of the rows, rounded up."""
    if not 0 <= percent <= 100:
        raise EngineError(1031, "per cent values are from 0 to 100")
    n = df.count()
    p = Decimal(str(percent)) * n / 100
    return top(df, int(p.to_integral_value(rounding="ROUND_CEILING")), *order)


def offset_fetch(df: DataFrame, offset: int, fetch: int | None, *order: Column) -> DataFrame:
    """ORDER BY ... OFFSET n ROWS [FETCH NEXT m ROWS ONLY]."""
    if offset < 0:
        raise EngineError(10742, "the offset may not be negative")
    if fetch is not None and fetch <= 0:
        raise EngineError(10744, "the number of rows to fetch must be positive")
    out = df.orderBy(*order).offset(offset)
    return out if fetch is None else out.limit(fetch)


def apply(left: DataFrame, right: Callable[[], DataFrame], outer: bool = False) -> DataFrame:
    """CROSS APPLY and OUTER APPLY; right() refers to left's columns by their outer().

    Columns that right() orders by before a limit are left out after it, not between the two, or Spark loses the order.
    """
    return left.lateralJoin(right(), on=F.lit(True), how="left" if outer else "inner")


def apply_full_join(outer: DataFrame, key: str, left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """CROSS APPLY over a FULL JOIN of two sources that both belong to an outer row.

    Both sources carry the outer row's key, so the correlated join is one full join on key and condition.
    """
    joined = left.join(right, [key, *on], "full")
    return outer.join(joined, key)


def values(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """(VALUES ...) v(names): columns have the common type of their rows."""
    alike: dict[tuple, list[tuple]] = {}  # rows of the same types make one frame
    for row in rows:
        if len(row) != len(names):
            raise EngineError(10709, "the rows of VALUES differ in length")
        alike.setdefault(tuple(map(_type_of, row)), []).append(tuple(row))
    kinds = [functools.reduce(common_type, column) for column in zip(*alike, strict=True)]
    frames = [spark.createDataFrame(part, T.StructType([T.StructField(n, t) for n, t in zip(names, own, strict=True)])) for own, part in alike.items()]
    return functools.reduce(DataFrame.union, [f.select(*[F.col(f"`{n}`").cast(k).alias(n) for n, k in zip(names, kinds, strict=True)]) for f in frames])


def _type_of(v: object) -> T.DataType:
    if v is None:
        return T.NullType()
    if isinstance(v, bool):
        return T.BooleanType()
    if isinstance(v, int):
        return T.IntegerType() if -(2**31) <= v < 2**31 else T.LongType()
    if isinstance(v, Decimal):
        _, digits, exponent = v.as_tuple()
        scale = max(0, -exponent)
        return T.DecimalType(max(len(digits), scale + 1), scale)
    return {float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType()}.get(type(v)) or T._infer_type(v)


def set_operation(kind: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """UNION ALL, UNION, INTERSECT, EXCEPT by position, with common types."""
    if len(a.columns) != len(b.columns):
        raise EngineError(205, "both sides need the same number of columns")
    kinds = [common_type(x.dataType, y.dataType) for x, y in zip(a.schema, b.schema, strict=True)]
    names = a.columns
    a, b = (df.toDF(*names).select(*[F.col(f"`{n}`").cast(k).alias(n) for n, k in zip(names, kinds, strict=True)]) for df in (a, b))
    return {"union all": lambda: a.union(b), "union": lambda: a.union(b).distinct(), "intersect": lambda: a.intersect(b), "except": lambda: a.subtract(b), "intersect all": lambda: a.intersectAll(b), "except all": lambda: a.exceptAll(b)}[kind]()


def recursive(spark: SparkSession, name: str, columns: list[str], anchor: str, step: str, final: str, limit: int = 100) -> DataFrame:
    """WITH name(columns) AS (anchor UNION ALL step) final; error 530 beyond the limit, 0 for none up to 32767."""
    if not 0 <= limit <= 32767:
        raise EngineError(310, "MAXRECURSION is from 0 to 32767")
    return spark.sql(f"WITH RECURSIVE {name}({', '.join(columns)}) MAX RECURSION LEVEL {limit or 32767} AS ({anchor} UNION ALL {step}) {final}")


def generate_series(spark: SparkSession, start: int | Decimal, stop: int | Decimal, step: int | Decimal | None = None) -> DataFrame:
    """GENERATE_SERIES: the step is 1 or -1 by default; an error for 0, no rows against its direction."""
    step = step if step is not None else (1 if start <= stop else -1)
    if step == 0:
        raise EngineError(4199, "the step may not be 0")
    if all(isinstance(v, int) for v in (start, stop, step)):
        kind = "int" if all(-(2**31) <= v < 2**31 for v in (start, stop, step)) else "long"
        n = max(0, (stop - start) // step + 1)
        return spark.range(n).select((F.lit(start) + F.col("id") * F.lit(step)).cast(kind).alias("value"))
    scale = max(-Decimal(v).as_tuple().exponent for v in (start, stop, step))
    a, b, c = (int(Decimal(v).scaleb(scale)) for v in (start, stop, step))
    n = max(0, (b - a) // c + 1)
    kind = T.DecimalType(18 + scale, scale)
    return spark.range(n).select(((F.lit(a) + F.col("id") * F.lit(c)).cast("decimal(18,0)") * F.lit(Decimal(1).scaleb(-scale))).cast(kind).alias("value"))


def string_split(x: Column, separator: str, ordinal: bool = False) -> Column:
    """STRING_SPLIT as a generator: value, or the place from 0 and the value; null gives no rows."""
    if len(separator) != 1:
        raise EngineError(214, "the separator is one character")
    parts = F.split(x, "\\Q" + separator + "\\E", -1)
    return F.posexplode(parts) if ordinal else F.explode(parts)


def distinct_ci(df: DataFrame, *columns: str) -> DataFrame:
    """SELECT DISTINCT under the default collation of text; the least whole row stands for each."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    if not text.intersection(columns):
        return df.select(*columns).distinct()
    keys = [(F.lower(F.rtrim(F.col(c))) if c in text else F.col(c)).alias(f"__k{i}") for i, c in enumerate(columns)]
    rows = df.select(*keys, F.struct(*columns).alias("__row"))
    return rows.groupBy(*[f"__k{i}" for i in range(len(columns))]).agg(F.min("__row").alias("__row")).select("__row.*")


def pivot(df: DataFrame, keys: list[str], column: str, labels: list, aggregate: Column) -> DataFrame:
    return df.groupBy(*keys).pivot(column, labels).agg(aggregate)


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """UNPIVOT leaves nulls out."""
    return df.unpivot(keys, columns, name, value).where(F.col(value).isNotNull())


def select_into(df: DataFrame, name: str) -> DataFrame:
    """SELECT ... INTO a new table."""
    spark = df.sparkSession
    if spark.catalog.tableExists(name):
        raise EngineError(2714, f"there is already an object named {name}")
    df.write.saveAsTable(name)
    return spark.table(name)


def compare_all(df: DataFrame, x: Column, op: str, values_: DataFrame) -> DataFrame:
    """x op ALL (subquery): true for an empty one; unknown, so not kept, if a null decides."""
    c = values_.columns[0]
    facts = values_.agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"), F.count("*").alias("__n"), F.count(c).alias("__c"))
    if op == "<>":
        df = df.join(values_.select(F.col(c).alias("__v")), x == F.col("__v"), "left_anti")
    j = df.crossJoin(F.broadcast(facts))
    bound = {">": "__hi", ">=": "__hi", "<": "__lo", "<=": "__lo"}.get(op)
    if bound:
        test = {">": x > F.col(bound), ">=": x >= F.col(bound), "<": x < F.col(bound), "<=": x <= F.col(bound)}[op]
    elif op == "=":
        test = (x == F.col("__lo")) & (x == F.col("__hi"))
    else:
        test = x.isNotNull()
    return j.where((F.col("__n") == 0) | ((F.col("__n") == F.col("__c")) & test)).drop("__lo", "__hi", "__n", "__c")


def compare_any(df: DataFrame, x: Column, op: str, values_: DataFrame) -> DataFrame:
    """x op ANY (subquery)."""
    c = values_.columns[0]
    if op == "=":
        return df.join(values_.select(F.col(c).alias("__v")).distinct(), x == F.col("__v"), "left_semi")
    facts = values_.agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"))
    j = df.crossJoin(F.broadcast(facts))
    test = {">": x > F.col("__lo"), ">=": x >= F.col("__lo"), "<": x < F.col("__hi"), "<=": x <= F.col("__hi"), "<>": (x != F.col("__lo")) | (x != F.col("__hi"))}[op]
    return j.where(test).drop("__lo", "__hi")


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, take: list[str], bucket: str | None = None) -> DataFrame:
    """For each left row the last right row of its key at or before its time: one shuffle, a running last value.

    Right rows stand before left ones of the same time. With a bucket (a unit such as "month") a key's history is dealt
    out by time, so that a key with much of the rows isn't one task's: each bucket's last right row is carried to the
    buckets after it, by a running last value over one row for each key and bucket.
    """
    if bucket is not None:
        return _asof_in_buckets(left, right, key, at, right_at, take, bucket)
    marked = right.select(F.col(key), F.col(right_at).alias("__t"), F.lit(0).alias("__side"), F.struct(*take).alias("__last"), F.lit(None).cast(left.schema.simpleString()).alias("__left"))
    asked = left.select(F.col(key), F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(*take).schema.simpleString()).alias("__last"), F.struct(*left.columns).alias("__left"))
    w = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = marked.unionByName(asked).withColumn("__found", F.last("__last", ignorenulls=True).over(w)).where("__side = 1")
    return both.select("__left.*", *[F.col("__found")[c].alias(c) for c in take])


def _asof_in_buckets(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, take: list[str], bucket: str) -> DataFrame:
    dated = right.select(F.col(key).alias("__k"), F.date_trunc(bucket, F.col(right_at)).alias("__b"), F.col(right_at).alias("__t"), F.struct(*take).alias("__last"))
    asked = left.select(F.col(key).alias("__k"), F.date_trunc(bucket, F.col(at)).alias("__b"), F.col(at).alias("__t"), F.struct(*left.columns).alias("__left"))
    last = dated.groupBy("__k", "__b").agg(F.max_by("__last", "__t").alias("__last"))
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = last.unionByName(asked.select("__k", "__b").distinct(), allowMissingColumns=True).groupBy("__k", "__b").agg(F.first("__last", ignorenulls=True).alias("__last"))
    carried = buckets.select("__k", "__b", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    both = dated.withColumn("__side", F.lit(0)).unionByName(asked.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    running = Window.partitionBy("__k", "__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__last", ignorenulls=True).over(running)).where("__side = 1").join(carried, ["__k", "__b"], "left")
    unkeyed = left.where(F.col(key).isNull()).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take])
    keyed = found.where("__k is not null").select("__left.*", *[F.coalesce("__found", "__carried")[c].alias(c) for c in take])
    return keyed.unionAll(unkeyed)


def band_join(left: DataFrame, right: DataFrame, x: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with low <= x < high, by buckets of a width: an equi-join instead of a nested loop."""
    dealt = right.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return left.withColumn("__b", F.floor(F.col(x) / width)).join(dealt, "__b").where((F.col(x) >= F.col(low)) & (F.col(x) < F.col(high))).drop("__b")
