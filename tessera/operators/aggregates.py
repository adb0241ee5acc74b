"""Aggregates with the dialect's result types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import EngineError
from tessera.functions.numeric import truncate
from tessera.types import MONEY


def _in(x: Column, over: WindowSpec | None) -> Column:
    """The aggregate by itself or over a window."""
    return x if over is None else x.over(over)


def count(x: Column | str = "*") -> Column:
    """COUNT as int; error if it doesn't fit."""
    return F.count(x).cast("int")


def count_big(x: Column | str = "*") -> Column:
    return F.count(x)


def count_distinct(*xs: Column) -> Column:
    return F.count_distinct(*xs).cast("int")


def sum_int(x: Column, kind: str = "int") -> Column:
    """SUM of integers: int for int and narrower, bigint for bigint; error if it doesn't fit."""
    return F.sum(x.cast("decimal(19,0)") if kind == "bigint" else x.cast("long")).cast(kind)


def avg_int(x: Column, kind: str = "int", over: WindowSpec | None = None) -> Column:
    """AVG of integers: toward zero."""
    return F.call_function("div", _in(F.sum(x.cast("long")), over), _in(F.count(x), over)).cast(kind)


def sum_decimal(x: Column, scale: int, over: WindowSpec | None = None) -> Column:
    return _in(F.sum(x.cast(T.DecimalType(38, scale))), over).cast(T.DecimalType(38, scale))


def avg_decimal(x: Column, scale: int, over: WindowSpec | None = None) -> Column:
    """AVG of decimals: DECIMAL(38, max(scale, 6)), cut toward zero.

    Whole and remaining parts are divided on their own, so nothing is rounded and no digit is lost.
    """
    places = max(scale, 6)
    total, n = _in(F.sum(x.cast(T.DecimalType(28, scale))), over), _in(F.count(x), over)
    units = (F.abs(total) * 10**scale).cast("decimal(38,0)")
    whole = ((units - units % n) / n).cast("decimal(38,0)")
    rest = F.floor(((units % n) * 10 ** (places - scale)).cast("decimal(38,0)") / n.cast("decimal(19,0)")).cast("decimal(38,0)")
    size = (whole.cast("decimal(30,0)") * F.lit(10 ** (places - scale)).cast("decimal(8,0)") + rest).cast("decimal(38,0)")
    value = (size.cast(T.DecimalType(38 - places, 0)) * F.lit(f"1e-{places}").cast(T.DecimalType(places, places))).cast(T.DecimalType(38, places))
    return F.when(total < 0, -value).otherwise(value).cast(T.DecimalType(38, places))


def sum_money(x: Column, over: WindowSpec | None = None) -> Column:
    return _in(F.sum(x.cast(MONEY)), over).cast(MONEY)


def avg_money(x: Column, over: WindowSpec | None = None) -> Column:
    """AVG of money: cut at four places."""
    return truncate(_in(F.sum(x.cast(MONEY)), over) / _in(F.count(x), over).cast("decimal(10,0)"), 4).cast(MONEY)


def sum_float(x: Column) -> Column:
    return F.sum(x.cast("double"))


def avg_float(x: Column) -> Column:
    return F.avg(x.cast("double"))


def _squares(x: Column, less: int, over: WindowSpec | None) -> Column:
    x = x.cast("double")
    n, s = _in(F.count(x), over), _in(F.sum(x), over)
    return F.when(n > less, F.greatest((_in(F.sum(x * x), over) - s * s / n) / (n - less), F.lit(0.0)))


def var(x: Column, over: WindowSpec | None = None) -> Column:
    """VAR from sums: null for one row."""
    return _squares(x, 1, over)


def varp(x: Column, over: WindowSpec | None = None) -> Column:
    return _squares(x, 0, over)


def stdev(x: Column, over: WindowSpec | None = None) -> Column:
    return F.sqrt(_squares(x, 1, over))


def stdevp(x: Column, over: WindowSpec | None = None) -> Column:
    return F.sqrt(_squares(x, 0, over))


def min_ci(x: Column) -> Column:
    """MIN of text under the default collation; of equal texts the least by code point."""
    return F.min_by(x, F.struct(F.lower(F.rtrim(x)), x))


def max_ci(x: Column) -> Column:
    return F.max_by(x, F.struct(F.lower(F.rtrim(x)), x))


def string_agg(x: Column, separator: str, *order: Column) -> Column:
    """STRING_AGG [WITHIN GROUP (ORDER BY ...)]: nulls are left out, none left gives null."""
    if not order:
        return F.when(F.count(x) > 0, F.listagg(x, F.lit(separator)))
    rows = F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], x.alias("x")))))
    return F.when(F.count(x) > 0, F.array_join(F.transform(rows, lambda r: r["x"]), separator))


def checksum_agg(x: Column) -> Column:
    """CHECKSUM_AGG: exclusive or of the values."""
    return F.bit_xor(x)


def approx_count_distinct(x: Column) -> Column:
    return F.approx_count_distinct(x)


def json_objectagg(key: Column, value: Column, absent_on_null: bool = False) -> Column:
    """JSON_OBJECTAGG; keys in ascending order."""
    rows = F.collect_list(F.when(value.isNotNull() if absent_on_null else F.lit(True), F.struct(key.cast("string"), value)))
    return F.to_json(F.map_from_entries(F.sort_array(rows)), {"ignoreNullFields": str(absent_on_null).lower()})


def json_arrayagg(value: Column, *order: Column) -> Column:
    """JSON_ARRAYAGG: nulls are left out."""
    rows = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("x")))))
    return F.to_json(F.transform(rows, lambda r: r["x"]))


def group_by_all(df: DataFrame, predicate: Column, keys: list[str], aggregates: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """GROUP BY ALL: groups that the predicate leaves without rows stay, with a count of 0 and nulls.

    aggregates: output name to (function, argument); count without an argument counts rows.
    """
    made = []
    for name, (function, x) in aggregates.items():
        value = F.when(predicate, F.lit(1) if x is None else x)
        made.append({"count": count, "count_big": count_big, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[function](value).alias(name))
    return df.groupBy(*keys).agg(*made)


def grouping_sets(df: DataFrame, sets: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """GROUPING SETS over columns; at most 4096 sets of at most 32 columns."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    if len(sets) > 4096:
        raise EngineError(10703, "too many grouping sets")
    if len(columns) > 32:
        raise EngineError(10706, "too many grouping expressions")
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(*aggregates)


def grouping_id(*columns: str) -> Column:
    return F.grouping_id(*columns).cast("int")
