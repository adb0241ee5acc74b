"""Window functions: typed rankings, value windows, percentiles, frames and named windows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.errors import EngineError


def row_number(w: WindowSpec) -> Column:
    return F.row_number().over(w).cast("long")


def rank(w: WindowSpec) -> Column:
    return F.rank().over(w).cast("long")


def dense_rank(w: WindowSpec) -> Column:
    return F.dense_rank().over(w).cast("long")


def ntile(n: int, w: WindowSpec) -> Column:
    if not isinstance(n, int) or n <= 0:
        raise EngineError(4116, "ntile takes a positive integer")
    return F.ntile(n).over(w).cast("long")


def percent_rank(w: WindowSpec) -> Column:
    return F.percent_rank().over(w)


def cume_dist(w: WindowSpec) -> Column:
    return F.cume_dist().over(w)


def lag(x: Column, w: WindowSpec, offset: int = 1, default: object = None) -> Column:
    if offset < 0:
        raise EngineError(8730, "the offset of lag cannot be negative")
    return F.lag(x, offset, default).over(w)


def lead(x: Column, w: WindowSpec, offset: int = 1, default: object = None) -> Column:
    if offset < 0:
        raise EngineError(8730, "the offset of lead cannot be negative")
    return F.lead(x, offset, default).over(w)


def first_value(x: Column, w: WindowSpec, ignore_nulls: bool = False) -> Column:
    return F.first(x, ignorenulls=ignore_nulls).over(w)


def last_value(x: Column, w: WindowSpec, ignore_nulls: bool = False) -> Column:
    return F.last(x, ignorenulls=ignore_nulls).over(w)


def _fraction(p: float) -> float:
    if not 0 <= p <= 1:
        raise EngineError(8727, "the fraction must be between 0 and 1")
    return p


def percentile_cont(p: float, x: str, partition: list[str], descending: bool = False) -> Column:
    """PERCENTILE_CONT(p) WITHIN GROUP (ORDER BY x) OVER (PARTITION BY ...)."""
    keys = ", ".join(f"`{k}`" for k in partition)
    return F.expr(f"percentile_cont({_fraction(p)}) WITHIN GROUP (ORDER BY `{x}`{' DESC' * descending}) OVER ({f'PARTITION BY {keys}' if keys else ''})")


def percentile_disc(p: float, x: str, partition: list[str], descending: bool = False) -> Column:
    keys = ", ".join(f"`{k}`" for k in partition)
    return F.expr(f"percentile_disc({_fraction(p)}) WITHIN GROUP (ORDER BY `{x}`{' DESC' * descending}) OVER ({f'PARTITION BY {keys}' if keys else ''})")


def frame(w: WindowSpec, unit: str, start: int | None, end: int | None) -> WindowSpec:
    """ROWS or RANGE between two places: None is unbounded, 0 the current row; RANGE takes no numbers."""
    if unit == "range" and any(b not in (None, 0) for b in (start, end)):
        raise EngineError(4194, "RANGE is only supported with UNBOUNDED and CURRENT ROW")
    lo = Window.unboundedPreceding if start is None else start
    hi = Window.unboundedFollowing if end is None else end
    if lo > hi:
        raise EngineError(4193, "the frame ends before it starts")
    return w.rowsBetween(lo, hi) if unit == "rows" else w.rangeBetween(lo, hi)


@dataclass
class Named:
    """A definition of a WINDOW clause; base is the window that it extends."""

    base: str | None = None
    partition: list[Column | str] = field(default_factory=list)
    order: list[Column | str] = field(default_factory=list)
    frame: tuple[str, int | None, int | None] | None = None


def named_windows(definitions: dict[str, Named]) -> dict[str, WindowSpec]:
    """The specifications of a WINDOW clause; errors 4123 for cycles, unknown names and what is defined twice."""

    def resolved(name: str, seen: tuple[str, ...]) -> Named:
        if name in seen or name not in definitions:
            raise EngineError(4123, f"window {name} is undefined or refers to itself")
        own = definitions[name]
        if own.base is None:
            return own
        base = resolved(own.base, (*seen, name))
        if base.frame or (own.partition and base.partition) or (own.order and base.order):
            raise EngineError(4123, f"window {name} defines again what its base has")
        return Named(None, own.partition or base.partition, own.order or base.order, own.frame)

    out = {}
    for name in definitions:
        d = resolved(name, ())
        w = Window.partitionBy(*d.partition)
        w = w.orderBy(*d.order) if d.order else w
        out[name] = frame(w, *d.frame) if d.frame else w
    return out
