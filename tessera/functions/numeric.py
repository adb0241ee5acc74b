"""Arithmetic with the dialect's result types: truncating division, exact decimals and money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.types import MONEY, decimal_result


def int_div(a: Column, b: Column, kind: str = "int") -> Column:
    """Integer / : toward zero, error on zero."""
    a, b = a.cast("long"), b.cast("long")
    return F.call_function("div", a, b).cast(kind)


def int_mod(a: Column, b: Column, kind: str = "int") -> Column:
    """Integer % : sign of the dividend."""
    return (a.cast("long") % b.cast("long")).cast(kind)


def truncate(x: Column, scale: int) -> Column:
    """A decimal cut toward zero at a scale."""
    return F.when(x < 0, F.ceil(x, F.lit(scale))).otherwise(F.floor(x, F.lit(scale)))


def decimal_div(a: Column, b: Column, left: T.DecimalType, right: T.DecimalType) -> Column:
    """Decimal / : exact, cut toward zero at the result's scale.

    Spark rounds the last digit; the quotient of the dividend less its remainder (at the result's scale) is exact.
    """
    out = decimal_result("/", left, right)
    a, b = a.cast(left), b.cast(right)
    quotient = (a / b).cast(T.DecimalType(min(out.precision, 37), out.scale))
    step = F.lit(f"1e-{out.scale}").cast(T.DecimalType(out.scale + 1, out.scale))
    over = F.abs(quotient * b) > F.abs(a)
    return F.when(over, quotient - F.when(quotient < 0, -step).otherwise(step)).otherwise(quotient).cast(out)


def decimal_add(a: Column, b: Column, left: T.DecimalType, right: T.DecimalType) -> Column:
    return (a.cast(left) + b.cast(right)).cast(decimal_result("+", left, right))


def decimal_mul(a: Column, b: Column, left: T.DecimalType, right: T.DecimalType) -> Column:
    return (a.cast(left) * b.cast(right)).cast(decimal_result("*", left, right))


def money(x: Column) -> Column:
    """Conversion to MONEY: rounded at four places, error outside its range."""
    return F.round(x.cast("decimal(38,10)"), 4).cast(MONEY)


def money_mul(a: Column, b: Column) -> Column:
    """MONEY times MONEY, rounded at four places."""
    return F.round(a.cast(MONEY).cast("decimal(19,4)") * b.cast(MONEY), 4).cast(MONEY)


def money_div(a: Column, b: Column) -> Column:
    """MONEY by MONEY, cut at four places."""
    return truncate(a.cast(MONEY).cast("decimal(25,4)") / b.cast("decimal(12,4)"), 4).cast(MONEY)


def negate(x: Column) -> Column:
    """Unary minus; a tinyint, stored wider, turns smallint."""
    return -x


def abs_(x: Column, kind: str | None = None) -> Column:
    """ABS: narrow integers give int, the least integer is an error."""
    return F.abs(x if kind is None else x.cast(kind))


def ceiling(x: Column) -> Column:
    return F.ceil(x)


def floor(x: Column) -> Column:
    return F.floor(x)


def sign(x: Column, kind: str = "int") -> Column:
    """SIGN keeps the type of its argument."""
    return F.signum(x).cast(kind)


def round_(x: Column, places: int, truncate_: bool = False) -> Column:
    """ROUND half away from zero, or cut with a third argument other than 0."""
    return truncate(x, places) if truncate_ else F.round(x, places)


def log(x: Column, base: float | None = None) -> Column:
    """LOG(x[, base])."""
    return F.log(x) if base is None else F.log(x) / F.log(F.lit(float(base)))


def square(x: Column) -> Column:
    return x.cast("double") * x.cast("double")


def cot(x: Column) -> Column:
    return F.lit(1.0) / F.tan(x)


def bit_and(a: Column, b: Column | int) -> Column:
    return a.bitwiseAND(b)


def bit_or(a: Column, b: Column | int) -> Column:
    return a.bitwiseOR(b)


def bit_xor(a: Column, b: Column | int) -> Column:
    return a.bitwiseXOR(b)


def bit_not(a: Column) -> Column:
    return F.bitwise_not(a)


def greatest(*xs: Column) -> Column:
    """GREATEST: nulls are left out."""
    return F.greatest(*xs)


def least(*xs: Column) -> Column:
    return F.least(*xs)


def newid() -> Column:
    """NEWID: random, in capitals."""
    return F.upper(F.uuid())


class Rand:
    """RAND: one value for a whole statement, from a seeded stream of two multiplicative generators."""

    #: The multipliers and moduli of the combined generator of L'Ecuyer (1988), the second state and the
    #: first one of a seed out of range, and the factor (the reciprocal of the first modulus to seven digits).
    A = (40014, 2147483563)
    B = (40692, 2147483399)
    SECOND, OTHERWISE, FACTOR = 67890, 12345, 4.656613e-10

    def __init__(self, seed: int = 1) -> None:
        self.seed(seed)

    def seed(self, seed: int) -> None:
        self.a, self.b = abs(seed) if 0 < abs(seed) < self.A[1] else self.OTHERWISE, self.SECOND

    def next(self) -> float:
        self.a = self.a * self.A[0] % self.A[1]
        self.b = self.b * self.B[0] % self.B[1]
        z = self.a - self.b
        return (z if z > 0 else z + self.A[1] - 1) * self.FACTOR

    def column(self, seed: int | None = None) -> Column:
        if seed is not None:
            self.seed(seed)
        return F.lit(self.next())
