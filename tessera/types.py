"""Type rules: precedence, shapes of decimal results, common types."""

from __future__ import annotations

from pyspark.sql import types as T

MAX = 38
MONEY = T.DecimalType(19, 4)
SMALLMONEY = T.DecimalType(10, 4)
#: From low to high: an operand of a lower type is converted to the higher.
PRECEDENCE = ("char", "varchar", "nchar", "nvarchar", "bit", "tinyint", "smallint", "int", "bigint", "smallmoney", "money", "decimal", "real", "float", "time", "date", "smalldatetime", "datetime", "datetime2", "datetimeoffset")
_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def higher(a: str, b: str) -> str:
    return max(a, b, key=PRECEDENCE.index)


def _fitted(precision: int, scale: int, product: bool) -> T.DecimalType:
    if precision <= MAX:
        return T.DecimalType(precision, scale)
    whole = precision - scale
    if product and whole > MAX - 6:
        scale = min(scale, 6)
    else:
        scale = max(0, min(scale, MAX - whole))
    return T.DecimalType(MAX, scale)


def decimal_result(op: str, a: T.DecimalType, b: T.DecimalType) -> T.DecimalType:
    """Precision and scale of a op b for + - * / %."""
    (p1, s1), (p2, s2) = (a.precision, a.scale), (b.precision, b.scale)
    if op in "+-":
        s = max(s1, s2)
        return _fitted(max(p1 - s1, p2 - s2) + s + 1, s, False)
    if op == "*":
        return _fitted(p1 + p2 + 1, s1 + s2, True)
    if op == "/":
        s = max(6, s1 + p2 + 1)
        return _fitted(p1 - s1 + s2 + s, s, True)
    if op == "%":
        s = max(s1, s2)
        return _fitted(min(p1 - s1, p2 - s2) + s, s, False)
    raise ValueError(op)


def set_operation_decimal(a: T.DecimalType, b: T.DecimalType) -> T.DecimalType:
    """Common type of the branches of a set operation: no digit for a carry."""
    whole = max(a.precision - a.scale, b.precision - b.scale)
    scale = min(max(a.scale, b.scale), MAX - whole)
    return T.DecimalType(whole + scale, scale)


def as_decimal(name: str) -> T.DecimalType:
    return {"smallmoney": SMALLMONEY, "money": MONEY}.get(name) or T.DecimalType(_DIGITS[name], 0)


_SIMPLE = {
    "bit": T.BooleanType(), "tinyint": T.ShortType(), "smallint": T.ShortType(), "int": T.IntegerType(), "integer": T.IntegerType(), "bigint": T.LongType(),
    "real": T.FloatType(), "float": T.DoubleType(), "money": MONEY, "smallmoney": SMALLMONEY, "date": T.DateType(),
    "datetime": T.TimestampNTZType(), "smalldatetime": T.TimestampNTZType(), "datetime2": T.TimestampNTZType(), "uniqueidentifier": T.StringType(),
    "char": T.StringType(), "varchar": T.StringType(), "nchar": T.StringType(), "nvarchar": T.StringType(), "text": T.StringType(), "ntext": T.StringType(), "xml": T.StringType(), "sysname": T.StringType(),
    "binary": T.BinaryType(), "varbinary": T.BinaryType(), "image": T.BinaryType(), "time": T.LongType(),
    "datetimeoffset": T.StructType([T.StructField("utc", T.TimestampNTZType()), T.StructField("offset_min", T.ShortType())]),
}


def spark_type(name: str, *args: int) -> T.DataType:
    """The Spark type that stores a type of the dialect."""
    name = name.lower()
    if name in ("decimal", "numeric", "dec"):
        return T.DecimalType(*(args or (18, 0)))
    if name == "float" and args and args[0] <= 24:
        return T.FloatType()
    return _SIMPLE[name]


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """Type of two branches of CASE, COALESCE, VALUES or a set operation; a string takes the other's type."""
    if a == b:
        return a
    if isinstance(a, T.NullType) or (isinstance(a, T.StringType) and not isinstance(b, T.NullType)):
        return b
    if isinstance(b, (T.NullType, T.StringType)):
        return a
    whole = {T.ShortType: T.DecimalType(5, 0), T.IntegerType: T.DecimalType(10, 0), T.LongType: T.DecimalType(19, 0), T.ByteType: T.DecimalType(3, 0)}
    order = [T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType, T.DateType, T.TimestampNTZType, T.TimestampType]
    if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
        x, y = whole.get(type(a), a), whole.get(type(b), b)
        if isinstance(x, T.DecimalType) and isinstance(y, T.DecimalType):
            return set_operation_decimal(x, y)
    return max(a, b, key=lambda t: order.index(type(t)))
