"""Errors with the dialect's numbers."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.errors import PySparkException


class EngineError(Exception):
    """An error that a query of the dialect raises."""

    def __init__(self, number: int, message: str, severity: int = 16, state: int = 1) -> None:
        super().__init__(f"{number}: {message}")
        self.number, self.message, self.severity, self.state = number, message, severity, state


#: Spark's error conditions and the numbers that the dialect has for them.
NUMBERS = {
    "DIVIDE_BY_ZERO": 8134,
    "REMAINDER_BY_ZERO": 8134,
    "ARITHMETIC_OVERFLOW": 8115,
    "CAST_OVERFLOW": 8115,
    "CAST_OVERFLOW_IN_TABLE_INSERT": 8115,
    "BINARY_ARITHMETIC_OVERFLOW": 8115,
    "NUMERIC_VALUE_OUT_OF_RANGE": 8115,
    "CAST_INVALID_INPUT": 245,
    "DATETIME_OVERFLOW": 517,
    "DATETIME_FIELD_OUT_OF_BOUNDS": 289,
    "RECURSION_LEVEL_LIMIT_EXCEEDED": 530,
    "UNRESOLVED_COLUMN": 207,
    "TABLE_OR_VIEW_NOT_FOUND": 208,
    "UNRESOLVED_ROUTINE": 195,
    "SCALAR_SUBQUERY_TOO_MANY_ROWS": 512,
    "PARSE_SYNTAX_ERROR": 102,
}


def number_of(error: Exception) -> int:
    """The dialect's number for an error; 50000 if it has none of its own."""
    if isinstance(error, EngineError):
        return error.number
    text = str(error)
    condition = (error.getCondition() or "").split(".")[0] if isinstance(error, PySparkException) else ""
    if condition in NUMBERS:
        return NUMBERS[condition]
    if "tessera-error-" in text:
        return int(text.split("tessera-error-")[1].split(":")[0])
    return next((n for name, n in NUMBERS.items() if f"[{name}" in text), 50000)


@contextlib.contextmanager
def translated() -> Iterator[None]:
    """Spark's errors come out as EngineError."""
    try:
        yield
    except EngineError:
        raise
    except Exception as e:
        raise EngineError(number_of(e), str(e).splitlines()[0]) from e
