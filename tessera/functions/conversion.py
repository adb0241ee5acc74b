"""CASE, COALESCE, ISNULL and conversions, with and without style."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.functions.strings import ansi, from_ansi


def iif(condition: Column, yes: Column | object, no: Column | object) -> Column:
    return F.when(condition, yes).otherwise(no)


def choose(index: Column, *values: Column | object) -> Column:
    """CHOOSE: counted from 1, null outside."""
    return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (index - 1).cast("int"))


def isnull(x: Column, other: Column | object, kind: str) -> Column:
    """ISNULL: has the type of its first argument."""
    return F.coalesce(x.cast(kind), (other if isinstance(other, Column) else F.lit(other)).cast(kind))


def coalesce(*xs: Column, kind: str) -> Column:
    return F.coalesce(*[x.cast(kind) for x in xs])


def nullif(a: Column, b: Column | object) -> Column:
    return F.nullif(a, b if isinstance(b, Column) else F.lit(b))


def to_int(x: Column, kind: str = "int") -> Column:
    """CAST of a number to an integer type: cut toward zero, error outside its range."""
    if kind == "tinyint":
        n = x.cast("int")
        return F.when((n < 0) | (n > 255), F.raise_error(F.lit("tessera-error-8115: arithmetic overflow converting to tinyint"))).otherwise(n.cast("smallint"))
    return x.cast({"smallint": "smallint", "int": "int", "bigint": "bigint"}[kind])


def text_to_int(x: Column, kind: str = "int") -> Column:
    """CAST of text to an integer type: blank text is 0, a fraction is an error."""
    t = F.trim(x)
    return F.when(t == "", F.lit(0)).otherwise(t).cast(kind)


def try_cast(x: Column, kind: str) -> Column:
    return x.try_cast(kind)


def to_bit(x: Column) -> Column:
    """CAST to BIT: zero or not; the words true and false of text."""
    return x.cast("double") != 0


def to_varchar(x: Column, n: int = 30, family: str = "number") -> Column:
    """CAST to VARCHAR(n): text is cut; an integer that is too wide gives a star."""
    text = x.cast("string")
    if family == "int":
        return F.when(F.length(text) > n, F.lit("*")).otherwise(text)
    return F.substring(text, 1, n)


def to_char(x: Column, n: int = 30) -> Column:
    """CAST to CHAR(n): cut or padded."""
    return F.rpad(x.cast("string"), n, " ")


def money_text(x: Column, style: int = 0) -> Column:
    """CONVERT of money to text: 0 two places, 1 with commas, 2 four places."""
    if style == 2:
        return x.cast("decimal(19,4)").cast("string")
    text = F.format_number(F.round(F.abs(x), 2), 2)
    text = F.when(x < 0, F.concat(F.lit("-"), text)).otherwise(text)  # the sign stays where two places show none of the amount
    return text if style == 1 else F.replace(text, F.lit(","), F.lit(""))


def float_money_text(x: Column, style: int = 0) -> Column:
    """money_text of a float as it stands, not rounded to money first: its exact binary value at the style's places, a half
    to even; a negative zero and a negative nan keep their sign.

    Built-in formatting goes by a double's shortest digits, which give other last places.
    """
    form = {1: ",.2f", 2: ".4f"}.get(style, ".2f")

    def text(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else "-nan" if v != v and math.copysign(1, v) < 0 else format(v, form) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(text, "string")(x)


def binary_text(x: Column, style: int = 0) -> Column:
    """CONVERT of binary to text: 1 with 0x, 2 without; else the bytes as characters."""
    if style == 1:
        return F.concat(F.lit("0x"), F.hex(x))
    if style == 2:
        return F.hex(x)
    return from_ansi(x)


def text_binary(x: Column, style: int = 0) -> Column:
    if style == 1:
        return F.unhex(F.substring(x, F.lit(3), F.length(x)))
    if style == 2:
        return F.unhex(x)
    return ansi(x)


def float_text(x: Column, style: int = 0) -> Column:
    """CONVERT of float to text: 1 eight digits, 2 sixteen digits, in scientific notation; 0 six significant digits."""
    if style in (1, 2):
        digits = 7 if style == 1 else 15
        raw = F.format_string(f"%.{digits}e", x.cast("double"))
        return F.regexp_replace(raw, r"e([+-])(\d\d)$", "e$10$2")
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6g", x.cast("double")), r"(\.\d*?)0+$", "$1"), r"\.$", "")


#: Date and time patterns of CONVERT styles.
STYLES = {
    0: "MMM ppd yyyy pph:mma", 100: "MMM ppd yyyy pph:mma", 1: "MM/dd/yy", 101: "MM/dd/yyyy", 2: "yy.MM.dd", 102: "yyyy.MM.dd", 3: "dd/MM/yy", 103: "dd/MM/yyyy", 4: "dd.MM.yy", 104: "dd.MM.yyyy",
    5: "dd-MM-yy", 105: "dd-MM-yyyy", 6: "dd MMM yy", 106: "dd MMM yyyy", 7: "MMM dd, yy", 107: "MMM dd, yyyy", 8: "HH:mm:ss", 108: "HH:mm:ss", 24: "HH:mm:ss", 10: "MM-dd-yy", 110: "MM-dd-yyyy",
    11: "yy/MM/dd", 111: "yyyy/MM/dd", 12: "yyMMdd", 112: "yyyyMMdd", 13: "dd MMM yyyy HH:mm:ss:SSS", 113: "dd MMM yyyy HH:mm:ss:SSS", 14: "HH:mm:ss:SSS", 114: "HH:mm:ss:SSS",
    20: "yyyy-MM-dd HH:mm:ss", 120: "yyyy-MM-dd HH:mm:ss", 21: "yyyy-MM-dd HH:mm:ss.SSS", 25: "yyyy-MM-dd HH:mm:ss.SSS", 121: "yyyy-MM-dd HH:mm:ss.SSS", 23: "yyyy-MM-dd", 126: "yyyy-MM-dd'T'HH:mm:ss", 127: "yyyy-MM-dd'T'HH:mm:ss",
}


def date_text(x: Column, style: int = 0) -> Column:
    """CONVERT of a date or time to text."""
    if style not in STYLES:
        raise EngineError(281, f"{style} is not a valid style for text")
    pattern = STYLES[style]
    if "pp" in pattern:  # numbers padded by spaces to two places
        return F.concat(F.date_format(x, "MMM "), F.lpad(F.date_format(x, "d"), 2, " "), F.date_format(x, " yyyy "), F.lpad(F.date_format(x, "h"), 2, " "), F.date_format(x, ":mma"))
    if style in (126, 127):
        fraction = F.date_format(x, ".SSS")
        return F.concat(F.date_format(x, pattern), F.when(fraction == ".000", "").otherwise(fraction))
    return F.date_format(x, pattern)


def text_date(x: Column, style: int = 120, try_: bool = False) -> Column:
    """CONVERT of text to a date and time by the style's pattern."""
    if style not in STYLES or "pp" in STYLES[style]:
        raise EngineError(281, f"{style} is not a valid style for text")
    pattern = STYLES[style]
    return F.try_to_timestamp(x, F.lit(pattern)).cast("timestamp_ntz") if try_ else F.to_timestamp_ntz(x, F.lit(pattern))


def guid(x: Column, try_: bool = False) -> Column:
    """CAST of text to UNIQUEIDENTIFIER, in capitals; error 8169 if it isn't one."""
    good = x.rlike(r"^\{?[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\}?")
    value = F.upper(F.regexp_extract(x, r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", 0))
    return F.when(x.isNull(), F.lit(None).cast("string")).when(good, value).otherwise(F.lit(None).cast("string") if try_ else F.raise_error(F.lit("tessera-error-8169: conversion to uniqueidentifier failed")))


def guid_key(x: Column) -> Column:
    """Sort key of a uniqueidentifier: its last group first, the first three groups by their bytes in reverse."""
    part = lambda a, n: F.substring(x, a, n)
    swap = lambda a, n: F.concat(*[part(a + n - 2 - i, 2) for i in range(0, n, 2)])
    return F.concat(part(25, 12), part(20, 4), swap(15, 4), swap(10, 4), swap(1, 8))


def isnumeric(x: Column) -> Column:
    return F.when(F.trim(x).try_cast("double").isNotNull(), 1).otherwise(0)


def isdate(x: Column) -> Column:
    return F.when(F.try_to_timestamp(x).isNotNull(), 1).otherwise(0)


def format_number(x: Column, spec: str) -> Column:
    """FORMAT of a number: N, F, C, P, D, X, E with places, or a custom mask of 0 # , and a point; null for a bad one."""
    kind, places = spec[:1].upper(), spec[1:]
    if spec and kind in "NFCPDXE" and (places == "" or places.isdigit()):
        n = int(places) if places else {"N": 2, "F": 2, "C": 2, "P": 2, "D": 0, "X": 0, "E": 6}[kind]
        if kind == "N":
            return F.format_number(F.round(x, n), n)
        if kind == "F":
            return F.replace(F.format_number(F.round(x, n), n), F.lit(","), F.lit(""))
        if kind == "C":
            text = F.concat(F.lit("$"), F.format_number(F.round(F.abs(x), n), n))
            return F.when(x < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)
        if kind == "P":
            return F.concat(F.format_number(F.round(x * 100, n), n), F.lit("%"))
        if kind == "D":
            return F.when(x < 0, F.concat(F.lit("-"), F.lpad(F.abs(x).cast("string"), max(n, 1), "0") if n else F.abs(x).cast("string"))).otherwise(F.when(F.length(x.cast("string")) < n, F.lpad(x.cast("string"), n, "0")).otherwise(x.cast("string")))
        if kind == "X":
            return F.when(F.length(F.hex(x.cast("long"))) < n, F.lpad(F.hex(x.cast("long")), n, "0")).otherwise(F.hex(x.cast("long")))
        return F.regexp_replace(F.format_string(f"%.{n}E", x.cast("double")), r"E([+-])(\d\d)$", "E$10$2")
    if spec and all(c in "0#,." for c in spec):
        whole, _, fraction = spec.partition(".")
        text = F.format_number(F.round(x, len(fraction)), len(fraction))
        text = text if "," in whole else F.replace(text, F.lit(","), F.lit(""))
        least = whole.count("0")
        if "," not in whole and least > 1:
            point = len(fraction) + 1 if fraction else 0
            text = F.when(F.length(text) < least + point, F.lpad(text, least + point, "0")).otherwise(text)
        optional = len(fraction) - len(fraction.rstrip("#"))
        for _ in range(optional):
            text = F.regexp_replace(text, r"(\.\d*)0$", "$1")
        return F.regexp_replace(text, r"\.$", "") if optional else text
    return F.lit(None).cast("string")


#: Custom date letters that differ between the two pattern languages.
_DATE_TOKENS = (("dddd", "EEEE"), ("ddd", "EEE"), ("tt", "a"), ("fff", "SSS"), ("ff", "SS"), ("f", "S"))
_DATE_STANDARD = {"d": "M/d/yyyy", "D": "EEEE, MMMM d, yyyy", "t": "h:mm a", "T": "h:mm:ss a", "g": "M/d/yyyy h:mm a", "G": "M/d/yyyy h:mm:ss a", "M": "MMMM d", "Y": "MMMM yyyy", "s": "yyyy-MM-dd'T'HH:mm:ss", "u": "yyyy-MM-dd HH:mm:ss'Z'", "R": "EEE, dd MMM yyyy HH:mm:ss 'GMT'"}


def format_date(x: Column, spec: str) -> Column:
    """FORMAT of a date: a standard letter or a custom pattern."""
    if len(spec) == 1:
        return F.date_format(x, _DATE_STANDARD[spec]) if spec in _DATE_STANDARD else F.lit(None).cast("string")
    for old, new in _DATE_TOKENS:
        spec = spec.replace(old, new)
    return F.date_format(x, spec)
