"""String functions with the dialect's rules: lengths in UTF-16 units, trailing spaces, widths, patterns."""

from __future__ import annotations

import gzip
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import EngineError

CI = "UTF8_LCASE_RTRIM"
_BYTES = 8000


def _c(x: Column | str | int | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def error(number: int, message: str) -> Column:
    """Raises when it is evaluated."""
    return F.raise_error(F.lit(f"tessera-error-{number}: {message}"))


def units(x: Column) -> Column:
    """Length in UTF-16 units."""
    return F.shiftright(F.octet_length(F.encode(x, "UTF-16LE")), 1)


def len_(x: Column) -> Column:
    """LEN: without trailing spaces."""
    return units(F.rtrim(x))


def datalength(x: Column, family: str = "nvarchar") -> Column:
    """DATALENGTH in bytes: two for each unit of national text, one for each character of the single-byte code page."""
    if family in ("nvarchar", "nchar"):
        return F.octet_length(F.encode(x, "UTF-16LE"))
    if family in ("varchar", "char"):
        return F.char_length(x)
    return F.octet_length(x)


def left(x: Column, n: Column | int) -> Column:
    n = _c(n)
    return F.when(n < 0, error(536, "invalid length for left")).otherwise(F.substring(x, F.lit(1), n))


def right(x: Column, n: Column | int) -> Column:
    n = _c(n)
    return F.when(n < 0, error(536, "invalid length for right")).otherwise(F.when(n == 0, F.lit("")).otherwise(F.substring(x, F.greatest(F.char_length(x) - n + 1, F.lit(1)), n)))


def substring(x: Column, start: Column | int, n: Column | int) -> Column:
    """SUBSTRING: a start below 1 uses up length."""
    start, n = _c(start), _c(n)
    end = start + n
    begin = F.greatest(start, F.lit(1))
    return F.when(n < 0, error(537, "invalid length for substring")).otherwise(F.when(end <= begin, F.when(x.isNotNull(), F.lit(""))).otherwise(F.substring(x, begin, end - begin)))


def ltrim(x: Column, chars: str = " ") -> Column:
    return F.ltrim(x, F.lit(chars))


def rtrim(x: Column, chars: str = " ") -> Column:
    return F.rtrim(x, F.lit(chars))


def trim(x: Column, chars: str = " ", side: str = "both") -> Column:
    return {"both": F.btrim, "leading": F.ltrim, "trailing": F.rtrim}[side](x, F.lit(chars))


def upper(x: Column) -> Column:
    """UPPER: one unit for each, so that what would grow (the sharp s) stays."""
    return F.when(x.contains("ß"), F.replace(F.upper(F.replace(x, F.lit("ß"), F.lit(""))), F.lit(""), F.lit("ß"))).otherwise(F.upper(x))


def lower(x: Column) -> Column:
    return F.lower(x)


def replicate(x: Column, n: Column | int) -> Column:
    """REPLICATE: null below 0, whole copies within 8000 bytes."""
    n = _c(n)
    fits = F.when(F.octet_length(x) == 0, n).otherwise(F.least(n, F.floor(F.lit(_BYTES) / F.octet_length(x)).cast("int")))
    return F.when(n < 0, F.lit(None).cast("string")).otherwise(F.repeat(x, fits.cast("int")))


def space(n: Column | int) -> Column:
    n = _c(n)
    return F.when(n < 0, F.lit(None).cast("string")).otherwise(F.repeat(F.lit(" "), F.least(n, F.lit(_BYTES)).cast("int")))


#: Code points of bytes 128 to 159 of the Windows Latin code page (undefined ones map to themselves).
CP1252 = (0x20AC, 0x81, 0x201A, 0x0192, 0x201E, 0x2026, 0x2020, 0x2021, 0x02C6, 0x2030, 0x0160, 0x2039, 0x0152, 0x8D, 0x017D, 0x8F, 0x90, 0x2018, 0x2019, 0x201C, 0x201D, 0x2022, 0x2013, 0x2014, 0x02DC, 0x2122, 0x0161, 0x203A, 0x0153, 0x9D, 0x017E, 0x0178)


_SPECIAL, _PLAIN = "".join(map(chr, CP1252)), "".join(map(chr, range(128, 160)))


def ansi(x: Column) -> Column:
    """The text's bytes in the code page."""
    return F.encode(F.translate(x, _SPECIAL, _PLAIN), "ISO-8859-1")


def from_ansi(x: Column) -> Column:
    """Text of bytes in the code page."""
    return F.translate(F.decode(x, "ISO-8859-1"), _PLAIN, _SPECIAL)


def char(n: Column) -> Column:
    """CHAR: the character of a byte of the code page, null outside 0 to 255."""
    table = F.array(*[F.lit(chr(c)) for c in CP1252])
    return F.when((n < 0) | (n > 255) | n.isNull(), F.lit(None).cast("string")).when(n.between(128, 159), F.get(table, (n - 128).cast("int"))).when(n == 0, F.lit("\0")).otherwise(F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 4, "0")), "UTF-16BE"))


def nchar(n: Column) -> Column:
    """NCHAR: the character of a code point of the basic plane, null outside it."""
    return F.when((n >= 0) & (n <= 65535), F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 4, "0")), "UTF-16BE"))


def unicode(x: Column) -> Column:
    """UNICODE: value of the first UTF-16 unit, null for the empty string."""
    return F.when(F.char_length(x) > 0, F.conv(F.hex(F.encode(F.substring(x, 1, 1), "UTF-16BE")).substr(1, 4), 16, 10).cast("int"))


def ascii(x: Column) -> Column:
    return F.when(F.char_length(x) > 0, F.ascii(x))


def concat(*xs: Column | str) -> Column:
    """CONCAT: null counts as the empty string."""
    return F.concat(*[F.coalesce(_c(x).cast("string"), F.lit("")) for x in xs])


def plus(*xs: Column | str) -> Column:
    """The + of strings: null if any is null."""
    return F.concat(*[_c(x) for x in xs])


def concat_ws(separator: str, *xs: Column | str) -> Column:
    """CONCAT_WS: nulls are left out, a null separator is the empty string."""
    if len(xs) < 2:
        raise EngineError(189, "concat_ws needs at least three arguments")
    return F.concat_ws(separator or "", *[_c(x).cast("string") for x in xs])


def translate(x: Column, chars: str, to: str) -> Column:
    if len(chars) != len(to):
        raise EngineError(9828, "the second and third arguments of translate differ in length")
    return F.translate(x, chars, to)


def replace(x: Column, old: Column | str, new: Column | str) -> Column:
    return F.when(F.char_length(_c(old)) == 0, x).otherwise(F.replace(x, _c(old), _c(new)))


def replace_ci(x: Column, old: str, new: str) -> Column:
    """REPLACE under the default collation, which ignores case."""
    return F.regexp_replace(x, F.lit("(?iu)" + java_quote(old)), F.lit(new.replace("\\", "\\\\").replace("$", "\\$")))


def stuff(x: Column, start: int, length: int, new: Column | str) -> Column:
    """STUFF: null outside the string or for a negative length."""
    if start <= 0 or length < 0:
        return F.lit(None).cast("string")
    new = F.coalesce(_c(new), F.lit(""))
    return F.when(F.char_length(x) >= start, F.concat(F.substring(x, F.lit(1), F.lit(start - 1)), new, F.substring(x, F.lit(start + length), F.char_length(x))))


def str_(x: Column, length: int = 10, decimals: int = 0) -> Column:
    """STR: right-aligned decimal text; stars if it is too wide."""
    text = F.format_string(f"%.{decimals}f", F.round(x.cast("double"), decimals))
    return F.when(F.length(text) > length, F.repeat(F.lit("*"), length)).otherwise(F.lpad(text, length, " "))


def charindex(sub: Column | str, x: Column, start: int = 1) -> Column:
    """CHARINDEX, ignoring case; 0 if absent."""
    return F.when(F.char_length(_c(sub)) == 0, F.lit(0)).otherwise(F.call_function("locate", F.lower(_c(sub)), F.lower(x), F.lit(max(start, 1))))


def java_quote(text: str) -> str:
    """A regular expression for the text itself."""
    return re.sub(r"([\\.\[\]{}()*+?^$|#&~-])", r"\\\1", text)


def like_regex(pattern: str, escape: str | None = None) -> str:
    """Java regular expression of a LIKE pattern with %, _, [set] and [^set]."""
    if escape is not None and len(escape) != 1:
        raise EngineError(506, "invalid escape character")
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            out.append(java_quote(pattern[i + 1]))
            i += 2
            continue
        if c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 2 if pattern[i + 1 : i + 2] != "^" else i + 3)) > 0:
            body = pattern[i + 1 : end]
            negated, body = body[:1] == "^", body.removeprefix("^")
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]^&~])", r"\\\1", body) + "]")
            i = end
        else:
            out.append(java_quote(c))
        i += 1
    return "".join(out)


def like(x: Column, pattern: str, escape: str | None = None, case_sensitive: bool = False) -> Column:
    """LIKE: ignores case by default; trailing spaces of the pattern count."""
    return x.rlike(f"(?s{'' if case_sensitive else 'iu'})\\A{like_regex(pattern, escape)}\\z")


def patindex(pattern: str, x: Column) -> Column:
    """PATINDEX: place of the first match of a %pattern%, 0 if there is none."""
    head, tail = pattern.startswith("%"), pattern.endswith("%")
    core = like_regex(pattern[head : len(pattern) - tail if tail else None])
    regex = f"(?siu){'' if head else chr(92) + 'A'}({core}){'' if tail else chr(92) + 'z'}"
    found = F.regexp_extract(x, "(?siu)" + ("\\A(.*?)" if head else "\\A()") + f"(?:{core})" + ("" if tail else "\\z"), 1)
    return F.when(x.isNull(), F.lit(None).cast("int")).when(x.rlike(regex), F.char_length(found) + 1).otherwise(F.lit(0))


def string_escape_json(x: Column) -> Column:
    """STRING_ESCAPE(x, 'json')."""
    out = x
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("/", "\\/"), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(old), F.lit(new))
    for code in [*range(8), 11, *range(14, 32)]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return out


def quotename(x: Column, quote: str = "[") -> Column:
    """QUOTENAME: null for more than 128 units or an unknown delimiter."""
    ends = {"[": "[]", "]": "[]", "'": "''", '"': '""', "(": "()", ")": "()", "<": "<>", ">": "<>", "{": "{}", "}": "{}", "`": "``"}
    if quote not in ends:
        return F.lit(None).cast("string")
    begin, end = ends[quote]
    return F.when(units(x) <= 128, F.concat(F.lit(begin), F.replace(x, F.lit(end), F.lit(end * 2)), F.lit(end)))


def soundex(x: Column) -> Column:
    """SOUNDEX: four characters; text that doesn't begin with a letter gives 0000."""
    return F.when(x.rlike("^[A-Za-z]"), F.soundex(F.regexp_extract(x, "^[A-Za-z]+", 0))).otherwise(F.when(x.isNotNull(), F.lit("0000")))


def difference(a: Column, b: Column) -> Column:
    """DIFFERENCE: how many places of two SOUNDEX codes agree."""
    x, y = soundex(a), soundex(b)
    return sum((F.substring(x, i, 1) == F.substring(y, i, 1)).cast("int") for i in range(2, 5)) + (F.substring(x, 1, 1) == F.substring(y, 1, 1)).cast("int")


def compress(x: Column) -> Column:
    """COMPRESS: GZIP of the bytes; text is taken as UTF-16 little-endian. The header's time is 0, so equal input gives equal bytes."""

    def packed(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else gzip.compress(v.encode("utf-16-le") if isinstance(v, str) else bytes(v), mtime=0) for v in values], dtype=object)

    return F.pandas_udf(packed, "binary")(x)


def decompress(x: Column) -> Column:
    """DECOMPRESS: the bytes of a GZIP; null for a null."""

    def unpacked(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else gzip.decompress(bytes(v)) for v in values], dtype=object)

    return F.pandas_udf(unpacked, "binary")(x)


def hashbytes(algorithm: str, x: Column, national: bool = True) -> Column:
    """HASHBYTES of the text's bytes; null for an unknown algorithm."""
    data = F.encode(x, "UTF-16LE") if national else ansi(x)
    name = algorithm.upper()
    if name == "MD5":
        return F.unhex(F.md5(data))
    if name in ("SHA", "SHA1"):
        return F.unhex(F.sha1(data))
    if name in ("SHA2_256", "SHA2_512"):
        return F.unhex(F.sha2(data, int(name[-3:])))
    return F.lit(None).cast("binary")


def ci(x: Column) -> Column:
    """The column under the default collation: case and trailing spaces don't count."""
    return F.collate(x, CI)


def collation(name: str) -> str:
    """Spark collation of a collation name of the dialect."""
    parts = name.upper().split("_")
    if "BIN2" in parts or "BIN" in parts:
        return "UTF8_BINARY_RTRIM"
    if "CS" in parts:
        return "UNICODE_RTRIM" if "AI" not in parts else "UNICODE_AI_RTRIM"
    if "CI" in parts:
        return "UNICODE_CI_AI_RTRIM" if "AI" in parts else CI
    raise EngineError(448, f"invalid collation {name}")


def collate(x: Column, name: str) -> Column:
    return F.collate(x, collation(name))
