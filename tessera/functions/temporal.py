"""Dates and times: boundaries, parts with a first day of the week, offsets and buckets.

datetime2 is TIMESTAMP_NTZ (microseconds), time is a bigint of 100-nanosecond ticks since midnight, datetimeoffset
is a struct of the UTC instant and the offset in minutes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import EngineError

#: Names and abbreviations of date parts.
PARTS = {
    "year": "year", "yy": "year", "yyyy": "year", "quarter": "quarter", "qq": "quarter", "q": "quarter", "month": "month", "mm": "month", "m": "month",
    "dayofyear": "dayofyear", "dy": "dayofyear", "y": "dayofyear", "day": "day", "dd": "day", "d": "day", "week": "week", "wk": "week", "ww": "week",
    "weekday": "weekday", "dw": "weekday", "iso_week": "iso_week", "isowk": "iso_week", "isoww": "iso_week", "hour": "hour", "hh": "hour", "minute": "minute", "mi": "minute", "n": "minute",
    "second": "second", "ss": "second", "s": "second", "millisecond": "millisecond", "ms": "millisecond", "microsecond": "microsecond", "mcs": "microsecond", "nanosecond": "nanosecond", "ns": "nanosecond", "tzoffset": "tzoffset", "tz": "tzoffset",
}
_MICROS = {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000, "microsecond": 1}


def part_name(name: str) -> str:
    try:
        return PARTS[name.lower()]
    except KeyError:
        raise EngineError(155, f"{name} is not a recognized date part") from None


def micros(x: Column) -> Column:
    """Microseconds since 1970, of a date or a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), x.cast("timestamp_ntz"))


def days(x: Column) -> Column:
    return F.unix_date(x.cast("date"))


def from_micros(x: Column) -> Column:
    return F.timestamp_add("MICROSECOND", x, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def dateadd(part: str, n: Column | int, x: Column) -> Column:
    """DATEADD; month ends are kept within the month, and the result keeps the argument's type."""
    part, n = part_name(part), n if isinstance(n, Column) else F.lit(n)
    unit = {"year": ("MONTH", 12), "quarter": ("MONTH", 3), "month": ("MONTH", 1), "week": ("DAY", 7), "dayofyear": ("DAY", 1), "day": ("DAY", 1), "weekday": ("DAY", 1), "hour": ("HOUR", 1), "minute": ("MINUTE", 1), "second": ("SECOND", 1), "millisecond": ("MICROSECOND", 1000), "microsecond": ("MICROSECOND", 1)}
    if part == "nanosecond":
        return F.timestamp_add("MICROSECOND", F.floor((n + 500) / 1000), x)
    if part not in unit:
        raise EngineError(9810, f"date part {part} is not supported by dateadd")
    name, times = unit[part]
    return F.timestamp_add(name, n * times, x.cast("timestamp_ntz"))


def dateadd_date(part: str, n: Column | int, x: Column) -> Column:
    """DATEADD of a DATE: parts of a day are an error."""
    if part_name(part) in (*_MICROS, "nanosecond"):
        raise EngineError(9810, f"date part {part} is not supported by dateadd for date")
    return dateadd(part, n, x).cast("date")


def datediff_big(part: str, a: Column, b: Column) -> Column:
    """DATEDIFF_BIG: how many boundaries of the part lie between; weeks begin on Sunday."""
    part = part_name(part)
    if part == "year":
        out = F.year(b) - F.year(a)
    elif part == "quarter":
        out = (F.year(b) * 4 + F.quarter(b)) - (F.year(a) * 4 + F.quarter(a))
    elif part == "month":
        out = (F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))
    elif part == "week":
        out = F.floor((days(b) + 4) / 7) - F.floor((days(a) + 4) / 7)
    elif part in ("day", "dayofyear", "weekday"):
        out = days(b) - days(a)
    elif part in _MICROS:
        size = F.lit(_MICROS[part])
        out = _floor_div(micros(b), size) - _floor_div(micros(a), size)
    elif part == "nanosecond":
        out = (micros(b) - micros(a)) * 1000
    else:
        raise EngineError(9806, f"date part {part} is not supported by datediff")
    return out.cast("long")


def _floor_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a - F.pmod(a, b), b)


def datediff(part: str, a: Column, b: Column) -> Column:
    """DATEDIFF as int; error if it doesn't fit."""
    return datediff_big(part, a, b).cast("int")


def datepart(part: str, x: Column, datefirst: int = 7) -> Column:
    """DATEPART as int; datefirst is the first day of the week, 1 for Monday to 7 for Sunday."""
    part = part_name(part)
    iso = F.weekday(x) + 1
    if part == "weekday":
        out = F.pmod(iso - datefirst, F.lit(7)) + 1
    elif part == "week":
        first = F.weekday(F.make_date(F.year(x), F.lit(1), F.lit(1))) + 1
        out = F.floor((F.dayofyear(x) - 1 + F.pmod(first - datefirst, F.lit(7))) / 7) + 1
    elif part == "iso_week":
        out = F.weekofyear(x)
    elif part == "millisecond":
        out = F.pmod(_floor_div(micros(x), F.lit(1000)), F.lit(1000))
    elif part == "microsecond":
        out = F.pmod(micros(x), F.lit(1_000_000))
    elif part == "nanosecond":
        out = F.pmod(micros(x), F.lit(1_000_000)) * 1000
    elif part == "tzoffset":
        out = F.lit(0)
    else:
        out = {"year": F.year, "quarter": F.quarter, "month": F.month, "dayofyear": F.dayofyear, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}[part](x)
    return out.cast("int")


def datename(part: str, x: Column, datefirst: int = 7) -> Column:
    """DATENAME: English names of months and weekdays, numbers else."""
    name = part_name(part)
    if name == "month":
        return F.date_format(x, "MMMM")
    if name == "weekday":
        return F.date_format(x, "EEEE")
    return datepart(part, x, datefirst).cast("string")


def year(x: Column) -> Column:
    return F.year(x)


def month(x: Column) -> Column:
    return F.month(x)


def day(x: Column) -> Column:
    return F.dayofmonth(x)


def eomonth(x: Column, n: int | Column = 0) -> Column:
    return F.last_day(F.add_months(x.cast("date"), n))


def datefromparts(y: Column, m: Column, d: Column) -> Column:
    return F.make_date(y, m, d)


def datetime2fromparts(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, fraction: Column | int = 0, precision: int = 0) -> Column:
    """DATETIME2FROMPARTS: the fraction counts units of the precision."""
    fraction = fraction if isinstance(fraction, Column) else F.lit(fraction)
    seconds = s.cast("decimal(16,6)") + (fraction.cast("decimal(16,6)") / F.lit(10**precision)).cast("decimal(16,6)")
    return F.make_timestamp_ntz(y, mo, d, h, mi, seconds)


def timefromparts(h: Column, mi: Column, s: Column, fraction: Column | int = 0, precision: int = 7) -> Column:
    """TIMEFROMPARTS in ticks."""
    fraction = fraction if isinstance(fraction, Column) else F.lit(fraction)
    return ((h * 3600 + mi * 60 + s).cast("long") * 10_000_000 + fraction.cast("long") * 10 ** (7 - precision)).cast("long")


def offset(utc: Column, minutes: Column | int) -> Column:
    """A datetimeoffset."""
    minutes = minutes if isinstance(minutes, Column) else F.lit(minutes)
    return F.struct(utc.cast("timestamp_ntz").alias("utc"), minutes.cast("short").alias("offset_min"))


def _minutes(zone: str | int) -> int:
    if isinstance(zone, int):
        total = zone
    else:
        if len(zone) != 6 or zone[0] not in "+-" or zone[3] != ":":
            raise EngineError(9812, f"invalid time zone offset {zone}")
        total = (1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 60 + int(zone[4:]))
    if abs(total) > 14 * 60:
        raise EngineError(9812, f"invalid time zone offset {zone}")
    return total


def todatetimeoffset(x: Column, zone: str | int) -> Column:
    """TODATETIMEOFFSET: the local time as it is, with an offset."""
    minutes = _minutes(zone)
    return offset(F.timestamp_add("MINUTE", F.lit(-minutes), x.cast("timestamp_ntz")), minutes)


def switchoffset(x: Column, zone: str | int) -> Column:
    """SWITCHOFFSET: the same instant under another offset."""
    return offset(x["utc"], _minutes(zone))


def local(x: Column) -> Column:
    """Local time of a datetimeoffset."""
    return F.timestamp_add("MINUTE", x["offset_min"].cast("int"), x["utc"])


#: Windows names of common time zones and their names in the public time zone database.
ZONES = {
    "UTC": "UTC", "GMT Standard Time": "Europe/London", "W. Europe Standard Time": "Europe/Berlin", "Romance Standard Time": "Europe/Paris", "Central Europe Standard Time": "Europe/Budapest",
    "Central European Standard Time": "Europe/Warsaw", "E. Europe Standard Time": "Europe/Chisinau", "FLE Standard Time": "Europe/Kiev", "GTB Standard Time": "Europe/Bucharest", "Russian Standard Time": "Europe/Moscow",
    "Turkey Standard Time": "Europe/Istanbul", "Israel Standard Time": "Asia/Jerusalem", "Egypt Standard Time": "Africa/Cairo", "South Africa Standard Time": "Africa/Johannesburg", "Arabian Standard Time": "Asia/Dubai",
    "India Standard Time": "Asia/Kolkata", "China Standard Time": "Asia/Shanghai", "Singapore Standard Time": "Asia/Singapore", "Tokyo Standard Time": "Asia/Tokyo", "Korea Standard Time": "Asia/Seoul",
    "AUS Eastern Standard Time": "Australia/Sydney", "New Zealand Standard Time": "Pacific/Auckland", "Hawaiian Standard Time": "Pacific/Honolulu", "Alaskan Standard Time": "America/Anchorage", "Pacific Standard Time": "America/Los_Angeles",
    "Mountain Standard Time": "America/Denver", "US Mountain Standard Time": "America/Phoenix", "Central Standard Time": "America/Chicago", "Eastern Standard Time": "America/New_York", "Atlantic Standard Time": "America/Halifax",
    "E. South America Standard Time": "America/Sao_Paulo", "Argentina Standard Time": "America/Buenos_Aires", "Newfoundland Standard Time": "America/St_Johns",
}


def at_time_zone(x: Column, zone: str, is_offset: bool = False) -> Column:
    """AT TIME ZONE: local time gets the zone's offset; a datetimeoffset is moved to the zone."""
    if zone not in ZONES:
        raise EngineError(9820, f"the time zone {zone} is invalid")
    name = ZONES[zone]
    if is_offset:
        there = F.convert_timezone(F.lit("UTC"), F.lit(name), x["utc"])
        return offset(x["utc"], F.timestamp_diff("MINUTE", x["utc"], there))
    utc = F.convert_timezone(F.lit(name), F.lit("UTC"), x.cast("timestamp_ntz"))
    back = F.convert_timezone(F.lit("UTC"), F.lit(name), utc)
    return offset(utc, F.timestamp_diff("MINUTE", utc, back))


def datetrunc(part: str, x: Column, datefirst: int = 7) -> Column:
    """DATETRUNC; weeks begin on the first day of the week, iso weeks on Monday."""
    part = part_name(part)
    if part in ("week", "iso_week"):
        first = 1 if part == "iso_week" else datefirst
        back = F.pmod(F.weekday(x) + 1 - first, F.lit(7))
        return F.date_sub(x.cast("date"), back.cast("int")).cast("timestamp_ntz")
    unit = {"dayofyear": "day", "weekday": "day"}.get(part, part)
    if unit in _MICROS:
        size = F.lit(_MICROS[unit])
        at = micros(x)
        return from_micros(at - F.pmod(at, size))
    return F.date_trunc(unit, x).cast("timestamp_ntz")


def date_bucket(part: str, n: int, x: Column, origin: str = "1900-01-01") -> Column:
    """DATE_BUCKET: start of the bucket of n parts, counted from the origin."""
    if n <= 0:
        raise EngineError(9834, "the bucket width must be positive")
    part = part_name(part)
    start = F.lit(f"{origin} 00:00:00" if len(origin) == 10 else origin).cast("timestamp_ntz")
    if part in ("year", "quarter", "month"):
        months = n * {"year": 12, "quarter": 3, "month": 1}[part]
        gone = datediff_big("month", start, x)
        gone = gone - F.when(dateadd("month", gone.cast("int"), start) > x, 1).otherwise(0)
        return dateadd("month", (gone - F.pmod(gone, F.lit(months))).cast("int"), start)
    size = F.lit(n * {"week": 7 * 86_400_000_000, "day": 86_400_000_000}.get(part, _MICROS.get(part, 0)))
    since = micros(x) - micros(start)
    return from_micros(micros(start) + since - F.pmod(since, size))


def current(spark) -> dict[str, Column]:  # noqa: ANN001
    """The clock's functions, all with one value for a statement; datetime is on a grid of 1/300 s."""
    now = spark.sql("SELECT localtimestamp() AS t").first().t
    grid = now.replace(microsecond=min(round(round(now.microsecond * 3 / 10000) * 10000 / 3), 999_999))
    fine, coarse = F.lit(now).cast("timestamp_ntz"), F.lit(grid).cast("timestamp_ntz")
    return {"getdate": coarse, "current_timestamp": coarse, "getutcdate": coarse, "sysdatetime": fine, "sysutcdatetime": fine, "sysdatetimeoffset": offset(fine, 0)}
