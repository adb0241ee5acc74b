"""Functions on micro-fixtures: nulls, boundaries, errors and result types."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import types
from tessera.errors import EngineError, number_of, translated
from tessera.functions import conversion as c
from tessera.functions import json as j
from tessera.functions import numeric as n
from tessera.functions import strings as s
from tessera.functions import temporal as d
from tessera.operators import aggregates as a


def one(spark, *columns):
    row = spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(columns)]).first()
    return list(row) if len(columns) > 1 else row[0]


L = F.lit


def test_lengths(spark):
    assert one(spark, s.len_(L("ab  ")), s.len_(L("\U0001f600")), s.datalength(L("aé")), s.datalength(L("aé"), "varchar")) == [2, 2, 4, 2]


def test_slices(spark):
    assert one(spark, s.left(L("abc"), 2), s.right(L("abc"), 2), s.right(L("abc"), 0), s.right(L("abc"), 9), s.substring(L("abc"), 0, 2), s.substring(L("abc"), 2, 9)) == ["ab", "bc", "", "abc", "a", "bc"]
    with pytest.raises(EngineError) as e, translated():
        one(spark, s.left(L("abc"), -1))
    assert e.value.number == 536


def test_building(spark):
    assert one(spark, s.replicate(L("ab"), 2), s.replicate(L("ab"), -1), s.replicate(L("ab"), 0), F.length(s.replicate(L("abc"), 9999)), s.space(2), s.space(-1)) == ["abab", None, "", 7998, "  ", None]
    assert one(spark, s.char(L(128)), s.char(L(65)), s.char(L(256)), s.nchar(L(8364)), s.unicode(L("\U0001f600")), s.unicode(L(""))) == ["€", "A", None, "€", 55357, None]
    assert one(spark, s.stuff(L("abcdef"), 2, 3, "xy"), s.stuff(L("abc"), 5, 1, "x"), s.str_(L(3.14159), 6, 2), s.str_(L(12345), 3)) == ["axyef", None, "  3.14", "***"]
    assert one(spark, s.quotename(L("a]b")), s.quotename(L("a'b"), "'"), s.quotename(L("x" * 129)), s.concat(L(None).cast("string"), "a"), s.concat_ws(",", L(None).cast("string"), L("b"))) == ["[a]]b]", "'a''b'", None, "a", "b"]
    with pytest.raises(EngineError):
        s.translate(L("a"), "ab", "x")


def test_search(spark):
    assert one(spark, s.charindex("B", L("abcb")), s.charindex("b", L("abcb"), 3), s.charindex("z", L("abc")), s.patindex("%[0-9]%", L("ab12")), s.patindex("ab%", L("xab")), s.patindex("%c", L("abc"))) == [2, 4, 0, 3, 0, 3]


@pytest.mark.parametrize(("text", "pattern", "escape", "expected"), [("abc", "A_c", None, True), ("a%c", "a!%c", "!", True), ("abc", "a!%c", "!", False), ("b1", "[^a][0-9]", None, True), ("a]", "a]", None, True), ("x.y", "x.y", None, True), ("xay", "x.y", None, False), ("ab ", "ab", None, False), ("a\nb", "a%b", None, True)])
def test_like(spark, text, pattern, escape, expected):
    assert one(spark, s.like(L(text), pattern, escape)) is expected


def test_escapes_and_sounds(spark):
    assert one(spark, s.string_escape_json(L('a"b\\/\n\x01')), s.soundex(L("Robert")), s.soundex(L("12")), s.difference(L("Robert"), L("Rupert"))) == ['a\\"b\\\\\\/\\n\\u0001', "R163", "0000", 4]
    assert one(spark, F.hex(s.hashbytes("MD5", L("a"))), s.hashbytes("NONE", L("a")), s.upper(L("straße")), F.hex(s.ansi(L("€é")))) == ["4144E195F46DE78A3623DA7364D04F11", None, "STRAßE", "80E9"]


def test_collations(spark):
    assert one(spark, s.ci(L("AB ")) == s.ci(L("ab")), s.collate(L("AB"), "Latin1_General_100_BIN2") == s.collate(L("ab"), "Latin1_General_100_BIN2"), s.ci(L("é")) == s.ci(L("e"))) == [True, False, False]
    with pytest.raises(EngineError):
        s.collation("nonsense")


def test_integers(spark):
    assert one(spark, n.int_div(L(-7), L(2)), n.int_mod(L(-7), L(2)), c.to_int(L(-1.7)), c.text_to_int(L("  ")), n.sign(L(-3))) == [-3, -1, -1, 0, -1]
    for bad, number in ((n.int_div(L(1), L(0)), 8134), (c.to_int(L(300), "tinyint"), 8115), (c.text_to_int(L("1.5")), 245)):
        with pytest.raises(Exception) as e:
            one(spark, bad)
        assert number_of(e.value) == number


def test_decimals(spark):
    five = T.DecimalType(5, 2)
    x = n.decimal_div(L(Decimal("2.00")), L(Decimal("3.00")), five, five)
    assert one(spark, x, n.decimal_div(L(Decimal("-2.00")), L(Decimal("3.00")), five, five), n.truncate(L(Decimal("-1.29")), 1)) == [Decimal("0.66666666"), Decimal("-0.66666666"), Decimal("-1.2")]
    assert one(spark, n.money_div(L(Decimal("10.0000")), L(3)), n.money_mul(L(Decimal("1.0001")), L(Decimal("1.0001")))) == [Decimal("3.3333"), Decimal("1.0002")]
    assert spark.range(1).select(x).schema[0].dataType == T.DecimalType(13, 8)


def test_money_text(spark):
    m = lambda v: L(Decimal(v)).cast("decimal(19,4)")
    assert one(spark, c.money_text(m("-0.0040")), c.money_text(m("-0.0040"), 1), c.money_text(m("-0.0040"), 2), c.money_text(m("0.0040"))) == ["-0.00", "-0.00", "-0.0040", "0.00"]
    assert one(spark, c.money_text(m("-1234.5650")), c.money_text(m("-1234.5650"), 1), c.money_text(m("922337203685477.5807"), 1), c.money_text(F.lit(None).cast("decimal(19,4)"))) == ["-1234.57", "-1,234.57", "922,337,203,685,477.58", None]
    assert one(spark, c.float_money_text(L(-0.0)), c.float_money_text(L(-1234567.125), 1), c.float_money_text(L(1.005)), c.float_money_text(L(-0.0), 2)) == ["-0.00", "-1,234,567.12", "1.00", "-0.0000"]


def test_decimal_shapes():
    for p1 in range(1, 39, 3):
        for s1 in range(0, p1 + 1, 4):
            for p2 in range(1, 39, 5):
                for op in "+*/%":
                    out = types.decimal_result(op, T.DecimalType(p1, s1), T.DecimalType(p2, p2 // 2))
                    assert 1 <= out.precision <= 38 and 0 <= out.scale <= out.precision
    assert types.decimal_result("/", T.DecimalType(5, 2), T.DecimalType(5, 2)) == T.DecimalType(13, 8)
    assert types.set_operation_decimal(T.DecimalType(10, 2), T.DecimalType(5, 4)) == T.DecimalType(12, 4)
    assert types.higher("int", "money") == "money"


def test_dates(spark):
    at = lambda x: L(x).cast("timestamp_ntz")
    assert one(spark, d.datediff("month", at("2024-01-31"), at("2024-02-01")), d.datediff("week", at("2024-01-06"), at("2024-01-07")), d.datediff("hour", at("1969-12-31 23:59"), at("1970-01-01 00:00")), d.datediff("year", at("9999-12-31"), at("0001-01-01"))) == [1, 1, 1, -9998]
    assert str(one(spark, d.dateadd_date("month", 1, L("2024-01-31").cast("date")))) == "2024-02-29"
    assert one(spark, d.datepart("weekday", at("2024-01-07")), d.datepart("weekday", at("2024-01-07"), 1), d.datepart("week", at("2024-12-31")), d.datepart("isowk", at("2024-12-31"))) == [1, 7, 53, 1]
    assert str(one(spark, d.datetrunc("week", at("2024-01-10")))) == "2024-01-07 00:00:00"
    assert str(one(spark, d.date_bucket("month", 5, at("2024-04-30"), "2024-01-31"))) == "2024-01-31 00:00:00"
    assert one(spark, d.at_time_zone(at("2024-07-01 12:00"), "Pacific Standard Time")["offset_min"]) == -420
    for call in (lambda: d.datediff("tz", at("2024-01-01"), at("2024-01-01")), lambda: d.dateadd_date("hour", 1, L("2024-01-01")), lambda: d.todatetimeoffset(at("2024-01-01"), "+15:00"), lambda: d.part_name("fortnight"), lambda: d.at_time_zone(at("2024-01-01"), "Nowhere")):
        with pytest.raises(EngineError):
            call()


def test_conversions(spark):
    at = L("2024-01-05 03:04:05.678").cast("timestamp_ntz")
    assert one(spark, c.date_text(at, 0), c.date_text(at, 126), c.date_text(at, 112), c.date_text(at, 113)) == ["Jan  5 2024  3:04AM", "2024-01-05T03:04:05.678", "20240105", "05 Jan 2024 03:04:05:678"]
    assert one(spark, c.to_varchar(L(12345), 3, "int"), c.to_char(L("ab"), 4), c.binary_text(L(b"\x0a"), 1), c.float_text(L(0.5), 0), c.guid(L("{6f9619ff-8b86-d011-b42d-00c04fc964ff}"))) == ["*", "ab  ", "0x0A", "0.5", "6F9619FF-8B86-D011-B42D-00C04FC964FF"]
    assert one(spark, c.format_number(L(1234.5), "N1"), c.format_number(L(-5), "C"), c.format_number(L(255), "X4"), c.format_number(L(1.5), "#.##"), c.format_number(L(1), "bad"), c.format_date(at, "d")) == ["1,234.5", "($5.00)", "00FF", "1.5", None, "1/5/2024"]
    assert one(spark, c.choose(L(2), "a", "b"), c.choose(L(9), "a", "b"), c.isnumeric(L("1e5")), c.isdate(L("nope"))) == ["b", None, 1, 0]


def test_json(spark):
    doc = L('{"a":{"b":[1,"x",null]},"s":"t","z":null}')
    assert one(spark, j.json_value(doc, "$.s"), j.json_value(doc, "$.a"), j.json_value(doc, "lax $.q"), j.json_query(doc, "$.a.b"), j.json_query(doc, "$.s"), j.json_path_exists(doc, "$.z"), j.json_path_exists(doc, "$.q")) == ["t", None, None, '[1,"x",null]', None, 1, 0]
    assert one(spark, j.isjson(doc), j.isjson(L("1")), j.isjson(L("1"), "SCALAR"), j.isjson(L("{")), j.isjson(L(None).cast("string"))) == [1, 0, 1, 0, None]
    with pytest.raises(Exception) as e:
        one(spark, j.json_value(doc, "strict $.q"))
    assert number_of(e.value) == 13608
    with pytest.raises(EngineError):
        j.path_steps("a.b")
    assert one(spark, j.json_modify(doc, "$.s", L(None).cast("string")), j.json_modify(doc, "$.a.b[0]", L("n")), j.json_modify(doc, "append $.a.b", L("n"))) == ['{"a":{"b":[1,"x",null]},"z":null}', '{"a":{"b":["n","x",null]},"s":"t","z":null}', '{"a":{"b":[1,"x",null,"n"]},"s":"t","z":null}']


def test_typed_aggregates(spark):
    df = spark.createDataFrame([(1, Decimal("-1.00")), (2, Decimal("-1.00")), (4, Decimal("0.00")), (None, None)], "i int, d decimal(5,2)")
    out = df.agg(a.count().alias("n"), a.count(F.col("i")).alias("k"), a.avg_int(F.col("i") * -1).alias("m"), a.avg_decimal(F.col("d"), 2).alias("d"), a.var(F.col("i")).alias("v"), a.string_agg(F.col("i").cast("string"), "-", F.col("i")).alias("s"))
    assert list(out.first()) == [4, 3, -2, Decimal("-0.666666"), pytest.approx(7 / 3), "1-2-4"]
    assert [f.dataType for f in out.schema[:4]] == [T.IntegerType(), T.IntegerType(), T.IntegerType(), T.DecimalType(38, 6)]
    none = df.limit(0).agg(a.avg_int(F.col("i")), a.avg_decimal(F.col("d"), 2), a.string_agg(F.col("i").cast("string"), ","))
    assert list(none.first()) == [None, None, None]
    with pytest.raises(Exception) as e:
        spark.createDataFrame([(2**31 - 1,), (1,)], "i int").agg(a.sum_int(F.col("i"))).collect()
    assert number_of(e.value) == 8115


def test_rand_is_one_value_for_a_statement():
    r = n.Rand(7)
    first = [r.next() for _ in range(5)]
    r.seed(7)
    assert first == [r.next() for _ in range(5)] and all(0 < x < 1 for x in first) and len(set(first)) == 5
