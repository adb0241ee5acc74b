"""Operators on micro-fixtures: empty tables, nulls, ties, errors."""

from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.errors import EngineError, number_of
from tessera.operators import aggregates as a
from tessera.operators import dml, json_shape
from tessera.operators import relational as r
from tessera.operators import windows as w
from tessera.sources import openjson as oj
from tessera.streaming import windows as sw


@pytest.fixture(scope="module")
def s(spark):
    return spark.createDataFrame([(1, 1, None), (2, 1, 10), (3, 1, 10), (4, 1, 20), (5, 1, 30), (6, 2, 7)], "id int, g int, n int").repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_limits(s):
    assert [x.id for x in r.top(s, 2, F.desc("n"), F.asc("id")).collect()] == [5, 4]
    assert rows(r.top_with_ties(s.select("n"), 2, ("n", "asc"))) == [(7,), (None,)]
    assert rows(r.top_with_ties(s.select("id", "n"), 2, ("n", "desc"))) == [(4, 20), (5, 30)]
    assert r.top_with_ties(s, 0, ("n", "asc")).count() == 0 and r.top_with_ties(s.limit(0), 3, ("n", "asc")).count() == 0
    assert r.top_percent(s, 17, F.asc("id")).count() == 2 and r.top_percent(s, 0, F.asc("id")).count() == 0
    for call in (lambda: r.top(s, -1), lambda: r.top_percent(s, 101), lambda: r.offset_fetch(s, -1, 1, F.asc("id")), lambda: r.top_with_ties(s, 1)):
        with pytest.raises(EngineError):
            call()


def test_series(spark):
    assert [x.value for x in r.generate_series(spark, 5, 1, -2).collect()] == [5, 3, 1]
    assert r.generate_series(spark, 5, 1, 2).count() == 0
    assert [x.value for x in r.generate_series(spark, Decimal("0.1"), Decimal("0.3"), Decimal("0.1")).collect()] == [Decimal("0.1"), Decimal("0.2"), Decimal("0.3")]
    with pytest.raises(EngineError):
        r.generate_series(spark, 1, 2, 0)


def test_quantified(s, spark):
    none = s.where("id < 0").select(F.col("n").alias("v"))
    some = s.where("id = 2").select(F.col("n").alias("v"))
    with_null = s.where("id < 3").select(F.col("n").alias("v"))
    assert r.compare_all(s, F.col("n"), ">", none).count() == 6 and r.compare_any(s, F.col("n"), ">", none).count() == 0
    assert rows(r.compare_all(s, F.col("n"), ">", some).select("id")) == [(4,), (5,)]
    assert r.compare_all(s, F.col("n"), ">", with_null).count() == 0
    assert rows(r.compare_all(s, F.col("n"), "<>", some).select("id")) == [(4,), (5,), (6,)]


def test_unequal_to_all_without_broadcast_of_the_subquery(s, spark):
    n = F.col("n")
    none, with_null = s.where("id < 0").select("n"), s.where("id < 3").select("n")
    some = s.where("id = 2 or id = 4").select("n")
    assert r.compare_all(s, n, "<>", none).count() == 6 and r.compare_all(s, n, "<>", with_null).count() == 0
    got = r.compare_all(s, s["n"], "<>", some)
    given = {x.n for x in some.collect()}
    assert got.columns == s.columns and rows(got.select("id")) == sorted((x.id,) for x in s.collect() if x.n is not None and x.n not in given)
    plan = got._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin BuildRight, LeftAnti" not in plan and "LeftAnti" in plan


def test_joins(s, spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 4, "a"), (1, 10, "b"), (3, 0, "c")], "k int, at int, v string")
    assert rows(r.asof_join(left, right, "k", "t", "at", ["v"])) == [(1, 10, "b"), (1, 5, "a"), (2, 1, None)]
    bands = spark.createDataFrame([(0, 10), (5, 25), (100, 101)], "lo int, hi int")
    assert rows(r.band_join(s.where("n is not null").select("id", "n"), bands, "n", "lo", "hi", 7.0)) == [(2, 10, 5, 25), (3, 10, 5, 25), (4, 20, 5, 25), (6, 7, 0, 10), (6, 7, 5, 25)]


def test_windows(s):
    p = Window.partitionBy("g").orderBy("n")
    assert rows(s.select("id", F.round(w.percent_rank(p), 3), F.round(w.cume_dist(p), 3)))[:3] == [(1, 0.0, 0.2), (2, 0.25, 0.6), (3, 0.25, 0.6)]
    for call in (lambda: w.ntile(0, p), lambda: w.lag(F.col("n"), p, -1), lambda: w.frame(p, "range", -1, 0), lambda: w.frame(p, "rows", 2, 1), lambda: w.percentile_cont(2, "n", []), lambda: w.named_windows({"a": w.Named("b"), "b": w.Named("a")}), lambda: w.named_windows({"a": w.Named(order=["n"]), "b": w.Named("a", order=["g"])})):
        with pytest.raises(EngineError):
            call()


def test_group_by_all(s):
    assert rows(a.group_by_all(s, F.col("n") > 25, ["g"], {"c": ("count", None), "m": ("max", F.col("n"))})) == [(1, 1, 30), (2, 0, None)]


def test_changes(s, spark):
    source = spark.createDataFrame([(2, 99), (2, 98), (9, 1)], "id int, v int")
    got = dml.update(s, {"n": F.col("s_v")}, source=source, keys=["id"])
    assert rows(got.table.where("id < 3").select("id", "n")) == [(1, None), (2, 98)] and rows(got.output.select("deleted_n", "inserted_n")) == [(10, 98)]
    with pytest.raises(Exception) as e:
        dml.merge(s, source, ["id"], [dml.Arm("matched", "update", {"n": F.col("s_v")})]).table.collect()
    assert number_of(e.value) == 8672
    one = dml.merge(s, source.where("v <> 98"), ["id"], [dml.Arm("matched", "update", {"n": F.col("s_v")}), dml.Arm("by_target", "insert", {"id": F.col("s_id")}), dml.Arm("by_source", "delete", condition=F.col("g") == 2)])
    assert rows(one.table.select("id", "n")) == [(1, None), (2, 99), (3, 10), (4, 20), (5, 30), (9, None)]
    assert rows(one.output.select("action", "deleted_id", "inserted_id")) == [("DELETE", 6, None), ("INSERT", None, 9), ("UPDATE", 2, 2)]
    assert rows(dml.delete(s, F.col("n") > 5).table.select("id")) == [(1,)]
    assert rows(dml.check_key(s, ["n"])) == [(10, 2)] and rows(dml.check_condition(s, F.col("n") < 25).select("id")) == [(5,)]
    assert [x.k for x in dml.identity(s.select("id"), "k", 3, 2, "id").orderBy("id").collect()] == [3, 5, 7, 9, 11, 13]


def test_shapes(s, spark):
    none = s.where("id < 3").select("id", "n")
    columns = {"a.id": F.col("id"), "a.n": F.col("n")}
    assert json_shape.for_json_path(none, columns, [F.col("id")]).first().json == '[{"a":{"id":1}},{"a":{"id":2,"n":10}}]'
    assert json_shape.for_json_path(none, columns, [F.col("id")], include_nulls=True, wrapper=False).first().json == '{"a":{"id":1,"n":null}},{"a":{"id":2,"n":10}}'
    with pytest.raises(EngineError):
        json_shape.row_json({"a": F.col("id"), "a.b": F.col("n")})
    assert json_shape.for_xml_path(none, {"@id": F.col("id"), "x/n": F.col("n")}, [F.col("id")]).first().xml == '<row id="1"/><row id="2"><x><n>10</n></x></row>'
    auto = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "a", 3)], "o int, p string, c int").withColumn("k", F.lit(0))
    assert json_shape.for_json_auto(auto, {"p": F.col("p")}, "c", {"c": F.col("c")}, [F.col("o")], ["k"]).first().json == '[{"p":"a","c":[{"c":1}]},{"p":"b","c":[{"c":2}]},{"p":"a","c":[{"c":3}]}]'


def test_openjson(spark):
    docs = spark.createDataFrame([(1, '{"a":1.50,"a":null,"b":[1, 2],"c":{"d":true}}'), (2, None), (3, "7")], "id int, doc string")
    assert [tuple(x) for x in oj.openjson(docs, "doc", ["id"]).collect()] == [(1, "a", "1.50", 2), (1, "a", None, 0), (1, "b", "[1,2]", 4), (1, "c", '{"d":true}', 5)]
    assert oj.openjson(docs, "doc", ["id"], "$.zzz").count() == 0
    for path in ("strict $.zzz", "strict $.a"):
        with pytest.raises(Exception, match="1360|1361"):
            oj.openjson(docs.limit(1), "doc", ["id"], path).collect()


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:09:00"), (3, "2024-01-01 00:11:00"), (4, "2024-01-01 03:00:00")], "id int, at string").select("id", F.col("at").cast("timestamp").alias("at"))
    events.write.parquet(f"{tmp_path}/in")
    stream = sw.file_stream(spark, f"{tmp_path}/in", events.schema).withWatermark("at", "1 minute")
    sw.run_available(sw.tumbling(stream, "at", "10 minutes", F.count("*").alias("n")), f"{tmp_path}/out", f"{tmp_path}/mark")
    assert rows(spark.read.parquet(f"{tmp_path}/out").select(F.minute("window_start"), "n")) == [(0, 2), (10, 1)]
    assert rows(sw.session(events, "at", "30 minutes", F.count("*").alias("n")).select("n")) == [(1,), (3,)]
