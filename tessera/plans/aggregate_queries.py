"""Aggregates, grouping and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions import strings as s
from tessera.operators import aggregates as a
from tessera.operators import windows as w
from tessera.plans.registry import Tables, query, sql_query


@query("SELECT CAST(count(*) AS INTEGER) AS n, CAST(count(NULLIF(o_orderstatus, 'P')) AS INTEGER) AS known, CAST(count(DISTINCT o_custkey) AS INTEGER) AS people, count(*) AS big FROM orders")
def count_forms(t: Tables) -> DataFrame:
    known = F.nullif("o_orderstatus", F.lit("P"))
    return t.orders.agg(a.count().alias("n"), a.count(known).alias("known"), a.count_distinct(F.col("o_custkey")).alias("people"), a.count_big().alias("big"))


@query("SELECT CAST(count(DISTINCT lower(rtrim(v))) AS INTEGER) AS n FROM (SELECT c_mktsegment AS v FROM customer UNION ALL SELECT lower(c_mktsegment) FROM customer)")
def count_distinct_ignoring_case(t: Tables) -> DataFrame:
    both = t.customer.select(F.col("c_mktsegment").alias("v")).unionAll(t.customer.select(F.lower("c_mktsegment")))
    return both.agg(a.count_distinct(s.ci(F.col("v"))).alias("n"))


@query("SELECT p_brand, CAST(sum(p_size) AS INTEGER) AS s, CAST(sum(p_partkey) AS BIGINT) AS b FROM part GROUP BY p_brand")
def sum_integers(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(a.sum_int(F.col("p_size")).alias("s"), a.sum_int(F.col("p_partkey"), "bigint").alias("b"))


@query("SELECT p_brand, CAST(sum(p_size - 30) // count(*) AS INTEGER) AS m FROM part GROUP BY p_brand")
def avg_integers(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(a.avg_int(F.col("p_size") - 30).alias("m"))


_CENTS = "CAST(CAST(round(o_totalprice * 100) AS BIGINT) - 8000000 AS HUGEINT)"


@query(f"SELECT o_orderstatus, CAST(CAST(sum({_CENTS}) AS DECIMAL(28,0)) * 0.01::DECIMAL(3,2) AS DECIMAL(38,2)) AS total, CAST(CAST(sum({_CENTS}) * 10000 // count(*) AS DECIMAL(28,0)) * 0.000001::DECIMAL(7,6) AS DECIMAL(38,6)) AS mean FROM orders GROUP BY o_orderstatus")
def sum_avg_decimal(t: Tables) -> DataFrame:
    x = (F.round(F.col("o_totalprice") * 100).cast("decimal(18,0)") - 8000000) * F.lit("0.01").cast("decimal(3,2)")
    return t.orders.groupBy("o_orderstatus").agg(a.sum_decimal(x, 2).alias("total"), a.avg_decimal(x, 2).alias("mean"))


@query("SELECT c_nationkey, CAST(sum(m) AS DECIMAL(19,4)) AS total, CAST(CAST(sum(CAST(m * 10000 AS HUGEINT)) // count(*) AS DECIMAL(19,0)) * 0.0001::DECIMAL(5,4) AS DECIMAL(19,4)) AS mean FROM (SELECT c_nationkey, CAST(c_acctbal AS DECIMAL(12,4)) AS m FROM customer) GROUP BY c_nationkey")
def sum_avg_money(t: Tables) -> DataFrame:
    m = F.col("c_acctbal").cast("decimal(19,4)")
    return t.customer.groupBy("c_nationkey").agg(a.sum_money(m).alias("total"), a.avg_money(m).alias("mean"))


@query("SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def sum_avg_float(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(a.sum_float(F.col("value")), 4).alias("total"), F.round(a.avg_float(F.col("value")), 6).alias("mean"))


sql_query("min_max", "SELECT o_orderstatus, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, min(o_orderpriority) AS low, max(o_totalprice) AS high FROM orders GROUP BY o_orderstatus")


@query("SELECT p_brand, arg_min(p_name, lower(rtrim(p_name))) AS low, arg_max(p_name, lower(rtrim(p_name))) AS high FROM part GROUP BY p_brand")
def min_max_ignoring_case(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(a.min_ci(F.col("p_name")).alias("low"), a.max_ci(F.col("p_name")).alias("high"))


@query("SELECT event_type, round(stddev_samp(value), 5) AS sd, round(stddev_pop(value), 5) AS sdp, round(var_samp(value), 4) AS v, round(var_pop(value), 4) AS vp FROM events GROUP BY event_type")
def stdev_var(t: Tables) -> DataFrame:
    x = F.col("value")
    return t.events.groupBy("event_type").agg(F.round(a.stdev(x), 5).alias("sd"), F.round(a.stdevp(x), 5).alias("sdp"), F.round(a.var(x), 4).alias("v"), F.round(a.varp(x), 4).alias("vp"))


@query("SELECT event_id, CASE WHEN count(*) > 1 THEN round(var_samp(value), 3) END AS v, round(var_pop(value), 3) AS one FROM events GROUP BY event_id")
def var_single_row(t: Tables) -> DataFrame:
    return t.events.groupBy("event_id").agg(F.round(a.var(F.col("value")), 3).alias("v"), F.round(a.varp(F.col("value")), 3).alias("one"))


@query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
def string_agg_ordered(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.expr("listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name DESC)").alias("names"))


@query("SELECT n_regionkey, string_agg(NULLIF(n_name, 'NATION_3'), ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def string_agg_skips_nulls(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(a.string_agg(F.nullif("n_name", F.lit("NATION_3")), ",", F.col("n_nationkey")).alias("names"))


@query("SELECT p_brand, bit_xor(p_size) AS c FROM part GROUP BY p_brand")
def checksum_agg(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(a.checksum_agg(F.col("p_size")).alias("c"))


@query("SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS s, CAST(count(DISTINCT p_size) AS BIGINT) AS n, round(avg(DISTINCT p_size), 6) AS m FROM part")
def distinct_aggregates(t: Tables) -> DataFrame:
    return t.part.agg(F.sum_distinct("p_size").alias("s"), F.count_distinct("p_size").alias("n"), F.round(F.expr("avg(DISTINCT p_size)"), 6).alias("m"))


@query()
def approx_count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(a.approx_count_distinct(F.col("l_partkey")).alias("parts"))


sql_query("group_by_expression", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)")
sql_query("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND min(o_totalprice) < 20000")
_GROUPS = "count(*) AS n, CAST(grouping(o_orderstatus) AS {t}) AS g FROM orders GROUP BY"
for _name, _by in {"grouping_sets": "GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), (), ())", "cube": "CUBE (o_orderstatus, o_orderpriority)", "rollup": "ROLLUP (o_orderstatus, o_orderpriority)", "cube_nested_in_sets": "GROUPING SETS (CUBE (o_orderstatus, o_orderpriority), (o_orderstatus))"}.items():
    sql_query(_name, f"SELECT o_orderstatus, o_orderpriority, {_GROUPS.format(t='TINYINT')} {_by}")


@query("SELECT o_orderstatus, o_orderpriority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS INTEGER) AS gid, CAST(count(*) AS INTEGER) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_id(t: Tables) -> DataFrame:
    return a.grouping_sets(t.orders, [["o_orderstatus"], ["o_orderpriority"], []], [a.grouping_id("o_orderstatus", "o_orderpriority").alias("gid"), a.count().alias("n")])


@query("SELECT c_mktsegment, CAST(count(*) FILTER (c_acctbal > 9900) AS INTEGER) AS n, round(sum(c_acctbal) FILTER (c_acctbal > 9900), 2) AS s FROM customer GROUP BY c_mktsegment")
def group_by_all(t: Tables) -> DataFrame:
    out = a.group_by_all(t.customer, F.col("c_acctbal") > 9900, ["c_mktsegment"], {"n": ("count", None), "s": ("sum", F.col("c_acctbal"))})
    return out.withColumn("s", F.round("s", 2))


@query("SELECT n_regionkey, CAST('{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS VARCHAR) AS j FROM nation GROUP BY n_regionkey")
def json_objectagg(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(a.json_objectagg(F.col("n_name"), F.col("n_nationkey")).alias("j"))


@query("SELECT n_regionkey, '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || ']' AS j FROM nation GROUP BY n_regionkey")
def json_arrayagg(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(a.json_arrayagg(F.col("n_nationkey"), F.col("n_nationkey")).alias("j"))


# windows


def _user() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS d FROM orders")
def ranking(t: Tables) -> DataFrame:
    p = Window.partitionBy("o_custkey")
    by = p.orderBy("o_orderpriority")
    return t.orders.select("o_orderkey", w.row_number(p.orderBy("o_orderdate", "o_orderkey")).alias("rn"), w.rank(by).alias("r"), w.dense_rank(by).alias("d"))


@query("SELECT event_id, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q FROM events")
def ntile(t: Tables) -> DataFrame:
    return t.events.select("event_id", w.ntile(4, _user()).alias("q"))


@query("SELECT event_id, round(percent_rank() OVER (PARTITION BY user_id ORDER BY event_type), 9) AS p, round(cume_dist() OVER (PARTITION BY user_id ORDER BY event_type), 9) AS c FROM events")
def distribution(t: Tables) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("event_type")
    return t.events.select("event_id", F.round(w.percent_rank(by), 9).alias("p"), F.round(w.cume_dist(by), 9).alias("c"))


@query("SELECT event_id, lag(event_type, 2, 'none') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events")
def lag_lead(t: Tables) -> DataFrame:
    return t.events.select("event_id", w.lag(F.col("event_type"), _user(), 2, "none").alias("before"), w.lead(F.col("event_id"), _user()).alias("after"))


@query("SELECT event_id, first_value(NULLIF(event_type, 'view') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, last_value(NULLIF(event_type, 'view') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events")
def first_last_ignore_nulls(t: Tables) -> DataFrame:
    x = F.nullif("event_type", F.lit("view"))
    return t.events.select("event_id", w.first_value(x, _user(), True).alias("f"), w.last_value(x, _user(), True).alias("l"), w.first_value(F.col("event_id"), _user()).alias("r"))


@query("SELECT event_id, nth_value(event_id, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS third FROM events")
def nth_value(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.nth_value("event_id", 3).over(_user()).alias("third"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS s, CAST(count(*) OVER (PARTITION BY user_id ORDER BY event_type RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS n, max(value) OVER (PARTITION BY user_id) AS m FROM events")
def window_frames(t: Tables) -> DataFrame:
    rows, ranged = w.frame(_user(), "rows", -2, 1), w.frame(Window.partitionBy("user_id").orderBy("event_type"), "range", None, 0)
    return t.events.select("event_id", F.round(F.sum("value").over(rows), 4).alias("s"), F.count("*").over(ranged).cast("int").alias("n"), F.max("value").over(Window.partitionBy("user_id")).alias("m"))


@query("SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest FROM events")
def window_rows_following(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.sum("event_id").over(w.frame(_user(), "rows", 0, None)).alias("rest"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, max(event_id) OVER (PARTITION BY user_id) AS top FROM events")
def named_windows(t: Tables) -> DataFrame:
    named = w.named_windows({"ordered": w.Named("base", order=["ts", "event_id"]), "base": w.Named(partition=["user_id"])})
    return t.events.select("event_id", w.row_number(named["ordered"]).alias("rn"), F.max("event_id").over(named["base"]).alias("top"))


@query("SELECT user_id, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS med, percentile_disc(0.9) WITHIN GROUP (ORDER BY value) AS p90 FROM events GROUP BY user_id")
def percentiles(t: Tables) -> DataFrame:
    return t.events.select("user_id", F.round(w.percentile_cont(0.5, "value", ["user_id"]), 6).alias("med"), w.percentile_disc(0.9, "value", ["user_id"]).alias("p90")).distinct()


@query("SELECT DISTINCT event_type, round(quantile_cont(value, 0.75) OVER (PARTITION BY event_type), 6) AS q FROM events")
def percentile_descending(t: Tables) -> DataFrame:
    return t.events.select("event_type", F.round(w.percentile_cont(0.25, "value", ["event_type"], descending=True), 6).alias("q")).distinct()


sql_query("window_over_aggregate", "SELECT o_custkey, n, rank() OVER (ORDER BY n DESC) AS r FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01' GROUP BY o_custkey) AS x", "SELECT o_custkey, n, CAST(rank() OVER (ORDER BY n DESC) AS INTEGER) AS r FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01' GROUP BY o_custkey) AS x")
