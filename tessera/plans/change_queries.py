"""INSERT, UPDATE, DELETE, MERGE, constraints and event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import dml
from tessera.plans.registry import Tables, query
from tessera.streaming import windows as sw


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, NULL FROM region")
def insert_select(t: Tables) -> DataFrame:
    return dml.insert(t.nation, t.region.select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"))).table


@query("SELECT n_nationkey, n_name, -1 AS n_regionkey FROM (SELECT CAST(trunc(p_retailprice / 10) AS INTEGER) AS n_nationkey, p_name AS n_name FROM part)")
def insert_defaults_output(t: Tables) -> DataFrame:
    rows = t.part.select((F.col("p_retailprice") / 10).alias("n_nationkey"), F.col("p_name").alias("n_name"))
    out = dml.insert(t.nation, rows, {"n_regionkey": F.lit(-1)}).output
    return out.toDF("n_nationkey", "n_name", "n_regionkey")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN round(c_acctbal * 2, 2) ELSE c_acctbal END AS c_acctbal FROM customer")
def update_where(t: Tables) -> DataFrame:
    return dml.update(t.customer, {"c_acctbal": F.round(F.col("c_acctbal") * 2, 2)}, F.col("c_mktsegment") == "BUILDING").table.select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, coalesce(m, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, min(o_totalprice) AS m FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def update_from_join(t: Tables) -> DataFrame:
    source = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_totalprice").alias("m"))
    return dml.update(t.customer, {"c_acctbal": F.col("s_m")}, source=source, keys=["c_custkey"]).table.select("c_custkey", "c_acctbal")


@query("SELECT n_nationkey AS id, n_regionkey AS old, CAST(n_regionkey + 10 AS INTEGER) AS new FROM nation WHERE n_nationkey < 10")
def update_output(t: Tables) -> DataFrame:
    out = dml.update(t.nation, {"n_regionkey": F.col("n_regionkey") + 10}, F.col("n_nationkey") < 10).output
    return out.select(F.col("deleted_n_nationkey").alias("id"), F.col("deleted_n_regionkey").alias("old"), F.col("inserted_n_regionkey").alias("new"))


@query("SELECT s_suppkey, CASE WHEN n_name IS NULL THEN 'none' ELSE n_name END AS s_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey = 1")
def update_outer_join(t: Tables) -> DataFrame:
    source = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("label"))
    return dml.update(t.supplier, {"s_name": F.coalesce(F.col("s_label"), F.lit("none"))}, source=source, keys=["s_nationkey"], how="left").table.select("s_suppkey", "s_name")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P' AND o_totalprice < 50000)")
def delete_where(t: Tables) -> DataFrame:
    return dml.delete(t.orders, (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 50000)).table.select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def delete_from_join_output(t: Tables) -> DataFrame:
    source = t.orders.where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return dml.delete(t.customer, source=source, keys=["c_custkey"]).output.select(F.col("deleted_c_custkey").alias("c_custkey"))


def _merge(t: Tables) -> dml.Changed:
    target = t.customer.where("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_acctbal")
    source = t.customer.where("c_nationkey < 12").select("c_custkey", (F.col("c_acctbal") + 1000).alias("bal"))
    return dml.merge(target, source, ["c_custkey"], [
        dml.Arm("matched", "delete", condition=F.col("s_bal") < 1000),
        dml.Arm("matched", "update", {"c_acctbal": F.round(F.col("s_bal"), 2)}),
        dml.Arm("by_target", "insert", {"c_custkey": F.col("s_c_custkey"), "c_acctbal": F.lit(0.0)}),
        dml.Arm("by_source", "delete", condition=F.col("c_acctbal") < 0),
    ])


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 WHEN c_nationkey < 12 THEN round(c_acctbal + 1000, 2) ELSE c_acctbal END AS c_acctbal FROM customer
WHERE CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey < 12 WHEN c_nationkey < 12 THEN c_acctbal + 1000 >= 1000 ELSE c_acctbal >= 0 END""")
def merge_all_arms(t: Tables) -> DataFrame:
    return _merge(t).table


@query("""SELECT action, count(*) AS n FROM (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'INSERT' WHEN c_nationkey < 12 THEN CASE WHEN c_acctbal + 1000 < 1000 THEN 'DELETE' ELSE 'UPDATE' END WHEN c_acctbal < 0 THEN 'DELETE' END AS action
FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_nationkey >= 12)) WHERE action IS NOT NULL GROUP BY action""")
def merge_output_actions(t: Tables) -> DataFrame:
    return _merge(t).output.groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey < 4 THEN r_name ELSE n_name END AS n_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def merge_rows_of_one_key(t: Tables) -> DataFrame:
    source = t.region.where("r_regionkey < 4").withColumnRenamed("r_regionkey", "n_regionkey")  # a key is one source row's and several target rows'
    return dml.merge(t.nation, source, ["n_regionkey"], [dml.Arm("matched", "update", {"n_name": F.col("s_r_name")})]).table


@query("SELECT * FROM region WHERE FALSE")
def truncate_table(t: Tables) -> DataFrame:
    return dml.truncate(t.region)


@query("SELECT o_custkey, count(*) AS rows FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def check_unique(t: Tables) -> DataFrame:
    return dml.check_key(t.orders, ["o_custkey"])


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def check_foreign_key(t: Tables) -> DataFrame:
    return dml.check_reference(t.supplier, ["s_nationkey"], t.nation.where("n_regionkey < 3"), ["n_nationkey"]).select("s_suppkey")


@query("SELECT p_partkey FROM part WHERE NOT (p_size < 45)")
def check_constraint(t: Tables) -> DataFrame:
    return dml.check_condition(t.part, F.col("p_size") < 45).select("p_partkey")


@query("SELECT p_partkey, 10 + 5 * (row_number() OVER (ORDER BY p_partkey) - 1) AS id FROM part")
def identity_column(t: Tables) -> DataFrame:
    return dml.identity(t.part.select("p_partkey"), "id", 10, 5, "p_partkey")



def _count() -> list[Column]:
    return [F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")]


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def tumbling_window(t: Tables) -> DataFrame:
    return sw.tumbling(t.events, "ts", "6 hours", *_count(), keys=("event_type",))


@query("SELECT s AS window_start, s + INTERVAL 6 HOUR AS window_end, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT value, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(3 * k) AS s FROM events, range(0, 2) AS r(k)) GROUP BY s")
def sliding_window(t: Tables) -> DataFrame:
    return sw.sliding(t.events, "ts", "6 hours", "3 hours", *_count())


@query("""SELECT min(ts) AS window_start, max(ts) + INTERVAL 2 HOUR AS window_end, user_id, count(*) AS n, round(sum(value), 3) AS total FROM (
SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, g""")
def session_window(t: Tables) -> DataFrame:
    return sw.session(t.events, "ts", "2 hours", *_count(), keys=("user_id",))
