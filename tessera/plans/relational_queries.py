"""Scans, predicates, joins, limits, set operations and recursion."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import strings as s
from tessera.operators import relational as r
from tessera.plans.registry import Tables, query, sql_query


@query("""SELECT n_name, CAST(count(*) AS INTEGER) AS cnt, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY n_name ORDER BY revenue DESC LIMIT 10""")
def flagship_top_nations(t: Tables) -> DataFrame:
    # amounts are summed per order before the join, so the large table is shuffled once, on its key
    dated = t.orders.where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_custkey")
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    amounts = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"), F.count("*").alias("lines"))
    j = amounts.join(dated, F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    return r.top(j.groupBy("n_name").agg(F.sum("lines").cast("int").alias("cnt"), F.round(F.sum("amount"), 2).alias("revenue")), 10, F.desc("revenue"))


sql_query("scan_table", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
sql_query("scan_projection_aliases", "SELECT c_custkey AS id, c_name AS name, c_nationkey + 1 AS next_nation FROM customer")


@query("SELECT * FROM (VALUES (1, 1.50::DECIMAL(4,2), 'a'), (2, 2.25::DECIMAL(4,2), 'b'), (3, NULL, 'c')) AS v(id, price, tag)")
def values_source(t: Tables) -> DataFrame:
    return r.values(t.spark, ["id", "price", "tag"], [(1, Decimal("1.50"), "a"), (2, Decimal("2.25"), "b"), (3, None, "c")]).withColumn("price", F.col("price").cast("decimal(4,2)"))


sql_query("cte_chained", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT o_custkey, n FROM per WHERE n > 2")
sql_query("derived_table", "SELECT d.seg, d.n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) AS d WHERE d.n > 10")


@query("SELECT CAST(range AS INTEGER) AS value FROM range(3, 1001, 7)")
def generate_series_int(t: Tables) -> DataFrame:
    return r.generate_series(t.spark, 3, 1000, 7)


@query("SELECT CAST(range / 100 AS DECIMAL(20,2)) AS value FROM range(0, 1001, 25)")
def generate_series_decimal(t: Tables) -> DataFrame:
    return r.generate_series(t.spark, Decimal("0.00"), Decimal("10.00"), Decimal("0.25"))


@query("SELECT CAST(range AS INTEGER) AS value FROM range(10, 0, -1)")
def generate_series_down(t: Tables) -> DataFrame:
    return r.generate_series(t.spark, 10, 1)


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS value FROM part")
def string_split_value(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", r.string_split(F.col("p_name"), " ").alias("value"))


@query("SELECT p_partkey, value, CAST(ordinal AS BIGINT) AS ordinal FROM part, unnest(string_split(p_type, ' ')) WITH ORDINALITY AS u(value, ordinal)")
def string_split_ordinal(t: Tables) -> DataFrame:
    split = t.part.select("p_partkey", r.string_split(F.col("p_type"), " ", ordinal=True).alias("ordinal", "value"))
    return split.select("p_partkey", "value", (F.col("ordinal") + 1).cast("long").alias("ordinal"))


# predicates

sql_query("where_comparisons", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 60000 AND o_orderstatus <> 'F'")
sql_query("where_not_and_or", "SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT (o_orderpriority = '1-URGENT' OR o_totalprice > 1000) OR o_orderstatus = 'P'")
sql_query("where_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
sql_query("where_in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
sql_query("where_not_in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
sql_query("where_is_null", "SELECT c_custkey FROM customer WHERE NULLIF(c_mktsegment, 'BUILDING') IS NULL")
sql_query("where_not_in_three_valued", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT NULLIF(n_nationkey, 3) FROM nation WHERE n_regionkey = 1 AND n_nationkey <> 3)")
sql_query("is_distinct_from", "SELECT c_custkey FROM customer WHERE NULLIF(c_nationkey, 5) IS DISTINCT FROM NULLIF(c_nationkey, 7)")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^[a-c].*o') AND NOT regexp_matches(p_name, '(?i)z.$')")
def like_sets(t: Tables) -> DataFrame:
    name = F.col("p_name")
    return t.part.where(s.like(name, "[a-c]%o%") & ~s.like(name, "%z_")).select("p_partkey", "p_name")


@query("SELECT doc_id FROM documents WHERE contains(text, '%') AND NOT contains(lower(text), 'the ')")
def like_escape(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.where(s.like(text, "%!%%", "!") & ~s.like(text, "%the %")).select("doc_id")


@query("SELECT p_partkey FROM part WHERE NOT regexp_matches(p_brand, '[^A-Za-z#0-9]') AND regexp_matches(p_brand, '(?i)^b[^a-m].*[1-3]$')")
def like_negated_set(t: Tables) -> DataFrame:
    return t.part.where(~s.like(F.col("p_brand"), "%[^A-Za-z#0-9]%") & s.like(F.col("p_brand"), "b[^a-m]%[1-3]")).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE lower(rtrim(c_mktsegment || '  ')) = 'building'")
def equals_ignoring_case(t: Tables) -> DataFrame:
    return t.customer.where(s.ci(F.concat("c_mktsegment", F.lit("  "))) == s.ci(F.lit("Building"))).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def collate_binary(t: Tables) -> DataFrame:
    return t.customer.where(s.collate(F.col("c_mktsegment"), "Latin1_General_100_BIN2") == s.collate(F.lit("BUILDING"), "Latin1_General_100_BIN2")).select("c_custkey")


sql_query("exists_correlated", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
sql_query("not_exists_correlated", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
sql_query("in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
sql_query("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)")
sql_query("scalar_subquery_correlated", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer")


@query("SELECT p_partkey FROM part WHERE p_size > ALL (SELECT p_size FROM part WHERE p_size < 45)")
def greater_than_all(t: Tables) -> DataFrame:
    return r.compare_all(t.part, F.col("p_size"), ">", t.part.where("p_size < 45").select(F.col("p_size").alias("other"))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size < ANY (SELECT p_size FROM part WHERE p_size < 5)")
def less_than_any(t: Tables) -> DataFrame:
    return r.compare_any(t.part, F.col("p_size"), "<", t.part.where("p_size < 5").select(F.col("p_size").alias("other"))).select("p_partkey")


# joins

sql_query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
sql_query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 150000")
sql_query("join_right", "SELECT o_orderkey, n_name FROM (SELECT * FROM nation WHERE n_regionkey = 1) AS n RIGHT JOIN (SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey) AS o ON n_nationkey = c_nationkey")
sql_query("join_full", "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM (SELECT * FROM nation WHERE n_nationkey < 15) AS a FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 8) AS b ON a.n_nationkey = b.n_nationkey")
sql_query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql_query("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
sql_query("join_nested", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey")
sql_query("join_self", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql_query("join_theta", "SELECT a.r_name AS low, b.r_name AS high FROM region AS a JOIN region AS b ON a.r_regionkey < b.r_regionkey")
sql_query("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
sql_query("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') AS p ON o_custkey = c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
sql_query("join_five_tables", "SELECT r_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")


@query("SELECT r_regionkey, n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 5) AS n")
def cross_apply(t: Tables) -> DataFrame:
    n = t.nation
    return r.apply(t.region, lambda: n.where((F.col("n_regionkey") == F.col("r_regionkey").outer()) & (F.col("n_nationkey") > 5)).select("n_name")).select("r_regionkey", "n_name")


@query("SELECT r_regionkey, n_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 20")
def outer_apply(t: Tables) -> DataFrame:
    n = t.nation
    return r.apply(t.region, lambda: n.where((F.col("n_regionkey") == F.col("r_regionkey").outer()) & (F.col("n_nationkey") > 20)).select("n_name"), outer=True).select("r_regionkey", "n_name")


@query("SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) AS best")
def cross_apply_top(t: Tables) -> DataFrame:
    # the limit stands on the order itself: with a projection between them, as from this text, Spark numbers each key's rows as they arrive
    o = t.orders
    best = lambda: r.top(o.where(F.col("o_custkey") == F.col("c_custkey").outer()), 2, F.desc_nulls_last("o_totalprice"), F.asc_nulls_last("o_orderkey"))
    return r.apply(t.customer, lambda: best().select("o_orderkey")).select("c_custkey", "o_orderkey")


@query("""SELECT c_custkey, k AS status, a.n AS before_1997, b.n AS after_1997 FROM customer
JOIN ((SELECT o_custkey, o_orderstatus AS k, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY ALL) AS a
FULL JOIN (SELECT o_custkey, o_orderstatus AS k, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY ALL) AS b USING (o_custkey, k)) ON o_custkey = c_custkey""")
def apply_full_join(t: Tables) -> DataFrame:
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    a = o.where(F.col("o_orderdate") < cut).groupBy("c_custkey", "status").agg(F.count("*").alias("before_1997"))
    b = o.where(F.col("o_orderdate") >= cut).groupBy("c_custkey", "status").agg(F.count("*").alias("after_1997"))
    return r.apply_full_join(t.customer.select("c_custkey"), "c_custkey", a, b, ["status"])


@query("""SELECT o_orderkey, e.event_id FROM (SELECT o_orderkey, o_custkey % 15 AS user_id, o_orderdate + INTERVAL 10000 DAY AS at FROM orders) AS o
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY user_id, ts) AS e ON o.user_id = e.user_id AND o.at >= e.ts""")
def join_asof(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", (F.col("o_custkey") % 15).alias("user_id"), (F.col("o_orderdate") + F.expr("INTERVAL 10000 DAY")).alias("at"))
    e = t.events.groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return r.asof_join(o, e, "user_id", "at", "ts", ["event_id"]).select("o_orderkey", "event_id")


@query("""SELECT o_orderkey, e.event_id FROM (SELECT o_orderkey, o_custkey % 15 AS user_id, o_orderdate + INTERVAL 10000 DAY AS at FROM orders) AS o
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY user_id, ts) AS e ON o.user_id = e.user_id AND o.at >= e.ts""")
def join_asof_in_buckets(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", (F.col("o_custkey") % 15).alias("user_id"), (F.col("o_orderdate") + F.expr("INTERVAL 10000 DAY")).alias("at"))
    e = t.events.groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return r.asof_join(o, e, "user_id", "at", "ts", ["event_id"], bucket="day").select("o_orderkey", "event_id")


@query("SELECT p_partkey, lo FROM part JOIN (SELECT range AS lo, range + 150 AS hi FROM range(900, 1500, 100)) ON p_retailprice >= lo AND p_retailprice < hi")
def join_band(t: Tables) -> DataFrame:
    bands = t.spark.range(900, 1500, 100).select(F.col("id").alias("lo"), (F.col("id") + 150).alias("hi"))
    return r.band_join(t.part, bands, "p_retailprice", "lo", "hi", 100.0).select("p_partkey", "lo")


# limits

@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_n(t: Tables) -> DataFrame:
    return r.top(t.orders.select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT (SELECT CAST(ceil(count(*) * 2.5 / 100) AS BIGINT) FROM orders)")
def top_percent(t: Tables) -> DataFrame:
    return r.top_percent(t.orders.select("o_orderkey", "o_totalprice"), 2.5, F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey")


@query("SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 30")
def top_with_ties(t: Tables) -> DataFrame:
    return r.top_with_ties(t.part.select("p_partkey", "p_size"), 30, ("p_size", "desc"))


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def offset_fetch(t: Tables) -> DataFrame:
    return r.offset_fetch(t.customer, 40, 20, F.desc("c_acctbal"), F.asc("c_custkey")).select("c_custkey")


sql_query("order_nulls_lowest", "SELECT o_orderkey FROM (SELECT o_orderkey, NULLIF(o_orderpriority, '1-URGENT') AS p FROM orders) AS x ORDER BY p, o_orderkey LIMIT 15", "SELECT o_orderkey FROM (SELECT o_orderkey, NULLIF(o_orderpriority, '1-URGENT') AS p FROM orders) AS x ORDER BY p NULLS FIRST, o_orderkey LIMIT 15")

# sets, recursion, shape

sql_query("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")


@query("SELECT min(v) AS v FROM (SELECT c_mktsegment AS v FROM customer UNION ALL SELECT lower(c_mktsegment) || ' ' FROM customer) GROUP BY lower(rtrim(v))")
def distinct_ignoring_case(t: Tables) -> DataFrame:
    both = t.customer.select(F.col("c_mktsegment").alias("v")).unionAll(t.customer.select(F.concat(F.lower("c_mktsegment"), F.lit(" "))))
    return r.distinct_ci(both, "v")


@query("SELECT CAST(n_nationkey AS DECIMAL(12,2)) AS k FROM nation UNION ALL SELECT CAST(p_retailprice AS DECIMAL(8,2)) FROM part")
def union_all_common_type(t: Tables) -> DataFrame:
    return r.set_operation("union all", t.nation.select(F.col("n_nationkey").alias("k")), t.part.select(F.col("p_retailprice").cast("decimal(8,2)").alias("k"))).select(F.col("k").cast("decimal(12,2)").alias("k"))


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(t: Tables) -> DataFrame:
    return r.set_operation("union", t.supplier.select(F.col("s_nationkey").alias("k")), t.customer.select("c_nationkey"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def intersect(t: Tables) -> DataFrame:
    o = t.orders
    return r.set_operation("intersect", o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 150000")
def except_(t: Tables) -> DataFrame:
    return r.set_operation("except", t.customer.select(F.col("c_custkey").alias("k")), t.orders.where("o_totalprice > 150000").select("o_custkey"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def intersect_all(t: Tables) -> DataFrame:
    o = t.orders
    return r.set_operation("intersect all", o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def except_all(t: Tables) -> DataFrame:
    o = t.orders
    return r.set_operation("except all", o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("WITH RECURSIVE f(n, v) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, v * (n + 1) FROM f WHERE n < 15) SELECT n, v FROM f")
def recursive_factorial(t: Tables) -> DataFrame:
    return r.recursive(t.spark, "f", ["n", "v"], "SELECT 1, CAST(1 AS BIGINT)", "SELECT n + 1, v * (n + 1) FROM f WHERE n < 15", "SELECT n, v FROM f")


@query("""WITH RECURSIVE tree(k, name, depth) AS (SELECT n_nationkey, n_name, 0 FROM nation WHERE n_nationkey = 0
UNION ALL SELECT n.n_nationkey, n.n_name, depth + 1 FROM nation AS n JOIN tree ON (n.n_nationkey - 1) // 2 = k AND n.n_nationkey > 0) SELECT k, name, depth FROM tree""")
def recursive_tree(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("nation")
    step = "SELECT n.n_nationkey, n.n_name, depth + 1 FROM nation AS n JOIN tree ON (n.n_nationkey - 1) div 2 = k AND n.n_nationkey > 0"
    return r.recursive(t.spark, "tree", ["k", "name", "depth"], "SELECT n_nationkey, n_name, 0 FROM nation WHERE n_nationkey = 0", step, "SELECT k, name, depth FROM tree", 50)


@query("SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS f, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS o FROM orders GROUP BY o_orderpriority")
def pivot(t: Tables) -> DataFrame:
    return r.pivot(t.orders, ["o_orderpriority"], "o_orderstatus", ["F", "O"], F.count(F.lit(1))).toDF("o_orderpriority", "f", "o")


@query("SELECT s_suppkey, 'nation' AS what, CAST(s_nationkey AS BIGINT) AS v FROM supplier UNION ALL SELECT s_suppkey, 'key', s_suppkey FROM supplier WHERE s_suppkey <> 7")
def unpivot(t: Tables) -> DataFrame:
    wide = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("long").alias("nation"), F.nullif("s_suppkey", F.lit(7).cast("long")).alias("key"))
    return r.unpivot(wide, ["s_suppkey"], ["nation", "key"], "what", "v")
