"""Queries given as text of the dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.registry import ORACLES, QUERIES, TABLES
from tessera.session import Engine


def text_query(name: str, sql: str, oracle: str) -> None:
    """Register a batch of the dialect; its last result is the query's."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = [t for t in TABLES if t in sql.lower()]
        return Engine.over(spark, sf_dir, used).batch(sql)[-1]

    QUERIES[name] = run
    ORACLES[name] = oracle


text_query("tsql_top_join_group", """
    SELECT TOP (5) n.n_name AS name, COUNT(*) AS cnt, MAX(o.o_totalprice) AS best
    FROM dbo.orders AS o WITH (NOLOCK) JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
    WHERE o.o_orderstatus = 'f' GROUP BY n.n_name ORDER BY cnt DESC, name""",
    "SELECT n_name AS name, CAST(count(*) AS INTEGER) AS cnt, max(o_totalprice) AS best FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name ORDER BY cnt DESC, name LIMIT 5")
text_query("tsql_outer_apply", """
    SELECT c.c_custkey, x.n, x.last_key FROM customer c
    OUTER APPLY (SELECT COUNT(*) AS n, MAX(o_orderkey) AS last_key FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 100000) x""",
    "SELECT c_custkey, CAST(coalesce(n, 0) AS INTEGER) AS n, last_key FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last_key FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey) ON o_custkey = c_custkey")
text_query("tsql_percent_ties", "SELECT TOP (3) WITH TIES p_partkey, p_size FROM part WHERE p_size % 2 = 0 ORDER BY p_size DESC",
    "SELECT p_partkey, p_size FROM part WHERE p_size % 2 = 0 QUALIFY rank() OVER (ORDER BY p_size DESC) <= 3")
text_query("tsql_window_names", "SELECT event_id, ROW_NUMBER() OVER w AS rn, LAG(event_id, 1) OVER w AS before FROM events WINDOW p AS (PARTITION BY user_id), w AS (p ORDER BY ts, event_id)",
    "SELECT event_id, row_number() OVER w AS rn, lag(event_id, 1) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
text_query("tsql_integer_rules", "SELECT p_partkey, p_size / 4 AS q, '10' + p_size AS s, CAST(p_size AS varchar(1)) AS v, AVG(p_size) OVER (PARTITION BY p_brand) AS m FROM part",
    "SELECT p_partkey, CAST(p_size // 4 AS INTEGER) AS q, CAST(10 + p_size AS INTEGER) AS s, CASE WHEN p_size > 9 THEN '*' ELSE CAST(p_size AS VARCHAR) END AS v, CAST(sum(p_size) OVER (PARTITION BY p_brand) // count(*) OVER (PARTITION BY p_brand) AS INTEGER) AS m FROM part")
text_query("tsql_recursive_cte", "WITH t(k, d) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.d + 1 FROM nation n JOIN t ON (n.n_nationkey - 1) / 2 = t.k AND n.n_nationkey > 0) SELECT k, d FROM t",
    "WITH RECURSIVE t(k, d) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.d + 1 FROM nation n JOIN t ON (n.n_nationkey - 1) // 2 = t.k AND n.n_nationkey > 0) SELECT k, d FROM t")
text_query("tsql_json_shredding", "SELECT e.event_id, j.[key] AS k, j.value AS v FROM events e CROSS APPLY OPENJSON(e.props) j WHERE e.event_type = 'view'",
    "SELECT event_id, 'k' AS k, json_extract_string(props, '$.k') AS v FROM events WHERE event_type = 'view'")
text_query("tsql_update_then_select", """
    DECLARE @limit float = 5000;
    UPDATE c SET c_acctbal = 0 FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE n.n_regionkey = 1 AND c.c_acctbal > @limit;
    DELETE FROM customer WHERE c_mktsegment LIKE '[a-b]%';
    SELECT c_custkey, c_acctbal FROM customer""",
    "SELECT c_custkey, CASE WHEN n_regionkey = 1 AND c_acctbal > 5000 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE NOT regexp_matches(c_mktsegment, '(?i)^[a-b]')")
text_query("tsql_dates_and_styles", "SELECT o_orderkey, DATEDIFF(week, '1996-01-01', o_orderdate) AS w, CONVERT(varchar(10), o_orderdate, 104) AS s, EOMONTH(o_orderdate) AS e FROM orders WHERE DATEPART(weekday, o_orderdate) = 1",
    "SELECT o_orderkey, CAST((date_diff('day', DATE '1970-01-04', CAST(o_orderdate AS DATE)) + 70000) // 7 - (date_diff('day', DATE '1970-01-04', DATE '1996-01-01') + 70000) // 7 AS INTEGER) AS w, strftime(o_orderdate, '%d.%m.%Y') AS s, last_day(CAST(o_orderdate AS DATE)) AS e FROM orders WHERE dayofweek(o_orderdate) = 0")
text_query("tsql_grouping_sets", "SELECT o_orderstatus AS s, o_orderpriority AS p, GROUPING(o_orderstatus) AS g, SUM(CASE WHEN o_totalprice > 50000 THEN 1 ELSE 0 END) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())",
    "SELECT o_orderstatus AS s, o_orderpriority AS p, CAST(grouping(o_orderstatus) AS TINYINT) AS g, CAST(sum(CASE WHEN o_totalprice > 50000 THEN 1 ELSE 0 END) AS INTEGER) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())")

# statements that define and change

text_query("tsql_scalar_function", """
    CREATE FUNCTION dbo.band(@price float, @least float = 50000) RETURNS varchar(10) AS
    BEGIN
        DECLARE @out varchar(10) = 'low';
        IF @price > 2 * @least RETURN 'high';
        IF @price > @least SET @out = 'middle' ELSE SET @out = LOWER('LOW');
        RETURN @out
    END;
    GO
    SELECT o_orderkey, dbo.band(o_totalprice, DEFAULT) AS band FROM orders""",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'low' END AS band FROM orders")
text_query("tsql_scalar_function_with_query", """
    CREATE FUNCTION dbo.held(@key bigint) RETURNS int AS
    BEGIN
        DECLARE @n int;
        SELECT @n = COUNT(*) FROM orders WHERE o_custkey = @key;
        RETURN ISNULL(@n, 0)
    END;
    GO
    SELECT c_custkey, dbo.held(c_custkey) AS n FROM customer""",
    "SELECT c_custkey, CAST(coalesce(n, 0) AS INTEGER) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
text_query("tsql_inline_function", """
    CREATE FUNCTION dbo.dear(@key bigint, @least float) RETURNS TABLE AS RETURN (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = @key AND o_totalprice > @least);
    GO
    SELECT c.c_custkey, d.o_orderkey FROM customer c CROSS APPLY dbo.dear(c.c_custkey, 100000) d""",
    "SELECT o_custkey AS c_custkey, o_orderkey FROM orders WHERE o_totalprice > 100000")
text_query("tsql_table_function", """
    CREATE FUNCTION dbo.regions(@least int) RETURNS @out TABLE (id int PRIMARY KEY, label varchar(20) DEFAULT 'none') AS
    BEGIN
        INSERT INTO @out (id, label) SELECT r_regionkey, r_name FROM region WHERE r_regionkey >= @least;
        INSERT INTO @out (id) VALUES (100);
        RETURN
    END;
    GO
    SELECT id, label FROM dbo.regions(2) AS r""",
    "SELECT r_regionkey AS id, r_name AS label FROM region WHERE r_regionkey >= 2 UNION ALL SELECT 100, 'none'")
text_query("tsql_defaults_and_computed", """
    CREATE TABLE stock (id int IDENTITY(10, 5) PRIMARY KEY, part bigint NOT NULL, qty int DEFAULT 3, price float, total AS qty * price, note varchar(10) NULL);
    INSERT INTO stock (part, price) SELECT p_partkey, p_retailprice FROM part;
    UPDATE stock SET qty = 2 * qty, note = 'big' WHERE price > 950;
    SELECT id, part, qty, total, note FROM stock""",
    "SELECT CAST(10 + 5 * (row_number() OVER (ORDER BY p_partkey, p_retailprice) - 1) AS INTEGER) AS id, p_partkey AS part, CAST(CASE WHEN p_retailprice > 950 THEN 6 ELSE 3 END AS INTEGER) AS qty, CASE WHEN p_retailprice > 950 THEN 6 ELSE 3 END * p_retailprice AS total, CASE WHEN p_retailprice > 950 THEN 'big' END AS note FROM part")
text_query("tsql_alter_table", """
    SELECT n_nationkey AS id, n_name AS name INTO #n FROM nation;
    ALTER TABLE #n ADD tag varchar(5) NOT NULL DEFAULT 'new', twice AS id * 2;
    ALTER TABLE #n ALTER COLUMN id bigint;
    ALTER TABLE #n DROP COLUMN name;
    INSERT INTO #n (id) VALUES (1000);
    SELECT id, tag, twice FROM #n""",
    "SELECT CAST(n_nationkey AS BIGINT) AS id, 'new' AS tag, CAST(2 * n_nationkey AS BIGINT) AS twice FROM nation UNION ALL SELECT 1000, 'new', 2000")
for _name, _sql, _number in (
    ("check", "INSERT INTO t VALUES (2, -1, 1)", 547), ("primary_key", "INSERT INTO t VALUES (1, 5, 1)", 2627), ("not_null", "INSERT INTO t VALUES (NULL, 5, 1)", 515), ("foreign_key", "UPDATE t SET r = 77", 547),
    ("referenced", "DELETE FROM parent WHERE r_regionkey = 1", 547), ("computed_change", "UPDATE t SET d = 1", 271), ("alias_in_where", "SELECT id AS x FROM t WHERE x = 1", 207), ("window_in_where", "SELECT id FROM t WHERE ROW_NUMBER() OVER (ORDER BY id) = 1", 4108),
    ("aggregate_in_group", "SELECT COUNT(*) FROM t GROUP BY COUNT(*)", 144), ("ordered_view", "SELECT id FROM (SELECT id FROM t ORDER BY id) AS x", 1033), ("sum_overflow", "SELECT 2147483647 + id FROM t", 8115), ("group_constant", "SELECT COUNT(*) FROM t GROUP BY 1", 164),
):
    text_query(f"tsql_error_{_name}", f"""
        SELECT r_regionkey, r_name INTO parent FROM region;
        CREATE TABLE t (id int NOT NULL, q int CHECK (q > 0), r int, d AS q + 1, CONSTRAINT pk PRIMARY KEY (id), FOREIGN KEY (r) REFERENCES parent (r_regionkey));
        INSERT INTO t VALUES (1, 1, 1);
        BEGIN TRY
            {_sql};
            SELECT 0 AS n
        END TRY
        BEGIN CATCH
            SELECT ERROR_NUMBER() AS n
        END CATCH""",
        f"SELECT CAST({_number} AS INTEGER) AS n")
text_query("tsql_rowcount", """
    DECLARE @changed int, @gone int;
    UPDATE customer SET c_acctbal = 0 WHERE c_acctbal < 0;
    SET @changed = @@ROWCOUNT;
    DELETE FROM customer WHERE c_mktsegment = 'building';
    SET @gone = @@ROWCOUNT;
    SELECT @changed AS changed, @gone AS gone""",
    "SELECT CAST(count(*) FILTER (c_acctbal < 0) AS INTEGER) AS changed, CAST(count(*) FILTER (c_mktsegment = 'BUILDING') AS INTEGER) AS gone FROM customer")
text_query("tsql_scope_identity", """
    CREATE TABLE ids (k int IDENTITY(7, 3), n int);
    INSERT INTO ids (n) SELECT n_nationkey FROM nation;
    INSERT INTO ids DEFAULT VALUES;
    SELECT SCOPE_IDENTITY() AS last, IDENT_SEED('ids') AS seed, IDENT_INCR('ids') AS step, @@ROWCOUNT AS n""",
    "SELECT CAST(7 + 3 * count(*) AS DECIMAL(38,0)) AS last, CAST(7 AS DECIMAL(38,0)) AS seed, CAST(3 AS DECIMAL(38,0)) AS step, CAST(1 AS INTEGER) AS n FROM nation")
text_query("tsql_executesql", """
    DECLARE @n int;
    EXEC sp_executesql N'SELECT @out = COUNT(*) FROM orders WHERE o_totalprice > @least', N'@least float, @out int OUTPUT', @least = 100000, @out = @n OUTPUT;
    SELECT @n AS n""",
    "SELECT CAST(count(*) AS INTEGER) AS n FROM orders WHERE o_totalprice > 100000")
text_query("tsql_procedure_output", """
    CREATE PROCEDURE dbo.totals @seg varchar(20), @n int OUTPUT, @least float = 0 AS
    BEGIN
        SELECT @n = COUNT(*) FROM customer WHERE c_mktsegment = @seg AND c_acctbal >= @least;
        RETURN 42
    END
    GO
    DECLARE @got int, @rc int;
    EXEC @rc = dbo.totals 'building', @got OUTPUT, @least = 1000;
    SELECT @got AS got, @rc AS rc""",
    "SELECT CAST(count(*) AS INTEGER) AS got, CAST(42 AS INTEGER) AS rc FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000")
text_query("tsql_insert_exec", """
    CREATE PROCEDURE big AS SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000
    GO
    DECLARE @t TABLE (id bigint, price float);
    INSERT INTO @t EXEC big;
    SELECT id, price FROM @t""",
    "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_totalprice > 100000")
text_query("tsql_output_into", """
    DECLARE @log TABLE (id bigint, before float, after float);
    UPDATE customer SET c_acctbal = c_acctbal + 1 OUTPUT inserted.c_custkey, deleted.c_acctbal, inserted.c_acctbal INTO @log WHERE c_nationkey = 3;
    SELECT id, before, after FROM @log""",
    "SELECT c_custkey AS id, c_acctbal AS before, c_acctbal + 1 AS after FROM customer WHERE c_nationkey = 3")
text_query("tsql_merge_top", """
    MERGE TOP (3) INTO nation AS t USING region AS s ON t.n_regionkey = s.r_regionkey WHEN MATCHED THEN UPDATE SET n_name = s.r_name;
    SELECT COUNT(*) AS n FROM nation WHERE n_name NOT LIKE 'nation%'""",
    "SELECT CAST(3 AS INTEGER) AS n")
text_query("tsql_update_of_several", """
    UPDATE c SET c_acctbal = o.o_totalprice, c_name = o.o_orderpriority FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey;
    SELECT c_custkey, c_acctbal, c_name FROM customer""",
    "SELECT c_custkey, coalesce(p, c_acctbal) AS c_acctbal, coalesce(r, c_name) AS c_name FROM customer LEFT JOIN (SELECT o_custkey, o_totalprice AS p, o_orderpriority AS r FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderpriority) = 1) ON o_custkey = c_custkey")
text_query("tsql_distinct_mixed", "SELECT DISTINCT x.v, x.k FROM (SELECT c_mktsegment AS v, c_nationkey AS k FROM customer UNION ALL SELECT LOWER(c_mktsegment), c_nationkey FROM customer) x",
    "SELECT DISTINCT c_mktsegment AS v, c_nationkey AS k FROM customer")
text_query("tsql_rand", "SELECT ROUND(RAND(42), 12) AS r", "SELECT 0.714355945035::DOUBLE AS r")
text_query("tsql_pivot", "SELECT o_orderpriority, [F], [O], [P] FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) AS s PIVOT (COUNT(o_orderkey) FOR o_orderstatus IN ([F], [O], [P])) AS p",
    "SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'F') AS INTEGER) AS F, CAST(count(*) FILTER (o_orderstatus = 'O') AS INTEGER) AS O, CAST(count(*) FILTER (o_orderstatus = 'P') AS INTEGER) AS P FROM orders GROUP BY o_orderpriority")
text_query("tsql_unpivot", "SELECT c_custkey, what, amount FROM (SELECT c_custkey, c_acctbal AS balance, NULLIF(c_acctbal, c_acctbal) AS nothing, c_acctbal * 2 AS twice FROM customer) AS s UNPIVOT (amount FOR what IN (balance, nothing, twice)) AS u",
    "SELECT c_custkey, 'balance' AS what, c_acctbal AS amount FROM customer UNION ALL SELECT c_custkey, 'twice', c_acctbal * 2 FROM customer")
text_query("tsql_tablesample", "SELECT COUNT(*) AS n FROM lineitem TABLESAMPLE SYSTEM (100 PERCENT) REPEATABLE (7)", "SELECT CAST(count(*) AS INTEGER) AS n FROM lineitem")
text_query("tsql_json_object", "SELECT n_nationkey, JSON_OBJECT('id': n_nationkey, 'name': NULLIF(n_name, 'NATION_1') ABSENT ON NULL) AS a, JSON_ARRAY(n_nationkey, NULL NULL ON NULL) AS b FROM nation",
    """SELECT n_nationkey, CASE WHEN n_name = 'NATION_1' THEN '{"id":' || n_nationkey || '}' ELSE '{"id":' || n_nationkey || ',"name":"' || n_name || '"}' END AS a, '[' || n_nationkey || ',null]' AS b FROM nation""")  # fmt: skip
text_query("tsql_parse", "SELECT o_orderkey, PARSE(CONVERT(varchar(10), o_orderdate, 23) AS date USING 'en-US') AS d, TRY_PARSE(o_orderpriority AS int) AS n FROM orders",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(NULL AS INTEGER) AS n FROM orders")
text_query("tsql_compress", "SELECT p_partkey, HASHBYTES('SHA2_256', DECOMPRESS(COMPRESS(CAST(p_name AS varbinary(100))))) AS h FROM part", "SELECT p_partkey, unhex(sha256(p_name)) AS h FROM part")
text_query("tsql_catalog_columns", "SELECT COLUMN_NAME AS c, ORDINAL_POSITION AS p, DATA_TYPE AS t FROM INFORMATION_SCHEMA.COLUMNS WHERE TABLE_NAME = 'region' ORDER BY 2", "SELECT * FROM (VALUES ('r_regionkey', 1, 'int'), ('r_name', 2, 'nvarchar')) AS v(c, p, t)")
text_query("tsql_catalog_objects", "SELECT t.name AS n, IIF(t.object_id = OBJECT_ID('dbo.nation', 'U'), 1, 0) AS same, IIF(OBJECT_ID('nowhere') IS NULL, 1, 0) AS missing FROM sys.tables t WHERE t.name = 'nation'", "SELECT 'nation' AS n, 1 AS same, 1 AS missing")
text_query("tsql_view", """
    CREATE VIEW rich AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000
    GO
    UPDATE customer SET c_acctbal = 0 WHERE c_nationkey < 10;
    SELECT c_custkey FROM rich""",
    "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 AND c_nationkey >= 10")
text_query("tsql_select_into", "SELECT n_regionkey AS r, COUNT(*) AS n INTO #t FROM nation GROUP BY n_regionkey; SELECT r, n FROM #t WHERE n > 0", "SELECT n_regionkey AS r, CAST(count(*) AS INTEGER) AS n FROM nation GROUP BY n_regionkey")
text_query("tsql_with_cube", "SELECT o_orderstatus AS s, o_orderpriority AS p, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority WITH CUBE", "SELECT o_orderstatus AS s, o_orderpriority AS p, CAST(count(*) AS INTEGER) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
text_query("tsql_any_value", "SELECT n_regionkey AS r, ANY_VALUE(n_regionkey * 2) AS v FROM nation GROUP BY n_regionkey", "SELECT n_regionkey AS r, CAST(n_regionkey * 2 AS INTEGER) AS v FROM nation GROUP BY n_regionkey")
text_query("tsql_partition_collated", "SELECT v, k, COUNT(*) OVER (PARTITION BY v) AS n FROM (SELECT LOWER(r_name) AS v, 1 AS k FROM region UNION ALL SELECT UPPER(r_name), 2 FROM region) AS x",
    "SELECT v, k, CAST(count(*) OVER (PARTITION BY lower(v)) AS INTEGER) AS n FROM (SELECT lower(r_name) AS v, 1 AS k FROM region UNION ALL SELECT upper(r_name), 2 FROM region)")
text_query("tsql_clock", "SELECT n_nationkey, IIF(GETDATE() > '2024-01-01' AND SYSDATETIME() >= GETUTCDATE() - 1, 1, 0) AS now, LEN(NEWID()) AS guid FROM nation", "SELECT n_nationkey, 1 AS now, CAST(36 AS INTEGER) AS guid FROM nation")
text_query("tsql_while_and_variables", """
    DECLARE @t TABLE (n int, square int);
    DECLARE @i int = 1;
    WHILE @i <= 5
    BEGIN
        INSERT INTO @t VALUES (@i, @i * @i);
        SET @i += 1
    END;
    SELECT n, square FROM @t""",
    "SELECT CAST(range AS INTEGER) AS n, CAST(range * range AS INTEGER) AS square FROM range(1, 6)")
text_query("tsql_isdate", "SELECT o_orderkey, ISDATE(CONVERT(varchar(10), o_orderdate, 23)) AS a, ISDATE(o_orderpriority) AS b FROM orders", "SELECT o_orderkey, CAST(1 AS INTEGER) AS a, CAST(0 AS INTEGER) AS b FROM orders")
text_query("tsql_datetime_casts", "SELECT event_id, CAST(CAST(ts AS date) AS datetime2) AS d, CAST('2024-02-29 10:11:12.123456' AS datetime2) AS x FROM events", "SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS d, TIMESTAMP '2024-02-29 10:11:12.123456' AS x FROM events")
text_query("tsql_large_literals", "SELECT p_partkey, 2147483648 AS a, 12345678901234567890123456789012345678 AS b, p_partkey * 3000000000 AS c FROM part", "SELECT p_partkey, 2147483648::BIGINT AS a, CAST('12345678901234567890123456789012345678' AS DECIMAL(38,0)) AS b, p_partkey * 3000000000::BIGINT AS c FROM part")
