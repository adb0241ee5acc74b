"""Batches of the dialect from text, on small tables."""

from decimal import Decimal

import pytest

from tessera.errors import EngineError
from tessera.session import Engine


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.tables["items"] = spark.createDataFrame([(1, "Pen", 10, 1.5), (2, "pen ", None, 2.0), (3, "Ink", 20, 9.0), (4, "Pad", 20, 3.0)], "id int, name string, qty int, price double")
    e.tables["orders"] = spark.createDataFrame([(10, 1, 3), (11, 1, 4), (12, 3, 5), (13, 9, 1)], "oid int, item int, n int")
    return e


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(("sql", "expected"), [
    ("SELECT 7 / 2, -7 % 3, '1' + 2, '1' + '2', 1 + NULL", [(3, -1, 3, "12", None)]),
    ("SELECT CAST(2 AS decimal(5,2)) / CAST(3 AS decimal(5,2))", [(Decimal("0.66666666"),)]),
    ("SELECT TOP (2) id FROM items ORDER BY price DESC", [(3,), (4,)]),
    ("SELECT TOP 50 PERCENT id FROM items ORDER BY id", [(1,), (2,)]),
    ("SELECT TOP (1) WITH TIES id, qty FROM items ORDER BY qty DESC", [(3, 20), (4, 20)]),
    ("SELECT id FROM items ORDER BY id OFFSET 1 ROWS FETCH NEXT 2 ROWS ONLY", [(2,), (3,)]),
    ("SELECT [id] AS [the id] FROM dbo.items WHERE name = 'PEN' ORDER BY 1", [(1,), (2,)]),
    ("SELECT COUNT(*), COUNT(qty), AVG(qty), SUM(qty), MIN(name) FROM items", [(4, 3, 16, 50, "Ink")]),
    ("SELECT qty, COUNT(*) AS c FROM items GROUP BY qty HAVING COUNT(*) > 1", [(20, 2)]),
    ("SELECT qty AS q FROM items ORDER BY q, id DESC", [(None,), (10,), (20,), (20,)]),
    ("SELECT i.id, o.n FROM items i LEFT JOIN orders AS o ON o.item = i.id ORDER BY i.id, o.n", [(1, 3), (1, 4), (2, None), (3, 5), (4, None)]),
    ("SELECT i.id, x.t FROM items i CROSS APPLY (SELECT SUM(n) AS t FROM orders WHERE item = i.id) x ORDER BY i.id", [(1, 7), (2, None), (3, 5), (4, None)]),
    ("SELECT i.id, s.value FROM items i CROSS APPLY STRING_SPLIT('a,b', ',') s WHERE i.id = 1 ORDER BY 2", [(1, "a"), (1, "b")]),
    ("SELECT id FROM items i WHERE EXISTS (SELECT 1 FROM orders WHERE item = i.id) ORDER BY id", [(1,), (3,)]),
    ("SELECT id FROM items WHERE id NOT IN (SELECT item FROM orders) ORDER BY id", [(2,), (4,)]),
    ("SELECT id FROM items WHERE price > ALL (SELECT price FROM items WHERE id < 3) ORDER BY id", [(3,), (4,)]),
    ("SELECT id, (SELECT MAX(n) FROM orders WHERE item = id) AS m FROM items ORDER BY id", [(1, 4), (2, None), (3, 5), (4, None)]),
    ("SELECT id FROM items WHERE name LIKE '[p]_n%' AND qty IS NOT NULL", [(1,)]),
    ("SELECT id, ROW_NUMBER() OVER (PARTITION BY qty ORDER BY id) AS rn, SUM(price) OVER w AS s FROM items WHERE qty = 20 WINDOW w AS (ORDER BY id) ORDER BY id", [(3, 1, 9.0), (4, 2, 12.0)]),
    ("WITH t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 4) SELECT SUM(n) FROM t", [(10,)]),
    ("SELECT id FROM items WHERE id < 3 UNION SELECT item FROM orders ORDER BY id", [(1,), (2,), (3,), (9,)]),
    ("SELECT v.a, v.b FROM (VALUES (1, 'x'), (2, NULL)) AS v(a, b) ORDER BY a", [(1, "x"), (2, None)]),
    ("SELECT value FROM GENERATE_SERIES(1, 7, 3) ORDER BY value", [(1,), (4,), (7,)]),
    ("SELECT LEN('ab  '), ISNULL(NULL, 5), IIF(1 > 2, 'y', 'n'), CHOOSE(2, 'a', 'b'), CONVERT(varchar(10), CAST('2024-05-06' AS date), 103)", [(2, 5, "n", "b", "06/05/2024")]),
    ("SELECT DATEDIFF(month, '2024-01-31', '2024-02-01'), DATEPART(weekday, '2024-01-07')", [(1, 1)]),
    ("SELECT CASE WHEN id = 1 THEN 'one' ELSE NULL END AS c, CASE qty WHEN 20 THEN 1 ELSE 0 END FROM items ORDER BY id", [("one", 0), (None, 0), (None, 1), (None, 1)]),
    ("SELECT qty, GROUPING(qty) AS g, COUNT(*) AS c FROM items WHERE id > 2 GROUP BY ROLLUP(qty) ORDER BY g", [(20, 0, 2), (None, 1, 2)]),
    ("SELECT qty, COUNT(*) AS c FROM items WHERE id > 3 GROUP BY ALL qty ORDER BY qty", [(None, 0), (10, 0), (20, 1)]),
    ("SELECT id, name AS [info.name] FROM items WHERE id = 3 FOR JSON PATH", [('[{"id":3,"info":{"name":"Ink"}}]',)]),
    ("SELECT j.[key], j.value FROM OPENJSON('{\"a\":1,\"b\":\"x\"}') j ORDER BY 1", [("a", "1"), ("b", "x")]),
    ("SELECT DISTINCT name FROM items WHERE id < 3", [("Pen",)]),
    ("SELECT STRING_AGG(name, '/') WITHIN GROUP (ORDER BY id) AS s FROM items WHERE qty = 20", [("Ink/Pad",)]),
])
def test_queries(engine, sql, expected):
    got = rows(engine.query(sql))
    assert got == expected


@pytest.mark.parametrize(("sql", "number"), [("SELECT nope FROM items", 207), ("SELECT * FROM nowhere", 208), ("SELECT TOP (-1) id FROM items", 1014), ("SELECT FROM", 102), ("SELECT frob(1)", 195), ("SELECT @x", 137), ("SELECT id FROM items GROUP BY 1", 164), ("SELECT i.id FROM items i JOIN orders o ON z.id = 1", 4104)])
def test_errors(engine, sql, number):
    with pytest.raises(EngineError) as e:
        engine.query(sql).collect()
    assert e.value.number == number


def test_recursion_limit(engine):
    with pytest.raises(EngineError) as e:
        engine.query("WITH t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t) SELECT n FROM t OPTION (MAXRECURSION 3)")
    assert e.value.number == 530


def test_changes(engine):
    out = engine.batch("""
        INSERT INTO items (id, name) OUTPUT inserted.id VALUES (5, 'Cap'), (6, 'Box');
        UPDATE items SET qty = 1, price += 1 OUTPUT deleted.qty AS old, inserted.qty AS new WHERE id = 1;
        UPDATE i SET qty = o.n FROM items i JOIN orders o ON o.item = i.id WHERE o.oid = 12;
        DELETE FROM items OUTPUT deleted.id WHERE name = 'pad';
        DELETE i FROM items i JOIN orders o ON o.item = i.id WHERE o.n = 4;
        SELECT id, qty, price FROM items ORDER BY id
    """)
    assert [sorted(rows(x), key=repr) for x in out] == [[(5,), (6,)], [(10, 1)], [(4,)], [(2, None, 2.0), (3, 5, 9.0), (5, None, None), (6, None, None)]]


def test_merge(engine):
    out = engine.batch("""
        MERGE INTO items AS t USING (VALUES (1, 100), (3, 0), (7, 70)) AS s(id, q) ON t.id = s.id
        WHEN MATCHED AND s.q = 0 THEN DELETE
        WHEN MATCHED THEN UPDATE SET qty = s.q
        WHEN NOT MATCHED THEN INSERT (id, name, qty) VALUES (s.id, 'New', s.q)
        WHEN NOT MATCHED BY SOURCE AND t.qty IS NULL THEN DELETE
        OUTPUT $action AS act, deleted.id AS d, inserted.id AS i;
        SELECT id, qty FROM items ORDER BY id
    """)
    assert sorted(rows(out[0]), key=repr) == sorted([("UPDATE", 1, 1), ("DELETE", 3, None), ("INSERT", None, 7), ("DELETE", 2, None)], key=repr)
    assert rows(out[1]) == [(1, 100), (4, 20), (7, 70)]
    with pytest.raises(EngineError) as e:
        engine.batch("MERGE items AS t USING (VALUES (1), (1)) AS s(id) ON t.id = s.id WHEN MATCHED THEN DELETE")
    assert e.value.number == 8672


def test_batch_control(engine):
    out = engine.batch("""
        DECLARE @i int = 0, @s varchar(20) = '';
        WHILE @i < 10
        BEGIN
            SET @i += 1;
            IF @i = 2 CONTINUE;
            IF @i > 4 BREAK;
            SET @s = @s + CAST(@i AS varchar(3));
        END;
        SELECT @m = MAX(n) FROM orders;
    """.replace("SELECT @m", "DECLARE @m int; SELECT @m") + """
        PRINT 'done';
        BEGIN TRY
            THROW 51000, 'boom', 1;
        END TRY
        BEGIN CATCH
            SELECT ERROR_NUMBER() AS n, ERROR_MESSAGE() AS m;
        END CATCH;
        SELECT @s AS s, @m AS m;
        SELECT id INTO #big FROM items WHERE price > 2;
        SELECT COUNT(*) AS c FROM #big;
        CREATE TABLE t (k int IDENTITY(10, 5), v varchar(5) NOT NULL);
        INSERT INTO t (v) VALUES ('a'), ('b');
        SELECT k, v FROM t ORDER BY k;
        RETURN;
        SELECT 1
    """)
    assert [rows(x) for x in out] == [[(51000, "boom")], [("134", 5)], [(2,)], [(10, "a"), (15, "b")]]
    assert engine.messages == ["done"]


def test_procedures_and_parameters(engine):
    engine.batch("CREATE PROCEDURE cheap @most int, @least int = 0 AS SELECT id FROM items WHERE price < @most AND price >= @least ORDER BY id")
    assert rows(engine.batch("EXEC cheap 3, @least = 2")[0]) == [(2,)]
    assert rows(engine.batch("EXEC cheap @most = 2")[0]) == [(1,)]
    assert rows(engine.query("SELECT id FROM items WHERE qty = @q ORDER BY id", q=20)) == [(3,), (4,)]
