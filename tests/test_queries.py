"""Every registered query of the engine against its DuckDB SQL on the smallest tables."""

import datetime
import os

import pytest

from tessera.plans.queries import oracle_sql, queries
from tessera.plans.registry import TABLES

DATA = os.environ.get("TESSERA_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


def sorted_rows(table, names):
    return sorted((tuple(map(plain, row)) for row in zip(*[table.column(n).to_pylist() for n in names], strict=True)), key=repr)


def kind(t):
    return str(t).replace("large_", "").replace("[us, tz=UTC]", "[us]")


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, oracle, name):
    got = queries()[name](spark, DATA).toArrow()
    sql = oracle_sql().get(name)
    if sql is None:
        assert got.num_rows > 0
        return
    expected = oracle.sql(sql).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(expected.column_names)
    assert [kind(got.schema.field(n).type) for n in names] == [kind(expected.schema.field(n).type) for n in names]
    assert sorted_rows(got, names) == sorted_rows(expected, names)


def differing(spark, name, folder, **tables):
    """Rows of a query over made tables that its SQL lacks, and the other way round."""
    import duckdb

    con = duckdb.connect()
    for t, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    got, expected = queries()[name](spark, str(folder)).toArrow(), con.sql(oracle_sql()[name]).to_arrow_table()
    assert got.column_names == expected.column_names
    a, b = sorted_rows(got, got.column_names), sorted_rows(expected, got.column_names)
    return [x for x in a if x not in b], [x for x in b if x not in a], len(a) - len(b)


def test_lateral_limit_keeps_its_order(spark, tmp_path):
    # several executors fetch a key's rows in any order, so the window that stands for the limit has to state it
    plan = queries()["cross_apply_top"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_totalprice" in plan[plan.index("windowspecdefinition") :].split("specifiedwindowframe")[0]
    orders = """SELECT k::BIGINT AS o_orderkey, c::BIGINT AS o_custkey, p::DOUBLE AS o_totalprice FROM (VALUES (1, 1, '5'), (2, 1, '5'), (NULL, 1, '5'), (3, 1, '4'), (4, 2, NULL), (5, 2, 'nan'),
        (6, 2, 'inf'), (8, 3, '-0.0'), (9, 3, '0.0'), (10, 3, '-0.0'), (11, NULL, '9'), (12, 4, NULL), (NULL, 4, NULL), (13, 4, NULL), (15, 6, '1'), (15, 6, '1'), (16, 99, '1')) AS v(k, c, p)"""
    customer = "SELECT k::BIGINT AS c_custkey FROM (VALUES (1), (2), (2), (3), (4), (5), (6), (NULL)) AS v(k)"
    assert differing(spark, "cross_apply_top", tmp_path, customer=customer, orders=orders) == ([], [], 0)


def test_money_text_of_odd_amounts(spark, tmp_path):
    amounts = "-0.0 0.0 -0.001 -0.004 0.125 0.375 1.005 2.675 -2.675 -1234.5 999999.995 562949953421312.125 0.12345 0.00005 -0.00001 922337203685477.5807 1e15 72057594037927936 1e23 5e-324 nan inf -inf".split()
    customer = f"SELECT row_number() OVER () AS c_custkey, x::DOUBLE AS c_acctbal FROM (VALUES (NULL), {', '.join(f"('{a}')" for a in amounts)}) AS v(x)"
    assert differing(spark, "convert_money_text", tmp_path, customer=customer) == ([], [], 0)
