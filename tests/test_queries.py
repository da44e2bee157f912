import pytest

from verdigris.oracle import ORACLES
from verdigris.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


#: Orders of one customer, priority and date whose facts have no id, one of them no department, the other no job.
ALIKE = (101 * 43, 101 * 53)


@pytest.mark.parametrize("name", ["audit_load", "hiring_load", "scripted_load"])
def test_load_of_facts_that_differ_in_the_missing_reference(name, spark, sf, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    two = f"select o.* replace (k as o_orderkey, 1 as o_custkey) from '{sf}/orders.parquet' o, (values ({ALIKE[0]}::bigint), ({ALIKE[1]}::bigint)) v(k) where o_orderkey = 1"
    con.execute(f"copy (from '{sf}/orders.parquet' where o_orderkey not in {ALIKE} union all {two}) to '{tmp_path}/orders.parquet'")
    for t in ("nation", "region"):
        con.execute(f"copy (from '{sf}/{t}.parquet') to '{tmp_path}/{t}.parquet'")
    for t in ("orders", "nation", "region"):
        con.execute(f"create view {t} as from '{tmp_path}/{t}.parquet'")
    told = con.execute(ORACLES[name])
    columns, want = [d[0] for d in told.description], told.fetchall()
    got = QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
