import glob
import os

import duckdb
import pytest

import __spark_entry__
from quire.plans import containers, relational

SF = "/root/testdata/sf0.001"


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order]) for r in found)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", [*sorted(relational.QUERIES), *sorted(containers.QUERIES)])
def test_query_matches_sql(spark, oracle, name):
    own = relational if name in relational.QUERIES else containers
    got, want = own.QUERIES[name](spark, SF), oracle.execute(own.ORACLES[name])
    names = [c[0] for c in want.description]
    expected = want.fetchall()
    assert sorted(got.columns) == sorted(names)
    assert expected and rows(got.columns, got.collect()) == rows(names, expected)


def test_shapes_with_ties_cycles_and_nulls(spark):
    from quire.operators import relational as ops

    levels = spark.createDataFrame([("g", k, v) for k, v in enumerate([3, 1, 4, 4, 2, 9, 9])] + [("h", 0, 5)], "g string, k int, level int")
    got = [r.written for r in ops.clamp_levels(levels, ["g"], ["k"], "level").orderBy("g", "k").collect()]
    assert got == [1, 1, 2, 3, 2, 3, 4, 1]
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 5), (7, 8), (7, 8), (None, 1)], "a int, b int")
    assert {tuple(r) for r in ops.closure(pairs, "a", "b").collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} | {(5, 5), (7, 8)}
    nodes = spark.createDataFrame([(1, None, "r"), (2, 1, "a"), (3, 2, "b"), (4, 5, "x"), (5, 4, "y")], "id int, parent int, name string")
    assert {tuple(r) for r in ops.walk(nodes, "id", "parent", "name").collect()} == {(1, 0, "r"), (2, 1, "r/a"), (3, 2, "r/a/b")}
    assert ops.walk(nodes.filter("id > 9"), "id", "parent", "name").count() == 0 == ops.closure(pairs.filter("a > 9"), "a", "b").count()
    left, right = spark.createDataFrame([(1,), (None,), (3,), (3,)], "x int"), spark.createDataFrame([(1,), (None,)], "y int")
    assert [tuple(r) for r in ops.difference(left, right).collect()] == [(3,)]
    copies = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, t string")
    assert sorted(tuple(r) for r in ops.exact_copies(copies, "id", "t").collect()) == [(1, 1, 2), (2, 1, 2)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert {*relational.QUERIES, *containers.QUERIES} <= set(__spark_entry__.queries())
    assert not {*relational.QUERIES} & {*containers.QUERIES}
