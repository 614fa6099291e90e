"""Every registered query against its SQL, as the driver compares them: names, and values in any order."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from gramloom import queries as linear

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(table):
    names = sorted(table.column_names)
    return sorted(tuple(x) for x in zip(*(table.column(n).to_pylist() for n in names), strict=True)), names, [str(table.schema.field(n).type) for n in names]


@pytest.mark.parametrize("name", sorted(linear.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, got_names, got_types = rows(entry.queries()[name](spark, SF).toArrow())
    want, want_names, want_types = rows(duck.execute(entry.oracle_sql()[name]).to_arrow_table())
    assert got_names == want_names
    assert got_types == want_types
    assert len(got) == len(want)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_queries_without_sql_run(spark):
    for name in [n for n in entry.queries() if n[0] == "l" and n not in entry.oracle_sql()]:
        assert entry.queries()[name](spark, SF).count() > 0


def test_whole_solves_multiply_back(spark):
    o = linear.Operands(spark, SF)
    run = lambda name: entry.queries()[name](spark, SF).collect()

    def vector(name, n):
        found = {r.i: r.v for r in run(name)}
        assert sorted(found) == list(range(n))
        return np.array([found[i] for i in range(n)])

    t, x, b = np.array(o.whole_t().to_rows()), np.array(o.x.to_list()), np.array(o.b.to_rows())
    assert np.count_nonzero(t[8:, 8:]) > 17
    band = np.where(np.subtract.outer(np.arange(25), np.arange(25)) <= 2, t, 0)
    for name, m in [("l2_trsv_whole", t), ("l2_trsv_t_whole", t.T), ("l2_tbsv_whole", band), ("l2_tpsv_whole", t)]:
        got = vector(name, 25)
        assert np.max(np.abs(m @ got - x)) <= 1e-10 * max(1, np.max(np.abs(got)))
    for name, want, right in [("l3_trsm_whole", 2 * b, False), ("l3_trsm_right_whole", b.T, True)]:
        got = np.zeros((25, 25))
        for r in run(name):
            got[r.i, r.j] = r.v
        assert np.max(np.abs((got @ t.T if right else t @ got) - want)) <= 1e-10 * max(1, np.max(np.abs(got)))
    large = np.array(o.whole_t(linear.LARGE).to_rows())
    assert np.count_nonzero(large[256:, 128:256]) > 10 and np.count_nonzero(large[128:, :128]) > 100
    got = vector("l2_trsv_blocks", linear.LARGE)
    assert np.max(np.abs(large @ got - np.array(o.large_x.to_list()))) <= 1e-10 * max(1, np.max(np.abs(got)))
