import duckdb
import pytest

from gramloom.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want, got = con.execute(queries.oracle_sql()[name]).to_arrow_table(), queries.queries()[name](spark, SF).toArrow()
    names = sorted(want.column_names)
    assert sorted(got.column_names) == names
    assert [str(got.schema.field(n).type) for n in names] == [str(want.schema.field(n).type) for n in names]
    rows = lambda t: sorted(zip(*(map(str, t.column(n).to_pylist()) for n in names), strict=True))
    assert rows(got) == rows(want)
