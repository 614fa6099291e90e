"""Vectors of one table, rank updates over present cells, buffers written back, rotations as columns, table functions."""

import random
import subprocess
import sys
from pathlib import Path

import pytest

from gramloom import names
from gramloom.arguments import fits, place
from gramloom.functions import sql
from gramloom.operators import level1, level2
from gramloom.sources import layout
from gramloom.types import DimensionMismatch, IllegalArgument, InvalidLeadingDimension, InvalidLength, InvalidStride, Matrix, Vector


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pair(spark):
    table = spark.range(40).selectExpr("id AS k", "double(id * 7 % 11 - 5) AS a", "double(id * 3 % 13 - 6) AS b").cache()
    return Vector.of(table, 40, "k", "a"), Vector.of(table, 40, "k", "b")


def test_one_table_is_a_projection(spark, pair):
    x, y = pair
    apart = [Vector(v.df, v.n) for v in pair]  # the same cells without their table: joined
    forms = {
        "axpy": lambda a, b: [level1.axpy(2, a, b)], "axpby": lambda a, b: [level1.axpby(2, a, -1, b)], "swap": lambda a, b: [*level1.swap(a, b)],
        "rot": lambda a, b: [*level1.rot(a, b, 2, 3)], "rotm": lambda a, b: [*level1.rotm(a, b, [-1, 2, 3, 4, 5])], "copy": lambda a, b: [level1.copy(a, b)],
        "chain": lambda a, b: [level1.axpy(2, a, level1.axpby(1, a, 3, b))],
    }
    for name, form in forms.items():
        for got, want in zip(form(x, y), form(*apart), strict=True):
            assert "Join" not in plan(got.df), name
            assert got.to_list() == want.to_list(), name
    assert "Join" not in plan(level1.dot(x, y)) and level1.dot(x, y).first() == level1.dot(*apart).first()


def test_one_table_with_shorter_prefix(pair):
    x, y = pair
    for a, b in ((x, Vector.on(y.base, 15)), (Vector.on(x.base, 15), y)):
        b_all, a_all = Vector(b.df.where("i < 15"), b.n) if b.n == 15 else Vector(b.df, b.n), Vector(a.df.where("i < 15"), a.n) if a.n == 15 else Vector(a.df, a.n)
        got, want = level1.swap(a, b)[0 if a.n == 40 else 1], level1.swap(a_all, b_all)[0 if a.n == 40 else 1]
        assert got.to_list() == want.to_list()


def test_rank_update_makes_present_cells_only(spark):
    n = 1 << 20
    one = Vector(spark.createDataFrame([(77, 2.0)], "i long, v double"), n)
    two = Vector(spark.createDataFrame([(1_000_000, 3.0)], "i long, v double"), n)
    a = Matrix(spark.createDataFrame([(5, 5, 1.0)], "i long, j long, v double"), n, n)
    got = level2.ger(2, one, two, a)
    assert "Range" not in plan(got.df) and sorted(map(tuple, got.df.collect())) == [(5, 5, 1.0), (77, 1_000_000, 12.0)]
    assert sorted(map(tuple, level2.syr2("U", 1, one, two, a).df.collect())) == [(5, 5, 1.0), (77, 1_000_000, 6.0)]
    assert sorted(map(tuple, level2.syr("L", 1, one, a).df.collect())) == [(5, 5, 1.0), (77, 77, 4.0)]


@pytest.mark.parametrize("uplo", ["U", "L"])
def test_packed_updates_go_by_place(spark, uplo):
    x, y = Vector.from_values(spark, [1.0, 2.0, 3.0]), Vector.from_values(spark, [4.0, 0.0, -1.0])
    a = Matrix.from_values(spark, [[1.0, 2.0, 3.0], [2.0, 5.0, 6.0], [3.0, 6.0, 9.0]])
    buf = layout.to_packed(a, uplo)
    for got, want in ((level2.spr(uplo, 2, x, buf), level2.syr(uplo, 2, x, a)), (level2.spr2(uplo, 2, x, y, buf), level2.syr2(uplo, 2, x, y, a))):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, layout.to_packed(want, uplo).collect()))
    assert "Aggregate" not in plan(level2.spr(uplo, 2, x, spark.createDataFrame([(k, 1.0) for k in range(6)], "pos long, v double")))


def buffer(spark, n):
    return spark.range(n).selectExpr("id AS pos", "-double(id) - 1 AS v")


def values(df) -> list:
    return [r.v for r in df.orderBy("pos").collect()]


def test_strided_write_back(spark):
    x = Vector(spark.createDataFrame([(1, 5.0)], "i long, v double"), 2)  # element 0 is a structural zero
    assert values(layout.put_strided(buffer(spark, 5), x, 2)) == [0.0, -2.0, 5.0, -4.0, -5.0]
    assert values(layout.put_strided(buffer(spark, 5), x, -2)) == [5.0, -2.0, 0.0, -4.0, -5.0]


def test_matrix_write_back(spark):
    a = Matrix(spark.createDataFrame([(0, 0, 1.0), (1, 1, 4.0), (0, 1, 3.0)], "i long, j long, v double"), 2, 2)
    assert values(layout.put_flat(buffer(spark, 7), a, 3)) == [1.0, 0.0, -3.0, 3.0, 4.0, -6.0, -7.0]
    assert values(layout.put_flat(buffer(spark, 7), a, 3, "row")) == [1.0, 3.0, -3.0, 0.0, 4.0, -6.0, -7.0]
    assert values(layout.put_flat(buffer(spark, 7), a, 3, uplo="L")) == [1.0, 0.0, -3.0, -4.0, 4.0, -6.0, -7.0]
    assert values(layout.put_packed(buffer(spark, 4), a, "U")) == [1.0, 3.0, 4.0, -4.0]
    assert values(layout.put_packed(buffer(spark, 4), a, "L")) == [1.0, 0.0, 4.0, -4.0]
    # one diagonal above, leading dimension 3: places 0 (above the matrix) and 2, 5 (padding) stay
    assert values(layout.put_band(buffer(spark, 6), a, 0, 1, 3)) == [-1.0, 1.0, -3.0, 3.0, 4.0, -6.0]
    for form in ("col", "row"):
        there = layout.put_band(buffer(spark, 8), a, 1, 1, 4, form)
        assert layout.from_band(there, 2, 2, 1, 1, 4, layout=form).to_rows() == a.to_rows()


def test_argument_numbers(spark):
    buf = buffer(spark, 9)
    for error, call, info in (
        (InvalidStride, lambda: layout.strided(buf, 3, 0, routine="gemv", name="incy"), 11), (InvalidLength, lambda: layout.strided(buf, -1, 1, routine="axpy"), 1),
        (InvalidLeadingDimension, lambda: layout.from_flat(buf, 3, 3, 2, routine="gemm", name="ldb"), 10), (InvalidLeadingDimension, lambda: layout.from_band(buf, 3, 3, 1, 1, 2, routine="gbmv"), 8),
        (InvalidLeadingDimension, lambda: layout.put_flat(buf, Matrix.from_values(spark, [[1.0], [2.0]]), 1, routine="gemm", name="ldc"), 13), (DimensionMismatch, lambda: fits("gemv", x=(2, 3)), 7),
    ):
        with pytest.raises(error) as found:
            call()
        assert found.value.info == info
    a, x = Matrix.from_values(spark, [[1.0, 2.0]]), Vector.from_values(spark, [1.0])
    with pytest.raises(DimensionMismatch) as found:
        level2.gemv("N", 1, a, x, 0, x)
    assert (found.value.routine, found.value.info) == ("gemv", 7)
    names.checked("daxpy", n=-1, incx=0)  # vector routines return at once
    with pytest.raises(IllegalArgument):
        names.checked("dgemv_", trans="N", m=-1)
    assert place("axpy", "incy") == 6


def test_views_check(spark):
    assert Vector.from_values(spark, [1.0, 2.0]).check().n == 2
    a = Matrix.from_values(spark, [[1.0, 2.0]])
    assert (a.check().adjoint().effective_row_count, a.adjoint().effective_column_count) == (2, 1)
    for cells in ([(5, 1.0)], [(0, 1.0), (0, 2.0)], [(None, 1.0)]):
        with pytest.raises(InvalidLength):
            Vector(spark.createDataFrame(cells, "i long, v double"), 3).check()
    for cells in ([(0, 5, 1.0)], [(0, 0, 1.0), (0, 0, 2.0)]):
        with pytest.raises(InvalidLength):
            Matrix(spark.createDataFrame(cells, "i long, j long, v double"), 3, 3).check()


def test_rotmg_columns_equal_the_scalar_form(spark):
    rng = random.Random(2)
    value = lambda: float(rng.choice([0, 1, -1, rng.uniform(-9, 9)]) * 2.0 ** rng.choice([0, 0, 0, 30, -30, 100, -100, -400, 300]))
    rows = [tuple(value() for _ in range(4)) for _ in range(1500)] + [(1.0, 2.0, float("inf"), 1.0), (5e-324, 1.0, 1.0, 1.0), (float("inf"), 1.0, 1.0, 2.0)]
    found = level1.rotmg_rows(spark.createDataFrame(rows, "d1 double, d2 double, x1 double, y1 double").coalesce(1))
    assert "Python" not in plan(found) and "Arrow" not in plan(found)
    plain = lambda v: tuple(None if c is None else str(c + 0.0) for c in v)
    for row, got in zip(rows, found.collect(), strict=True):
        want = level1.rotmg(*row)
        assert plain(got) == plain((want["d1"], want["d2"], want["x1"], *want["param"])), row


def test_table_functions(spark):
    for name, operand in (("tx", [1.0, 2.0, 2.0]), ("ty", [4.0, 5.0, 6.0])):
        Vector.from_values(spark, operand).df.createOrReplaceTempView(name)
    Matrix.from_values(spark, [[1.0, 2.0, 0.0], [0.0, 1.0, 0.0], [3.0, 0.0, 1.0]]).df.createOrReplaceTempView("ta")
    call = lambda text: sorted(map(tuple, spark.sql(f"SELECT * FROM {text}").collect()))
    sql.create(spark, "dot", "t_dot", x="tx", y="ty")
    sql.create(spark, "nrm2", "t_norm", x="tx")
    sql.create(spark, "gemv", "t_mv", a="ta", x="tx", y="ty")
    sql.create(spark, "gemm", "t_mm", a="ta", b="ta", c="ta")
    assert call("t_dot()") == [(26.0,)] and call("t_norm()") == [(3.0,)]
    assert call("t_mv(1, 0)") == [(0, 5.0), (1, 2.0), (2, 5.0)] and call("t_mv(0, 2)") == [(0, 8.0), (1, 10.0), (2, 12.0)]
    assert dict(((i, j), v) for i, j, v in call("t_mm(1, -1)"))[0, 1] == 2.0
    spark.createDataFrame([(0, 1e200), (1, 1e200)], "i long, v double").createOrReplaceTempView("tx")
    assert abs(spark.sql("SELECT value FROM t_norm()").first()[0] / 1.4142135623730951e200 - 1) < 1e-14
    with pytest.raises(ValueError, match="views"):
        sql.create(spark, "dot", "t_bad", x="tx")
    with pytest.raises(ValueError, match="letters"):
        sql.create(spark, "nrm2", "t; DROP", x="tx")


def test_entry_imports_without_a_session():
    """No column is built at import."""
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 90"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)
