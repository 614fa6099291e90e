"""Argument numbers, places counted by the C names, rotations of NaN, norms at the ends of the range, sparse results."""

import math

import pytest
from pyspark.sql import functions as F

from gramloom import arguments, names
from gramloom.operators import level1 as l1
from gramloom.operators import level2 as l2
from gramloom.operators import level3 as l3
from gramloom.operators import solve
from gramloom.sources import layout
from gramloom.types import IllegalArgument, Matrix, Vector

NAN = float("nan")


def vec(spark, values, dtype="d"):
    return Vector.from_values(spark, values, dtype)


def mat(spark, rows, dtype="d"):
    return Matrix.from_values(spark, rows, dtype)


@pytest.mark.parametrize("routine,given,number", [
    ("gemm", {"transa": "X"}, 1), ("gemm", {"transa": "n", "transb": "q"}, 2), ("gemm", {"m": -1}, 3), ("gemm", {"m": 1, "n": -1}, 4), ("gemm", {"k": -1}, 5),
    ("gemm", {"transa": "N", "m": 4, "k": 2, "lda": 3}, 8), ("gemm", {"transa": "T", "m": 4, "k": 2, "lda": 2, "ldb": 1, "n": 1}, 10), ("gemm", {"m": 4, "ldc": 3}, 13),
    ("trsm", {"side": "x"}, 1), ("trsm", {"uplo": "x"}, 2), ("trmm", {"trans": "x"}, 3), ("trmm", {"diag": "x"}, 4), ("trmm", {"m": -1}, 5), ("trmm", {"n": -1}, 6),
    ("trmm", {"side": "R", "m": 1, "n": 3, "lda": 2}, 9), ("trmm", {"m": 3, "ldb": 2}, 11), ("gemv", {"trans": "x"}, 1), ("gemv", {"m": 3, "lda": 2}, 6), ("gemv", {"incx": 0}, 8), ("gemv", {"incy": 0}, 11),
    ("gbmv", {"kl": -1}, 4), ("gbmv", {"ku": -1}, 5), ("gbmv", {"kl": 1, "ku": 1, "lda": 2}, 8), ("gbmv", {"incx": 0}, 10), ("gbmv", {"incy": 0}, 13),
    ("symv", {"uplo": "x"}, 1), ("hemv", {"n": -1}, 2), ("symv", {"n": 3, "lda": 2}, 5), ("sbmv", {"k": -1}, 3), ("hbmv", {"k": 2, "lda": 2}, 6), ("spmv", {"incx": 0}, 6), ("hpmv", {"incy": 0}, 9),
    ("trmv", {"diag": "x"}, 3), ("trsv", {"n": 2, "lda": 1}, 6), ("tbmv", {"k": -1}, 5), ("tbsv", {"k": 1, "lda": 1}, 7), ("tpmv", {"incx": 0}, 7), ("ger", {"m": -1}, 1), ("gerc", {"m": 2, "lda": 1}, 9),
    ("syr", {"incx": 0}, 5), ("her", {"n": 2, "lda": 1}, 7), ("spr", {"incx": 0}, 5), ("syr2", {"incy": 0}, 7), ("her2", {"n": 2, "lda": 1}, 9), ("hpr2", {"uplo": "x"}, 1),
    ("syrk", {"trans": "T", "n": 1, "k": 3, "lda": 2}, 7), ("herk", {"n": 2, "ldc": 1}, 10), ("syr2k", {"n": 2, "ldb": 1}, 9), ("her2k", {"n": 2, "ldc": 1}, 12), ("symm", {"side": "R", "n": 2, "lda": 1}, 7), ("hemm", {"m": 2, "ldb": 1}, 9),
])
def test_numbers(routine, given, number):
    with pytest.raises(IllegalArgument) as e:
        arguments.check(routine, **given)
    assert (e.value.routine, e.value.info) == (routine, number)


def test_legal_arguments_and_names():
    arguments.check("gemm", transa="t", transb="C", m=2, n=3, k=4, lda=4, ldb=3, ldc=2)
    with pytest.raises(IllegalArgument) as e:
        names.checked("cblas_zgemm", m=-1)
    assert e.value.info == 3


def test_operators_report_their_own_name_and_number(spark):
    a, x = mat(spark, [[1, 2], [3, 4]]), vec(spark, [1, 1])
    for call, routine, number in [
        (lambda: l3.trmm("L", "L", "N", "X", 1, a, a), "trmm", 4), (lambda: l3.herk("X", "N", 1, a, 0, a), "herk", 1), (lambda: l3.her2k("U", "X", 1j, a, a, 0, a), "her2k", 2),
        (lambda: l2.gbmv("N", -1, 0, 1, a, x, 0, x), "gbmv", 4), (lambda: l2.sbmv("U", -1, 1, a, x, 0, x), "sbmv", 3), (lambda: l2.tbmv("U", "N", "N", -1, a, x), "tbmv", 5),
        (lambda: l2.her("X", 1, x, a), "her", 1), (lambda: l2.hpr("X", 1, x, None), "hpr", 1), (lambda: solve.tbsv("U", "N", "N", -1, a, x), "tbsv", 5), (lambda: solve.trsv("U", "N", "Z", a, x), "trsv", 3),
    ]:
        with pytest.raises(IllegalArgument) as e:
            call()
        assert (e.value.routine, e.value.info) == (routine, number)


def test_largest_place(spark):
    place = lambda routine, v: names.lookup(routine)[0](v).first().idx
    assert place("idamax_", vec(spark, [1, -5, 2])) == 2 and place("cblas_idamax", vec(spark, [1, -5, 2])) == 1
    assert place("cblas_idamax", vec(spark, [])) == 0 and place("idamax_", vec(spark, [0, 0, 0])) == 1
    sparse = lambda cells, n: Vector(spark.createDataFrame(cells, "i long, v double"), n)
    none = Vector(spark.range(0).select(F.col("id").alias("i"), F.lit(0.0).alias("v")), 3)
    assert place("idamax_", none) == 1 and place("idamax_", sparse([(1, 0.0), (2, NAN)], 4)) == 1 and place("idamax_", sparse([(0, NAN), (2, 9.0)], 4)) == 1
    assert place("idamax_", sparse([(1 << 33, -2.0), (7, 1.0)], 1 << 40)) == (1 << 33) + 1


def test_rotations_read_both_sides(spark):
    x, y = vec(spark, [1, 2, 3]), vec(spark, [NAN, 5])
    a, b = l1.rot(x, y, 1, 0)
    assert math.isnan(a.to_list()[0]) and a.to_list()[1:] == [2, 3] and b.to_list()[1] == 5
    a, b = l1.rotm(x, y, [-1.0, 1.0, 0.0, 0.0, 1.0])
    assert math.isnan(a.to_list()[0]) and math.isnan(b.to_list()[0])
    assert [tuple(r) for r in l1.rotm_paired(x, vec(spark, [1, 1, 1]), [1.0, 2.0, None, None, 3.0]).orderBy("i").collect()] == [(0, 3, 2), (1, 5, 1), (2, 7, 0)]
    assert l1.rotm(x, y, [-2.0, None, None, None, None]) == (x, y)


def test_norm_at_the_ends_of_the_range(spark):
    norm = lambda *v: l1.nrm2(vec(spark, v)).first().value
    assert norm(3e200, 4e200) == pytest.approx(5e200, rel=1e-14) and norm(3e-200, 4e-200) == pytest.approx(5e-200, rel=1e-14)
    assert norm(3e-160, 4e-150) == pytest.approx(4e-150, rel=1e-14) and norm(1e300, 1.0, 1e-300) == pytest.approx(1e300)
    assert norm() == 0 and norm(0, 0) == 0 and norm(5e-324) == 5e-324 and norm(float("inf"), 1) == math.inf and math.isnan(norm(float("inf"), NAN))
    assert l1.nrm2(vec(spark, [3 + 4j], "z")).first().value == 5


def test_results_follow_the_cells_there_are(spark):
    n = 1 << 40
    a = Matrix(spark.createDataFrame([(5, 0, 2.0), (n - 1, 1, 3.0)], "i long, j long, v double"), n, 2)
    y = Vector(spark.createDataFrame([(5, 1.0), (9, 4.0)], "i long, v double"), n)
    got = l2.gemv("N", 10, a, vec(spark, [1, 1]), 2, y)
    assert sorted(map(tuple, got.df.collect())) == [(5, 22.0), (9, 8.0), (n - 1, 30.0)]
    assert l2.gemv("N", 0, a, vec(spark, [1, 1]), 0, y).df.count() == 0


@pytest.mark.parametrize("uplo", ["U", "L"])
@pytest.mark.parametrize("order", ["col", "row"])
def test_packed_places_invert(spark, uplo, order):
    for n in (1, 2, 7, 40):
        cells = [(i, j) for i in range(n) for j in range(n) if (i <= j if uplo == "U" else i >= j)]
        m = Matrix(spark.createDataFrame([(i, j, float(100 * i + j)) for i, j in cells], "i long, j long, v double"), n, n)
        packed = layout.to_packed(m, uplo, order)
        assert sorted(r.pos for r in packed.collect()) == list(range(n * (n + 1) // 2))
        assert sorted(map(tuple, layout.from_packed(packed, n, uplo, layout=order).df.collect())) == sorted((i, j, 100.0 * i + j) for i, j in cells)
    last = 200_000_000 * 200_000_001 // 2 - 1
    far = spark.createDataFrame([(last, 1.0), (last - 200_000_000, 2.0)], "pos long, v double")
    assert {(r.i, r.j) for r in layout.from_packed(far, 200_000_000, "U").df.collect()} == {(199_999_999, 199_999_999), (199_999_998, 199_999_998)}


def test_zero_divisors_keep_their_sign(spark):
    from gramloom.functions.scalars import ieee_div

    df = spark.createDataFrame([(1.0, 0.0), (1.0, -0.0), (-1.0, 0.0), (-1.0, -0.0), (6.0, 3.0)], "a double, b double")
    assert [r.q for r in df.select(ieee_div(F.col("a"), F.col("b")).alias("q")).collect()] == [math.inf, -math.inf, -math.inf, math.inf, 2.0]


def test_block_product_sums_over_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x, y = rng.integers(-3, 4, (300, 530)), rng.integers(-3, 4, (530, 270))
    got = l3.product(mat(spark, x.tolist()), mat(spark, y.tolist()), plan="block").collect()
    out = np.zeros((300, 270))
    for r in got:
        out[r.i, r.j] = r.p
    assert (out == x @ y).all()
