import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gramloom import api, names
from gramloom.operators import level1 as l1
from gramloom.operators import level2 as l2
from gramloom.operators import level3 as l3
from gramloom.operators import solve
from gramloom.sources import layout
from gramloom.types import DimensionMismatch, IllegalArgument, InvalidLeadingDimension, InvalidStride, Matrix, Vector

NAN = float("nan")


def vec(spark, values, dtype="d"):
    return Vector.from_values(spark, values, dtype)


def mat(spark, rows, dtype="d"):
    return Matrix.from_values(spark, np.asarray(rows).tolist(), dtype)


def rand(rng, *shape, dtype="d"):
    x = rng.integers(-6, 7, shape).astype(float)
    return x + 1j * rng.integers(-6, 7, shape) if dtype in "cz" else x


def buf(spark, values):
    return spark.createDataFrame(pa.table({"pos": list(range(len(values))), "v": list(map(float, values))}))


def value(df):
    r = df.collect()
    assert len(r) == 1
    v = r[0][0]
    return complex(v.re, v.im) if hasattr(v, "re") else v


def test_goldens_of_matrix_products(spark):
    c = mat(spark, [[NAN] * 2] * 2)
    assert l3.gemm(1, mat(spark, [[1, 3, 5], [2, 4, 6]]), mat(spark, [[7, 10], [8, 11], [9, 12]]), 0, c).to_rows() == [[76, 103], [100, 136]]
    bad = mat(spark, [[NAN] * 2] * 2)
    assert l3.gemm(0, bad, bad, 2, mat(spark, [[1, 2], [3, 4]])).to_rows() == [[2, 4], [6, 8]]
    assert l2.gemv("N", 1, mat(spark, [[1, 2, 3], [4, 5, 6]]), vec(spark, [1, 2, 3]), 0, vec(spark, [NAN, NAN])).to_list() == [14, 32]
    band = layout.from_band(buf(spark, [777, 1, 3, 2, 4, 6, 5, 7, 777]), 3, 3, 1, 1)
    assert l2.gbmv("N", 1, 1, 1, band, vec(spark, [1, 2, 3]), 0, vec(spark, [0, 0, 0])).to_list() == [5, 26, 33]
    up = mat(spark, [[1, 2, 3], [999, 4, 5], [999, 999, 6]])
    assert l2.symv("U", 1, up, vec(spark, [1, 2, 3]), 0, vec(spark, [0] * 3)).to_list() == [14, 25, 31]
    h = mat(spark, [[1 + 99j, 2 + 1j], [0, 3 - 7j]], "z")
    assert l2.hemv("U", 1, h, vec(spark, [1 + 1j, 2 - 1j], "z"), 0, vec(spark, [0, 0], "z")).to_list() == [6 + 1j, 9 - 2j]
    t = mat(spark, [[1, 2], [777, 3]])
    assert l2.trmv("U", "N", "N", t, vec(spark, [4, 5])).to_list() == [14, 15]
    assert solve.trsv("U", "N", "N", t, vec(spark, [14, 15])).to_list() == [4, 5]


def test_level1(spark):
    x, y = vec(spark, [1, 2, 3]), vec(spark, [4, 5, 6, 9])
    assert value(l1.dot(x, y)) == 32
    assert l1.axpy(2, x, y).to_list() == [6, 9, 12, 9]
    assert l1.axpby(2, x, 3, y).to_list() == [14, 19, 24, 9]
    assert l1.axpy(0, vec(spark, [NAN]), y).to_list() == y.to_list()
    assert math.isnan(l1.scal(0, vec(spark, [NAN])).to_list()[0])
    a, b = l1.swap(x, y)
    assert (a.to_list(), b.to_list()) == ([4, 5, 6], [1, 2, 3, 9])
    assert l1.copy(x, y).to_list() == [1, 2, 3, 9]
    zx, zy = vec(spark, [1 + 2j, -3 + 1j, 2 - 1j], "z"), vec(spark, [4 - 1j, 0.5 + 2j, -2 + 3j], "z")
    assert value(l1.dotu(zx, zy)) == 1.5 + 9.5j and value(l1.dotc(zx, zy)) == -4.5 - 11.5j
    assert value(l1.iamax(zx)) == 2 and value(l1.asum(zx)) == 10
    assert value(l1.dsdot(vec(spark, [1, 2], "s"), vec(spark, [3, 4], "s"))) == 11
    assert value(l1.sdsdot(1.5, vec(spark, [1, 2], "s"), vec(spark, [3, 4], "s"))) == 12.5
    assert math.copysign(1, value(l1.sdsdot(-0.0, vec(spark, [], "s"), vec(spark, [], "s")))) == -1
    assert value(l1.iamax(vec(spark, [1, -3, 3, NAN]))) == 2
    assert value(l1.iamax(vec(spark, [NAN, 5]))) == 1 and value(l1.iamax(vec(spark, []))) == 0
    assert value(l1.iamax(vec(spark, [1, 7]), base=0)) == 1
    assert value(l1.nrm2(vec(spark, [3e200, 4e200]))) == pytest.approx(5e200)
    assert value(l1.nrm2(vec(spark, [3e-200, 4e-200]))) == pytest.approx(5e-200)
    assert value(l1.nrm2(vec(spark, [math.inf, math.inf]))) == math.inf
    assert math.isnan(value(l1.nrm2(vec(spark, [NAN, math.inf])))) and value(l1.nrm2(vec(spark, []))) == 0 and value(l1.nrm2(vec(spark, [0, 0]))) == 0
    p, q = l1.rot(x, vec(spark, [4, 5, 6]), 0.0, 1.0)
    assert (p.to_list(), q.to_list()) == ([4, 5, 6], [-1, -2, -3])
    assert l1.axpby(0, vec(spark, [NAN]), 3, y).to_list() == [12, 5, 6, 9]
    assert [v.to_list() for v in l1.rot(vec(spark, [1]), y, 2.0, 0.0)] == [[2], [8, 5, 6, 9]]
    p, q = l1.rotm(x, vec(spark, [4, 5, 6]), [0, 9, 2, 3, 9])
    assert (p.to_list(), q.to_list()) == ([13, 17, 21], [6, 9, 12])
    with pytest.raises(DimensionMismatch):
        l1.axpy_into(1, x, y, y)


def test_rotations(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (3.0, 4.0), (4.0, 3.0), (-3.0, 1.0), (0.0, -2.0), (2.0, 0.0)], "a double, b double")
    for r in rows.select("a", "b", l1.rotg(F.col("a"), F.col("b")).alias("g")).collect():
        g = r.g
        assert g.c * r.a + g.s * r.b == pytest.approx(g.r) and g.c * r.b - g.s * r.a == pytest.approx(0, abs=1e-12)
        want = 0 if r.a == r.b == 0 else g.s if abs(r.a) > abs(r.b) else 1 / g.c if g.c else 1
        assert g.z == pytest.approx(want)
    z = spark.createDataFrame([((1.0, 2.0), (3.0, -1.0)), ((0.0, 0.0), (2.0, 5.0))], "a struct<re:double,im:double>, b struct<re:double,im:double>")
    for r in z.select("a", "b", l1.rotg_complex(F.col("a"), F.col("b")).alias("g")).collect():
        a, b, s, new = (complex(v.re, v.im) for v in (r.a, r.b, r.g.s, r.g.a))
        if a == 0:
            assert (r.g.c, s, new) == (0, 1, b)
        else:
            assert r.g.c * a + s * b == pytest.approx(new) and abs(-s.conjugate() * a + r.g.c * b) < 1e-12


@pytest.mark.parametrize("d1,d2,x1,y1", [(1, 1, 2, 1), (1, 1, 1, 2), (-1, 1, 1, 1), (1, 0, 1, 1), (1e-9, 1, 1, 1e-6), (1e9, 1, 1, 1), (2, 3e-9, 4, 1e-3), (1, -1, 1, 2)])
def test_rotmg_zeroes_the_second_component(spark, d1, d2, x1, y1):
    g = l1.rotmg(d1, d2, x1, y1)
    kind, h11, h21, h12, h22 = g["param"]
    if kind == -2:
        return
    if kind == 0:
        h11 = h22 = 1
    elif kind == 1:
        h12, h21 = 1, -1
    if g["d1"] or g["d2"]:
        assert h11 * x1 + h12 * y1 == pytest.approx(g["x1"]) and h21 * x1 + h22 * y1 == pytest.approx(0, abs=1e-9)
        assert g["d1"] * g["x1"] ** 2 == pytest.approx(d1 * x1**2 + d2 * y1**2)
    got = l1.rotmg_rows(spark.createDataFrame([(float(d1), float(d2), float(x1), float(y1))], "d1 double, d2 double, x1 double, y1 double")).first()
    assert (got.d1, got.flag) == (g["d1"], kind)


@pytest.mark.parametrize("dtype", ["s", "d", "c", "z"])
def test_products_against_numpy(spark, dtype):
    rng = np.random.default_rng(4)
    op = {"N": lambda x: x, "T": lambda x: x.T, "C": lambda x: x.conj().T}
    alpha, beta = (2 - 1j, 0.5 + 1j) if dtype in "cz" else (2, -0.5)
    a, b, c = rand(rng, 3, 4, dtype=dtype), rand(rng, 4, 2, dtype=dtype), rand(rng, 3, 2, dtype=dtype)
    for ta, tb in itertools.product("NTC", "NTC"):
        pa, pb = (a if ta == "N" else a.T), (b if tb == "N" else b.T)
        got = l3.gemm(alpha, mat(spark, pa, dtype), mat(spark, pb, dtype), beta, mat(spark, c, dtype), ta, tb).to_rows()
        np.testing.assert_allclose(got, alpha * op[ta](pa) @ op[tb](pb) + beta * c, rtol=1e-6)
    s, x, y = rand(rng, 3, 3, dtype=dtype), rand(rng, 3, dtype=dtype), rand(rng, 3, dtype=dtype)
    for t in "NTC":
        np.testing.assert_allclose(l2.gemv(t, alpha, mat(spark, s, dtype), vec(spark, x, dtype), beta, vec(spark, y, dtype)).to_list(), alpha * op[t](s) @ x + beta * y, rtol=1e-6)
    np.testing.assert_allclose(l2.ger(alpha, vec(spark, x, dtype), vec(spark, y, dtype), mat(spark, s, dtype)).to_rows(), s + alpha * np.outer(x, y), rtol=1e-6)
    np.testing.assert_allclose(l2.gerc(alpha, vec(spark, x, dtype), vec(spark, y, dtype), mat(spark, s, dtype)).to_rows(), s + alpha * np.outer(x, y.conj()), rtol=1e-6)


@pytest.mark.parametrize("dtype,hermitian,uplo", [("d", False, "U"), ("z", False, "L"), ("z", True, "U"), ("z", True, "L")])
def test_rank_updates_and_symmetric_products(spark, dtype, hermitian, uplo):
    rng = np.random.default_rng(5)
    n, k = 4, 3
    t = (lambda m: m.conj().T) if hermitian else (lambda m: m.T)
    tri = np.triu if uplo == "U" else np.tril
    a, b, c, x, y = rand(rng, n, k, dtype=dtype), rand(rng, n, k, dtype=dtype), rand(rng, n, n, dtype=dtype), rand(rng, n, dtype=dtype), rand(rng, n, dtype=dtype)
    alpha = 2 - 1j if dtype == "z" else 2.0
    base = c.copy()
    if hermitian:
        np.fill_diagonal(base, base.diagonal().real)

    def check(got, full):
        want = np.where(tri(np.ones((n, n))) > 0, full, c)
        np.testing.assert_allclose(got.to_rows(), want)

    m = lambda v: mat(spark, v, dtype)
    v = lambda w: vec(spark, w, dtype)
    if hermitian:
        back = np.conj(alpha)
        check(l3.herk(uplo, "N", 2, m(a), 0.5, m(c)), 2 * a @ t(a) + 0.5 * base)
        check(l3.herk(uplo, "C", 2, m(a.conj().T), 0, m(c)), 2 * a @ t(a))
        check(l3.her2k(uplo, "N", alpha, m(a), m(b), 0.5, m(c)), alpha * a @ t(b) + back * b @ t(a) + 0.5 * base)
        check(l2.her(uplo, 3, v(x), m(c)), base + 3 * np.outer(x, x.conj()))
        check(l2.her2(uplo, alpha, v(x), v(y), m(c)), base + alpha * np.outer(x, y.conj()) + back * np.outer(y, x.conj()))
    else:
        check(l3.syrk(uplo, "N", alpha, m(a), 0.5, m(c)), alpha * a @ a.T + 0.5 * c)
        check(l3.syrk(uplo, "T", alpha, m(a.T), 0, m(c)), alpha * a @ a.T)
        check(l3.syr2k(uplo, "N", alpha, m(a), m(b), 0.5, m(c)), alpha * (a @ b.T + b @ a.T) + 0.5 * c)
        check(l2.syr(uplo, alpha, v(x), m(c)), c + alpha * np.outer(x, x))
        check(l2.syr2(uplo, alpha, v(x), v(y), m(c)), c + alpha * (np.outer(x, y) + np.outer(y, x)))
    half = tri(base)
    full = half + t(tri(base, 1 if uplo == "U" else -1))
    mult = l3.hemm if hermitian else l3.symm
    np.testing.assert_allclose(mult("L", uplo, alpha, m(c), m(a), 0, m(a)).to_rows(), alpha * full @ a)
    np.testing.assert_allclose(mult("R", uplo, alpha, m(c), m(a.T), 0, m(a.T)).to_rows(), alpha * a.T @ full)
    packed = layout.to_packed(Matrix(m(c).triangle(uplo).df, n, n, dtype), uplo)
    mv = l2.hpmv if hermitian else l2.spmv
    np.testing.assert_allclose(mv(uplo, alpha, packed, n, v(x), 0.5, v(y)).to_list(), alpha * full @ x + 0.5 * y)
    up = (l2.hpr if hermitian else l2.spr)(uplo, 2, v(x), packed)
    got = np.array(layout.from_packed(up, n, uplo, dtype).to_rows())
    np.testing.assert_allclose(got, tri(base + 2 * np.outer(x, x.conj() if hermitian else x)))
    up = (l2.hpr2 if hermitian else l2.spr2)(uplo, 2, v(x), v(y), packed)
    np.testing.assert_allclose(np.array(layout.from_packed(up, n, uplo, dtype).to_rows()), tri(base + 2 * (np.outer(x, y.conj() if hermitian else y) + np.outer(y, x.conj() if hermitian else x))))


@pytest.mark.parametrize("side,uplo", itertools.product("LR", "UL"))
def test_triangular_modes(spark, side, uplo):
    rng = np.random.default_rng(6)
    n, m = 5, 3
    op = {"N": lambda x: x, "T": lambda x: x.T, "C": lambda x: x.conj().T}
    for dtype, trans, diag in [("d", "N", "N"), ("d", "T", "U"), ("z", "C", "N")]:
        a = rand(rng, n, n, dtype=dtype) / 8
        np.fill_diagonal(a, 4)
        dirty = a.copy()
        dirty[np.tril_indices(n, -1) if uplo == "U" else np.triu_indices(n, 1)] = NAN
        if diag == "U":
            np.fill_diagonal(dirty, NAN)
            np.fill_diagonal(a, 1)
        t = op[trans](np.triu(a) if uplo == "U" else np.tril(a))
        b = rand(rng, *((n, m) if side == "L" else (m, n)), dtype=dtype)
        dm, bm = mat(spark, dirty, dtype), mat(spark, b, dtype)
        np.testing.assert_allclose(l3.trmm(side, uplo, trans, diag, 2, dm, bm).to_rows(), 2 * (t @ b if side == "L" else b @ t))
        x = np.array(solve.trsm(side, uplo, trans, diag, 2, dm, bm).to_rows())
        np.testing.assert_allclose(t @ x if side == "L" else x @ t, 2 * b, atol=1e-9)
        if side == "L":
            v = rand(rng, n, dtype=dtype)
            np.testing.assert_allclose(l2.trmv(uplo, trans, diag, dm, vec(spark, v, dtype)).to_list(), t @ v)
            np.testing.assert_allclose(t @ np.array(solve.trsv(uplo, trans, diag, dm, vec(spark, v, dtype)).to_list()), v, atol=1e-9)


def test_blocked_solve_and_block_product(spark, monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(solve, "BLOCK", 4)
    a = np.tril(rng.normal(size=(11, 11))) + 6 * np.eye(11)
    b = rng.normal(size=(11, 2))
    for uplo, t in (("L", a), ("U", a.T)):
        x = np.array(solve.trsm("L", uplo, "N", "N", 1, mat(spark, t), mat(spark, b)).to_rows())
        np.testing.assert_allclose(t @ x, b, atol=1e-9)
    for dtype in "dz":
        p, q = rand(rng, 300, 20, dtype=dtype), rand(rng, 20, 270, dtype=dtype)
        got = l3.gemm(1, mat(spark, p, dtype), mat(spark, q, dtype), 0, mat(spark, np.zeros((300, 270)), dtype), plan="block").to_rows()
        np.testing.assert_allclose(got, p @ q)


def test_zero_pivot_is_ieee(spark):
    got = solve.trsv("L", "N", "N", mat(spark, [[0, 0], [1, 2]]), vec(spark, [1, 4])).to_list()
    assert got == [math.inf, -math.inf]
    assert math.isnan(solve.trsv("L", "N", "N", mat(spark, [[0.0]]), vec(spark, [0])).to_list()[0])


def test_layouts(spark):
    flat = buf(spark, [1, 2, 99, 3, 4, 99, 5, 6])
    a = layout.from_flat(flat, 2, 3, ld=3)
    assert a.to_rows() == [[1, 3, 5], [2, 4, 6]]
    assert layout.from_flat(buf(spark, [1, 2, 3, 4, 5, 6]), 2, 3, layout="row").to_rows() == [[1, 2, 3], [4, 5, 6]]
    assert [r.v for r in layout.to_flat(a, layout="row").orderBy("pos").collect()] == [1, 3, 5, 2, 4, 6]
    assert layout.strided(buf(spark, [20, 10]), 2, -1).to_list() == [10, 20]
    x = layout.strided(buf(spark, [1, 0, 2, 0, 3]), 3, 2)
    assert x.to_list() == [1, 2, 3]
    assert [r.v for r in layout.put_strided(buf(spark, [7, 8, 9]), vec(spark, [1, 2]), -2).orderBy("pos").collect()] == [2, 8, 1]
    full = mat(spark, [[1, 2, 3], [2, 4, 5], [3, 5, 6]])
    for uplo, order in itertools.product("UL", ("col", "row")):
        packed = layout.to_packed(full, uplo, order)
        assert sorted(r.pos for r in packed.collect()) == list(range(6))
        assert layout.from_packed(packed, 3, uplo, layout=order).mirrored(uplo).to_rows() == full.to_rows()
    band = layout.from_band(layout.to_band(full, 1, 0), 3, 3, 1, 0)
    assert band.to_rows() == [[1, 0, 0], [2, 4, 0], [0, 5, 6]]
    assert layout.from_triangle_band(layout.to_band(full, 0, 1), 3, 1, "U").to_rows() == [[1, 2, 0], [0, 4, 5], [0, 0, 6]]
    with pytest.raises(InvalidLeadingDimension):
        layout.from_flat(flat, 3, 2, ld=2)
    with pytest.raises(InvalidStride):
        layout.strided(flat, 2, 0)


def test_bad_arguments(spark):
    a = mat(spark, [[1, 2], [3, 4]])
    with pytest.raises(IllegalArgument) as e:
        l2.gemv("X", 1, a, vec(spark, [1, 2]), 0, vec(spark, [1, 2]))
    assert e.value.info == 1
    with pytest.raises(DimensionMismatch):
        l3.gemm(1, a, mat(spark, [[1, 2, 3]]), 0, a)
    with pytest.raises(Exception, match="NULL"):
        Vector.of(spark.createDataFrame([(0, None)], "i long, v double"), 1).to_list()


def test_empty_shapes(spark):
    empty, y = Matrix.from_values(spark, [], n=0), vec(spark, [1, 2])
    assert l2.gemv("N", 1, empty, y, 5, y).to_list() == [1, 2]
    no_k = Matrix(spark.createDataFrame([], "i long, j long, v double"), 2, 0)
    assert l3.gemm(1, no_k, no_k.transposed(), 2, mat(spark, [[1, 2], [3, 4]])).to_rows() == [[2, 4], [6, 8]]
    longer = l2.gemv("N", 1, mat(spark, [[2]]), vec(spark, [3, 9]), 0, vec(spark, [NAN, 8]))
    assert longer.to_list() == [6, 8]


def test_names(spark):
    fortran = [n for n in names.ROUTINES if n.endswith("_")]
    c_names = [n for n in names.ROUTINES if n.startswith("cblas_")]
    assert (len(fortran), len(c_names)) == (159, 150)
    routine, dtype = names.lookup("cblas_zdscal")
    assert dtype == "z" and routine(2.0, vec(spark, [1 + 1j], "z")).to_list() == [2 + 2j]
    assert names.lookup("idamax_")[0] is l1.iamax and names.same_letter("n", "N")


def test_typed_api(spark):
    x, y = vec(spark, [1, 2]), vec(spark, [3, 4])
    assert api.add_scaled_vector(x, y, 2).to_list() == [5, 8]
    assert api.matrix_vector_multiply(mat(spark, [[1, 1], [0, 1]]), x, y).to_list() == [3, 2]
    assert api.matrix_multiply(mat(spark, [[2]]), mat(spark, [[3]]), mat(spark, [[1]]), result_scale=1).to_rows() == [[7]]
    with pytest.raises(DimensionMismatch):
        api.scale_vector_into(x, vec(spark, [1]), 2)


def test_grams(spark):
    rng = np.random.default_rng(8)
    x = rand(rng, 50, 3)
    df = spark.createDataFrame([(*map(float, r), [float(v) for v in r]) for r in x], "a double, b double, c double, row array<double>")
    want = x.T @ x
    for got in (l3.tall_gram(df, ["a", "b", "c"]), l3.array_gram(df, "row", 3)):
        assert {(r.i, r.j): r.v for r in got.collect()} == {(i, j): want[i, j] for i in range(3) for j in range(i, 3)}


def test_streaming_gram(spark, tmp_path):
    from gramloom.streaming.incremental import running_gram

    spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("a double, b double").parquet(f"{tmp_path}/in")
    q = running_gram(stream, ["a", "b"]).writeStream.outputMode("complete").format("memory").queryName("gram").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.i, r.j): r.v for r in spark.table("gram").collect()} == {(0, 0): 10, (0, 1): 14, (1, 1): 20}
