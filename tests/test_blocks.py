"""Relations of tiles: equal to the cell plans, NaN and missing cells included, in chains, groups and slabs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramloom.operators import blocked, level3, solve
from gramloom.operators.blocked import Blocks
from gramloom.plans.strategy import grouping
from gramloom.types import DimensionMismatch, Matrix, Vector

NAN, INF = float("nan"), float("inf")


@pytest.fixture(autouse=True)
def small_tiles(monkeypatch):
    monkeypatch.setattr(blocked, "BLOCK", 4)


def matrix(spark, m, n, dtype, seed, special=0.03, missing=0.3) -> Matrix:
    rng, cells = np.random.default_rng(seed), []
    odd = lambda: [NAN, INF, -INF][rng.integers(3)] if rng.random() < special else float(rng.integers(-4, 5))
    for i in range(m):
        for j in range(n):
            if rng.random() >= missing:
                cells.append((i, j, (odd(), odd()) if dtype in "cz" else odd()))
    real = "float" if dtype in "sc" else "double"
    return Matrix(spark.createDataFrame(cells, f"i long, j long, v {f'struct<re:{real},im:{real}>' if dtype in 'cz' else real}").coalesce(2), m, n, dtype)


def told(x) -> dict:
    x = x.matrix() if isinstance(x, Blocks) else x
    name = lambda v: str(v + 0.0) if isinstance(v, float) else f"{v.re + 0.0} {v.im + 0.0}"
    return {(r.i, r.j): name(r.v) for r in x.df.collect()}


@pytest.mark.parametrize("dtype", ["d", "z"])
def test_tiles_equal_cells(spark, dtype):
    a, b, c, q = matrix(spark, 9, 7, dtype, 1), matrix(spark, 7, 10, dtype, 2), matrix(spark, 9, 10, dtype, 3), matrix(spark, 9, 9, dtype, 4)
    alpha = 2 - 1j if dtype == "z" else 2.0
    forms = {
        "gemm": lambda f: level3.gemm(alpha, f(a), f(b), 3, f(c)),
        "alpha 0": lambda f: level3.gemm(0, f(a), f(b), 2, f(c)),
        "chain": lambda f: level3.gemm(1, level3.gemm(1, f(a), f(b), 0, f(c)), f(c), 1, f(q), "N", "C"),
        "syrk": lambda f: level3.syrk("U", "N", alpha, f(a), 0, f(q)),
        "syr2k": lambda f: level3.syr2k("L", "N", alpha, f(a), f(a), 1, f(q)),
        "trmm": lambda f: level3.trmm("L", "U", "C", "U", alpha, f(q), f(c)),
    }
    if dtype == "z":
        forms |= {"herk": lambda f: level3.herk("L", "C", 2, f(c), 0.5, f(matrix(spark, 10, 10, dtype, 5))), "hemm": lambda f: level3.hemm("L", "U", alpha, f(q), f(c), 2, f(c))}
    for name, form in forms.items():
        assert told(form(Blocks.of)) == told(form(lambda x: x)), name


@pytest.mark.parametrize("uplo", [None, "U", "L"])
def test_nan_infinity_and_missing_cells_in_every_plan(spark, uplo):
    a, b = matrix(spark, 9, 9, "d", 6, special=0.1), matrix(spark, 9, 9, "d", 7, special=0.1)
    found = [{(r.i, r.j): str(r.p + 0.0) for r in level3.product(a, b, uplo, plan).collect()} for plan in ("join", "broadcast", "block")]
    assert found[0] == found[1] == found[2] and "nan" in found[0].values()


def test_stored_zero_meets_nan_and_missing_does_not(spark):
    a = Matrix(spark.createDataFrame([(0, 0, 0.0), (1, 1, 5.0)], "i long, j long, v double"), 2, 2)
    b = Matrix(spark.createDataFrame([(0, 0, NAN), (1, 0, 2.0)], "i long, j long, v double"), 2, 2)
    for plan in ("join", "broadcast", "block"):
        got = {(r.i, r.j): r.v for r in level3.gemm(1, a, b, 0, a, plan=plan).df.collect()}
        assert math.isnan(got[0, 0]) and got[1, 0] == 10.0 and set(got) == {(0, 0), (1, 0)}


@pytest.mark.parametrize("groups", [(1, 1), (2, 2), (8, 1), (8, 3), (3, 2)])
def test_groups_and_slabs_change_nothing(spark, groups):
    a, b, c = (matrix(spark, 11, 11, "d", k) for k in (8, 9, 10))
    want = told(level3.gemm(2, a, b, 3, c))
    assert told(blocked.update(2, Blocks.of(a), Blocks.of(b), 3, Blocks.of(c), groups=groups)) == want


def test_chain_stays_in_tiles(spark):
    a = Blocks.of(matrix(spark, 9, 9, "d", 1))
    chain = level3.gemm(1, level3.gemm(1, a, a, 0, a), a, 0, a)
    plan = chain.df._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "Join" not in plan and "HashAggregate" not in plan


def test_grouping():
    """All cores at k = 1; sums over slabs follow the cores, not k; no tile is sent once a multiplication."""
    edge, slabs = grouping(20, 1, 20, 8)
    assert slabs == 1 and (-(-20 // edge)) ** 2 >= 8
    for k in (8, 80, 800):
        edge, slabs = grouping(2, k, 2, 8)
        assert slabs * -(-2 // edge) ** 2 <= 16
    edge, slabs = grouping(64, 64, 64, 8)
    assert edge == 8 and slabs == 1  # 8 copies of each tile, not 64


def test_sums_do_not_grow_with_k(spark):
    """Slabs, and so the rows of the sums' shuffle, are the same for ten times as many tiles of k; the product stays right."""
    assert grouping(2, 100, 2, 8) == grouping(2, 1000, 2, 8)
    a, b = matrix(spark, 8, 60, "d", 1, missing=0), matrix(spark, 60, 8, "d", 2, missing=0)
    assert told(blocked.update(1, Blocks.of(a), Blocks.of(b), 0, None)) == told(level3.gemm(1, a, b, 0, Matrix(a.df.limit(0), 8, 8)))


def test_stored_and_turned(spark, tmp_path):
    a = matrix(spark, 9, 6, "z", 3)
    kept = Blocks.of(a).op("C").stored(str(tmp_path / "tiles"))
    assert (kept.m, kept.n) == (6, 9) and told(kept) == told(a.op("C")) and told(kept.op("T").op("C").op("T").op("T")) == told(a.op("C").op("T").op("C").op("T").op("T"))


def test_rows_of_arrays(spark):
    df = spark.createDataFrame([(k, [float(k * 10 + j) for j in range(6)]) for k in (0, 1, 4, 5, 8)], "k int, row array<double>")
    assert told(Blocks.from_rows(df, 9, 6, "k", "row")) == told(Matrix.from_rows(df, 9, 6, "k", "row"))
    with pytest.raises(Exception, match="array of 5"):
        Blocks.from_rows(df, 9, 5, "k", "row").df.collect()


def test_array_gram_keeps_nan(spark):
    df = spark.createDataFrame([([NAN, 1.0],), ([2.0, 3.0],)], "row array<double>")
    got = {(r.i, r.j): r.v for r in level3.array_gram(df, "row", 2).collect()}
    assert math.isnan(got[0, 0]) and math.isnan(got[0, 1]) and got[1, 1] == 10.0
    for rows in ([(None,)], [([1.0],)], [([1.0, None],)]):
        with pytest.raises(Exception, match="array of 2|NULL"):
            level3.array_gram(spark.createDataFrame(rows, "row array<double>"), "row", 2).collect()


def test_mismatch(spark):
    a = Blocks.of(matrix(spark, 4, 5, "d", 1))
    with pytest.raises(DimensionMismatch):
        level3.gemm(1, a, a, 0, a)


@pytest.mark.parametrize(("uplo", "diag", "trans"), [("L", "N", "N"), ("U", "U", "C"), ("U", "N", "T")])
def test_inverse_by_halves(spark, uplo, diag, trans):
    """64 rows in 16 tiles: as many rounds as 4,096 rows in real ones, logarithmic in the tiles."""
    n, rounds = 64, []
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (n, n)) / 16.0
    np.fill_diagonal(x, 3)
    a = Matrix.from_values(spark, x.tolist())

    def cut(df):
        rounds.append(1)
        return spark.createDataFrame(df.toArrow(), df.schema)

    got = np.array(blocked.inverse(Blocks.of(a), uplo, diag, cut).op(trans).matrix().to_rows())
    t = np.triu(x) if uplo == "U" else np.tril(x)
    if diag == "U":
        np.fill_diagonal(t, 1)
    t = t if trans == "N" else t.T
    assert np.abs(t @ got - np.eye(n)).max() < 1e-10 and len(rounds) <= 6


def test_solve_by_inverse_with_missing_pivots(spark, monkeypatch):
    monkeypatch.setattr(solve, "BLOCK", 4)
    a = Matrix(spark.createDataFrame([(k, k, 2.0) for k in range(9) if k != 5], "i long, j long, v double"), 9, 9)
    x = solve.trsv("L", "N", "N", a, Vector.from_values(spark, [4.0] * 9)).to_list()
    assert x[:5] == [2.0] * 5 and not math.isfinite(x[5]) and solve.trsv("L", "N", "U", a, Vector.from_values(spark, [4.0] * 9)).to_list() == [4.0] * 9


def test_solve_of_tiles(spark):
    x = np.tril(np.random.default_rng(1).integers(1, 4, (9, 9))).astype(float)
    b = np.arange(27.0).reshape(9, 3)
    got = solve.trsm("L", "L", "N", "N", 2, Blocks.of(Matrix.from_values(spark, x.tolist())), Blocks.of(Matrix.from_values(spark, b.tolist())))
    assert isinstance(got, Blocks) and np.allclose(x @ np.array(got.matrix().to_rows()), 2 * b)
    assert set(told(solve.trsm("L", "L", "N", "N", 0, Blocks.of(Matrix.from_values(spark, x.tolist())), Blocks.of(Matrix.from_values(spark, b.tolist())))).values()) == {"0.0"}


def test_wide_sum_is_rounded_once(spark):
    """Single precision: products and sums in double, rounded on return, in tiles as in cells."""
    rng = np.random.default_rng(2)
    a, b = (Matrix.from_values(spark, rng.random((9, 9)).astype(np.float32).tolist(), "s") for _ in range(2))
    tiles, cells = level3.gemm(1, Blocks.of(a), Blocks.of(b), 0, Blocks.of(a)).matrix(), level3.gemm(1, a, b, 0, a)
    both = tiles.df.withColumnRenamed("v", "x").join(cells.df, ["i", "j"])
    assert both.count() == 81 and both.where(F.abs(F.col("x") - F.col("v")) > 1e-6).count() == 0
