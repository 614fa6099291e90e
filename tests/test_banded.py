"""Bands over long vectors: halo exchange and solves by interfaces, against NumPy."""

import numpy as np
import pytest

from gramloom.operators import banded, level2, solve
from gramloom.types import Matrix, Vector


def dense(spark, x, dtype):
    i, j = np.nonzero(x)
    pair = lambda v: (float(v.real), float(v.imag)) if dtype == "z" else float(v)
    kind = "struct<re:double,im:double>" if dtype == "z" else "double"
    return Matrix.of(spark.createDataFrame([(int(p), int(q), pair(x[p, q])) for p, q in zip(i, j, strict=True)], f"i long, j long, v {kind}"), *x.shape, dtype=dtype)


def numbers(rng, *shape, dtype="d"):
    x = rng.integers(-3, 4, shape).astype(float)
    return x + 1j * rng.integers(-3, 4, shape) if dtype == "z" else x


@pytest.mark.parametrize(("m", "n", "kl", "ku", "chunk", "dtype"), [(40, 40, 2, 3, 7, "d"), (40, 33, 5, 0, 6, "z"), (20, 50, 1, 2, 8, "d"), (9, 9, 20, 20, 2, "d")])
def test_product(spark, m, n, kl, ku, chunk, dtype):
    rng = np.random.default_rng(1)
    a, x, y = numbers(rng, m, n, dtype=dtype), numbers(rng, n, dtype=dtype), numbers(rng, m + 3, dtype=dtype)
    i, j = np.indices((m, n))
    alpha, beta = (2 - 1j, 1j) if dtype == "z" else (2.0, -1.0)
    want = y.copy()
    want[:m] = alpha * np.where((i - j <= kl) & (j - i <= ku), a, 0) @ x + beta * y[:m]
    found = banded.multiply(kl, ku, alpha, dense(spark, a, dtype), Vector.from_values(spark, x.tolist(), dtype), beta, Vector.from_values(spark, y.tolist(), dtype), chunk)
    assert np.array_equal(np.array(found.to_list()), want)


def test_product_plans_one_shuffle(spark):
    a = dense(spark, np.eye(9), "d")
    x = Vector.from_values(spark, [1.0] * 9)
    plan = level2.gbmv("N", 1, 1, 1, a, x, 1, x, plan="halo").df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("form", ["gbmv", "sbmv", "hbmv", "tbmv", "tbmv unit"])
def test_halo_equals_join(spark, form):
    rng = np.random.default_rng(4)
    dtype = "z" if form == "hbmv" else "d"
    a, x, y = dense(spark, numbers(rng, 15, 15, dtype=dtype), dtype), *(Vector.from_values(spark, numbers(rng, 15, dtype=dtype).tolist(), dtype) for _ in range(2))
    call = {
        "gbmv": lambda p: level2.gbmv("T", 2, 3, 2, a, x, 3, y, plan=p), "sbmv": lambda p: level2.sbmv("L", 2, 2, a, x, 0, y, plan=p), "hbmv": lambda p: level2.hbmv("U", 2, 2j, a, x, 1, y, plan=p),
        "tbmv": lambda p: level2.tbmv("U", "T", "N", 3, a, x, plan=p), "tbmv unit": lambda p: level2.tbmv("L", "N", "U", 3, a, x, plan=p),
    }[form]
    assert call("halo").to_list() == call("join").to_list()


def test_nan_meets_only_cells(spark):
    a = np.eye(6)
    x = Vector.from_values(spark, [1.0, float("nan"), 2.0, float("inf"), 3.0, 4.0])
    got = banded.multiply(1, 1, 1, dense(spark, a, "d"), x, 0, x, 2).to_list()
    assert str(got) == str([1.0, float("nan"), 2.0, float("inf"), 3.0, 4.0])
    got = banded.solve(True, False, 1, dense(spark, a, "d"), x, 2).to_list()
    assert str(got) == str([1.0, float("nan"), 2.0, float("inf"), 3.0, 4.0])


@pytest.mark.parametrize(("n", "k", "chunk", "lower", "unit", "dtype"), [(60, 3, 7, True, False, "d"), (61, 2, 5, False, False, "z"), (50, 1, 4, False, True, "d"), (30, 0, None, True, False, "d"), (45, 4, 4, True, True, "z"), (200, 3, None, False, False, "d")])
def test_solve(spark, n, k, chunk, lower, unit, dtype):
    rng = np.random.default_rng(2)
    i, j = np.indices((n, n))
    a = np.where((i - j <= k) & (j <= i) if lower else (j - i <= k) & (j >= i), numbers(rng, n, n, dtype=dtype), 0)
    np.fill_diagonal(a, 7)
    b = numbers(rng, n, dtype=dtype)
    x = np.array(banded.solve(lower, unit, k, dense(spark, a, dtype), Vector.from_values(spark, b.tolist(), dtype), chunk).to_list())
    if unit:
        np.fill_diagonal(a, 1)
    assert np.abs(a @ x - b).max() <= 1e-9 * max(1, np.abs(x).max())


def test_long_solve_leaves_a_small_residual(spark):
    """100,000 rows of orders-like band through tbsv itself."""
    n, k = 100_000, 8
    cells = spark.range(n).selectExpr("id AS i", f"explode(sequence(0, {k})) AS d").selectExpr("i", "i - d AS j", "if(d = 0, 40D, double((i * 7 + d * 3) % 5 - 2)) AS v").where("j >= 0")
    a, b = Matrix.of(cells, n, n), Vector.of(spark.range(n).selectExpr("id AS i", "double(id % 11) AS v"), n)
    x = solve.tbsv("L", "N", "N", k, a, b)
    back = level2.tbmv("L", "N", "N", k, a, x, plan="halo")
    gap = back.df.withColumnRenamed("v", "w").join(b.df, "i").selectExpr("max(abs(v - w)) AS gap", "count(*) AS n").first()
    assert gap.n == n and gap.gap < 1e-9


def test_chunks_stay_as_large_while_the_vector_grows():
    sizes = [banded.chunk_rows(n, 8, 12) for n in (900_000, 9_000_000, 54_000_000)]
    assert len(set(sizes)) == 1 and sizes[0] * 9 <= 1 << 17
    assert all(banded.chunk_rows(10**8, k, 12) >= min(4 * k, (1 << 20) // (k + 1)) for k in (0, 1, 100, 300, 1000))  # no narrower beside wide bands
