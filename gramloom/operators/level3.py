"""Matrix products and rank-k updates.

A product is an equi-join on the contraction index and a sum by (i, j); what
may be skipped (alpha = 0, beta = 0, an unread triangle) is decided while the
plan is built.  Large products of cells go by tiles, so no row is made per
scalar multiplication; operands that are relations of tiles (``Blocks``) stay so.
A term exists where both cells do, in every plan.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.strategy import product_plan, small
from ..arguments import check, place
from ..types import SIDE, TRANS, UPLO, DimensionMismatch, Matrix, Vector, flag
from .blocked import Blocks, as_blocks, rows_of, update
from .level1 import _same_type


def inside(uplo: str | None) -> Column | None:
    return None if uplo is None else F.col("i") <= F.col("j") if uplo == "U" else F.col("i") >= F.col("j")


def product(a: Matrix, b: Matrix, uplo: str | None = None, plan: str | None = None) -> DataFrame:
    """``i, j, p``: cells of A B that have any term, in double precision; one triangle only if asked."""
    if a.n != b.m:
        raise DimensionMismatch(f"{a.m} x {a.n} by {b.m} x {b.n}")
    s, plan = a.s, plan or product_plan(a.m, a.n, b.n)
    if plan == "block":
        wide = lambda x: Blocks.of(replace(x.made(x.cells()), df=x.cells(), dtype="z" if s.is_complex else "d"))  # noqa: E731  sums are rounded by the caller
        return update(1, wide(a), wide(b), 0, None, uplo).cells("p")
    left, right = a.cells("x").withColumnRenamed("j", "k"), b.cells("y").withColumnRenamed("i", "k")
    if plan == "broadcast":
        left, right = (left, small(right, b.m * b.n)) if b.m * b.n <= a.m * a.n else (small(left, a.m * a.n), right)
    terms = left.join(right, "k")
    if (keep := inside(uplo)) is not None:
        terms = terms.where(keep)  # before the sum
    return terms.groupBy("i", "j").agg(s.total(s.mul(F.col("x"), F.col("y"))).alias("p"))


def summed(shape: Matrix | Vector, keys: list[str], term: DataFrame | None, beta, old: Matrix | Vector) -> DataFrame:
    """Cells of ``term`` and of beta * ``old`` in double precision, added where both have one: one union, one aggregate."""
    s = shape.s
    kept = None if beta == 0 else old.cells().select(*keys, s.scale(beta, F.col("v")).alias("v"))
    if term is None or kept is None:
        found = term if kept is None else kept
        return old.cells().limit(0) if found is None else found
    return term.unionByName(kept).groupBy(*keys).agg(s.total(F.col("v")).alias("v"))


def combine(alpha, p: DataFrame | None, beta, c: Matrix, uplo: str | None = None, real_diagonal: bool = False) -> Matrix:
    """alpha * p + beta * C (on a triangle): C is not read when beta is 0, p absent when alpha is 0; the other triangle is C's.

    Cells that neither has stay structural zeros, so work follows the cells there are; ``dense`` spells zeros out.
    """
    s, value = c.s, F.col("v")
    half = c if uplo is None else c.triangle(uplo)
    if real_diagonal and s.is_complex:
        value = s.pair(value["re"], F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(value["im"]))
    term = None if p is None else p.select("i", "j", s.scale(alpha, F.col("p")).alias("v"))
    out = c.made(summed(c, ["i", "j"], term, beta, half).select("i", "j", value.alias("v")))
    return out if uplo is None else replace(out, df=out.df.unionByName(c.df.where("i > j" if uplo == "U" else "i < j")))


def _update(alpha, a, b, beta, c, uplo: str | None = None, real_diagonal: bool = False, plan: str | None = None):
    """alpha * A B + beta * C (on a triangle): in tiles if any operand is, else in cells."""
    if any(isinstance(x, Blocks) for x in (a, b, c)):
        return update(alpha, as_blocks(a), as_blocks(b), beta, as_blocks(c), uplo, real_diagonal)
    return combine(alpha, None if alpha == 0 or a.n == 0 else product(a, b, uplo, plan), beta, c, uplo, real_diagonal)


def gemm(alpha, a: Matrix, b: Matrix, beta, c: Matrix, trans_a: str = "N", trans_b: str = "N", plan: str | None = None) -> Matrix:
    """alpha * op(A) op(B) + beta * C, any of the nine pairs of transposes; of relations of tiles if one operand is one."""
    _same_type(a, b, c)
    a, b = a.op(flag(trans_a, TRANS, "gemm", 1)), b.op(flag(trans_b, TRANS, "gemm", 2))
    if (a.m, a.n, b.n) != (c.m, b.m, c.n):
        raise DimensionMismatch(f"{a.m} x {a.n} by {b.m} x {b.n} into {c.m} x {c.n}", "gemm", place("gemm", "m" if a.m != c.m else "k" if a.n != b.m else "n"))
    return _update(alpha, a, b, beta, c, plan=plan)


def _sided(side: str, alpha, a: Matrix, b: Matrix, beta, c: Matrix, name: str) -> Matrix:
    side = flag(side, SIDE, name, 1)
    return gemm(alpha, a, b, beta, c) if side == "L" else gemm(alpha, b, a, beta, c)


def symm(side: str, uplo: str, alpha, a: Matrix, b: Matrix, beta, c: Matrix) -> Matrix:
    return _sided(side, alpha, a.mirrored(flag(uplo, UPLO, "symm", 2)), b, beta, c, "symm")


def hemm(side: str, uplo: str, alpha, a: Matrix, b: Matrix, beta, c: Matrix) -> Matrix:
    return _sided(side, alpha, a.mirrored(flag(uplo, UPLO, "hemm", 2), hermitian=True), b, beta, c, "hemm")


def _rank_k(name, uplo, trans, alpha, a: Matrix, beta, c: Matrix, hermitian: bool) -> Matrix:
    uplo, trans = flag(uplo, UPLO, name, 1), flag(trans, TRANS, name, 2)
    a = a if trans == "N" else a.op("C" if hermitian else "T")
    if not a.m == c.m == c.n:
        raise DimensionMismatch(f"{a.m} and {c.m} x {c.n}")
    return _update(alpha, a, a.op("C" if hermitian else "T"), beta, c, uplo, hermitian)


def syrk(uplo: str, trans: str, alpha, a: Matrix, beta, c: Matrix) -> Matrix:
    """One triangle of alpha * A A^T (or A^T A) + beta * C; the other stays C's."""
    return _rank_k("syrk", uplo, trans, alpha, a, beta, c, False)


def herk(uplo: str, trans: str, alpha: float, a: Matrix, beta: float, c: Matrix) -> Matrix:
    return _rank_k("herk", uplo, trans, float(alpha), a, float(beta), c, True)


def _rank_2k(name, uplo, trans, alpha, a: Matrix, b: Matrix, beta, c: Matrix, hermitian: bool) -> Matrix:
    uplo, trans = flag(uplo, UPLO, name, 1), flag(trans, TRANS, name, 2)
    turn = "C" if hermitian else "T"
    a, b = (a, b) if trans == "N" else (a.op(turn), b.op(turn))
    if (a.m, a.n) != (b.m, b.n) or not a.m == c.m == c.n:
        raise DimensionMismatch(f"{a.m} x {a.n}, {b.m} x {b.n} and {c.m} x {c.n}")
    if alpha == 0 or a.n == 0:
        return _update(0, a, b.op(turn), beta, c, uplo, hermitian)
    s, back = c.s, alpha.conjugate() if hermitian else alpha
    if any(isinstance(x, Blocks) for x in (a, b, c)):
        return _update(back, b, a.op(turn), 1, _update(alpha, a, b.op(turn), beta, c, uplo, hermitian), uplo, hermitian)
    one = product(a, b.op(turn), uplo).select("i", "j", s.scale(alpha, F.col("p")).alias("p"))
    two = product(b, a.op(turn), uplo).select("i", "j", s.scale(back, F.col("p")).alias("p"))
    p = one.unionByName(two).groupBy("i", "j").agg(s.total(F.col("p")).alias("p"))
    return combine(1, p, beta, c, uplo, hermitian)


def syr2k(uplo: str, trans: str, alpha, a: Matrix, b: Matrix, beta, c: Matrix) -> Matrix:
    return _rank_2k("syr2k", uplo, trans, alpha, a, b, beta, c, False)


def her2k(uplo: str, trans: str, alpha, a: Matrix, b: Matrix, beta: float, c: Matrix) -> Matrix:
    return _rank_2k("her2k", uplo, trans, alpha, a, b, float(beta), c, True)


def trmm(side: str, uplo: str, trans: str, diag: str, alpha, a: Matrix, b: Matrix) -> Matrix:
    """alpha * op(A) B, or alpha * B op(A), of a triangle."""
    check("trmm", side=side, uplo=uplo, trans=trans, diag=diag)
    t = a.triangular(uplo[:1].upper(), diag[:1].upper()).op(trans[:1].upper())
    return _sided(side, alpha, t, b, 0, b, "trmm")


def tall_gram(df: DataFrame, columns: list[str | Column]) -> DataFrame:
    """``i, j, v``, i <= j: the Gram matrix of a few numeric columns of a table of any length.

    One scan, one aggregate of p (p + 1) / 2 sums, no join: the plan for tall matrices.
    """
    values = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns]
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    sums = df.agg(*[F.coalesce(F.sum(values[i] * values[j]), F.lit(0.0)).alias(f"g{k}") for k, (i, j) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.col(f"g{k}").alias("v")) for k, (i, j) in enumerate(pairs)])
    return sums.select(F.explode(cells).alias("c")).select("c.i", "c.j", "c.v")


def array_gram(df: DataFrame, array: str, n: int) -> DataFrame:
    """``i, j, v``, i <= j: the Gram matrix of an array column of n numbers; one small matrix of partial sums from each task."""

    def run(batches):
        total = np.zeros((n, n))
        with np.errstate(all="ignore"):
            for batch in batches:
                x = rows_of(batch.column(0), n)
                total += x.T @ x
        i, j = np.triu_indices(n)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i), "j": pa.array(j), "v": pa.array(total[i, j])})

    rows = df.select(F.col(array).cast("array<double>").alias("row"))
    return rows.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
