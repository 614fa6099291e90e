"""Matrix-vector products and rank-1 and rank-2 updates, on dense, banded, symmetric, packed and triangular operands.

Storage forms are decoded by ``sources.layout``; a band or triangle is a filter
below the join, a symmetric operand one generated mirror, and every product is
one equi-join against the vector and one sum.  Bands over vectors too long to
broadcast go by halo exchange.  Rank updates make the cells that both vectors
have: an element meets the other vector in strips of a fixed width.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..arguments import check, place
from ..functions.scalars import Scalars
from ..plans.strategy import BROADCAST_CELLS, small
from ..types import DIAG, TRANS, UPLO, DimensionMismatch, Matrix, Vector, flag
from . import banded
from .level1 import _same_type, zipped
from .level3 import combine, inside, summed


def _finish(alpha, p, beta, y: Vector, m: int) -> Vector:
    """alpha * p + beta * y below m, y beyond; y is not read where beta is 0, and cells that neither has stay structural zeros."""
    s = y.s
    out = y.made(summed(y, ["i"], None if p is None else p.select("i", s.scale(alpha, F.col("p")).alias("v")), beta, y.prefix(m)))
    return out if m >= y.n else Vector(out.df.unionByName(y.df.where(F.col("i") >= m)), y.n, y.dtype)


def gemv(trans: str, alpha, a: Matrix, x: Vector, beta, y: Vector) -> Vector:
    """alpha * op(A) x + beta * y.  Vectors may be longer than needed: their prefix is used.  An empty A leaves y as it is."""
    _same_type(a, x, y)
    a = a.op(flag(trans, TRANS, "gemv", 1))
    if x.n < a.n or y.n < a.m:
        raise DimensionMismatch(f"{a.m} x {a.n} by {x.n} into {y.n}", "gemv", place("gemv", "x" if x.n < a.n else "y"))
    if a.m == 0 or a.n == 0:
        return y
    s, p = a.s, None
    if alpha != 0:
        terms = a.cells("a").join(small(x.prefix(a.n).cells("x").withColumnRenamed("i", "j"), a.n), "j")
        p = terms.groupBy("i").agg(s.total(s.mul(F.col("a"), F.col("x"))).alias("p"))
    return _finish(alpha, p, beta, y, a.m)


def _banded(kl: int, ku: int, alpha, a: Matrix, x: Vector, beta, y: Vector, plan: str | None) -> Vector:
    """A band times a vector: ``halo`` by chunks of rows, ``join`` by ``gemv``; by the length of x if no plan is given."""
    _same_type(a, x, y)
    if plan == "halo" or (plan is None and a.n > BROADCAST_CELLS):
        return banded.multiply(kl, ku, alpha, a, x, beta, y)
    return gemv("N", alpha, a.band(kl, ku), x, beta, y)


def gbmv(trans: str, kl: int, ku: int, alpha, a: Matrix, x: Vector, beta, y: Vector, plan: str | None = None) -> Vector:
    check("gbmv", trans=trans, kl=kl, ku=ku)
    trans = flag(trans, TRANS, "gbmv", 1)
    below, above = (kl, ku) if trans == "N" else (ku, kl)
    return _banded(below, above, alpha, a.op(trans), x, beta, y, plan)


def symv(uplo: str, alpha, a: Matrix, x: Vector, beta, y: Vector) -> Vector:
    return gemv("N", alpha, a.mirrored(flag(uplo, UPLO, "symv", 1)), x, beta, y)


def hemv(uplo: str, alpha, a: Matrix, x: Vector, beta, y: Vector) -> Vector:
    return gemv("N", alpha, a.mirrored(flag(uplo, UPLO, "hemv", 1), hermitian=True), x, beta, y)


def sbmv(uplo: str, k: int, alpha, a: Matrix, x: Vector, beta, y: Vector, plan: str | None = None) -> Vector:
    check("sbmv", uplo=uplo, k=k)
    return _banded(k, k, alpha, a.band(k, k).mirrored(flag(uplo, UPLO, "sbmv", 1)), x, beta, y, plan)


def hbmv(uplo: str, k: int, alpha, a: Matrix, x: Vector, beta, y: Vector, plan: str | None = None) -> Vector:
    check("hbmv", uplo=uplo, k=k)
    return _banded(k, k, alpha, a.band(k, k).mirrored(flag(uplo, UPLO, "hbmv", 1), hermitian=True), x, beta, y, plan)


def spmv(uplo: str, alpha, ap, n: int, x: Vector, beta, y: Vector) -> Vector:
    """``ap``: a packed buffer ``(pos, v)``."""
    from ..sources.layout import from_packed

    check("spmv", uplo=uplo, n=n)
    return symv(uplo, alpha, from_packed(ap, n, uplo, y.dtype), x, beta, y)


def hpmv(uplo: str, alpha, ap, n: int, x: Vector, beta, y: Vector) -> Vector:
    from ..sources.layout import from_packed

    check("hpmv", uplo=uplo, n=n)
    return hemv(uplo, alpha, from_packed(ap, n, uplo, y.dtype), x, beta, y)


def trmv(uplo: str, trans: str, diag: str, a: Matrix, x: Vector) -> Vector:
    """op(A) x of a triangle; the other triangle and a unit diagonal are never read."""
    check("trmv", uplo=uplo, trans=trans, diag=diag)
    t = a.triangular(flag(uplo, UPLO, "trmv", 1), flag(diag, DIAG, "trmv", 3))
    return gemv(trans, 1, t, x, 0, x)


def tbmv(uplo: str, trans: str, diag: str, k: int, a: Matrix, x: Vector, plan: str | None = None) -> Vector:
    check("tbmv", uplo=uplo, trans=trans, diag=diag, k=k)
    if plan != "halo" and (plan is not None or a.n <= BROADCAST_CELLS):
        return trmv(uplo, trans, diag, a.band(k, k), x)
    uplo, trans, unit = uplo[:1].upper(), trans[:1].upper(), diag[:1].upper() == "U"
    t = a.triangle(uplo)
    if unit:  # its diagonal is x itself, not read
        t = Matrix(t.df.where("i <> j"), a.m, a.n, a.dtype)
    lower = (uplo == "L") == (trans == "N")
    return banded.multiply(k if lower else 0, 0 if lower else k, 1, t.op(trans), x, 1 if unit else 0, x)


def tpmv(uplo: str, trans: str, diag: str, ap, x: Vector) -> Vector:
    from ..sources.layout import from_packed

    check("tpmv", uplo=uplo, trans=trans, diag=diag)
    return trmv(uplo, trans, diag, from_packed(ap, x.n, uplo, x.dtype), x)


#: Elements of a strip of a rank update.
STRIP = 1024


def _outer(left, right, n: int, uplo: str | None, values: list[str]):
    """``i, j`` and the values of every cell of a triangle, or of the whole, whose row is in ``left(i, ...)`` and column in ``right(j, ...)``.

    Columns come in strips; an element of the left side meets each strip there is once, so nothing is made that neither vector has.
    """
    strips = right.groupBy(F.expr(f"j div {STRIP}").alias("strip")).agg(F.collect_list(F.struct("j", *values)).alias("other"))
    own = F.expr(f"i div {STRIP}")
    first, last = F.lit(0).cast("long"), F.lit(max(0, n - 1) // STRIP).cast("long")
    first, last = (own, last) if uplo == "U" else (first, F.least(own, last)) if uplo == "L" else (first, last)
    met = left.withColumn("strip", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))).join(small(strips, n), "strip")
    cells = met.select("i", *[c for c in left.columns if c != "i"], F.explode("other").alias("o")).select("i", *[c for c in left.columns if c != "i"], "o.*")
    keep = inside(uplo)
    return cells if keep is None else cells.where(keep)


def ger(alpha, x: Vector, y: Vector, a: Matrix, conjugated: bool = False) -> Matrix:
    """A + alpha * x y^T (geru), or x y^H (gerc)."""
    _same_type(a, x, y)
    if x.n < a.m or y.n < a.n:
        raise DimensionMismatch(f"{x.n} by {y.n} into {a.m} x {a.n}", "ger", place("ger", "x" if x.n < a.m else "y"))
    if alpha == 0:
        return a
    s, right = a.s, F.col("y")
    cells = _outer(x.prefix(a.m).cells("x"), y.prefix(a.n).cells("y").withColumnRenamed("i", "j"), a.n, None, ["y"])
    return combine(alpha, cells.select("i", "j", s.mul(F.col("x"), s.conj(right) if conjugated else right).alias("p")), 1, a)


def gerc(alpha, x: Vector, y: Vector, a: Matrix) -> Matrix:
    return ger(alpha, x, y, a, conjugated=True)


def _square(a: Matrix, *vectors: Vector) -> None:
    if a.m != a.n or any(v.n < a.n for v in vectors):
        raise DimensionMismatch(f"{a.m} x {a.n} and {[v.n for v in vectors]}")


def syr(uplo: str, alpha, x: Vector, a: Matrix, hermitian: bool = False) -> Matrix:
    """A + alpha * x x^T (or x x^H with real alpha) on one triangle; a Hermitian diagonal comes out real."""
    _square(a, x)
    uplo, s = flag(uplo, UPLO, "syr", 1), a.s
    if alpha == 0:
        return a
    right = s.conj(F.col("y")) if hermitian else F.col("y")
    cells = _outer(x.prefix(a.n).cells("x"), x.prefix(a.n).cells("y").withColumnRenamed("i", "j"), a.n, uplo, ["y"])
    return combine(alpha, cells.select("i", "j", s.mul(F.col("x"), right).alias("p")), 1, a, uplo, hermitian)


def her(uplo: str, alpha: float, x: Vector, a: Matrix) -> Matrix:
    check("her", uplo=uplo)
    return syr(uplo, float(alpha), x, a, hermitian=True)


def syr2(uplo: str, alpha, x: Vector, y: Vector, a: Matrix, hermitian: bool = False) -> Matrix:
    """A + alpha * (x y^T + y x^T), or alpha * x y^H + conj(alpha) * y x^H, on one triangle."""
    _square(a, x, y)
    uplo, s = flag(uplo, UPLO, "syr2", 1), a.s
    if alpha == 0:
        return a
    x, y = x.prefix(a.n), y.prefix(a.n)
    turn, back = s.conj if hermitian else lambda v: v, alpha.conjugate() if hermitian else alpha
    outer = lambda left, right, f: _outer(left.cells("x"), right.cells("y").withColumnRenamed("i", "j"), a.n, uplo, ["y"]).select("i", "j", s.scale(f, s.mul(F.col("x"), turn(F.col("y")))).alias("p"))
    return combine(1, outer(x, y, alpha).unionByName(outer(y, x, back)), 1, a, uplo, hermitian)  # summed with A


def her2(uplo: str, alpha, x: Vector, y: Vector, a: Matrix) -> Matrix:
    check("her2", uplo=uplo)
    return syr2(uplo, complex(alpha), x, y, a, hermitian=True)


def _packed(name: str, uplo: str, ap, n: int, dtype: str, vectors, terms, hermitian: bool = False):
    """A packed buffer with terms of vectors added, place by place: a projection of the buffer.

    ``vectors`` has the cells ``(i, ...)``; a term is the names of its column at the row and at the column, and its value of both.  It
    counts where both are there.  Places that the buffer lacks stay absent.
    """
    from ..sources.layout import packed_cells

    s = Scalars(dtype)
    names = [c for c in vectors.columns if c != "i"]
    side = lambda key, mark: small(vectors.select(F.col("i").alias(key), *[F.col(c).alias(f"{c}_{mark}") for c in names]), n)
    cells = packed_cells(ap, n, flag(uplo, UPLO, name, 1)).join(side("i", "here"), "i", "left").join(side("j", "there"), "j", "left")
    value = s.wide(F.col("v"))
    for here, there, term in terms:
        here, there = F.col(f"{here}_here"), F.col(f"{there}_there")
        value = s.add(value, F.when(here.isNotNull() & there.isNotNull(), term(here, there)).otherwise(s.lit(0)))
    if hermitian and s.is_complex:
        value = s.pair(value["re"], F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(value["im"]))
    return cells.select("pos", s.narrow(value).alias("v"))


def spr(uplo: str, alpha, x: Vector, ap, hermitian: bool = False):
    """``syr`` on a packed buffer ``(pos, v)``; so spr2, hpr and hpr2."""
    s = x.s
    if alpha == 0:
        return ap
    turn = s.conj if hermitian else lambda v: v
    return _packed("hpr" if hermitian else "spr", uplo, ap, x.n, x.dtype, x.cells("x"), [("x", "x", lambda a, b: s.scale(alpha, s.mul(a, turn(b))))], hermitian)


def hpr(uplo: str, alpha: float, x: Vector, ap):
    return spr(uplo, float(alpha), x, ap, hermitian=True)


def spr2(uplo: str, alpha, x: Vector, y: Vector, ap, hermitian: bool = False):
    _same_type(x, y)
    if alpha == 0:
        return ap
    if y.n < x.n:
        raise DimensionMismatch(f"{x.n} and {y.n}", "spr2", place("spr2", "y"))
    s, back = x.s, alpha.conjugate() if hermitian else alpha
    turn = s.conj if hermitian else lambda v: v
    terms = [("x", "y", lambda a, b: s.scale(alpha, s.mul(a, turn(b)))), ("y", "x", lambda a, b: s.scale(back, s.mul(a, turn(b))))]
    return _packed("hpr2" if hermitian else "spr2", uplo, ap, x.n, x.dtype, zipped(x, y.prefix(x.n), "full"), terms, hermitian)


def hpr2(uplo: str, alpha, x: Vector, y: Vector, ap):
    return spr2(uplo, complex(alpha), x, y, ap, hermitian=True)
