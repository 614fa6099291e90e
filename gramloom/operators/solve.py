"""Triangular solves.

A triangle of at most BLOCK rows is solved for all right sides at once, each an
ordered fold in its own group.  A larger one is inverted by halves in tiles
(``blocked.inverse``), so dependent rounds are the logarithm of its tiles, and
multiplied.  A band over a long vector goes by chunks and their interfaces
(``banded.solve``).  Rounds write what they found to the shared checkpoint
folder.  Division is IEEE: a zero pivot gives infinities and NaN, never an error.
"""

from __future__ import annotations

import tempfile
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arguments import check
from ..functions.scalars import bind
from ..types import DIAG, SIDE, TRANS, UPLO, DimensionMismatch, Matrix, Vector, flag
from . import banded
from .blocked import Blocks, as_blocks, inverse, update
from .level1 import _same_type

BLOCK = 128


def _fold(t: DataFrame, b: DataFrame, lower: bool, unit: bool, n: int, s) -> DataFrame:
    """Solve one diagonal block (rows 0 .. n-1) for every column of ``b(i, j, v)``."""
    at = (lambda c: c) if lower else (lambda c: F.lit(n - 1) - c)  # order of elimination
    rows = t.select(at(F.col("i")).cast("int").alias("r"), at(F.col("j")).cast("int").alias("k"), "v").groupBy("r").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("row"))
    table = F.broadcast(rows.agg(F.map_from_entries(F.collect_list(F.struct("r", "row"))).alias("rows")))
    sides = b.select("j", at(F.col("i")).cast("int").alias("r"), "v").groupBy("j").agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("b"))
    pick = F.array(*[F.try_element_at("rows", F.lit(r)) for r in range(n)])
    given = F.array(*[s.or_zero(F.try_element_at("b", F.lit(r))) for r in range(n)])
    flat = sides.join(table).select("j", pick.alias("rows"), given.alias("b"))
    none = F.array(s.lit(0)).getItem(F.lit(0))

    cell = "struct<re:double,im:double>" if s.is_complex else "double"

    def solved_by(x, r, row):
        known = F.aggregate(F.filter(row, lambda c: c["k"] < r), s.lit(0), lambda acc, c: s.add(acc, s.mul(c["v"], F.get(x, c["k"]))))
        value = s.sub(F.get("b", r), known)
        if unit:
            return value
        pivot = s.or_zero(F.get(F.filter(row, lambda c: c["k"] == r), F.lit(0))["v"])
        return bind(F.struct(value.alias("v"), pivot.alias("p")), lambda q: s.div(q["v"], q["p"]))

    def step(x, r):
        row = F.coalesce(F.get("rows", r), F.array().cast(f"array<struct<k:int,v:{cell}>>"))
        return F.concat(x, F.array(bind(row, lambda w: solved_by(x, r, w))))

    empty = F.slice(F.array(none), 1, 0)
    solved = flat.select("j", F.posexplode(F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), empty, step)).alias("r", "v"))
    return solved.select(at(F.col("r")).cast("long").alias("i"), "j", "v")


def _cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder the cluster names; in one of our own only where none is set."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: executors and driver need a folder they share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-gramloom-"))
    return df.checkpoint()


def _by_inverse(side: str, uplo: str, trans: str, diag: str, alpha, a: Matrix | Blocks, b: Matrix | Blocks) -> Blocks:
    """alpha * op(A)^-1 B, or alpha * B op(A)^-1, in tiles; the other triangle is never read."""
    t = inverse(a if isinstance(a, Blocks) else as_blocks(a.triangle(uplo)), uplo, diag, _cut_lineage).op(trans)
    return update(alpha, t, as_blocks(b), 0, None) if side == "L" else update(alpha, as_blocks(b), t, 0, None)


def trsm(side: str, uplo: str, trans: str, diag: str, alpha, a: Matrix, b: Matrix) -> Matrix:
    """X with op(A) X = alpha * B (left), or X op(A) = alpha * B (right); of relations of tiles if one operand is one."""
    _same_type(a, b)
    side, uplo, trans, diag = flag(side, SIDE, "trsm", 1), flag(uplo, UPLO, "trsm", 2), flag(trans, TRANS, "trsm", 3), flag(diag, DIAG, "trsm", 4)
    if a.m != a.n or a.n != (b.m if side == "L" else b.n):
        raise DimensionMismatch(f"{a.m} x {a.n} and {b.m} x {b.n}")
    if b.m == 0 or b.n == 0:
        return b
    s = b.s
    if isinstance(a, Blocks) or isinstance(b, Blocks):
        b = as_blocks(b)
        return b.tiled(lambda r, c, x, there: [(r, c, 0 * x.real, None)]) if alpha == 0 else _by_inverse(side, uplo, trans, diag, alpha, a, b)
    if alpha == 0:
        return b.made(b.grid().select("i", "j", s.lit(0).alias("v")))
    if a.n > BLOCK:
        return _by_inverse(side, uplo, trans, diag, alpha, a, b).matrix()
    scaled = b if alpha == 1 else b.made(b.cells().select("i", "j", s.scale(alpha, F.col("v")).alias("v")))
    scaled = scaled.dense()
    t = a.triangle(uplo) if diag == "N" else replace(a, df=a.df.where("i < j" if uplo == "U" else "i > j"))
    t = t.op(trans)
    lower = (uplo == "L") == (trans == "N")
    if side == "R":
        x = _fold(t.op("T").cells(), scaled.op("T").cells(), not lower, diag == "U", a.n, s).select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    else:
        x = _fold(t.cells(), scaled.cells(), lower, diag == "U", a.n, s)
    return b.made(x)


def trsv(uplo: str, trans: str, diag: str, a: Matrix, b: Vector) -> Vector:
    """x with op(A) x = b."""
    check("trsv", uplo=uplo, trans=trans, diag=diag)
    column = Matrix(b.prefix(a.n).df.select("i", F.lit(0).cast("long").alias("j"), "v"), min(a.n, b.n), 1, b.dtype)
    x = trsm("L", uplo, trans, diag, 1, a, column)
    tail = b.df.where(F.col("i") >= a.n)
    return Vector(x.df.select("i", "v").unionByName(tail) if b.n > a.n else x.df.select("i", "v"), b.n, b.dtype)


def tbsv(uplo: str, trans: str, diag: str, k: int, a: Matrix, b: Vector) -> Vector:
    """``trsv`` of a band of k diagonals: by chunks if it has more rows than one fold, so the vector may be long."""
    check("tbsv", uplo=uplo, trans=trans, diag=diag, k=k)
    _same_type(a, b)
    if a.n <= BLOCK or a.m != a.n or b.n < a.n:
        return trsv(uplo, trans, diag, a.band(k, k), b)
    uplo, trans, diag = uplo[:1].upper(), trans[:1].upper(), diag[:1].upper()
    x = banded.solve((uplo == "L") == (trans == "N"), diag == "U", k, a.triangle(uplo).op(trans), b.prefix(a.n), settle=_cut_lineage)
    return x if b.n == a.n else Vector(x.df.unionByName(b.df.where(F.col("i") >= a.n)), b.n, b.dtype)


def tpsv(uplo: str, trans: str, diag: str, ap: DataFrame, b: Vector) -> Vector:
    from ..sources.layout import from_packed

    check("tpsv", uplo=uplo, trans=trans, diag=diag)
    return trsv(uplo, trans, diag, from_packed(ap, b.n, uplo, b.dtype), b)
