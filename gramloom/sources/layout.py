"""Flat, strided, packed and banded buffers to relations and back.

A buffer is a relation ``(pos, v)``; ``buffer`` makes one from an array column.
Decoding is index arithmetic in a projection; padding is filtered out there.
The ``put_`` forms write a result into a buffer that exists: every place of the
operand gets its cell, or zero where it has none, and gaps, padding and the
other triangle keep what they held.  Buffers have all their places.

Errors of increments, leading dimensions and lengths carry the argument's
number where ``routine`` (and ``name``) say whose argument the buffer is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..arguments import place
from ..functions.scalars import Scalars
from ..types import BlasError, BufferTooSmall, InvalidLeadingDimension, InvalidLength, InvalidStride, Matrix, Vector


def _illegal(kind: type[BlasError], why: str, routine: str | None, name: str) -> BlasError:
    return kind(why, routine or "", place(routine, name) if routine else 0)


def buffer(df: DataFrame, array: str) -> DataFrame:
    """``pos, v`` of an array column of a one-row table."""
    return df.select(F.posexplode(array).alias("pos", "v"))


def strided(buf: DataFrame, n: int, inc: int = 1, dtype: str = "d", size: int | None = None, routine: str | None = None, name: str = "incx") -> Vector:
    """Element i lies at i * inc; a negative increment reads the same places in reverse."""
    if inc == 0:
        raise _illegal(InvalidStride, "increment 0", routine, name)
    if n < 0:
        raise _illegal(InvalidLength, f"length {n}", routine, "n")
    if size is not None and n and size < 1 + (n - 1) * abs(inc):
        raise BufferTooSmall(f"{size} for {n} elements at {inc}")
    at = F.expr(f"pos div {abs(inc)}")
    cells = buf.where((F.col("pos") % abs(inc) == 0) & (at < n)).select((at if inc > 0 else F.lit(n - 1) - at).alias("i"), "v")
    return Vector.of(cells, n, dtype=dtype)


def _written(buf: DataFrame, ours: Column, new: DataFrame, dtype: str) -> DataFrame:
    """The buffer with ``new(pos, new)`` at the places that are ``ours``, zeros where it has none."""
    zero = Scalars(dtype).narrow(Scalars(dtype).lit(0))
    return buf.join(new, "pos", "left").select("pos", F.when(ours, F.coalesce("new", zero)).otherwise(F.col("v")).alias("v"))


def put_strided(buf: DataFrame, x: Vector, inc: int = 1) -> DataFrame:
    """The buffer with x's elements, structural zeros too, at its increment; what lies between stays."""
    if inc == 0:
        raise InvalidStride("increment 0")
    to = x.df.select((F.col("i") * inc if inc > 0 else (F.col("i") - (x.n - 1)) * inc).alias("pos"), F.col("v").alias("new"))
    return _written(buf, (F.col("pos") % abs(inc) == 0) & (F.expr(f"pos div {abs(inc)}") < x.n), to, x.dtype)


def put_flat(buf: DataFrame, a: Matrix, ld: int | None = None, layout: str = "col", uplo: str | None = None, routine: str | None = None, name: str = "lda") -> DataFrame:
    """The buffer with the cells of a (of one triangle, if ``uplo`` is given) in column or row order; the padding stays."""
    inner, outer = (a.m, a.n) if layout == "col" else (a.n, a.m)
    ld = _leading(inner if ld is None else ld, inner, routine, name)
    near, far = F.col("pos") % ld, F.expr(f"pos div {ld}")
    i, j = (near, far) if layout == "col" else (far, near)
    ours = (near < inner) & (far < outer)
    cells = a if uplo is None else a.triangle(str(uplo)[:1].upper())
    if uplo is not None:
        ours = ours & (i <= j if str(uplo)[:1].upper() == "U" else i >= j)
    at = F.col("i") + F.col("j") * ld if layout == "col" else F.col("j") + F.col("i") * ld
    return _written(buf, ours, cells.df.select(at.alias("pos"), F.col("v").alias("new")), a.dtype)


def put_packed(buf: DataFrame, a: Matrix, uplo: str, layout: str = "col") -> DataFrame:
    """The buffer with one triangle of a in its first n (n + 1) / 2 places; what lies beyond stays."""
    uplo = str(uplo)[:1].upper()
    new = a.triangle(uplo).df.select(packed_place(a.n, uplo, layout).cast("long").alias("pos"), F.col("v").alias("new"))
    return _written(buf, F.col("pos") < a.n * (a.n + 1) // 2, new, a.dtype)


def put_band(buf: DataFrame, a: Matrix, kl: int, ku: int, ld: int | None = None, layout: str = "col", routine: str | None = None, name: str = "lda") -> DataFrame:
    """The buffer with the cells of a within its band; corners outside the matrix and padding stay."""
    ld = _leading(kl + ku + 1 if ld is None else ld, kl + ku + 1, routine, name)
    near, far = F.col("pos") % ld, F.expr(f"pos div {ld}")
    i, j = (near + far - ku, far) if layout == "col" else (far, near + far - kl)
    ours = (near <= kl + ku) & (i >= 0) & (i < a.m) & (j >= 0) & (j < a.n)
    return _written(buf, ours, to_band(a, kl, ku, ld, layout).withColumnRenamed("v", "new"), a.dtype)


def _leading(ld: int, least: int, routine: str | None, name: str) -> int:
    if ld < max(1, least):
        raise _illegal(InvalidLeadingDimension, f"{ld} for {least}", routine, name)
    return ld


def from_flat(buf: DataFrame, m: int, n: int, ld: int | None = None, layout: str = "col", dtype: str = "d", size: int | None = None, routine: str | None = None, name: str = "lda") -> Matrix:
    """A dense buffer in column or row order; the padding of a leading dimension is dropped."""
    inner, outer = (m, n) if layout == "col" else (n, m)
    ld = _leading(inner if ld is None else ld, inner, routine, name)
    if size is not None and outer and size < (outer - 1) * ld + inner:
        raise BufferTooSmall(f"{size} for {m} x {n} at {ld}")
    a, b = F.col("pos") % ld, F.expr(f"pos div {ld}")
    cells = buf.where((a < inner) & (b < outer)).select((a if layout == "col" else b).alias("i"), (b if layout == "col" else a).alias("j"), "v")
    return Matrix.of(cells, m, n, dtype=dtype)


def to_flat(a: Matrix, ld: int | None = None, layout: str = "col") -> DataFrame:
    """``pos, v`` of all cells, zeros spelled out; padding places are absent."""
    inner = a.m if layout == "col" else a.n
    ld = _leading(inner if ld is None else ld, inner, None, "lda")
    at = F.col("i") + F.col("j") * ld if layout == "col" else F.col("j") + F.col("i") * ld
    return a.dense().df.select(at.alias("pos"), "v")


def packed_place(n: int, uplo: str, layout: str = "col") -> Column:
    """Place of (i, j) in a packed triangle; a row-ordered upper triangle packs as the column-ordered lower one of the transpose."""
    i, j, upper = F.col("i"), F.col("j"), uplo == "U"
    if layout == "row":
        i, j, upper = j, i, not upper
    half = lambda twice: F.shiftright(twice.cast("long"), 1)
    return i + half(j * (j + 1)) if upper else i - j + half(j * (2 * n - j + 1))


def _column_of(place: Column) -> tuple[Column, Column]:
    """(column, row) of a place in a packed upper triangle in column order."""
    start = lambda j: F.shiftright(j * (j + 1), 1)
    near = F.floor((F.sqrt(place.cast("double") * 8 + 1) - 1) / 2)
    j = F.when(start(near) > place, near - 1).when(start(near + 1) <= place, near + 1).otherwise(near)  # the root is rounded
    return j, place - start(j)


def packed_cells(buf: DataFrame, n: int, uplo: str, layout: str = "col") -> DataFrame:
    """``pos, i, j, v`` of the places of a packed triangle."""
    upper = (str(uplo)[:1].upper() == "U") == (layout == "col")
    last = n * (n + 1) // 2 - 1
    at = F.col("pos").cast("long")
    j, i = _column_of(at if upper else F.lit(last) - at)
    j, i = (j, i) if upper else (F.lit(n - 1) - j, F.lit(n - 1) - i)  # the lower triangle reads the upper one backwards
    i, j = (i, j) if layout == "col" else (j, i)
    return buf.where((F.col("pos") >= 0) & (F.col("pos") <= last)).select("pos", i.cast("long").alias("i"), j.cast("long").alias("j"), "v")


def from_packed(buf: DataFrame, n: int, uplo: str, dtype: str = "d", layout: str = "col") -> Matrix:
    """The given triangle of a packed buffer of n (n + 1) / 2 elements."""
    return Matrix.of(packed_cells(buf, n, uplo, layout), n, n, dtype=dtype)


def to_packed(a: Matrix, uplo: str, layout: str = "col") -> DataFrame:
    """``pos, v`` of one triangle."""
    uplo = str(uplo)[:1].upper()
    return a.dense(uplo).df.select(packed_place(a.n, uplo, layout).alias("pos"), "v")


def from_band(buf: DataFrame, m: int, n: int, kl: int, ku: int, ld: int | None = None, dtype: str = "d", layout: str = "col", routine: str | None = None, name: str = "lda") -> Matrix:
    """General band: (i, j) lies at (ku + i - j) + j * ld; in row order at (kl + j - i) + i * ld."""
    ld = _leading(kl + ku + 1 if ld is None else ld, kl + ku + 1, routine, name)
    a, b = F.col("pos") % ld, F.expr(f"pos div {ld}")
    i, j = (a + b - ku, b) if layout == "col" else (b, a + b - kl)
    cells = buf.where(a <= kl + ku).select(i.alias("i"), j.alias("j"), "v").where((F.col("i") >= 0) & (F.col("i") < m) & (F.col("j") >= 0) & (F.col("j") < n))
    return Matrix.of(cells, m, n, dtype=dtype)


def from_triangle_band(buf: DataFrame, n: int, k: int, uplo: str, ld: int | None = None, dtype: str = "d", layout: str = "col") -> Matrix:
    """Symmetric or triangular band, one triangle stored."""
    upper = str(uplo)[:1].upper() == "U"
    return from_band(buf, n, n, 0 if upper else k, k if upper else 0, ld or k + 1, dtype, layout)


def to_band(a: Matrix, kl: int, ku: int, ld: int | None = None, layout: str = "col") -> DataFrame:
    """``pos, v`` of the cells within the band."""
    ld = _leading(kl + ku + 1 if ld is None else ld, kl + ku + 1, None, "lda")
    at = F.lit(ku) + F.col("i") - F.col("j") + F.col("j") * ld if layout == "col" else F.lit(kl) + F.col("j") - F.col("i") + F.col("i") * ld
    return a.band(kl, ku).df.select(at.alias("pos"), "v")
