"""Band matrices over long vectors: products by halo exchange and solves by interfaces.

Rows are cut into chunks of consecutive indexes.  A product sends each cell of
the matrix to its row's chunk and each element of x to the chunks whose band
reaches it: its own and, near a border, a neighbour's (the halo).  That is one
shuffle, without a join and without a key a cell.

A solve knows of the chunk before only its last k elements.  So every chunk
solves k + 1 right sides apart: its own with zeros before it, and the unit
vectors of those k elements.  What its last k elements become is then an affine
map of the k before, and all maps together are a band system of k rows a chunk,
solved in the same way until it fits one chunk.  A second pass solves every
chunk once, its k elements known.  No step runs over all rows in turn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import Scalars
from ..types import DimensionMismatch, Matrix, Vector
from .blocked import divided

#: Cells of a band that one chunk may hold, and how many so that it has four times the band's width of rows: some 32 bytes each, many times over in transit.
CHUNK_CELLS, WIDE_CELLS = 1 << 17, 1 << 20
_LONG = "long"


def chunk_rows(n: int, width: int, cores: int) -> int:
    """Rows of a chunk: a few chunks a core, as many cells as memory allows, not much less than the band's width."""
    fit = max(1, CHUNK_CELLS // (width + 1), min(4 * width, WIDE_CELLS // (width + 1)))
    return max(1, width, min(fit, max(4 * width, 1024, -(-n // (2 * cores)))))


def _values(v, s: Scalars) -> list:
    """Columns of a value: one, or two if complex."""
    return [v["re"].alias("re"), v["im"].alias("im")] if s.is_complex else [v.alias("re")]


def _numbers(table: pa.Table, complex_: bool) -> np.ndarray:
    re = table.column("re").to_numpy()
    if not complex_:
        return re
    out = np.empty(len(re), complex)
    out.real, out.imag = re, table.column("im").to_numpy()
    return out


def _told(i: np.ndarray, v: np.ndarray) -> pa.Table:
    if np.iscomplexobj(v):
        return pa.table({"i": pa.array(i, pa.int64()), "re": pa.array(v.real), "im": pa.array(v.imag)})
    return pa.table({"i": pa.array(i, pa.int64()), "re": pa.array(v)})


def _schema(s: Scalars) -> str:
    return "i long, re double" + (", im double" if s.is_complex else "")


def _vector(df: DataFrame, n: int, dtype: str) -> Vector:
    s = Scalars(dtype)
    return Vector(df.select("i", s.narrow(F.struct("re", "im") if s.is_complex else F.col("re")).alias("v")), n, dtype)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of cells, components apart."""
    with np.errstate(all="ignore"):
        if not np.iscomplexobj(a):
            return a * b
        out = np.empty(a.shape, complex)
        out.real, out.imag = a.real * b.real - a.imag * b.imag, a.real * b.imag + a.imag * b.real
        return out


def multiply(kl: int, ku: int, alpha, a: Matrix, x: Vector, beta, y: Vector, chunk: int | None = None) -> Vector:
    """alpha * A x + beta * y of a band of kl and ku diagonals; cells beyond the band are not read.

    Like ``gemv``: alpha = 0 does not read A and x, beta = 0 not y; results have the cells that a term or y has.
    """
    if x.n < a.n or y.n < a.m:
        raise DimensionMismatch(f"{a.m} x {a.n} by {x.n} into {y.n}")
    if a.m == 0 or a.n == 0:
        return y
    s, m = a.s, a.m
    size = chunk or chunk_rows(m, kl + ku, a.spark.sparkContext.defaultParallelism)
    none, parts = F.lit(None).cast("long").alias("j"), []
    if alpha != 0:
        cells = a.band(kl, ku).cells()
        parts.append(cells.select(F.expr(f"i div {size}").alias("p"), F.lit(0).alias("kind"), "i", "j", *_values(F.col("v"), s)))
        first, last = F.greatest(F.lit(0).cast("long"), F.col("i") - ku), F.least(F.lit(m - 1).cast("long"), F.col("i") + kl)
        reach = F.when(first <= last, F.sequence(F.floor(first / size).cast("long"), F.floor(last / size).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        parts.append(x.prefix(a.n).cells().select(F.explode(reach).alias("p"), F.lit(1).alias("kind"), "i", none, *_values(F.col("v"), s)))
    if beta != 0:
        parts.append(y.prefix(m).cells().select(F.expr(f"i div {size}").alias("p"), F.lit(2).alias("kind"), "i", none, *_values(F.col("v"), s)))
    whole = lambda df: _vector(df, y.n, y.dtype)
    rest = y.df.where(F.col("i") >= m)
    if not parts:
        return Vector(rest, y.n, y.dtype)
    deal = parts[0]
    for p in parts[1:]:
        deal = deal.unionByName(p)
    complex_, scale = s.is_complex, lambda f, v: v if complex(f) == 1 else _times(np.full(v.shape, f, complex if complex_ else float), v) if complex(f).imag else _apart(f, v)

    def run(key, table):
        base = key[0].as_py() * size
        kind, i, v = table.column("kind").to_numpy(), table.column("i").to_numpy(), _numbers(table, complex_)
        a_at, x_at, y_at = (np.flatnonzero(kind == k) for k in (0, 1, 2))
        j = table.column("j").take(pa.array(a_at)).to_numpy()
        start = base - kl
        near, known = np.zeros(size + kl + ku + 1, v.dtype), np.zeros(size + kl + ku + 1, bool)
        near[i[x_at] - start], known[i[x_at] - start] = v[x_at], True
        there = known[j - start]
        row, term = i[a_at][there] - base, _times(v[a_at][there], near[j[there] - start])
        with np.errstate(all="ignore"):
            sums = np.bincount(row, term.real, size)
            if complex_:
                sums = sums + 0j
                sums.imag = np.bincount(row, term.imag, size)
            found = scale(alpha, sums)
            has = np.bincount(row, minlength=size) > 0
            if len(y_at):
                own = i[y_at] - base
                found[own] = np.where(has[own], found[own], 0) + scale(beta, v[y_at])
                has[own] = True
        at = np.flatnonzero(has)
        return _told(at + base, found[at])

    out = whole(deal.groupBy("p").applyInArrow(run, _schema(s)))
    return out if m >= y.n else Vector(out.df.unionByName(rest), y.n, y.dtype)


def _apart(f, v: np.ndarray) -> np.ndarray:
    """A real factor times values, without a cross term."""
    f = complex(f).real
    if not np.iscomplexobj(v):
        return f * v
    out = np.empty(v.shape, complex)
    out.real, out.imag = f * v.real, f * v.imag
    return out


def forward(band: np.ndarray, there: np.ndarray, sides: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Rows of the solution of a lower band: ``band[i]`` has the k cells left of the diagonal and the pivot, ``before`` the k rows before.

    A cell that does not exist meets no infinity or NaN.
    """
    k = band.shape[1] - 1
    out = np.concatenate([before, np.zeros_like(sides)])
    left, pivot = band[:, :k], band[:, k]
    with np.errstate(all="ignore"):
        for i in range(len(band)):
            known = out[i : i + k]
            row = sides[i] - left[i] @ known if k else sides[i]
            if k and not np.isfinite(row).all():
                at = there[i, :k]
                row = sides[i] - _times(np.repeat(left[i][at][:, None], known.shape[1], 1), known[at]).sum(axis=0)
            out[i + k] = divided(row, pivot[i])
    return out


def solve(lower: bool, unit: bool, k: int, t: Matrix, b: Vector, chunk: int | None = None, settle=lambda df: df) -> Vector:
    """x with T x = b for a triangular band of k diagonals beside the main one.  ``settle`` cuts the lineage of each level's small system."""
    if t.m != t.n or b.n != t.n:
        raise DimensionMismatch(f"{t.m} x {t.n} and {b.n}")
    n, s = t.n, t.s
    if n == 0:
        return b
    at = (lambda c: F.col(c)) if lower else (lambda c: F.lit(n - 1) - F.col(c))  # an upper band is a lower one read from its end
    cells = t.cells().select(at("i").alias("i"), at("j").alias("j"), "v").where((F.col("j") <= F.col("i")) & (F.col("i") - F.col("j") <= k))
    if unit:
        cells = cells.where("i <> j")
    x = _solve(unit, k, cells, b.cells().select(at("i").alias("i"), "v"), n, s, chunk, settle)
    return _vector(x.select(at("i").alias("i"), *[c for c in x.columns if c != "i"]), n, b.dtype)


def _solve(unit: bool, k: int, cells: DataFrame, b: DataFrame, n: int, s: Scalars, chunk: int | None, settle) -> DataFrame:
    """``i, re, im`` of the solution of a lower band."""
    size = chunk or chunk_rows(n, k, cells.sparkSession.sparkContext.defaultParallelism)
    complex_, kind = s.is_complex, complex if s.is_complex else float
    place, none = F.expr(f"i div {size}").alias("p"), F.lit(None).cast("long").alias("j")
    rows = cells.select(place, F.lit(0).alias("kind"), "i", "j", *_values(F.col("v"), s))
    sides = b.select(place, F.lit(1).alias("kind"), "i", none, *_values(F.col("v"), s))
    every = cells.sparkSession.range(-(-n // size)).select(F.col("id").alias("p"), F.lit(3).alias("kind"), F.lit(0).cast("long").alias("i"), none, *[F.lit(0.0).alias(c) for c in (("re", "im") if complex_ else ("re",))])
    deal = rows.unionByName(sides).unionByName(every)

    def parts(key, table):
        """The chunk's first row, length, band with mask, right side, and the elements before it that are known."""
        base = key[0].as_py() * size
        length = min(size, n - base)
        which, i, v = table.column("kind").to_numpy(), table.column("i").to_numpy(), _numbers(table, complex_)
        band, there = np.zeros((length, k + 1), kind), np.zeros((length, k + 1), bool)
        if unit:
            band[:, k] = 1
        at = np.flatnonzero(which == 0)
        slot = i[at] - base, table.column("j").take(pa.array(at)).to_numpy() - i[at] + k
        band[slot], there[slot] = v[at], True
        side, before = np.zeros(length, kind), np.zeros(k, kind)
        own = np.flatnonzero(which == 1)
        side[i[own] - base] = v[own]
        known = np.flatnonzero(which == 2)
        before[i[known] - base + k] = v[known]
        return base, length, band, there, side, before

    if n <= size or k == 0:

        def only(key, table):
            base, length, band, there, side, before = parts(key, table)
            return _told(np.arange(base, base + length), forward(band, there, side[:, None], before[:, None])[k:, 0])

        return deal.groupBy("p").applyInArrow(only, _schema(s))

    def maps(key, table):
        """The affine map of a chunk's last k elements, as rows of the band system of all chunks' last elements: number p * k + element."""
        base, length, band, there, side, _ = parts(key, table)
        right = np.zeros((length, k + 1), kind)
        right[:, 0] = side
        start = np.zeros((k, k + 1), kind)
        start[:, 1:] = np.eye(k)
        last = forward(band, there, right, start)[-k:]
        row = base // size * k + np.arange(k)
        i, j, v = [row], [np.full(k, -1)], [last[:, 0]]
        if base:
            i, j, v = [*i, np.repeat(row, k)], [*j, np.tile(row - k, k)], [*v, -last[:, 1:].ravel()]
        i, j, v = (np.concatenate(q) for q in (i, j, v))
        keep = (j < 0) | (v != 0)
        told = _told(i[keep], v[keep])
        return told.append_column("j", pa.array(j[keep], pa.int64()))

    small = settle(deal.groupBy("p").applyInArrow(maps, f"{_schema(s)}, j long"))
    value = (F.struct("re", "im") if complex_ else F.col("re")).alias("v")
    count = -(-n // size) * k
    ends = _solve(True, 2 * k - 1, small.where("j >= 0").select("i", "j", value), small.where("j < 0").select("i", value), count, s, None if chunk is None else max(chunk, 2 * k), settle)
    ends = settle(ends)
    after = ends.select((F.expr(f"i div {k}") + 1).alias("p"), F.lit(2).alias("kind"), (F.expr(f"i div {k} + 1") * size - k + F.col("i") % k).alias("i"), none, *[c for c in ends.columns if c != "i"])
    deal = deal.unionByName(after.where(F.col("p") < -(-n // size)))

    def finish(key, table):
        base, length, band, there, side, before = parts(key, table)
        return _told(np.arange(base, base + length), forward(band, there, side[:, None], before[:, None])[k:, 0])

    return deal.groupBy("p").applyInArrow(finish, _schema(s))
