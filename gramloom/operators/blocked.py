"""Matrices as relations of dense tiles, and products that stay in tiles.

A row ``(r, c, tile, held)`` is one BLOCK x BLOCK part in row order (smaller at
the lower and right edge); ``held`` has a bit for every cell that exists, null
where all do.  Operators take and return such relations, so a chain of products
never becomes cells, and ``stored`` keeps one between sessions.

The rule for terms is that of the cell plans: a term exists where both cells
do.  A missing cell is an exact zero and meets nothing, a stored zero meets
NaN and infinity as IEEE 754 says; a result cell exists if it has a term.

A product deals tiles to groups of g x g result tiles, in one shuffle: a tile of
A goes once to each column of groups, one of B to each row of them, C to its
own.  A group reads its tiles in order of k and adds up as it goes, so sums over
k are combined before anything is sent, memory is a group's accumulators, and no
tile is sent once a multiplication.  Where there are fewer groups than cores, k
is cut into slabs, whose sums one more shuffle adds: their number follows the
cores, not k.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import Scalars
from ..plans.strategy import BLOCK, grouping
from ..types import DimensionMismatch, InvalidLength, Matrix, flag, DIAG, TRANS, UPLO

TILES = "r long, c long, tile binary, held binary"


def _kind(dtype: str):
    return complex if dtype in "cz" else float


def opened(tile, held, shape: tuple[int, int], kind, turn: str = "N") -> tuple[np.ndarray, np.ndarray | None]:
    """Values and mask (None: complete) of a stored tile; absent cells are 0."""
    x = np.frombuffer(tile, kind).reshape(shape)
    there = None if held is None else np.unpackbits(np.frombuffer(held, np.uint8), count=x.size).reshape(shape).astype(bool)
    if turn != "N":
        x, there = (x.conj() if turn == "C" else x).T, None if there is None else there.T
    return x, there


def closed(r: int, c: int, x: np.ndarray, there: np.ndarray | None, dtype: str) -> dict | None:
    """A row of a tile, rounded to the type; None if it has no cell."""
    if there is not None:
        if not there.any():
            return None
        x, there = np.where(there, x, 0), None if there.all() else there
    if dtype in "sc":
        with np.errstate(over="ignore"):
            x = x.astype(np.complex64 if dtype == "c" else np.float32)
    x = np.ascontiguousarray(x, dtype=_kind(dtype))
    return {"r": r, "c": c, "tile": x.tobytes(), "held": None if there is None else np.packbits(there).tobytes()}


def _batch(rows: list[dict | None]) -> pa.RecordBatch:
    rows = [r for r in rows if r is not None]
    kinds = {"r": pa.int64(), "c": pa.int64(), "tile": pa.binary(), "held": pa.binary()}
    return pa.RecordBatch.from_pydict({n: pa.array([row[n] for row in rows], t) for n, t in kinds.items()})


def _rows(batches):
    """Rows of Arrow batches, one at a time; binaries are views."""
    for batch in batches:
        for k in range(len(batch)):
            yield {n: (v.as_buffer() if v.is_valid else None) if pa.types.is_binary(v.type) else v.as_py() for n, v in zip(batch.schema.names, (c[k] for c in batch.columns), strict=True)}


def _special(x: np.ndarray, xm: np.ndarray, y: np.ndarray, ym: np.ndarray) -> np.ndarray:
    """A real product in which NaN and infinity meet the cells that exist, stored zeros included, and nothing else."""
    fx, fy = np.isfinite(x), np.isfinite(y)
    some = lambda a, b: a.astype(np.float32) @ b.astype(np.float32) > 0
    inf_x, inf_y = np.isinf(x), np.isinf(y)
    out = np.where(fx, x, 0) @ np.where(fy, y, 0)
    up = some(x == np.inf, y > 0) | some(x == -np.inf, y < 0) | some(x > 0, y == np.inf) | some(x < 0, y == -np.inf)
    down = some(x == np.inf, y < 0) | some(x == -np.inf, y > 0) | some(x < 0, y == np.inf) | some(x > 0, y == -np.inf)
    none = some(np.isnan(x), ym) | some(xm, np.isnan(y)) | some(inf_x, ym & (y == 0)) | some(xm & (x == 0), inf_y)
    out = np.where(up, out + np.inf, out)
    out = np.where(down, out - np.inf, out)
    return np.where(none, np.nan, out)


def times(x: np.ndarray, xm: np.ndarray | None, y: np.ndarray, ym: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Product of two tiles, and where it has a term (None: everywhere)."""
    there = None if xm is None and ym is None else ((np.ones(x.shape, np.float32) if xm is None else xm.astype(np.float32)) @ (np.ones(y.shape, np.float32) if ym is None else ym.astype(np.float32))) > 0
    with np.errstate(all="ignore"):
        if np.isfinite(x).all() and np.isfinite(y).all():
            return x @ y, there
        xm, ym = np.ones(x.shape, bool) if xm is None else xm, np.ones(y.shape, bool) if ym is None else ym
        if not np.iscomplexobj(x):
            return _special(x, xm, y, ym), there
        part = lambda a, b: _special(a, xm, b, ym)
        out = np.empty((x.shape[0], y.shape[1]), complex)
        out.real = part(x.real, y.real) - part(x.imag, y.imag)
        out.imag = part(x.real, y.imag) + part(x.imag, y.real)
        return out, there


def scaled(alpha, x: np.ndarray) -> np.ndarray:
    """alpha * x; a real factor scales components apart, without a cross term."""
    z = complex(alpha)
    with np.errstate(all="ignore"):
        if z == 1:
            return x
        if not np.iscomplexobj(x):
            return z.real * x
        out = np.empty(x.shape, complex)
        out.real = z.real * x.real if z.imag == 0 else z.real * x.real - z.imag * x.imag
        out.imag = z.real * x.imag if z.imag == 0 else z.real * x.imag + z.imag * x.real
        return out


def plus(one: tuple | None, two: tuple | None) -> tuple | None:
    """Sum of two tiles with masks; a cell that only one has is that one's."""
    if one is None or two is None:
        return two if one is None else one
    (x, xm), (y, ym) = one, two
    with np.errstate(all="ignore"):
        return x + y, None if xm is None or ym is None else xm | ym


@dataclass(frozen=True)
class Blocks:
    """A matrix of tiles.  ``turn`` is a transpose (T) or adjoint (C) that readers apply: the tiles are stored unturned."""

    df: DataFrame
    m: int
    n: int
    dtype: str = "d"
    turn: str = "N"

    def __post_init__(self):
        if self.m < 0 or self.n < 0:
            raise InvalidLength(f"shape {self.m} x {self.n}")

    @property
    def s(self) -> Scalars:
        return Scalars(self.dtype)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def tiles(self) -> tuple[int, int]:
        """Rows and columns of tiles."""
        return -(-self.m // BLOCK), -(-self.n // BLOCK)

    def shape(self, r: int, c: int) -> tuple[int, int]:
        """Shape of the stored tile (r, c)."""
        m, n = (self.m, self.n) if self.turn == "N" else (self.n, self.m)
        return min(BLOCK, m - r * BLOCK), min(BLOCK, n - c * BLOCK)

    @classmethod
    def of(cls, a: Matrix) -> Blocks:
        """From cells: one shuffle; a tile is a bounded group."""
        parts = ["v.re", "v.im"] if a.s.is_complex else ["v"]
        keyed = a.cells().select(F.expr(f"i div {BLOCK}").alias("r"), F.expr(f"j div {BLOCK}").alias("c"), F.expr(f"int(i % {BLOCK})").alias("y"), F.expr(f"int(j % {BLOCK})").alias("x"), *[F.col(p).alias(f"v{k}") for k, p in enumerate(parts)])
        m, n, dtype = a.m, a.n, a.dtype

        def fill(key, table):
            r, c = (k.as_py() for k in key)
            shape = min(BLOCK, m - r * BLOCK), min(BLOCK, n - c * BLOCK)
            values, there = np.zeros(shape, _kind(dtype)), np.zeros(shape, bool)
            at = tuple(table.column(name).to_numpy() for name in ("y", "x"))
            if dtype in "cz":
                values.real[at], values.imag[at] = table.column("v0").to_numpy(), table.column("v1").to_numpy()
            else:
                values[at] = table.column("v0").to_numpy()
            there[at] = True
            return pa.Table.from_batches([_batch([closed(r, c, values, there, dtype)])])

        return cls(keyed.groupBy("r", "c").applyInArrow(fill, TILES), m, n, dtype)

    @classmethod
    def from_rows(cls, df: DataFrame, m: int, n: int, key: str, array: str) -> Blocks:
        """From a table with one array of n numbers a row of the matrix: rows go to their strip of tiles, never to cells."""

        def strip(table):
            r = table.column("r")[0].as_py()
            h = min(BLOCK, m - r * BLOCK)
            values, there = np.zeros((h, n)), np.zeros((h, n), bool)
            place = table.column("y").to_numpy()
            values[place], there[place] = rows_of(table.column("row"), n), True
            cuts = range(0, n, BLOCK)
            return pa.Table.from_batches([_batch([closed(r, k // BLOCK, values[:, k : k + BLOCK], there[:, k : k + BLOCK], "d") for k in cuts])])

        keyed = df.select(F.expr(f"cast({key} as long) div {BLOCK}").alias("r"), F.expr(f"int({key} % {BLOCK})").alias("y"), F.col(array).cast("array<double>").alias("row"))
        return cls(keyed.groupBy("r").applyInArrow(strip, TILES), m, n)

    @classmethod
    def read(cls, spark: SparkSession, path: str, m: int, n: int, dtype: str = "d") -> Blocks:
        """A relation that ``stored`` has written."""
        return cls(spark.read.schema(TILES).parquet(path), m, n, dtype)

    def stored(self, path: str) -> Blocks:
        """The relation written as Parquet, and read from there."""
        now = self.settled()
        now.df.write.parquet(path)
        return Blocks.read(self.spark, path, now.m, now.n, now.dtype)

    def op(self, trans: str) -> Blocks:
        """op(A): a flag that the reader of the tiles applies."""
        if trans == "N":
            return self
        turned = {("N", "T"): "T", ("N", "C"): "C", ("T", "T"): "N", ("C", "C"): "N"}
        if (self.turn, trans) not in turned:
            return self.settled().op(trans)
        return Blocks(self.df, self.n, self.m, self.dtype, turned[self.turn, trans])

    def transposed(self) -> Blocks:
        return self.op("T")

    def adjoint(self) -> Blocks:
        return self.op("C")

    def tiled(self, change) -> Blocks:
        """Rows of new tiles from ``change(r, c, values, mask)`` (a list of such tuples) of every tile, the turn applied."""
        turn, shape, dtype, kind = self.turn, self.shape_of(), self.dtype, _kind(self.dtype)

        def run(batches):
            for row in _rows(batches):
                r, c = row["r"], row["c"]
                x, there = opened(row["tile"], row["held"], shape(r, c), kind, turn)
                if turn != "N":
                    r, c = c, r
                yield _batch([closed(*new, dtype) for new in change(r, c, x, there)])

        return Blocks(self.df.select("r", "c", "tile", "held").mapInArrow(run, TILES), self.m, self.n, self.dtype)

    def shape_of(self):
        """``shape`` without the DataFrame, for use in tasks."""
        m, n = (self.m, self.n) if self.turn == "N" else (self.n, self.m)
        return lambda r, c: (min(BLOCK, m - r * BLOCK), min(BLOCK, n - c * BLOCK))

    def settled(self) -> Blocks:
        """The same matrix without a pending turn."""
        return self if self.turn == "N" else self.tiled(lambda r, c, x, there: [(r, c, x, there)])

    def conj(self) -> Blocks:
        return self.tiled(lambda r, c, x, there: [(r, c, x.conj(), there)]) if self.s.is_complex else self

    def mirrored(self, uplo: str, hermitian: bool = False) -> Blocks:
        """The full matrix of which one triangle is given, tile by tile; the other triangle is never read."""
        turn = np.conj if hermitian else lambda v: v
        real = hermitian and self.s.is_complex

        def both(r, c, x, there):
            if r != c:
                return [(r, c, x, there), (c, r, turn(x).T, None if there is None else there.T)] if (r < c) == (uplo == "U") else []
            keep = np.triu(np.ones(x.shape, bool)) if uplo == "U" else np.tril(np.ones(x.shape, bool))
            full = np.where(keep, x, turn(x).T)
            if real:
                full = full.copy()
                full.imag[np.diag_indices(len(full))] = 0
            return [(r, c, full, None if there is None else np.where(keep, there, there.T))]

        return self.tiled(both)

    def triangular(self, uplo: str, diag: str = "N") -> Blocks:
        """One triangle; a unit diagonal is supplied, not read."""

        def one(r, c, x, there):
            if r != c:
                return [(r, c, x, there)] if (r < c) == (uplo == "U") else []
            there = np.ones(x.shape, bool) if there is None else there
            keep = np.triu(there) if uplo == "U" else np.tril(there)
            if diag == "U":
                x = x.copy()
                x[np.diag_indices(len(x))] = 1
                keep = keep | np.eye(len(x), dtype=bool)
            return [(r, c, x, keep)]

        found = self.tiled(one)
        return found.with_diagonal(1) if diag == "U" else found

    def with_diagonal(self, value: float) -> Blocks:
        """Diagonal tiles that are not stored supplied, ``value`` on the diagonal; stored ones stay."""
        m, dtype = self.m, self.dtype
        missing = self.spark.range(self.tiles[0]).select(F.col("id").alias("r")).join(self.df.where("r = c").select("r"), "r", "left_anti")

        def supply(batches):
            for row in _rows(batches):
                eye = np.eye(min(BLOCK, m - row["r"] * BLOCK), dtype=bool)
                yield _batch([closed(row["r"], row["r"], (eye * value).astype(_kind(dtype)), eye, dtype)])

        return replace(self, df=self.df.unionByName(missing.mapInArrow(supply, TILES)))

    def matrix(self) -> Matrix:
        """As cells: those that exist, in their type."""
        turn, shape, dtype, kind = self.turn, self.shape_of(), self.dtype, _kind(self.dtype)
        real = pa.float32() if dtype in "sc" else pa.float64()

        def run(batches):
            for row in _rows(batches):
                r, c = row["r"], row["c"]
                x, there = opened(row["tile"], row["held"], shape(r, c), kind, turn)
                if turn != "N":
                    r, c = c, r
                y, z = np.nonzero(np.ones(x.shape, bool) if there is None else there)
                v = x[y, z]
                v = pa.StructArray.from_arrays([pa.array(v.real).cast(real, safe=False), pa.array(v.imag).cast(real, safe=False)], ["re", "im"]) if dtype in "cz" else pa.array(v).cast(real, safe=False)
                yield pa.RecordBatch.from_pydict({"i": pa.array(y + r * BLOCK), "j": pa.array(z + c * BLOCK), "v": v})

        return Matrix(self.df.select("r", "c", "tile", "held").mapInArrow(run, f"i long, j long, v {self.s.sql_type}"), self.m, self.n, self.dtype)

    def cells(self, name: str = "v") -> DataFrame:
        return self.matrix().cells(name)

    def dense(self) -> Matrix:
        return self.matrix().dense()


def rows_of(column, n: int) -> np.ndarray:
    """Rows of n numbers of an Arrow list column; null or ragged rows are an error."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = []
    for part in parts:
        if part.null_count or (len(part) and not (np.diff(part.offsets.to_numpy()) == n).all()):
            raise ValueError(f"every row must be an array of {n} numbers")
        flat = part.flatten()
        if flat.null_count:
            raise ValueError("NULL in a row of a matrix")
        out.append(flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, n))
    return np.concatenate(out) if out else np.zeros((0, n))


def as_blocks(x: Matrix | Blocks) -> Blocks:
    return x if isinstance(x, Blocks) else Blocks.of(x)


def _spread(at, first, last):
    """Numbers ``first`` .. ``last`` of groups, exploded; none where first > last."""
    return F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))).alias(at)


def update(alpha, a: Blocks, b: Blocks, beta, c: Blocks | None, uplo: str | None = None, real_diagonal: bool = False, within: int | None = None, groups: tuple[int, int] | None = None) -> Blocks:
    """alpha * A B + beta * C, or its triangle: the other one stays C's.

    What is not read (A and B for alpha = 0, C for beta = 0 but for the kept triangle) is not planned.  ``within`` tells that results
    lie in diagonal squares of so many tiles, so tiles travel no further.  ``groups``: tiles of a group's edge, slabs of k.
    """
    if a.n != b.m or (c is not None and (a.m, b.n) != (c.m, c.n)):
        raise DimensionMismatch(f"{a.m} x {a.n} by {b.m} x {b.n}" + ("" if c is None else f" into {c.m} x {c.n}"))
    dtype, kind, m, n = a.dtype, _kind(a.dtype), a.m, b.n
    old = None if c is None or (beta == 0 and uplo is None) else c.settled()
    other = None if uplo is None or old is None else old.df.where("r > c" if uplo == "U" else "r < c")
    if old is not None and uplo is not None:
        old = replace(old, df=old.df.where(("r = c" if beta == 0 else "r <= c") if uplo == "U" else ("r = c" if beta == 0 else "r >= c")))
    (rows, ks), cols = a.tiles, b.tiles[1]
    edge, slabs = groups or grouping(rows, ks, cols, a.spark.sparkContext.defaultParallelism)
    across, down = -(-cols // edge), -(-rows // edge)
    wide = -(-max(1, ks) // slabs)
    parts = []
    if alpha != 0 and a.n:
        left = a.df.select(*[F.col(x).alias(y) for x, y in zip(("r", "c") if a.turn == "N" else ("c", "r"), ("at", "k"), strict=True)], "tile", "held")
        right = b.df.select(*[F.col(x).alias(y) for x, y in zip(("c", "r") if b.turn == "N" else ("r", "c"), ("at", "k"), strict=True)], "tile", "held")
        zero = F.lit(0).cast("long")
        own = F.expr(f"at div {edge}")
        for side, df, most, above in ((0, left, across, uplo == "U"), (1, right, down, uplo == "L")):
            first, last = zero, F.lit(most - 1).cast("long")
            if uplo is not None:  # groups beyond the triangle are not wanted
                first, last = (own, last) if above else (first, F.least(own, last))
            if within is not None:
                first, last = F.greatest(first, F.expr(f"at div {within} * {within} div {edge}")), F.least(last, F.expr(f"(at div {within} * {within} + {within - 1}) div {edge}"))
            dealt = df.select("at", "k", "tile", "held", _spread("to", first, last))
            gr, gc = (own, F.col("to")) if side == 0 else (F.col("to"), own)
            parts.append(dealt.select(((gr * across + gc) * slabs + F.expr(f"k div {wide}")).alias("group"), "k", F.lit(side).alias("side"), "at", zero.alias("at2"), "tile", "held"))
    if old is not None:
        group = (F.expr(f"r div {edge}") * across + F.expr(f"c div {edge}")) * slabs
        parts.append(old.df.select(group.alias("group"), F.lit(-1).cast("long").alias("k"), F.lit(2).alias("side"), F.col("r").alias("at"), F.col("c").alias("at2"), "tile", "held"))
    if not parts:
        return Blocks(a.spark.createDataFrame([], TILES), m, n, dtype)
    deal = parts[0]
    for p in parts[1:]:
        deal = deal.unionByName(p)
    a_turn, b_turn, a_shape, b_shape = a.turn, b.turn, a.shape_of(), b.shape_of()
    c_shape = lambda r, c: (min(BLOCK, m - r * BLOCK), min(BLOCK, n - c * BLOCK))
    last_step = slabs == 1

    def finish(r, c, total, kept):
        """One result tile of the sum and C's tile."""
        new = None if total is None else (scaled(alpha, total[0]), total[1])
        scaled_old = None if kept is None or beta == 0 else (scaled(beta, kept[0]), kept[1])
        found = plus(new, scaled_old)
        x, there = found if found is not None else (np.zeros(c_shape(r, c), kind), np.zeros(c_shape(r, c), bool))
        if real_diagonal and r == c and np.iscomplexobj(x):
            x = x.copy()
            x.imag[np.diag_indices(len(x))] = 0
        if uplo is not None and r == c:
            inside = np.triu(np.ones(x.shape, bool)) if uplo == "U" else np.tril(np.ones(x.shape, bool))
            before, was = kept if kept is not None else (np.zeros(x.shape, kind), np.zeros(x.shape, bool))
            x = np.where(inside, x, before)
            there = np.where(inside, True if there is None else there, True if was is None else was)
        return closed(r, c, x, there, dtype)

    def multiply(batches):
        """Sums of a group, its tiles in order of k, A's before B's."""
        now, step, held, sums, kept = None, None, {}, {}, {}

        def told():
            for key in sums.keys() | kept.keys():
                if last_step:
                    yield _batch([finish(*key, sums.get(key), kept.get(key))])
                    continue
                for mark, found in ((0, sums.get(key)), (1, kept.get(key))):
                    if found is not None and (row := closed(*key, *found, "z" if dtype in "cz" else "d")) is not None:
                        yield _marked([row], mark)

        for row in _rows(batches):
            if row["group"] != now:
                yield from told()
                now, step, held, sums, kept = row["group"], None, {}, {}, {}
            at, k, side = row["at"], row["k"], row["side"]
            if side == 2:
                kept[at, row["at2"]] = opened(row["tile"], row["held"], c_shape(at, row["at2"]), kind)
                continue
            if k != step:
                step, held = k, {}
            if side == 0:
                stored = (at, k) if a_turn == "N" else (k, at)
                held[at] = opened(row["tile"], row["held"], a_shape(*stored), kind, a_turn)
                continue
            stored = (k, at) if b_turn == "N" else (at, k)
            y = opened(row["tile"], row["held"], b_shape(*stored), kind, b_turn)
            for r, x in held.items():
                if uplo is None or (r <= at if uplo == "U" else r >= at):
                    sums[r, at] = plus(sums.get((r, at)), times(*x, *y))
        yield from told()

    def add(batches):
        """Sums over the slabs of a tile."""
        at, sums = None, {}
        for row in _rows(batches):
            if (row["r"], row["c"]) != at:
                if at is not None:
                    yield _batch([finish(*at, sums.get(0), sums.get(1))])
                at, sums = (row["r"], row["c"]), {}
            sums[row["mark"]] = plus(sums.get(row["mark"]), opened(row["tile"], row["held"], c_shape(*at), kind))
        if at is not None:
            yield _batch([finish(*at, sums.get(0), sums.get(1))])

    count = down * across * slabs
    dealt = deal.repartitionById(count, F.col("group").cast("int")) if count < 10_000 else deal.repartition(count // 4, "group")
    dealt = dealt.sortWithinPartitions("group", "k", "side", "at")
    if last_step:
        out = dealt.mapInArrow(multiply, TILES)
    else:
        sums = dealt.mapInArrow(multiply, f"{TILES}, mark int")
        out = sums.repartition("r", "c").sortWithinPartitions("r", "c", "mark").mapInArrow(add, TILES)
    return Blocks(out if other is None else out.unionByName(other), m, n, dtype)


def _marked(rows: list[dict], mark: int) -> pa.RecordBatch:
    batch = _batch(rows)
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array([mark] * len(rows), pa.int32())], names=[*batch.schema.names, "mark"])


def inverse(t: Blocks, uplo: str, diag: str = "N", checkpoint=lambda df: df) -> Blocks:
    """Inverse of a triangle by halves: diagonal tiles first, then squares of twice the edge in every round, all at once.

    A square's other half is -C^-1 B A^-1 of its two diagonal halves A and C: two products a round and log2 of the number of tiles
    rounds.  A zero pivot gives infinities and NaN, never an error.  ``checkpoint`` cuts a round's lineage.
    """
    uplo, diag = flag(uplo, UPLO, "trtri", 1), flag(diag, DIAG, "trtri", 2)
    if t.m != t.n:
        raise DimensionMismatch(f"{t.m} x {t.n}")
    lower = t.settled() if uplo == "L" else t.op("T").settled()
    lower = lower.triangular("L", diag).with_diagonal(0)
    lower = replace(lower, df=checkpoint(lower.df))

    def invert(r, c, x, there):
        """Forward substitution of the identity, a row at a time; what is above the diagonal does not exist."""
        size = len(x)
        out, below = np.zeros_like(x), np.tril(np.ones(x.shape, bool))
        with np.errstate(all="ignore"):
            for k in range(size):
                row = np.zeros(size, x.dtype)
                row[k] = 1
                used = np.arange(k) if there is None else np.flatnonzero(there[k, :k])
                if len(used):
                    row[:k] -= times(x[k : k + 1, used], None, out[used, :k], below[used, :k])[0][0]
                out[k, : k + 1] = divided(row[: k + 1], x[k, k])
        return [(r, c, out, below)]

    done = replace(lower, df=lower.df.where("r = c")).tiled(invert)
    done = replace(done, df=checkpoint(done.df))
    half = 1
    while half < t.tiles[0]:
        span = 2 * half
        below = replace(lower, df=lower.df.where(f"r div {span} = c div {span} and r div {half} > c div {half}"))
        right = update(1, below, done, 0, None, within=span)
        corner = update(-1, done, right, 0, None, within=span)
        done = replace(done, df=checkpoint(done.df.unionByName(corner.df)))
        half = span
    return done if uplo == "L" else done.op("T")


def divided(a: np.ndarray, b) -> np.ndarray:
    """a / b by IEEE 754; complex over re^2 + im^2, components apart."""
    if not np.iscomplexobj(a):
        return a / b
    norm = b.real * b.real + b.imag * b.imag
    out = np.empty(a.shape, complex)
    out.real, out.imag = (a.real * b.real + a.imag * b.imag) / norm, (a.imag * b.real - a.real * b.imag) / norm
    return out
