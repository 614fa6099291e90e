"""Vectors and matrices as relations, with their dimensions and scalar type.

A vector is ``(i, v)``, a matrix ``(i, j, v)``, indexes from 0.  A missing cell
is an exact structural zero.  Nothing runs at construction: dimensions are
given, and checks run on the driver.  NULL cells raise when a job reads them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import Scalars


class BlasError(ValueError):
    """Base of all argument errors; ``info`` is the number of the argument (from 1) in the list of ``routine``, 0 where neither is known."""

    def __init__(self, why: str = "", routine: str = "", info: int = 0):
        super().__init__(f"{routine}: parameter {info} has an illegal value: {why}" if routine else why)
        self.routine, self.info = routine, info


class IllegalArgument(BlasError):
    """A routine's argument number ``info`` is illegal."""

    def __init__(self, routine: str, info: int, why: str = ""):
        super().__init__(why or "not allowed", routine, info)


class DimensionMismatch(BlasError):
    pass


class InvalidLength(BlasError):
    pass


class InvalidStride(BlasError):
    pass


class InvalidLeadingDimension(BlasError):
    pass


class BufferTooSmall(BlasError):
    pass


def flag(value: str, allowed: dict[str, str], routine: str, info: int) -> str:
    """A case-insensitive flag by its first letter."""
    key = str(value)[:1].upper()
    if key not in allowed:
        raise IllegalArgument(routine, info, f"{value!r} is none of {sorted(allowed)}")
    return allowed[key]


#: Flags of the routines.
TRANS = {"N": "N", "T": "T", "C": "C"}
UPLO = {"U": "U", "L": "L"}
DIAG = {"N": "N", "U": "U"}
SIDE = {"L": "L", "R": "R"}


def _checked(v: Column, s: Scalars) -> Column:
    there = v["re"].isNotNull() & v["im"].isNotNull() if s.is_complex else v.isNotNull()
    return s.wide(F.when(there, v).otherwise(F.raise_error(F.lit("NULL cell in a vector or matrix"))))


def _local(spark: SparkSession, index: dict, values: list, s: Scalars) -> DataFrame:
    """Driver values as a local relation, without Python workers."""
    real = pa.float32() if s.real_type == "float" else pa.float64()
    if s.is_complex:
        v = pa.StructArray.from_arrays([pa.array([complex(x).real for x in values], real), pa.array([complex(x).imag for x in values], real)], names=["re", "im"])
    else:
        v = pa.array([float(x) for x in values], real)
    return spark.createDataFrame(pa.table({**{k: pa.array(list(x), pa.int64()) for k, x in index.items()}, "v": v}))


@dataclass(frozen=True)
class Base:
    """The table a vector is a projection of: its index and its value, in the vector's type."""

    df: DataFrame
    index: Column
    value: Column


@dataclass(frozen=True)
class Vector:
    """``df(i, v)``; one made from a table's columns knows the table (``base``), so vectors of one table meet in a projection."""

    df: DataFrame
    n: int
    dtype: str = "d"
    base: Base | None = field(default=None, compare=False, repr=False)

    def __post_init__(self):
        if self.n < 0:
            raise InvalidLength(f"length {self.n}")

    @property
    def s(self) -> Scalars:
        return Scalars(self.dtype)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @classmethod
    def of(cls, df: DataFrame, n: int, index: str = "i", value: str | Column = "v", dtype: str = "d") -> Vector:
        """From any table: an index column and a value column or expression."""
        v = F.col(value) if isinstance(value, str) else value
        s = Scalars(dtype)
        return cls.on(Base(df, F.col(index).cast("long"), s.narrow(_checked(v, s))), n, dtype)

    @classmethod
    def on(cls, base: Base, n: int, dtype: str = "d") -> Vector:
        """A projection of a table; the index tells its rows apart."""
        return cls(base.df.select(base.index.alias("i"), base.value.alias("v")), n, dtype, base)

    def shares(self, other: Vector) -> bool:
        """Whether both are projections of one table, element by element."""
        return self.base is not None and other.base is not None and self.base.df is other.base.df and str(self.base.index) == str(other.base.index)

    def check(self) -> Vector:
        """Raise where a cell is NULL, lies outside 0 .. n - 1 or occurs twice: one job, for buffers of unknown origin."""
        if self.df.where(F.col("i").isNull() | (F.col("i") < 0) | (F.col("i") >= self.n) | self.df.v.isNull()).limit(1).count():
            raise InvalidLength(f"a cell is NULL or outside 0 .. {self.n - 1}")
        if self.df.groupBy("i").count().where("count > 1").limit(1).count():
            raise InvalidLength("an index occurs twice")
        return self

    @classmethod
    def from_values(cls, spark: SparkSession, values: Iterable, dtype: str = "d") -> Vector:
        values = list(values)
        return cls(_local(spark, {"i": range(len(values))}, values, Scalars(dtype)), len(values), dtype)

    def cells(self, name: str = "v") -> DataFrame:
        """``(i, name)`` in double precision."""
        return self.df.select("i", self.s.wide(F.col("v")).alias(name))

    def made(self, df: DataFrame, n: int | None = None) -> Vector:
        """A result of this type from double-precision cells."""
        return Vector(df.select("i", self.s.narrow(F.col("v")).alias("v")), self.n if n is None else n, self.dtype)

    def prefix(self, n: int) -> Vector:
        return self if n >= self.n else replace(self, df=self.df.where(F.col("i") < n), n=n, base=None)

    def conj(self) -> Vector:
        return replace(self, df=self.df.select("i", self.s.conj(F.col("v")).alias("v")), base=None)

    def dense(self) -> Vector:
        """Every index present, structural zeros spelled out."""
        full = self.spark.range(self.n).withColumnRenamed("id", "i").join(self.cells(), "i", "left")
        return self.made(full.select("i", self.s.or_zero(F.col("v")).alias("v")))

    def to_list(self) -> list:
        """Small vectors, for tests."""
        out = [0j if self.s.is_complex else 0.0] * self.n
        for r in self.df.collect():
            out[r.i] = complex(r.v.re, r.v.im) if self.s.is_complex else r.v
        return out


@dataclass(frozen=True)
class Matrix:
    df: DataFrame
    m: int
    n: int
    dtype: str = "d"

    def __post_init__(self):
        if self.m < 0 or self.n < 0:
            raise InvalidLength(f"shape {self.m} x {self.n}")

    @property
    def s(self) -> Scalars:
        return Scalars(self.dtype)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @classmethod
    def of(cls, df: DataFrame, m: int, n: int, row: str = "i", column: str = "j", value: str | Column = "v", dtype: str = "d") -> Matrix:
        v = F.col(value) if isinstance(value, str) else value
        s = Scalars(dtype)
        return cls(df.select(F.col(row).cast("long").alias("i"), F.col(column).cast("long").alias("j"), s.narrow(_checked(v, s)).alias("v")), m, n, dtype)

    @classmethod
    def from_columns(cls, df: DataFrame, m: int, key: str, columns: list[str | Column]) -> Matrix:
        """A tall matrix: one row per table row (``key`` is the row index), one column per numeric column."""
        values = [F.col(c) if isinstance(c, str) else c for c in columns]
        cells = df.select(F.col(key).alias("i"), F.posexplode(F.array(*[v.cast("double") for v in values])).alias("j", "v"))
        return cls.of(cells, m, len(columns))

    @classmethod
    def from_rows(cls, df: DataFrame, m: int, n: int, key: str, array: str) -> Matrix:
        """One array column holds each row."""
        return cls.of(df.select(F.col(key).alias("i"), F.posexplode(array).alias("j", "v")), m, n)

    @classmethod
    def from_values(cls, spark: SparkSession, rows: list[list], dtype: str = "d", n: int | None = None) -> Matrix:
        at = [(i, j) for i, r in enumerate(rows) for j in range(len(r))]
        df = _local(spark, {"i": [i for i, _ in at], "j": [j for _, j in at]}, [x for r in rows for x in r], Scalars(dtype))
        return cls(df, len(rows), len(rows[0]) if rows else n or 0, dtype)

    def cells(self, name: str = "v") -> DataFrame:
        return self.df.select("i", "j", self.s.wide(F.col("v")).alias(name))

    def made(self, df: DataFrame, m: int | None = None, n: int | None = None) -> Matrix:
        return Matrix(df.select("i", "j", self.s.narrow(F.col("v")).alias("v")), self.m if m is None else m, self.n if n is None else n, self.dtype)

    def op(self, trans: str) -> Matrix:
        """op(A): a column rename, and a conjugate for 'C'."""
        if trans == "N":
            return self
        v = self.s.conj(F.col("v")) if trans == "C" else F.col("v")
        return Matrix(self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), v.alias("v")), self.n, self.m, self.dtype)

    def transposed(self) -> Matrix:
        return self.op("T")

    def adjoint(self) -> Matrix:
        return self.op("C")

    @property
    def effective_row_count(self) -> int:
        """Rows after ``op``: operands carry their turned shape."""
        return self.m

    @property
    def effective_column_count(self) -> int:
        return self.n

    def check(self) -> Matrix:
        """Raise where a cell is NULL, lies outside the shape or occurs twice: one job, for buffers of unknown origin."""
        i, j = F.col("i"), F.col("j")
        if self.df.where(i.isNull() | j.isNull() | (i < 0) | (i >= self.m) | (j < 0) | (j >= self.n) | self.df.v.isNull()).limit(1).count():
            raise InvalidLength(f"a cell is NULL or outside {self.m} x {self.n}")
        if self.df.groupBy("i", "j").count().where("count > 1").limit(1).count():
            raise InvalidLength("a cell occurs twice")
        return self

    def triangle(self, uplo: str) -> Matrix:
        return replace(self, df=self.df.where("i <= j" if uplo == "U" else "i >= j"))

    def band(self, kl: int, ku: int) -> Matrix:
        return replace(self, df=self.df.where((F.col("i") - F.col("j") <= kl) & (F.col("j") - F.col("i") <= ku)))

    def mirrored(self, uplo: str, hermitian: bool = False) -> Matrix:
        """The full matrix of which one triangle is given; the other triangle is never read, nor a Hermitian diagonal's imaginary part."""
        s, v = self.s, F.col("v")
        diagonal = F.array(F.struct("i", "j", (s.narrow(s.real_only(s.wide(v))) if hermitian else v).alias("v")))
        both = F.array(F.struct("i", "j", "v"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), (s.narrow(s.conj(s.wide(v))) if hermitian else v).alias("v")))
        half = self.triangle(uplo).df
        return replace(self, df=half.select(F.explode(F.when(F.col("i") == F.col("j"), diagonal).otherwise(both)).alias("c")).select("c.i", "c.j", "c.v"))

    def triangular(self, uplo: str, diag: str = "N") -> Matrix:
        """One triangle; a unit diagonal is supplied, not read."""
        if diag == "N":
            return self.triangle(uplo)
        strict = self.df.where("i < j" if uplo == "U" else "i > j")
        ones = self.spark.range(self.m).select(F.col("id").alias("i"), F.col("id").alias("j"), self.s.narrow(self.s.lit(1)).alias("v"))
        return replace(self, df=strict.unionByName(ones))

    def grid(self, uplo: str | None = None) -> DataFrame:
        """All index pairs of the shape, or of a triangle, generated in parallel."""
        cells = self.spark.range(self.m * self.n).select(F.expr(f"id div {max(1, self.n)}").alias("i"), F.expr(f"id % {max(1, self.n)}").alias("j"))
        return cells if uplo is None else cells.where("i <= j" if uplo == "U" else "i >= j")

    def dense(self, uplo: str | None = None) -> Matrix:
        full = self.grid(uplo).join(self.cells(), ["i", "j"], "left")
        return self.made(full.select("i", "j", self.s.or_zero(F.col("v")).alias("v")))

    def to_rows(self) -> list[list]:
        """Small matrices, for tests."""
        out = [[0j if self.s.is_complex else 0.0] * self.n for _ in range(self.m)]
        for r in self.df.collect():
            out[r.i][r.j] = complex(r.v.re, r.v.im) if self.s.is_complex else r.v
        return out
