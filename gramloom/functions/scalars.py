"""Column algebra over the four scalar types: s, d (real) and c, z (complex as ``struct<re, im>``).

Single-precision values are multiplied and summed in double and rounded once,
when an operator returns them.  Division follows IEEE 754 under ANSI mode too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with infinities and NaN instead of an error when b is zero; the sign of a zero divisor counts."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    negative_zero = b.cast("string") == "-0.0"  # asked of zeros only; Spark's arithmetic hides their sign
    by_zero = F.when(F.isnan(a) | (a == 0), nan).when((a > 0) != negative_zero, inf).otherwise(-inf)
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def bind(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@dataclass(frozen=True)
class Scalars:
    """Operations on columns of one scalar type."""

    dtype: str

    @property
    def is_complex(self) -> bool:
        return self.dtype in "cz"

    @property
    def real_type(self) -> str:
        return "float" if self.dtype in "sc" else "double"

    @property
    def sql_type(self) -> str:
        return f"struct<re:{self.real_type},im:{self.real_type}>" if self.is_complex else self.real_type

    def lit(self, x) -> Column:
        z = complex(x)
        return self.pair(F.lit(z.real), F.lit(z.imag)) if self.is_complex else F.lit(float(z.real))

    @staticmethod
    def pair(re: Column, im: Column) -> Column:
        return F.struct(re.alias("re"), im.alias("im"))

    def wide(self, v: Column) -> Column:
        """The value in double precision."""
        return self.pair(v["re"].cast("double"), v["im"].cast("double")) if self.is_complex else v.cast("double")

    def narrow(self, v: Column) -> Column:
        """The value rounded to this type."""
        return self.pair(v["re"].cast(self.real_type), v["im"].cast(self.real_type)) if self.is_complex else v.cast(self.real_type)

    def mul(self, a: Column, b: Column) -> Column:
        if not self.is_complex:
            return a * b
        return self.pair(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])

    def scale(self, alpha, v: Column) -> Column:
        """alpha * v for a Python number; a real factor scales components apart, without a cross term."""
        z = complex(alpha)
        if z == 1:
            return v
        if not self.is_complex:
            return F.lit(z.real) * v
        if z.imag == 0:
            return self.pair(F.lit(z.real) * v["re"], F.lit(z.real) * v["im"])
        return self.mul(self.lit(z), v)

    def add(self, a: Column, b: Column) -> Column:
        return self.pair(a["re"] + b["re"], a["im"] + b["im"]) if self.is_complex else a + b

    def sub(self, a: Column, b: Column) -> Column:
        return self.pair(a["re"] - b["re"], a["im"] - b["im"]) if self.is_complex else a - b

    def conj(self, v: Column) -> Column:
        return self.pair(v["re"], -v["im"]) if self.is_complex else v

    def real_only(self, v: Column) -> Column:
        return self.pair(v["re"], F.lit(0.0)) if self.is_complex else v

    def div(self, a: Column, b: Column) -> Column:
        """Unscaled complex division: both components over re^2 + im^2."""
        if not self.is_complex:
            return ieee_div(a, b)
        norm = b["re"] * b["re"] + b["im"] * b["im"]
        return self.pair(ieee_div(a["re"] * b["re"] + a["im"] * b["im"], norm), ieee_div(a["im"] * b["re"] - a["re"] * b["im"], norm))

    def abs1(self, v: Column) -> Column:
        return F.abs(v["re"]) + F.abs(v["im"]) if self.is_complex else F.abs(v)

    def abs2(self, v: Column) -> Column:
        return F.sqrt(v["re"] * v["re"] + v["im"] * v["im"]) if self.is_complex else F.abs(v)

    def total(self, v: Column) -> Column:
        """Aggregate sum; zero over no rows."""
        zero = F.lit(0.0)
        if self.is_complex:
            return self.pair(F.coalesce(F.sum(v["re"]), zero), F.coalesce(F.sum(v["im"]), zero))
        return F.coalesce(F.sum(v), zero)

    def or_zero(self, v: Column) -> Column:
        return F.coalesce(v, self.lit(0))
