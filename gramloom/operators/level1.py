"""Vector updates, reductions and rotations.

In-place forms of two vectors act on their shared prefix: indexes below the
shorter length.  Updates of one table are projections; of two, one equi-join on
the index.  Vectors that are columns of one table (``Vector.of`` of the same
DataFrame and index) meet in a projection of it, so nothing is joined.
Reductions are one partial and one final aggregate.
"""

from __future__ import annotations

from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import Scalars, bind
from ..plans.strategy import small
from ..types import Base, DimensionMismatch, Vector

#: Fixed values of the modified rotation: gamma, its square and the inverse of that.
GAMMA, GAMMA2 = 4096.0, 16777216.0


def _same_type(*parts) -> None:
    if len({p.dtype for p in parts}) > 1:
        raise DimensionMismatch("operands of different scalar types")


def zipped(x: Vector, y: Vector, how: str = "left") -> DataFrame:
    """``i, y, x`` for every cell of y below the shared length (``left``), x null where it has no cell; of one table by projection."""
    n = min(x.n, y.n)
    if x.shares(y):
        both = y.base.df.select(y.base.index.alias("i"), y.s.wide(y.base.value).alias("y"), x.s.wide(x.base.value).alias("x"))
        return both if x.n == y.n else both.where(F.col("i") < n)
    right = x.prefix(n).cells("x")
    return y.prefix(n).cells("y").join(right if how == "full" else small(right, n), "i", how)


def _both(x: Vector, y: Vector) -> DataFrame:
    """``i, x, y`` of all cells below the shared length, zeros where one has none."""
    return zipped(x, y, "full").select("i", x.s.or_zero(F.col("x")).alias("x"), y.s.or_zero(F.col("y")).alias("y"))


def _keep_tail(y: Vector, changed: DataFrame, n: int) -> Vector:
    """y with the cells below n replaced."""
    out = y.made(changed)
    return out if n >= y.n else Vector(out.df.unionByName(y.df.where(F.col("i") >= n)), y.n, y.dtype)


def _given(x: Vector, y: Vector, keep: Vector, value: Column) -> Vector:
    """``keep`` with ``value`` (in double precision, of the two bases' columns) below the shared length: a projection of their table."""
    n, s = min(x.n, y.n), keep.s
    new = s.narrow(value)
    return Vector.on(Base(keep.base.df, keep.base.index, new if n >= keep.n else F.when(keep.base.index < n, new).otherwise(keep.base.value)), keep.n, keep.dtype)


def swap(x: Vector, y: Vector) -> tuple[Vector, Vector]:
    _same_type(x, y)
    n = min(x.n, y.n)
    if x.shares(y):
        return _given(x, y, x, y.base.value), _given(x, y, y, x.base.value)
    give = lambda a, b: Vector(b.prefix(n).df.unionByName(a.df.where(F.col("i") >= n)) if n < a.n else b.prefix(n).df, a.n, a.dtype)
    return give(x, y), give(y, x)


def copy(x: Vector, y: Vector) -> Vector:
    return swap(y, x)[0]


def scal(alpha, x: Vector) -> Vector:
    """alpha * x; zero multiplies, so NaN stays NaN. A real factor leaves no cross term (csscal, zdscal)."""
    return x if alpha == 1 else x.made(x.cells().select("i", x.s.scale(alpha, F.col("v")).alias("v")))


def rscal(alpha: float, x: Vector) -> Vector:
    return scal(float(alpha), x)


def scal_into(alpha, x: Vector, result: Vector) -> Vector:
    if x.n != result.n:
        raise DimensionMismatch(f"{x.n} and {result.n}")
    return scal(alpha, x)


def axpby(alpha, x: Vector, beta, y: Vector) -> Vector:
    """alpha * x + beta * y over the shared prefix; alpha = 0 does not read x."""
    _same_type(x, y)
    s, n = y.s, min(x.n, y.n)
    if alpha == 0:
        return _keep_tail(y, scal(beta, y.prefix(n)).cells(), n)
    if alpha == 1 and beta == 0:
        return copy(x, y)
    line = lambda a, b: s.add(s.scale(alpha, a), s.scale(beta, b))
    if x.shares(y):
        return _given(x, y, y, line(s.wide(x.base.value), s.wide(y.base.value)))
    return _keep_tail(y, _both(x, y).select("i", line(F.col("x"), F.col("y")).alias("v")), n)


def axpy(alpha, x: Vector, y: Vector) -> Vector:
    """y + alpha * x; alpha = 0 leaves y untouched, whatever x holds."""
    return y if alpha == 0 else axpby(alpha, x, 1, y)


def axpy_into(alpha, source: Vector, x: Vector, result: Vector) -> Vector:
    """x + alpha * source; all of one length."""
    if not source.n == x.n == result.n:
        raise DimensionMismatch(f"{source.n}, {x.n} and {result.n}")
    return axpy(alpha, source, x)


def axpby_into(alpha, source: Vector, beta, x: Vector, result: Vector) -> Vector:
    if not source.n == x.n == result.n:
        raise DimensionMismatch(f"{source.n}, {x.n} and {result.n}")
    return axpby(alpha, source, beta, x)


def _one(x: Vector, df: DataFrame, value: Column) -> DataFrame:
    return df.agg(x.s.narrow(value).alias("value"))


def dot(x: Vector, y: Vector, conjugated: bool = False) -> DataFrame:
    """One row ``value``: sum of x * y, or conj(x) * y; 0 over nothing."""
    _same_type(x, y)
    s, left = x.s, F.col("x")
    return _one(x, zipped(x, y, "inner"), s.total(s.mul(s.conj(left) if conjugated else left, F.col("y"))))


def dotu(x: Vector, y: Vector) -> DataFrame:
    return dot(x, y)


def dotc(x: Vector, y: Vector) -> DataFrame:
    return dot(x, y, conjugated=True)


def dsdot(x: Vector, y: Vector) -> DataFrame:
    """Single-precision inputs, double-precision product sum."""
    return zipped(x, y, "inner").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("value"))


def sdsdot(sb: float, x: Vector, y: Vector) -> DataFrame:
    """sb + dsdot, rounded to single precision once."""
    if min(x.n, y.n) == 0:
        return x.spark.range(1).select(F.lit(sb).cast("float").alias("value"))
    return dsdot(x, y).select((F.lit(float(sb)) + F.col("value")).cast("float").alias("value"))


#: Fixed values of the scaled sums of squares: bounds of large and small components and the factors that bring them to range.
LARGE, SMALL, DOWN, UP = 1.997919072202235e146, 1.4916681462400413e-154, 1.1113793747425387e-162, 4.4989137945431964e161


def nrm2(x: Vector) -> DataFrame:
    """2-norm without overflow or underflow, in one pass: large, middling and small components are summed apart, each in its own scale.

    Any NaN gives NaN, else any infinity gives infinity.
    """
    parts = F.array("v.re", "v.im") if x.s.is_complex else F.array("v")
    v = F.col("v")
    sums = lambda where, by: F.coalesce(F.sum(F.when(where, (v * by) * (v * by))), F.lit(0.0))
    cells = x.cells().select(F.explode(parts).alias("v")).select(F.abs("v").alias("v"))
    found = cells.agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("top"), sums(v > LARGE, DOWN).alias("large"), sums((v <= LARGE) & (v >= SMALL), 1.0).alias("mid"), sums(v < SMALL, UP).alias("small"))
    large = F.sqrt(F.col("large") + F.col("mid") * DOWN * DOWN) / DOWN
    mid, little = F.sqrt("mid"), F.sqrt("small") / UP
    middle = F.when(F.col("small") == 0, mid).when(F.col("mid") == 0, little).otherwise(mid * F.sqrt(F.lit(1.0) + (little / F.when(mid > 0, mid).otherwise(1.0)) * (little / F.when(mid > 0, mid).otherwise(1.0))))
    value = F.when(F.isnan("top") | (F.col("top") == float("inf")), F.col("top")).when(F.col("large") > 0, large).otherwise(middle)
    return found.select(value.cast(x.s.real_type).alias("value"))


def asum(x: Vector) -> DataFrame:
    """Sum of |v|, for complex of |re| + |im|."""
    return x.cells().agg(F.coalesce(F.sum(x.s.abs1(F.col("v"))), F.lit(0.0)).cast(x.s.real_type).alias("value"))


def iamax(x: Vector, base: int = 1) -> DataFrame:
    """One row ``idx``: place of the first largest |v| (complex: |re| + |im|).

    Counted from ``base`` (1; 0 for the C names); 0 for an empty vector.  A NaN
    in the first place wins, later ones are passed over; without any larger than
    zero, cells left out included, it is the first place.
    """
    if x.n == 0:
        return x.spark.range(1).select(F.lit(0).cast("long").alias("idx"))
    a = F.col("a")
    cells = x.cells().select("i", x.s.abs1(F.col("v")).alias("a"))
    first = F.max((F.isnan(a) & (F.col("i") == 0)).cast("int")) == 1
    place = F.when(first, F.lit(0)).otherwise(F.min_by(F.when(~F.isnan(a) & (a > 0), F.col("i")), F.when(~F.isnan(a) & (a > 0), F.struct((-a).alias("a"), "i"))))
    return cells.agg((F.coalesce(place, F.lit(0)) + base).cast("long").alias("idx"))


def iamax_from_zero(x: Vector) -> DataFrame:
    """``iamax`` under its C names, which count from 0."""
    return iamax(x, base=0)


def cabs1(v: Column) -> Column:
    return F.abs(v["re"]) + F.abs(v["im"])


def rotg(a: Column, b: Column) -> Column:
    """Plane rotation of two reals: struct r, z, c, s."""
    zero, one = F.lit(0.0), F.lit(1.0)
    cells = F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))

    def sized(v):
        scale = F.abs(v["a"]) + F.abs(v["b"])
        return F.struct(v["a"].alias("a"), v["b"].alias("b"), (scale == 0).alias("none"), F.when(scale == 0, one).otherwise(scale).alias("scale"))

    def turned(v):
        a, b, scale = v["a"], v["b"], v["scale"]
        size = scale * F.sqrt((a / scale) * (a / scale) + (b / scale) * (b / scale))
        lead = F.when(F.abs(b) > F.abs(a), b).otherwise(a)
        return F.struct(a.alias("a"), b.alias("b"), v["none"].alias("none"), F.when(v["none"], one).when(lead < 0, -size).otherwise(size).alias("r"))

    def told(v):
        a, b, r, none = v["a"], v["b"], v["r"], v["none"]
        z = F.when(none, zero).when(F.abs(a) > F.abs(b), b / r).when(a != 0, r / F.when(a == 0, one).otherwise(a)).otherwise(one)
        return F.struct(F.when(none, zero).otherwise(r).alias("r"), z.alias("z"), F.when(none, one).otherwise(a / r).alias("c"), F.when(none, zero).otherwise(b / r).alias("s"))

    return bind(cells, lambda v: bind(sized(v), lambda w: bind(turned(w), told)))


def rotg_complex(a: Column, b: Column) -> Column:
    """Plane rotation of two complex values: struct a (new), c (real), s."""
    k = Scalars("z")
    zero = F.lit(0.0)

    def sized(v):
        return F.struct(v["a"].alias("a"), v["b"].alias("b"), k.abs2(v["a"]).alias("size"), (k.abs2(v["a"]) + k.abs2(v["b"])).alias("scale"), k.abs2(v["b"]).alias("other"))

    def turned(v):
        norm = v["scale"] * F.sqrt((v["size"] / v["scale"]) * (v["size"] / v["scale"]) + (v["other"] / v["scale"]) * (v["other"] / v["scale"]))
        unit = k.pair(v["a"]["re"] / v["size"], v["a"]["im"] / v["size"])
        return F.struct(v["b"].alias("b"), v["size"].alias("size"), norm.alias("norm"), unit.alias("unit"))

    def told(v):
        s = bind(k.mul(v["unit"], k.conj(v["b"])), lambda p: k.pair(p["re"] / v["norm"], p["im"] / v["norm"]))
        return F.struct(k.mul(v["unit"], k.pair(v["norm"], zero)).alias("a"), (v["size"] / v["norm"]).alias("c"), s.alias("s"))

    whole = F.struct(k.wide(a).alias("a"), k.wide(b).alias("b"))
    none = lambda v: F.struct(v["b"].alias("a"), zero.alias("c"), k.lit(1).alias("s"))
    return bind(whole, lambda v: bind(sized(v), lambda w: F.when(w["size"] == 0, none(w)).otherwise(bind(turned(w), told))))


def turned(x: Vector, y: Vector, h11: float, h12: float, h21: float, h22: float) -> DataFrame:
    """``i, x, y`` over the shared prefix: h11 x + h12 y and h21 x + h22 y, from one join, or none if both are of one table.  Zero factors multiply, so NaN stays NaN."""
    _same_type(x, y)
    s, both = x.s, _both(x, y)
    line = lambda a, b: s.narrow(s.add(s.scale(a, F.col("x")), s.scale(b, F.col("y"))))
    return both.select("i", line(h11, h12).alias("x"), line(h21, h22).alias("y"))


def rot_paired(x: Vector, y: Vector, c: float, s: float) -> DataFrame:
    """Both sides of ``rot`` over the shared prefix, as ``i, x, y``."""
    return turned(x, y, c, s, -s, c)


def _implied(param: list[float]) -> tuple[float, float, float, float] | None:
    """h11, h12, h21, h22 of a modified rotation; None where the flag leaves everything as it is."""
    kind, h11, h21, h12, h22 = param
    return {-2: None, 0: (1.0, h12, h21, 1.0), 1: (h11, 1.0, -1.0, h22)}.get(kind, (h11, h12, h21, h22))


def rotm_paired(x: Vector, y: Vector, param: list[float]) -> DataFrame:
    """Both sides of ``rotm`` over the shared prefix, as ``i, x, y``."""
    return turned(x, y, *(_implied(param) or (1.0, 0.0, 0.0, 1.0)))


def _apart(x: Vector, y: Vector, both: DataFrame) -> tuple[Vector, Vector]:
    """Both results as vectors of one table, ``both``, where their lengths are equal."""
    n = min(x.n, y.n)
    if x.n == y.n:
        return tuple(Vector.on(Base(both, F.col("i"), F.col(name)), n, x.dtype) for name in ("x", "y"))
    return tuple(_keep_tail(old, both.select("i", F.col(name).alias("v")), n) for name, old in (("x", x), ("y", y)))


def rot(x: Vector, y: Vector, c: float, s: float) -> tuple[Vector, Vector]:
    """x' = c x + s y, y' = c y - s x, over the shared prefix."""
    return _apart(x, y, rot_paired(x, y, c, s))


def rotm(x: Vector, y: Vector, param: list[float]) -> tuple[Vector, Vector]:
    """Modified rotation; param is flag, h11, h21, h12, h22, of which the flag implies some."""
    return (x, y) if _implied(param) is None else _apart(x, y, rotm_paired(x, y, param))


def rotmg(d1: float, d2: float, x1: float, y1: float) -> dict:
    """Modified rotation generator for driver values: d1, d2, x1 and param (None: not implied by the flag)."""
    h = {"11": 0.0, "12": 0.0, "21": 0.0, "22": 0.0}
    p2 = d2 * y1
    if d1 >= 0 and p2 == 0:
        return {"d1": d1, "d2": d2, "x1": x1, "param": [-2.0, None, None, None, None]}
    kind = -1
    if d1 >= 0:
        p1 = d1 * x1
        q1, q2 = p1 * x1, p2 * y1
        if abs(q1) > abs(q2):
            h["21"], h["12"] = -y1 / x1, p2 / p1
            u = 1 - h["12"] * h["21"]
            if u > 0:
                kind, d1, d2, x1 = 0, d1 / u, d2 / u, x1 * u
        elif q2 >= 0:
            h["11"], h["22"] = p1 / p2, x1 / y1
            u = 1 + h["11"] * h["22"]
            kind, d1, d2, x1 = 1, d2 / u, d1 / u, y1 * u
    if kind == -1:
        d1 = d2 = x1 = 0.0
        h = dict.fromkeys(h, 0.0)
    for first in (True, False):
        d = d1 if first else d2
        while d != 0 and isfinite(d) and not 1 / GAMMA2 < abs(d) < GAMMA2:
            if kind >= 0:
                h |= {"11": 1.0, "22": 1.0} if kind == 0 else {"21": -1.0, "12": 1.0}
                kind = -1
            up = abs(d) <= 1 / GAMMA2
            d = d * GAMMA2 if up else d / GAMMA2
            for name in ("11", "12") if first else ("21", "22"):
                h[name] = h[name] / GAMMA if up else h[name] * GAMMA
            if first:
                x1 = x1 / GAMMA if up else x1 * GAMMA
        d1, d2 = (d, d2) if first else (d1, d)
    told = {-1: ("11", "21", "12", "22"), 0: ("21", "12"), 1: ("11", "22")}[kind]
    return {"d1": d1, "d2": d2, "x1": x1, "param": [float(kind), *(h[k] if k in told else None for k in ("11", "21", "12", "22"))]}


#: Rescalings that bring any finite number between 1 / GAMMA2 and GAMMA2.
MOST_STEPS = 46


def rotmg_columns(d1: Column, d2: Column, x1: Column, y1: Column) -> Column:
    """``rotmg`` of columns: struct d1, d2, x1, flag, h11, h21, h12, h22, null where the flag implies an h.

    The two rescaling loops are a fold of at most ``MOST_STEPS`` steps, entered by rows that need one; numbers that are not finite are left alone.
    """
    zero, one = F.lit(0.0), F.lit(1.0)
    names = ("d1", "d2", "x1", "flag", "h11", "h21", "h12", "h22")
    state = lambda *v: F.struct(*[F.coalesce(c, zero).alias(n) for c, n in zip(v, names, strict=True)])
    over = lambda a, b: a / F.when(b == 0, one).otherwise(b)  # noqa: E731  only where b is not 0

    def begun(v):
        d1, d2, x1, y1 = (v[n] for n in ("d1", "d2", "x1", "y1"))
        p1, p2 = d1 * x1, d2 * y1
        q1, q2 = p1 * x1, p2 * y1

        def first(w):
            return state(over(d1, w["u"]), over(d2, w["u"]), x1 * w["u"], zero, zero, w["a"], w["b"], zero)

        def second(w):
            return state(over(d2, w["u"]), over(d1, w["u"]), y1 * w["u"], one, w["a"], zero, zero, w["b"])

        halves = lambda a, b, sign: bind(F.struct(a.alias("a"), b.alias("b")), lambda h: F.struct(h["a"].alias("a"), h["b"].alias("b"), (one + F.lit(sign) * h["a"] * h["b"]).alias("u")))
        none = state(zero, zero, zero, -one, zero, zero, zero, zero)
        lead = bind(halves(over(-y1, x1), over(p2, p1), -1.0), lambda w: F.when(w["u"] > 0, first(w)).otherwise(none))
        swapped = bind(halves(over(p1, p2), over(x1, y1), 1.0), second)
        return F.when(F.abs(q1) > F.abs(q2), lead).when(q2 >= 0, swapped).otherwise(none)

    def outside(d):
        return (d != 0) & ~F.isnan(d) & (F.abs(d) != float("inf")) & ~((F.abs(d) > 1 / GAMMA2) & (F.abs(d) < GAMMA2))

    def step(v, which):
        """One rescaling of d1 or d2; the first one spells out what the flag implied."""
        kind = v["flag"]
        spelled = {"h11": F.when(kind == 0, one).otherwise(v["h11"]), "h22": F.when(kind == 0, one).otherwise(v["h22"]), "h21": F.when(kind == 1, -one).otherwise(v["h21"]), "h12": F.when(kind == 1, one).otherwise(v["h12"])}
        small_ = F.abs(v[which]) <= 1 / GAMMA2
        grown, shrunk = F.when(small_, F.lit(GAMMA2)).otherwise(1 / GAMMA2), F.when(small_, F.lit(1 / GAMMA)).otherwise(GAMMA)
        new = {"d1": v["d1"], "d2": v["d2"], "x1": v["x1"], "flag": -one} | spelled
        new[which] = v[which] * grown
        for h in ("h11", "h12") if which == "d1" else ("h21", "h22"):
            new[h] = spelled[h] * shrunk
        if which == "d1":
            new["x1"] = v["x1"] * shrunk
        return state(*[new[n] for n in names])

    def rescaled(v, which):
        fold = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_STEPS)), v, lambda acc, _: F.when(outside(acc[which]), step(acc, which)).otherwise(acc))
        return F.when(outside(v[which]), fold).otherwise(v)

    def told(v):
        kind = v["flag"]
        return F.struct(v["d1"].alias("d1"), v["d2"].alias("d2"), v["x1"].alias("x1"), kind.alias("flag"), F.when(kind != 0, v["h11"]).alias("h11"), F.when(kind != 1, v["h21"]).alias("h21"), F.when(kind != 1, v["h12"]).alias("h12"), F.when(kind != 0, v["h22"]).alias("h22"))

    def run(v):
        nothing = F.lit(None).cast("double")
        same = F.struct(v["d1"].alias("d1"), v["d2"].alias("d2"), v["x1"].alias("x1"), F.lit(-2.0).alias("flag"), *[nothing.alias(h) for h in ("h11", "h21", "h12", "h22")])
        lost = told(state(zero, zero, zero, -one, zero, zero, zero, zero))
        turned = bind(bind(bind(begun(v), lambda w: rescaled(w, "d1")), lambda w: rescaled(w, "d2")), told)
        return F.when(v["d1"] < 0, lost).when(v["d2"] * v["y1"] == 0, same).otherwise(turned)

    return bind(F.struct(*[c.cast("double").alias(n) for n, c in (("d1", d1), ("d2", d2), ("x1", x1), ("y1", y1))]), run)


def rotmg_rows(df: DataFrame) -> DataFrame:
    """``rotmg`` of every row of ``df(d1, d2, x1, y1)``: ``d1, d2, x1, flag, h11, h21, h12, h22``."""
    return df.select(rotmg_columns(*[F.col(n) for n in ("d1", "d2", "x1", "y1")]).alias("g")).select("g.*")
