"""Registered linear-algebra queries and the SQL that DuckDB runs beside them.

Operands come from the whole tables: 25 x 25 counts by nation, 512 x 512 counts,
long vectors, bands and a tall matrix over ``orders``, and the features of
``lineitem``.  Most entries are integers, so sums are exact in any order and
results compare by value; solves whose quotients are not exact are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions import sql
from .operators import level1 as l1
from .operators import level2 as l2
from .operators import level3 as l3
from .operators import solve
from .operators.blocked import Blocks
from .sources import layout
from .types import Matrix, Vector

N = 25
LARGE = 300  # more rows than a block of a solve
WIDE = 512  # a matrix of several tiles
LONG = 1 << 40  # indexes of the long vectors are order keys, below this
K = 8  # diagonals of the long triangular band


class Operands:
    """The tables as vectors and matrices; nothing is read before a query runs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.read = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        """One DataFrame a table, so vectors of one table know it."""
        if name not in self.read:
            self.read[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self.read[name]

    def counts(self, column: str) -> Matrix:
        cells = self.table("customer").groupBy(F.col("c_nationkey").alias("i"), F.expr(column).alias("j")).agg(F.count("*").alias("v"))
        return Matrix.of(cells, N, N)

    @property
    def a(self) -> Matrix:
        return self.counts("c_custkey % 25")

    @property
    def b(self) -> Matrix:
        return self.counts("c_custkey div 25 % 25")

    @property
    def x(self) -> Vector:
        return Vector.of(self.table("supplier").groupBy(F.col("s_nationkey").alias("i")).agg(F.count("*").alias("v")), N)

    @property
    def y(self) -> Vector:
        return Vector.of(self.table("nation"), N, "n_nationkey", F.col("n_regionkey") + 1)

    def long(self, value: str, dtype: str = "d") -> Vector:
        return Vector.of(self.table("orders"), LONG, "o_orderkey", F.expr(value), dtype)

    @property
    def p(self) -> Vector:
        return self.long("floor(o_totalprice)")

    @property
    def q(self) -> Vector:
        return self.long("o_custkey % 1000 - 500")

    @property
    def zp(self) -> Vector:
        return self.long("struct(floor(o_totalprice) as re, o_custkey % 100 as im)", "z")

    @property
    def zq(self) -> Vector:
        return self.long("struct(o_custkey % 1000 - 500 as re, floor(o_totalprice) % 10 as im)", "z")

    def pair(self, re, im, kind):
        """A complex operand of two real ones."""
        keys = ["i", "j"] if kind is Matrix else ["i"]
        both = re.cells("a").join(im.cells("b"), keys, "full")
        v = F.struct(F.coalesce("a", F.lit(0.0)).alias("re"), F.coalesce("b", F.lit(0.0)).alias("im"))
        return Matrix.of(both.withColumn("v", v), N, N, dtype="z") if kind is Matrix else Vector.of(both.withColumn("v", v), N, dtype="z")

    def typed(self, operand, dtype: str):
        """The operand in another precision."""
        cells = operand.cells()
        return Matrix.of(cells, operand.m, operand.n, dtype=dtype) if isinstance(operand, Matrix) else Vector.of(cells, operand.n, dtype=dtype)

    @property
    def za(self) -> Matrix:
        return self.pair(self.a, self.b, Matrix)

    @property
    def zb(self) -> Matrix:
        return self.pair(self.b, self.a.op("T"), Matrix)

    @property
    def zx(self) -> Vector:
        return self.pair(self.x, self.y, Vector)

    @property
    def zy(self) -> Vector:
        return self.pair(self.y, self.x, Vector)

    @property
    def features(self) -> list:
        return [F.col("l_quantity"), F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100), F.lit(1.0)]

    @property
    def tall(self) -> Matrix:
        """A tall matrix over the rows of ``orders``."""
        return Matrix.from_columns(self.table("orders"), LONG, "o_orderkey", [F.col("o_custkey") % 100, F.floor("o_totalprice") % 10, F.lit(1)])

    @property
    def t(self) -> Matrix:
        """Lower triangle of all nations with zeros, ones and pivots 2: solutions are exact dyadic fractions."""
        diagonal = self.spark.range(N).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(2.0).alias("v"))
        return Matrix.of(self.a.cells().where("i > j").select("i", "j", (F.col("v") % 2).alias("v")).unionByName(diagonal), N, N)

    def whole_t(self, n: int = N) -> Matrix:
        """Lower triangle with pivots 4 over all nations, or over customers by their keys modulo n."""
        cells = self.a.cells() if n == N else self.table("customer").groupBy((F.col("c_custkey") % n).alias("i"), F.expr(f"(c_custkey div {n} * 53 + c_custkey % {n} * 7) % {n}").alias("j")).agg(F.count("*").cast("double").alias("v"))
        below = cells.where("i > j").select("i", "j", (F.col("v") % 3 if n == N else F.col("v") % 3 / 64).alias("v"))
        return Matrix.of(below.unionByName(self.spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(4.0).alias("v"))), n, n)

    @property
    def large_x(self) -> Vector:
        """Customers by key modulo LARGE."""
        return Vector.of(self.table("customer").groupBy((F.col("c_custkey") % LARGE).alias("i")).agg(F.count("*").alias("v")), LARGE)

    def wide(self, row: str, column: str) -> Matrix:
        """Counts of orders, WIDE x WIDE."""
        return Matrix.of(self.table("orders").groupBy(F.expr(row).alias("i"), F.expr(column).alias("j")).agg(F.count("*").alias("v")), WIDE, WIDE)

    @property
    def wa(self) -> Matrix:
        return self.wide("o_orderkey % 512", "o_custkey % 512")

    @property
    def wb(self) -> Matrix:
        return self.wide("o_custkey * 7 % 512", "o_orderkey div 3 % 512")

    @property
    def nan(self) -> Matrix:
        """Counts with NaN and infinities among them, and zeros of both kinds: stored and missing."""
        v = F.when((F.col("i") * 3 + F.col("j")) % 29 == 0, float("nan")).when((F.col("i") + F.col("j") * 5) % 31 == 0, float("inf")).when((F.col("i") * 5 + F.col("j")) % 37 == 0, float("-inf")).otherwise(F.col("v") % 3)
        return Matrix.of(self.a.cells().where("(i + j) % 2 = 0").select("i", "j", v.alias("v")), N, N)

    @property
    def buffer(self) -> DataFrame:
        """The customers as a buffer of negative keys."""
        return self.table("customer").select(F.col("c_custkey").alias("pos"), (-F.col("c_custkey")).cast("double").alias("v"))

    @property
    def n_orders(self) -> int:
        return self.table("orders").count()

    def band(self, kl: int, ku: int, pivot: float | None = None) -> Matrix:
        """A band over the rows of ``orders``, whose keys are 0 .. n - 1."""
        n = self.n_orders
        v = (F.col("o_custkey") + 3 * F.col("d") + 6) % 5 - 2
        cells = self.table("orders").select("o_custkey", F.col("o_orderkey").alias("i"), F.explode(F.sequence(F.lit(-kl), F.lit(ku))).alias("d")).select("i", (F.col("i") + F.col("d")).alias("j"), (v if pivot is None else F.when(F.col("d") == 0, pivot).otherwise(v)).cast("double").alias("v"))
        return Matrix.of(cells.where((F.col("j") >= 0) & (F.col("j") < n)), n, n)

    def order_vector(self, value: str) -> Vector:
        return Vector.of(self.table("orders"), self.n_orders, "o_orderkey", F.expr(value))

    def views(self, **vectors) -> None:
        """Temporary views of vectors and matrices, for the table functions."""
        for name, operand in vectors.items():
            operand.cells().createOrReplaceTempView(f"gramloom_{name}")


#: Operands in SQL, all cells spelled out.
SQL = """
WITH RECURSIVE r AS (SELECT range::BIGINT AS i FROM range(25)),
g AS (SELECT s.i, t.i AS j FROM r s, r t),
ac AS (SELECT c_nationkey::BIGINT AS i, (c_custkey % 25)::BIGINT AS j, count(*)::DOUBLE AS v FROM customer GROUP BY 1, 2),
bc AS (SELECT c_nationkey::BIGINT AS i, (c_custkey // 25 % 25)::BIGINT AS j, count(*)::DOUBLE AS v FROM customer GROUP BY 1, 2),
xc AS (SELECT s_nationkey::BIGINT AS i, count(*)::DOUBLE AS v FROM supplier GROUP BY 1),
a AS (SELECT i, j, coalesce(v, 0) AS v FROM g LEFT JOIN ac USING (i, j)),
b AS (SELECT i, j, coalesce(v, 0) AS v FROM g LEFT JOIN bc USING (i, j)),
x AS (SELECT i, coalesce(v, 0) AS v FROM r LEFT JOIN xc USING (i)),
y AS (SELECT n_nationkey::BIGINT AS i, (n_regionkey + 1)::DOUBLE AS v FROM nation),
za AS (SELECT i, j, a.v AS re, b.v AS im FROM a JOIN b USING (i, j)),
zb AS (SELECT b.i, b.j, b.v AS re, a.v AS im FROM b JOIN a ON a.i = b.j AND a.j = b.i),
zx AS (SELECT i, x.v AS re, y.v AS im FROM x JOIN y USING (i)),
zy AS (SELECT i, y.v AS re, x.v AS im FROM x JOIN y USING (i)),
o AS (SELECT o_orderkey AS i, floor(o_totalprice) AS p, (o_custkey % 1000 - 500)::DOUBLE AS q, floor(o_totalprice) AS pr, (o_custkey % 100)::DOUBLE AS pi,
      (o_custkey % 1000 - 500)::DOUBLE AS qr, floor(o_totalprice)::BIGINT % 10 AS qi FROM orders),
t AS (SELECT i, j, CASE WHEN i = j THEN 2.0::DOUBLE ELSE v % 2 END AS v FROM a WHERE j <= i),
wt AS (SELECT i, j, CASE WHEN i = j THEN 4.0::DOUBLE ELSE v % 3 END AS v FROM a WHERE j <= i),
wa AS (SELECT (o_orderkey % 512)::BIGINT AS i, (o_custkey % 512)::BIGINT AS j, count(*)::DOUBLE AS v FROM orders GROUP BY 1, 2),
wb AS (SELECT (o_custkey * 7 % 512)::BIGINT AS i, (o_orderkey // 3 % 512)::BIGINT AS j, count(*)::DOUBLE AS v FROM orders GROUP BY 1, 2),
na AS (SELECT i, j, CASE WHEN (i * 3 + j) % 29 = 0 THEN 'nan'::DOUBLE WHEN (i + j * 5) % 31 = 0 THEN 'inf'::DOUBLE WHEN (i * 5 + j) % 37 = 0 THEN '-inf'::DOUBLE ELSE v % 3 END AS v FROM ac WHERE (i + j) % 2 = 0),
ob AS (SELECT o_orderkey AS i, o_orderkey + d AS j, d, (((o_custkey + 3 * d + 6) % 5) - 2)::DOUBLE AS v, o_custkey FROM orders, (SELECT unnest(range(-8, 9)) AS d)),
ox AS (SELECT o_orderkey AS i, (o_custkey % 10)::DOUBLE AS v, (o_custkey % 7)::DOUBLE AS y FROM orders),
"""

L1 = lambda body: SQL.rstrip().rstrip(",") + "\n" + body


def _mv(m: str, v: str = "x") -> str:
    """SUM of a matrix relation times a vector, with alpha 2 and beta 3 on y."""
    return L1(f"SELECT m.i, 2 * sum(m.v * {v}.v) + 3 * any_value(y.v) AS v FROM ({m}) m JOIN {v} ON {v}.i = m.j JOIN y ON y.i = m.i GROUP BY m.i")


def _zmv(m: str, add_y: bool = True) -> str:
    y = " + any_value(zy.re)", " + any_value(zy.im)"
    return L1(f"SELECT m.i, sum(m.re * zx.re - m.im * zx.im){y[0] if add_y else ''} AS re, sum(m.re * zx.im + m.im * zx.re){y[1] if add_y else ''} AS im FROM ({m}) m JOIN zx ON zx.i = m.j JOIN zy ON zy.i = m.i GROUP BY m.i")


def _mm(left: str, right: str, where: str = "true", extra: str = "0") -> str:
    return f"SELECT l.i, q.j, sum(l.v * q.v) AS v FROM ({left}) l JOIN ({right}) q ON l.j = q.i WHERE {where} GROUP BY l.i, q.j"


def _zmm(left: str, right: str) -> str:
    return f"SELECT l.i, q.j, sum(l.re * q.re - l.im * q.im) AS re, sum(l.re * q.im + l.im * q.re) AS im FROM ({left}) l JOIN ({right}) q ON l.j = q.i GROUP BY l.i, q.j"


T = "SELECT j AS i, i AS j, v FROM {}"
SYM = "SELECT i, j, v FROM a WHERE i <= j UNION ALL SELECT j, i, v FROM a WHERE i < j"
HERM = "SELECT i, j, re, CASE WHEN i = j THEN 0 ELSE im END AS im FROM za WHERE i <= j UNION ALL SELECT j, i, re, -im FROM za WHERE i < j"
BAND = "SELECT i, j, v FROM a WHERE i - j <= 2 AND j - i <= 3"
NEAR = "abs(i - j) <= 3"
HER = """SELECT a.i, a.j, a.re + 2 * (x.re * w.re + x.im * w.im) AS re, CASE WHEN a.i = a.j THEN 0 ELSE a.im + 2 * (x.im * w.re - x.re * w.im) END AS im
FROM za a JOIN zx x ON x.i = a.i JOIN zx w ON w.i = a.j WHERE a.i <= a.j"""
HER2 = """SELECT i, j, re + (r1 - 2 * m1) + (r2 + 2 * m2) AS re, CASE WHEN i = j THEN 0 ELSE im + (m1 + 2 * r1) + (m2 - 2 * r2) END AS im FROM (
SELECT a.*, x.re * v.re + x.im * v.im AS r1, x.im * v.re - x.re * v.im AS m1, y.re * w.re + y.im * w.im AS r2, y.im * w.re - y.re * w.im AS m2
FROM za a JOIN zx x ON x.i = a.i JOIN zy y ON y.i = a.i JOIN zx w ON w.i = a.j JOIN zy v ON v.i = a.j WHERE a.i <= a.j)"""
ZT = "SELECT j AS i, i AS j, re, {}im AS im FROM {}"


def _solve(rows: str, given: str, more: str = "") -> str:
    """Forward substitution as a recursion over a list of solved values."""
    return SQL + f"""{more}
rows AS (SELECT i, list(v ORDER BY j) AS w FROM ({rows}) GROUP BY i),
sides AS ({given}),
s(k, c, xs) AS (
  SELECT 0::BIGINT, c, []::DOUBLE[] FROM (SELECT DISTINCT c FROM sides)
  UNION ALL
  SELECT s.k + 1, s.c, list_append(s.xs, (d.v - coalesce(list_sum(list_transform(range(s.k), lambda z: rows.w[z + 1] * s.xs[z + 1])), 0)) / rows.w[s.k + 1])
  FROM s JOIN rows ON rows.i = s.k JOIN sides d ON d.i = s.k AND d.c = s.c)
"""


def _long(columns: str) -> str:
    return L1(f"SELECT i, {columns} FROM o")


def flat(df: DataFrame) -> DataFrame:
    """Complex values as two columns."""
    return df.select(*[c for c in df.columns if c != "v"], "v.re", "v.im")


def _two(x: Vector, y: Vector) -> DataFrame:
    return l1.zipped(x, y, "inner").select("i", "x", "y")


def _only(uplo_filter: str, m: Matrix) -> DataFrame:
    return m.dense().df.where(uplo_filter)


def _packed_sql(cells: str, upper: bool = True) -> str:
    place = "i + j * (j + 1) // 2" if upper else "i - j + j * (2 * 25 - j + 1) // 2"
    return L1(f"SELECT ({place})::BIGINT AS pos, v FROM ({cells})")


def _called(o: Operands, routine: str, columns: str, arguments: str = "", **operands) -> DataFrame:
    """A table function of SQL over views of the operands."""
    o.views(**{f"{routine}_{role}": operand for role, operand in operands.items()})
    name = sql.create(o.spark, routine, f"gramloom_{routine}", **{role: f"gramloom_{routine}_{role}" for role in operands})
    return o.spark.sql(f"SELECT {columns} FROM {name}({arguments})")


def _put(ours: str, i: str, j: str, there: str, more: str = "") -> str:
    """The customers as a buffer of negative keys, with the cells of a where the place is its own."""
    return L1(f"SELECT c_custkey AS pos, CASE WHEN {ours} THEN coalesce(w.v, 0) ELSE -c_custkey::DOUBLE END AS v FROM customer {more} LEFT JOIN (SELECT * FROM a WHERE {there}) w ON w.i = {i} AND w.j = {j} AND {ours}")


def _band_sql(value: str, where: str, row: str, column: str, both: bool = False, outer: bool = False) -> str:
    """A band over the orders times their vector; the mirrored one, or rows without a term, if asked."""
    cells = f"SELECT i, j, d, v FROM ob m WHERE {where} AND j >= 0 AND j < (SELECT count(*) FROM orders)"
    cells += f" UNION ALL SELECT j, i, d, v FROM ({cells}) WHERE i <> j" if both else ""
    terms = f"({cells}) m JOIN ox x ON x.i = {column}"
    return L1(f"SELECT y.i, {value} AS v FROM ox y LEFT JOIN ({terms}) ON {row} = y.i GROUP BY y.i" if outer else f"SELECT {row} AS i, {value} AS v FROM {terms} JOIN ox y ON y.i = {row} GROUP BY 1")


def _six():
    """The value rounded to six places."""
    return ((F.floor(F.col("v") * 1e6 + 0.5) + 0) / 1e6).alias("v")


def _kinds() -> list:
    """Finite values, and the names of the others."""
    v = F.col("v")
    kind = F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf").otherwise("")
    return [F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v).alias("v"), kind.alias("kind")]


NAN_SQL = "CASE WHEN isnan(v) OR isinf(v) THEN 0 ELSE v END AS v, CASE WHEN isnan(v) THEN 'nan' WHEN v = 'inf'::DOUBLE THEN 'inf' WHEN v = '-inf'::DOUBLE THEN '-inf' ELSE '' END AS kind"
#: Arguments of the modified rotation, of many magnitudes.
ROTMG = ["(o_custkey % 7) * pow(2.0D, (o_orderkey % 9 - 4) * 10)", "(o_custkey % 5 + 1) * pow(2.0D, (o_orderkey % 5 - 2) * 20)", "floor(o_totalprice) * 1.0D", "double(o_custkey % 11)"]


def _pack(m: Matrix) -> DataFrame:
    return layout.to_packed(m, "U")


Q: dict[str, tuple[Callable[[Operands], DataFrame], str | None]] = {
    # level 1
    "l1_swap": (lambda o: _two(*l1.swap(o.p, o.q)), _long("q AS x, p AS y")),
    "l1_copy": (lambda o: l1.copy(o.p, o.q).df, _long("p AS v")),
    "l1_scal": (lambda o: l1.scal(3, o.p).df, _long("3 * p AS v")),
    "l1_rscal": (lambda o: flat(l1.rscal(2, o.zp).df), _long("2 * pr AS re, 2 * pi AS im")),
    "l1_axpy": (lambda o: l1.axpy(2, o.p, o.q).df, _long("q + 2 * p AS v")),
    "l1_axpby": (lambda o: l1.axpby(2, o.p, -3, o.q).df, _long("2 * p - 3 * q AS v")),
    "l1_axpy_complex": (lambda o: flat(l1.axpy(2 - 1j, o.zp, o.zq).df), _long("qr + 2 * pr + pi AS re, qi + 2 * pi - pr AS im")),
    "l1_saxpy": (lambda o: l1.axpy(2, o.long("o_custkey % 1000", "s"), o.long("o_custkey % 7", "s")).df, L1("SELECT o_orderkey AS i, (2 * (o_custkey % 1000) + o_custkey % 7)::FLOAT AS v FROM orders")),
    "l1_dot": (lambda o: l1.dot(o.p, o.q), L1("SELECT sum(p * q) AS value FROM o")),
    "l1_dotu": (lambda o: l1.dotu(o.zp, o.zq).select("value.re", "value.im"), L1("SELECT sum(pr * qr - pi * qi) AS re, sum(pr * qi + pi * qr) AS im FROM o")),
    "l1_dotc": (lambda o: l1.dotc(o.zp, o.zq).select("value.re", "value.im"), L1("SELECT sum(pr * qr + pi * qi) AS re, sum(pr * qi - pi * qr) AS im FROM o")),
    "l1_dsdot": (lambda o: l1.dsdot(o.long("o_custkey % 1000", "s"), o.long("o_custkey % 7", "s")), L1("SELECT sum((o_custkey % 1000) * (o_custkey % 7))::DOUBLE AS value FROM orders")),
    "l1_sdsdot": (lambda o: l1.sdsdot(0.5, o.long("o_custkey % 5", "s"), o.long("o_custkey % 3", "s")), L1("SELECT (0.5 + sum((o_custkey % 5) * (o_custkey % 3)))::FLOAT AS value FROM orders")),
    "l1_nrm2": (lambda o: l1.nrm2(o.q).select((F.floor(F.col("value") * 1000 + 0.5) / 1000).alias("value")), L1("SELECT floor(sqrt(sum(q * q)) * 1000 + 0.5) / 1000 AS value FROM o")),
    "l1_asum": (lambda o: l1.asum(o.q), L1("SELECT sum(abs(q)) AS value FROM o")),
    "l1_asum_complex": (lambda o: l1.asum(o.zq), L1("SELECT sum(abs(qr) + abs(qi)) AS value FROM o")),
    "l1_iamax": (lambda o: l1.iamax(o.q).select(F.col("idx").cast("int")), L1("SELECT (arg_min(i, {'a': -abs(q), 'i': i}) + 1)::INTEGER AS idx FROM o")),
    "l1_iamax_complex": (lambda o: l1.iamax(o.zq).select(F.col("idx").cast("int")), L1("SELECT (arg_min(i, {'a': -(abs(qr) + abs(qi)), 'i': i}) + 1)::INTEGER AS idx FROM o")),
    "l1_cabs1": (lambda o: o.zq.df.select("i", l1.cabs1(F.col("v")).alias("v")), _long("abs(qr) + abs(qi) AS v")),
    "l1_rot": (lambda o: l1.rot_paired(o.p, o.q, 2, 3), _long("2 * p + 3 * q AS x, 2 * q - 3 * p AS y")),
    "l1_rotm": (lambda o: l1.rotm_paired(o.p, o.q, [-1, 2, 3, 4, 5]), _long("2 * p + 4 * q AS x, 3 * p + 5 * q AS y")),
    "l1_rotg": (
        lambda o: _two(o.p, o.q).select("i", l1.rotg(F.col("y"), F.lit(12.0)).alias("g")).select("i", "g.r", "g.z", "g.c", "g.s"),
        L1("""SELECT i, r, CASE WHEN abs(q) > 12 THEN s WHEN q <> 0 THEN r / q ELSE 1 END AS z, c, s FROM (SELECT *, q / r AS c, 12.0 / r AS s FROM (SELECT i, q,
              CASE WHEN CASE WHEN 12 > abs(q) THEN 12 ELSE q END < 0 THEN -n ELSE n END AS r FROM (SELECT i, q, (abs(q) + 12) * sqrt((q / (abs(q) + 12)) * (q / (abs(q) + 12)) + (12.0 / (abs(q) + 12)) * (12.0 / (abs(q) + 12))) AS n FROM o)))"""),
    ),
    "l1_rotg_complex": (
        lambda o: o.zq.df.select("i", l1.rotg_complex(F.col("v"), F.struct(F.lit(3.0).alias("re"), F.lit(-4.0).alias("im"))).alias("g")).select("i", "g.c", "g.a.re", "g.a.im"),
        L1("""SELECT i, size / norm AS c, CASE WHEN size = 0 THEN 3.0::DOUBLE ELSE qr / size * norm - qi / size * 0.0::DOUBLE END AS re, CASE WHEN size = 0 THEN -4.0::DOUBLE ELSE qr / size * 0.0::DOUBLE + qi / size * norm END AS im
              FROM (SELECT *, scale * sqrt((size / scale) * (size / scale) + (5.0::DOUBLE / scale) * (5.0::DOUBLE / scale)) AS norm FROM (SELECT *, size + 5.0::DOUBLE AS scale FROM (SELECT i, qr, qi::DOUBLE AS qi, sqrt(qr * qr + qi::DOUBLE * qi::DOUBLE) AS size FROM o)))"""),
    ),
    "l1_rotmg": (lambda o: o.table("orders").select(F.col("o_orderkey").alias("i"), l1.rotmg_columns(*[F.expr(e) for e in ROTMG]).alias("g")).select("i", "g.*"), None),
    "l1_swap_lengths": (lambda o: l1.swap(o.order_vector("o_custkey % 10"), o.order_vector("o_custkey % 7").prefix(1000))[0].df, L1("SELECT i, CASE WHEN i < 1000 THEN y ELSE v END AS v FROM ox")),
    "l1_put_strided": (
        lambda o: layout.put_strided(o.buffer, Vector(o.x.df.where("i <> 3"), N), -3),
        L1("SELECT c_custkey AS pos, CASE WHEN c_custkey % 3 = 0 AND c_custkey < 75 THEN coalesce(x.v, 0) ELSE -c_custkey::DOUBLE END AS v FROM customer LEFT JOIN (SELECT * FROM x WHERE i <> 3) x ON c_custkey = (24 - x.i) * 3"),
    ),
    # level 2
    "l2_gemv": (lambda o: l2.gemv("N", 2, o.a, o.x, 3, o.y).dense().df, _mv("SELECT * FROM a")),
    "l2_gemv_t": (lambda o: l2.gemv("T", 2, o.a, o.x, 3, o.y).dense().df, _mv(T.format("a"))),
    "l2_gemv_c": (lambda o: flat(l2.gemv("C", 1, o.za, o.zx, 1, o.zy).dense().df), _zmv(ZT.format("-", "za"))),
    "l2_gemv_complex": (lambda o: flat(l2.gemv("N", 1, o.za, o.zx, 1, o.zy).dense().df), _zmv("SELECT * FROM za")),
    "l2_gemv_tall": (
        lambda o: l2.gemv("T", 1, o.tall, o.q, 0, Vector.from_values(o.spark, [0] * 3)).dense().df,
        L1("SELECT unnest([0, 1, 2])::BIGINT AS i, unnest([sum(pi * q), sum(floor(p)::BIGINT % 10 * q), sum(q)]) AS v FROM o"),
    ),
    "l2_gbmv": (lambda o: l2.gbmv("N", 2, 3, 2, o.a, o.x, 3, o.y).dense().df, _mv(BAND)),
    "l2_symv": (lambda o: l2.symv("U", 2, o.a, o.x, 3, o.y).dense().df, _mv(SYM)),
    "l2_hemv": (lambda o: flat(l2.hemv("U", 1, o.za, o.zx, 1, o.zy).dense().df), _zmv(HERM)),
    "l2_sbmv": (lambda o: l2.sbmv("U", 3, 2, o.a, o.x, 3, o.y).dense().df, _mv(f"SELECT * FROM ({SYM}) WHERE {NEAR}")),
    "l2_hbmv": (lambda o: flat(l2.hbmv("U", 3, 1, o.za, o.zx, 1, o.zy).dense().df), _zmv(f"SELECT * FROM ({HERM}) WHERE {NEAR}")),
    "l2_spmv": (lambda o: l2.spmv("U", 2, _pack(o.a), N, o.x, 3, o.y).dense().df, _mv(SYM)),
    "l2_hpmv": (lambda o: flat(l2.hpmv("U", 1, layout.to_packed(o.za, "U"), N, o.zx, 1, o.zy).dense().df), _zmv(HERM)),
    "l2_trmv": (lambda o: l2.trmv("L", "N", "N", o.a, o.x).dense().df, L1("SELECT a.i, sum(a.v * x.v) AS v FROM a JOIN x ON x.i = a.j WHERE a.i >= a.j GROUP BY a.i")),
    "l2_trmv_unit": (lambda o: l2.trmv("U", "T", "U", o.a, o.x).dense().df, L1("SELECT a.j AS i, sum(CASE WHEN a.i = a.j THEN 1 ELSE a.v END * x.v) AS v FROM a JOIN x ON x.i = a.i WHERE a.i <= a.j GROUP BY a.j")),
    "l2_tbmv": (lambda o: l2.tbmv("L", "N", "N", 3, o.a, o.x).dense().df, L1("SELECT a.i, sum(a.v * x.v) AS v FROM a JOIN x ON x.i = a.j WHERE a.i >= a.j AND a.i - a.j <= 3 GROUP BY a.i")),
    "l2_tpmv": (lambda o: l2.tpmv("U", "N", "N", _pack(o.a), o.x).dense().df, L1("SELECT a.i, sum(a.v * x.v) AS v FROM a JOIN x ON x.i = a.j WHERE a.i <= a.j GROUP BY a.i")),
    "l2_trsv": (lambda o: solve.trsv("L", "N", "N", o.t, o.x).df, None),
    "l2_trsv_t": (lambda o: solve.trsv("L", "T", "N", o.t, o.x).df, None),
    "l2_tbsv": (lambda o: solve.tbsv("L", "N", "N", 2, o.t, o.x).df, None),
    "l2_tpsv": (lambda o: solve.tpsv("L", "N", "N", layout.to_packed(o.t, "L"), o.x).df, None),
    "l2_ger": (lambda o: l2.ger(2, o.x, o.y, o.a).dense().df, L1("SELECT a.i, a.j, a.v + 2 * x.v * y.v AS v FROM a JOIN x ON x.i = a.i JOIN y ON y.i = a.j")),
    "l2_geru": (lambda o: flat(l2.ger(1, o.zx, o.zy, o.za).dense().df), L1("SELECT a.i, a.j, a.re + x.re * y.re - x.im * y.im AS re, a.im + x.re * y.im + x.im * y.re AS im FROM za a JOIN zx x ON x.i = a.i JOIN zy y ON y.i = a.j")),
    "l2_gerc": (lambda o: flat(l2.gerc(1, o.zx, o.zy, o.za).dense().df), L1("SELECT a.i, a.j, a.re + x.re * y.re + x.im * y.im AS re, a.im + x.im * y.re - x.re * y.im AS im FROM za a JOIN zx x ON x.i = a.i JOIN zy y ON y.i = a.j")),
    "l2_syr": (lambda o: _only("i <= j", l2.syr("U", 2, o.x, o.a)), L1("SELECT a.i, a.j, a.v + 2 * x.v * w.v AS v FROM a JOIN x ON x.i = a.i JOIN x w ON w.i = a.j WHERE a.i <= a.j")),
    "l2_spr": (lambda o: l2.spr("U", 2, o.x, _pack(o.a)), _packed_sql("SELECT a.i, a.j, a.v + 2 * x.v * w.v AS v FROM a JOIN x ON x.i = a.i JOIN x w ON w.i = a.j WHERE a.i <= a.j")),
    "l2_syr2": (lambda o: _only("i <= j", l2.syr2("U", 2, o.x, o.y, o.a)), L1("SELECT a.i, a.j, a.v + 2 * (x.v * y2.v + y.v * w.v) AS v FROM a JOIN x ON x.i = a.i JOIN y ON y.i = a.i JOIN x w ON w.i = a.j JOIN y y2 ON y2.i = a.j WHERE a.i <= a.j")),
    "l2_spr2": (lambda o: l2.spr2("U", 2, o.x, o.y, _pack(o.a)), _packed_sql("SELECT a.i, a.j, a.v + 2 * (x.v * y2.v + y.v * w.v) AS v FROM a JOIN x ON x.i = a.i JOIN y ON y.i = a.i JOIN x w ON w.i = a.j JOIN y y2 ON y2.i = a.j WHERE a.i <= a.j")),
    "l2_her": (lambda o: flat(_only("i <= j", l2.her("U", 2, o.zx, o.za))), L1(f"SELECT * FROM ({HER})")),
    "l2_hpr": (lambda o: flat(l2.hpr("U", 2, o.zx, layout.to_packed(o.za, "U"))), L1(f"SELECT (i + j * (j + 1) // 2)::BIGINT AS pos, re, im FROM ({HER})")),
    "l2_her2": (lambda o: flat(_only("i <= j", l2.her2("U", 1 + 2j, o.zx, o.zy, o.za))), L1(f"SELECT * FROM ({HER2})")),
    "l2_hpr2": (lambda o: flat(l2.hpr2("U", 1 + 2j, o.zx, o.zy, layout.to_packed(o.za, "U"))), L1(f"SELECT (i + j * (j + 1) // 2)::BIGINT AS pos, re, im FROM ({HER2})")),
    # single precision
    "l2_gemv_single": (lambda o: l2.gemv("N", 2, o.typed(o.a, "s"), o.typed(o.x, "s"), 3, o.typed(o.y, "s")).dense().df, f"SELECT i, v::FLOAT AS v FROM ({_mv('SELECT * FROM a')})"),
    "l2_gemv_csingle": (lambda o: flat(l2.gemv("N", 1, o.typed(o.za, "c"), o.typed(o.zx, "c"), 1, o.typed(o.zy, "c")).dense().df), f"SELECT i, re::FLOAT AS re, im::FLOAT AS im FROM ({_zmv('SELECT * FROM za')})"),
    "l3_gemm_single": (lambda o: l3.gemm(1, o.typed(o.a, "s"), o.typed(o.b, "s"), 0, o.typed(o.a, "s")).dense().df, L1(f"SELECT i, j, v::FLOAT AS v FROM ({_mm('SELECT * FROM a', 'SELECT * FROM b')})")),
    "l3_gemm_csingle": (lambda o: flat(l3.gemm(1, o.typed(o.za, "c"), o.typed(o.zb, "c"), 0, o.typed(o.za, "c")).dense().df), L1(f"SELECT i, j, re::FLOAT AS re, im::FLOAT AS im FROM ({_zmm('SELECT * FROM za', 'SELECT * FROM zb')})")),
    # buffers: increments, leading dimensions, row order, bands
    "l1_copy_strided": (lambda o: layout.strided(o.table("orders").select((F.col("o_orderkey") * 3).alias("pos"), (F.col("o_custkey") * 1.0).alias("v")), LONG, -3).df, L1(f"SELECT {LONG - 1} - o_orderkey AS i, o_custkey::DOUBLE AS v FROM orders")),
    "l2_gemv_row_order": (lambda o: l2.gemv("N", 2, layout.from_flat(layout.to_flat(o.a, 30, "row"), N, N, 30, "row"), o.x, 3, o.y).dense().df, _mv("SELECT * FROM a")),
    "l2_gemv_leading": (lambda o: l2.gemv("T", 2, layout.from_flat(layout.to_flat(o.a, 28), N, N, 28), o.x, 3, o.y).dense().df, _mv(T.format("a"))),
    "l2_gbmv_buffer": (lambda o: l2.gbmv("N", 2, 3, 2, layout.from_band(layout.to_band(o.a, 2, 3, 8), N, N, 2, 3, 8), o.x, 3, o.y).dense().df, _mv(BAND)),
    "l2_sbmv_buffer": (lambda o: l2.sbmv("U", 3, 2, layout.from_triangle_band(layout.to_band(o.a, 0, 3, 5), N, 3, "U", 5), o.x, 3, o.y).dense().df, _mv(f"SELECT * FROM ({SYM}) WHERE {NEAR}")),
    "l2_tpmv_row_order": (lambda o: l2.trmv("U", "N", "N", layout.from_packed(layout.to_packed(o.a, "U", "row"), N, "U", layout="row"), o.x).dense().df, L1("SELECT a.i, sum(a.v * x.v) AS v FROM a JOIN x ON x.i = a.j WHERE a.i <= a.j GROUP BY a.i")),
    "l2_put_flat": (lambda o: layout.put_flat(o.buffer, Matrix(o.a.df.where("i <> j"), N, N), 28), _put("c_custkey % 28 < 25 AND c_custkey // 28 < 25", "c_custkey % 28", "c_custkey // 28", "i <> j")),
    "l2_put_triangle": (lambda o: layout.put_flat(o.buffer, o.a, 28, "row", "L"), _put("c_custkey // 28 < 25 AND c_custkey % 28 <= c_custkey // 28", "c_custkey // 28", "c_custkey % 28", "i >= j")),
    "l2_put_packed": (lambda o: layout.put_packed(o.buffer, o.a, "U"), _put("c_custkey < 325", "p.i", "p.j", "i <= j", "LEFT JOIN (SELECT i, j, i + j * (j + 1) // 2 AS at FROM g WHERE i <= j) p ON p.at = c_custkey")),
    "l2_put_band": (lambda o: layout.put_band(o.buffer, o.a, 2, 3, 8), _put("c_custkey % 8 <= 5 AND c_custkey // 8 < 25 AND c_custkey % 8 + c_custkey // 8 - 3 BETWEEN 0 AND 24", "c_custkey % 8 + c_custkey // 8 - 3", "c_custkey // 8", "true")),
    "l2_gbmv_row_order": (
        lambda o: flat(l2.gbmv("C", 2, 3, 1, layout.from_band(layout.to_band(o.za, 2, 3, 8, "row"), N, N, 2, 3, 8, "z", "row"), o.zx, 1, o.zy).dense().df),
        _zmv(ZT.format("-", "(SELECT * FROM za WHERE i - j <= 2 AND j - i <= 3)")),
    ),
    # long bands over orders: products by halo exchange, a solve by chunks and interfaces, multiplied back
    "l2_gbmv_long": (lambda o: l2.gbmv("N", 2, 3, 2, o.band(2, 3), o.order_vector("o_custkey % 10"), 3, o.order_vector("o_custkey % 7"), plan="halo").df, _band_sql("2 * sum(m.v * x.v) + 3 * any_value(y.y)", "m.d BETWEEN -2 AND 3", "m.i", "m.j")),
    "l2_gbmv_long_t": (lambda o: l2.gbmv("T", 2, 3, 2, o.band(2, 3), o.order_vector("o_custkey % 10"), 3, o.order_vector("o_custkey % 7"), plan="halo").df, _band_sql("2 * sum(m.v * x.v) + 3 * any_value(y.y)", "m.d BETWEEN -2 AND 3", "m.j", "m.i")),
    "l2_sbmv_long": (lambda o: l2.sbmv("U", 3, 1, o.band(0, 3), o.order_vector("o_custkey % 10"), 0, o.order_vector("o_custkey % 7"), plan="halo").df, _band_sql("sum(m.v * x.v)", "m.d BETWEEN 0 AND 3", "m.i", "m.j", both=True)),
    "l2_tbmv_long": (lambda o: l2.tbmv("L", "N", "U", 3, o.band(3, 0), o.order_vector("o_custkey % 10"), plan="halo").df, _band_sql("coalesce(sum(m.v * x.v), 0) + any_value(y.v)", "m.d BETWEEN -3 AND -1", "m.i", "m.j", outer=True)),
    "l2_tbsv_long": (
        lambda o: l2.tbmv("L", "N", "N", K, o.band(K, 0, 40.0), solve.tbsv("L", "N", "N", K, o.band(K, 0, 40.0), o.order_vector("o_custkey % 10")), plan="halo").df.select("i", _six()),
        L1("SELECT i, v FROM ox"),
    ),
    # level 3
    "l3_gemm": (lambda o: l3.gemm(2, o.a, o.b, 3, o.a).dense().df, L1(f"SELECT p.i, p.j, 2 * p.v + 3 * a.v AS v FROM ({_mm('SELECT * FROM a', 'SELECT * FROM b')}) p JOIN a USING (i, j)")),
    "l3_gemm_nt": (lambda o: l3.gemm(1, o.a, o.b, 0, o.a, "N", "T").dense().df, L1(_mm("SELECT * FROM a", T.format("b")))),
    "l3_gemm_tn": (lambda o: l3.gemm(1, o.a, o.b, 0, o.a, "T", "N").dense().df, L1(_mm(T.format("a"), "SELECT * FROM b"))),
    "l3_gemm_tt": (lambda o: l3.gemm(1, o.a, o.b, 0, o.a, "T", "T").dense().df, L1(_mm(T.format("a"), T.format("b")))),
    "l3_gemm_complex": (lambda o: flat(l3.gemm(1, o.za, o.zb, 0, o.za, "N", "C").dense().df), L1(_zmm("SELECT * FROM za", ZT.format("-", "zb")))),
    "l3_gemm_block": (lambda o: l3.gemm(1, o.a, o.b, 0, o.a, plan="block").dense().df, L1(_mm("SELECT * FROM a", "SELECT * FROM b"))),
    "l3_gemm_nan": (lambda o: l3.gemm(1, o.nan, o.b, 0, o.b, plan="block").df.select("i", "j", *_kinds()), L1(f"SELECT i, j, {NAN_SQL} FROM ({_mm('SELECT * FROM na', 'SELECT * FROM bc')})")),
    "l3_gemm_nan_join": (lambda o: l3.gemm(1, o.nan, o.b, 0, o.b, plan="join").df.select("i", "j", *_kinds()), L1(f"SELECT i, j, {NAN_SQL} FROM ({_mm('SELECT * FROM na', 'SELECT * FROM bc')})")),
    "l3_gemm_512": (lambda o: l3.gemm(2, o.wa, o.wb, 3, o.wa, plan="block").df, L1(f"SELECT i, j, sum(v) AS v FROM (SELECT i, j, 2 * v AS v FROM ({_mm('SELECT * FROM wa', 'SELECT * FROM wb')}) UNION ALL SELECT i, j, 3 * v FROM wa) GROUP BY i, j")),
    "l3_gemm_chain": (lambda o: l3.gemm(1, l3.gemm(1, Blocks.of(o.wa), Blocks.of(o.wb), 0, Blocks.of(o.wa)), Blocks.of(o.wa), 1, Blocks.of(o.wb), "N", "T").matrix().df,
                      L1(f"SELECT i, j, sum(v) AS v FROM (SELECT * FROM ({_mm(_mm('SELECT * FROM wa', 'SELECT * FROM wb'), T.format('wa'))}) UNION ALL SELECT i, j, v FROM wb) GROUP BY i, j")),
    "l3_syrk_tiles": (lambda o: l3.syrk("U", "T", 1, Blocks.of(o.wa), 2, Blocks.of(o.wb)).matrix().df.where("i <= j"), L1(f"SELECT i, j, sum(v) AS v FROM (SELECT * FROM ({_mm(T.format('wa'), 'SELECT * FROM wa')}) UNION ALL SELECT i, j, 2 * v FROM wb) WHERE i <= j GROUP BY i, j")),
    "l3_syr2k_tiles": (lambda o: l3.syr2k("L", "N", 1, Blocks.of(o.wa), Blocks.of(o.wb), 0, Blocks.of(o.wb)).matrix().df.where("i >= j"), L1(f"SELECT i, j, sum(v) AS v FROM (SELECT * FROM ({_mm('SELECT * FROM wa', T.format('wb'))}) UNION ALL SELECT * FROM ({_mm('SELECT * FROM wb', T.format('wa'))})) WHERE i >= j GROUP BY i, j")),
    "l3_symm_tiles": (lambda o: l3.symm("R", "U", 1, Blocks.of(o.wa), Blocks.of(o.wb), 0, Blocks.of(o.wb)).matrix().df, L1(_mm("SELECT * FROM wb", "SELECT i, j, v FROM wa WHERE i <= j UNION ALL SELECT j, i, v FROM wa WHERE i < j"))),
    "l3_trmm_tiles": (lambda o: l3.trmm("L", "L", "N", "U", 2, Blocks.of(o.wa), Blocks.of(o.wb)).matrix().df, L1(f"SELECT i, j, 2 * v AS v FROM ({_mm('SELECT i, j, v FROM wa WHERE i > j UNION ALL SELECT range, range, 1.0::DOUBLE FROM range(512)', 'SELECT * FROM wb')})")),
    "l3_hemm_tiles": (lambda o: flat(l3.hemm("L", "U", 1, Blocks.of(o.za), Blocks.of(o.zb), 0, Blocks.of(o.zb)).dense().df), L1(_zmm(HERM, "SELECT * FROM zb"))),
    "l3_symm": (lambda o: l3.symm("L", "U", 1, o.a, o.b, 0, o.b).dense().df, L1(_mm(SYM, "SELECT * FROM b"))),
    "l3_symm_right": (lambda o: l3.symm("R", "U", 1, o.a, o.b, 0, o.b).dense().df, L1(_mm("SELECT * FROM b", SYM))),
    "l3_hemm": (lambda o: flat(l3.hemm("L", "U", 1, o.za, o.zb, 0, o.zb).dense().df), L1(_zmm(HERM, "SELECT * FROM zb"))),
    "l3_syrk": (lambda o: l3.tall_gram(o.table("lineitem"), o.features), None),
    "l3_syrk_general": (lambda o: _only("i <= j", l3.syrk("U", "N", 1, o.a, 0, o.a)), L1(_mm("SELECT * FROM a", T.format("a"), "l.i <= q.j"))),
    "l3_herk": (lambda o: flat(_only("i <= j", l3.herk("U", "N", 1, o.za, 0, o.za))), L1(f"SELECT * FROM ({_zmm('SELECT * FROM za', ZT.format('-', 'za'))}) WHERE i <= j")),
    "l3_syr2k": (lambda o: _only("i <= j", l3.syr2k("U", "N", 1, o.a, o.b, 0, o.a)), L1(f"SELECT p.i, p.j, p.v + s.v AS v FROM ({_mm('SELECT * FROM a', T.format('b'))}) p JOIN ({_mm('SELECT * FROM b', T.format('a'))}) s USING (i, j) WHERE i <= j")),
    "l3_her2k": (lambda o: flat(_only("i <= j", l3.her2k("U", "N", 1 + 0j, o.za, o.zb, 0, o.za))), L1(f"SELECT p.i, p.j, p.re + s.re AS re, CASE WHEN i = j THEN 0 ELSE p.im + s.im END AS im FROM ({_zmm('SELECT * FROM za', ZT.format('-', 'zb'))}) p JOIN ({_zmm('SELECT * FROM zb', ZT.format('-', 'za'))}) s USING (i, j) WHERE i <= j")),
    "l3_trmm": (lambda o: l3.trmm("L", "L", "N", "N", 2, o.a, o.b).dense().df, L1(f"SELECT i, j, 2 * v AS v FROM ({_mm('SELECT * FROM a WHERE i >= j', 'SELECT * FROM b')})")),
    "l3_trsm": (lambda o: solve.trsm("L", "L", "N", "N", 2, o.t, o.b).df, None),
    "l3_trsm_right": (lambda o: solve.trsm("R", "L", "T", "N", 1, o.t, o.b.op("T")).df, None),
    # pivots 4: quotients are not exact, so results are rounded; 300 rows go by halves in tiles
    "l2_trsv_whole": (lambda o: solve.trsv("L", "N", "N", o.whole_t(), o.x).df.select("i", _six()), None),
    "l2_trsv_t_whole": (lambda o: solve.trsv("L", "T", "N", o.whole_t(), o.x).df.select("i", _six()), None),
    "l2_tbsv_whole": (lambda o: solve.tbsv("L", "N", "N", 2, o.whole_t(), o.x).df.select("i", _six()), None),
    "l2_tpsv_whole": (lambda o: solve.tpsv("L", "N", "N", layout.to_packed(o.whole_t(), "L"), o.x).df.select("i", _six()), None),
    "l3_trsm_whole": (lambda o: solve.trsm("L", "L", "N", "N", 2, o.whole_t(), o.b).df.select("i", "j", _six()), None),
    "l3_trsm_right_whole": (lambda o: solve.trsm("R", "L", "T", "N", 1, o.whole_t(), o.b.op("T")).df.select("i", "j", _six()), None),
    "l2_trsv_blocks": (lambda o: solve.trsv("L", "N", "N", o.whole_t(LARGE), o.large_x).dense().df.select("i", _six()), None),
    # typed functions and table functions
    "api_matrix_multiply": (lambda o: api.matrix_multiply(api.matrix(layout.to_flat(o.a, 30), N, N, 30).check(), o.b.adjoint(), o.a, 2, 3).dense().df, L1(f"SELECT p.i, p.j, 2 * p.v + 3 * a.v AS v FROM ({_mm('SELECT * FROM a', T.format('b'))}) p JOIN a USING (i, j)")),
    "api_combine_vectors": (lambda o: api.combine_vectors(o.p, o.q, 2, 3).df, _long("2 * p + 3 * q AS v")),
    "api_dot_product": (lambda o: api.dot_product(o.p, o.q), L1("SELECT sum(p * q) AS value FROM o")),
    "api_swap_vectors": (lambda o: _two(*api.swap_vectors(o.p, o.q)), _long("q AS x, p AS y")),
    "api_copy_vector": (lambda o: api.copy_vector(o.p, o.q).df, _long("p AS v")),
    "api_scale_vector": (lambda o: api.scale_vector(o.p, 3).df, _long("3 * p AS v")),
    "api_scale_vector_into": (lambda o: flat(api.scale_vector_into(o.zp, o.zq, 2 - 1j).df), _long("2 * pr + pi AS re, 2 * pi - pr AS im")),
    "api_add_scaled_vector": (lambda o: api.add_scaled_vector(o.p, o.q, 2).df, _long("q + 2 * p AS v")),
    "api_add_scaled_vector_into": (lambda o: api.add_scaled_vector_into(o.p, o.q, o.p, -3).df, _long("q - 3 * p AS v")),
    "api_combine_vectors_into": (lambda o: flat(api.combine_vectors_into(o.zp, o.zq, o.zp, 2, 3).df), _long("2 * pr + 3 * qr AS re, 2 * pi + 3 * qi AS im")),
    "api_conjugated_dot_product": (lambda o: api.conjugated_dot_product(o.zp, o.zq).select("value.re", "value.im"), L1("SELECT sum(pr * qr + pi * qi) AS re, sum(pr * qi - pi * qr) AS im FROM o")),
    "api_euclidean_norm": (lambda o: api.euclidean_norm(o.q).select((F.floor(F.col("value") * 1000 + 0.5) / 1000).alias("value")), L1("SELECT floor(sqrt(sum(q * q)) * 1000 + 0.5) / 1000 AS value FROM o")),
    "api_const_vector": (lambda o: api.const_vector(o.table("orders").select((F.col("o_orderkey") * 2).alias("pos"), (F.col("o_custkey") * 1.0).alias("v")), LONG, 2).check().df, L1("SELECT o_orderkey AS i, o_custkey::DOUBLE AS v FROM orders")),
    "api_matrix_vector_multiply": (lambda o: api.matrix_vector_multiply(api.const_matrix(layout.to_flat(o.a, 27, "row"), N, N, 27, "row").transposed(), o.x, o.y, 2, 3).dense().df, _mv(T.format("a"))),
    "api_matrix_vector_multiply_adjoint": (lambda o: flat(api.matrix_vector_multiply_with_workspace(api.matrix(layout.to_flat(o.za, 26, "row"), N, N, 26, "row", "z").adjoint(), o.zx, o.zy, None, 1, 1).dense().df), _zmv(ZT.format("-", "za"))),
    "api_matrix_multiply_adjoint": (lambda o: flat(api.matrix_multiply_with_workspace(o.za.adjoint(), api.matrix(layout.to_flat(o.zb, 31, "row"), N, N, 31, "row", "z").transposed(), o.za).dense().df), L1(_zmm(ZT.format("-", "za"), ZT.format("", "zb")))),
    "l2_hemv_row_order": (lambda o: flat(l2.hemv("U", 1, layout.from_flat(layout.to_flat(o.za, 29, "row"), N, N, 29, "row", "z"), o.zx, 1, o.zy).dense().df), _zmv(HERM)),
    "l2_tbmv_row_order": (lambda o: l2.tbmv("U", "T", "N", 3, layout.from_triangle_band(layout.to_band(o.a, 0, 3, 6, "row"), N, 3, "U", 6, layout="row"), o.x).dense().df, L1(f"SELECT r.i, coalesce(sum(m.v * x.v), 0) AS v FROM r LEFT JOIN (SELECT * FROM a WHERE i <= j AND {NEAR}) m ON m.j = r.i LEFT JOIN x ON x.i = m.i GROUP BY r.i")),
    "sql_dot": (lambda o: _called(o, "dot", "value", x=o.p, y=o.q), L1("SELECT sum(p * q) AS value FROM o")),
    "sql_asum": (lambda o: _called(o, "asum", "value", x=o.q), L1("SELECT sum(abs(q)) AS value FROM o")),
    "sql_nrm2": (lambda o: _called(o, "nrm2", "floor(value * 1000 + 0.5) / 1000 AS value", x=o.q), L1("SELECT floor(sqrt(sum(q * q)) * 1000 + 0.5) / 1000 AS value FROM o")),
    "sql_axpy": (lambda o: _called(o, "axpy", "i, v", "2", x=o.p, y=o.q), _long("q + 2 * p AS v")),
    "sql_gemv": (lambda o: _called(o, "gemv", "i, v", "2, 3", a=o.a, x=o.x, y=o.y), _mv("SELECT * FROM a")),
    "sql_gemm": (lambda o: _called(o, "gemm", "i, j, v", "2, 3", a=o.wa, b=o.wb, c=o.wa), L1(f"SELECT i, j, sum(v) AS v FROM (SELECT i, j, 2 * v AS v FROM ({_mm('SELECT * FROM wa', 'SELECT * FROM wb')}) UNION ALL SELECT i, j, 3 * v FROM wa) GROUP BY i, j")),
    "l3_array_gram": (lambda o: l3.array_gram(o.table("embeddings"), "embedding", 64).select("i", "j", ((F.floor(F.col("v") * 1000 + 0.5) + 0) / 1000).alias("v")), None),
}

#: Full rows of the triangle, zeros spelled out, and right sides as (i, c, v).
_T = "SELECT g.i, g.j, coalesce(t.v, 0) AS v FROM g LEFT JOIN t USING (i, j)"
_FLIP = "SELECT 24 - g.j AS i, 24 - g.i AS j, coalesce(t.v, 0) AS v FROM g LEFT JOIN t USING (i, j)"
_X = "SELECT i, 0::BIGINT AS c, v FROM x"
_LAST = "SELECT k, c, xs FROM s WHERE k = 25"
_VECTOR = f" SELECT unnest(range(25))::BIGINT AS i, unnest(xs) AS v FROM ({_LAST})"
_MATRIX = f" SELECT {{}} FROM (SELECT unnest(range(25))::BIGINT AS r, c, unnest(xs) AS v FROM ({_LAST}))"
_BANDED = f"SELECT i, j, CASE WHEN i - j <= 2 THEN v ELSE 0 END AS v FROM ({_T})"

_WT = _T.replace("t USING", "wt t USING")


def _rounded(select: str, keys: str = "i") -> str:
    return f" SELECT {keys}, (floor(v * 1e6::DOUBLE + 0.5) + 0) / 1e6::DOUBLE AS v FROM ({select})"


_OUT = "({0} <> 0 AND NOT (abs({0}) > 1 / 16777216.0::DOUBLE AND abs({0}) < 16777216.0::DOUBLE))"
_O1, _O2 = _OUT.format("d1"), _OUT.format("d2")
_STEP = lambda v: f"CASE WHEN abs({v}) <= 1 / 16777216.0::DOUBLE THEN 1 ELSE -1 END"
#: One rescaling a round, of d1 while it is out of range, then of d2.
ROTMG_SQL = f"""
WITH RECURSIVE z AS (SELECT o_orderkey AS i, (o_custkey % 7) * pow(2.0::DOUBLE, (o_orderkey % 9 - 4) * 10) AS d1, (o_custkey % 5 + 1) * pow(2.0::DOUBLE, (o_orderkey % 5 - 2) * 20) AS d2,
  floor(o_totalprice)::DOUBLE AS x1, (o_custkey % 11)::DOUBLE AS y1 FROM orders),
p AS (SELECT *, d1 * x1 * x1 AS q1, d2 * y1 * y1 AS q2, d1 * x1 AS p1, d2 * y1 AS p2 FROM z),
a AS (SELECT *, CASE WHEN abs(q1) > abs(q2) THEN -y1 / x1 END AS a21, CASE WHEN abs(q1) > abs(q2) THEN p2 / p1 END AS a12, CASE WHEN abs(q1) <= abs(q2) AND p2 <> 0 THEN p1 / p2 END AS a11, CASE WHEN abs(q1) <= abs(q2) AND p2 <> 0 THEN x1 / y1 END AS a22 FROM p),
s(i, kind, d1, d2, x1, h11, h21, h12, h22, n) AS (
  SELECT i, CASE WHEN p2 = 0 THEN -2.0::DOUBLE WHEN abs(q1) > abs(q2) THEN 0.0 ELSE 1.0 END, CASE WHEN p2 = 0 THEN d1 WHEN abs(q1) > abs(q2) THEN d1 / (1 - a12 * a21) ELSE d2 / (1 + a11 * a22) END,
    CASE WHEN p2 = 0 THEN d2 WHEN abs(q1) > abs(q2) THEN d2 / (1 - a12 * a21) ELSE d1 / (1 + a11 * a22) END, CASE WHEN p2 = 0 THEN x1 WHEN abs(q1) > abs(q2) THEN x1 * (1 - a12 * a21) ELSE y1 * (1 + a11 * a22) END,
    coalesce(a11, 0), coalesce(a21, 0), coalesce(a12, 0), coalesce(a22, 0), 0 FROM a
  UNION ALL
  SELECT i, -1.0, CASE WHEN {_O1} THEN d1 * pow(16777216.0::DOUBLE, {_STEP('d1')}) ELSE d1 END, CASE WHEN {_O1} THEN d2 ELSE d2 * pow(16777216.0::DOUBLE, {_STEP('d2')}) END, CASE WHEN {_O1} THEN x1 * pow(4096.0::DOUBLE, -({_STEP('d1')})) ELSE x1 END,
    CASE WHEN kind = 0 THEN 1 ELSE h11 END * CASE WHEN {_O1} THEN pow(4096.0::DOUBLE, -({_STEP('d1')})) ELSE 1 END, CASE WHEN kind = 1 THEN -1 ELSE h21 END * CASE WHEN {_O1} THEN 1 ELSE pow(4096.0::DOUBLE, -({_STEP('d2')})) END,
    CASE WHEN kind = 1 THEN 1 ELSE h12 END * CASE WHEN {_O1} THEN pow(4096.0::DOUBLE, -({_STEP('d1')})) ELSE 1 END, CASE WHEN kind = 0 THEN 1 ELSE h22 END * CASE WHEN {_O1} THEN 1 ELSE pow(4096.0::DOUBLE, -({_STEP('d2')})) END, n + 1
  FROM s WHERE kind <> -2 AND ({_O1} OR {_O2}))
SELECT i, d1, d2, x1, kind AS flag, CASE WHEN kind IN (-1, 1) THEN h11 END AS h11, CASE WHEN kind IN (-1, 0) THEN h21 END AS h21, CASE WHEN kind IN (-1, 0) THEN h12 END AS h12, CASE WHEN kind IN (-1, 1) THEN h22 END AS h22
FROM s WHERE kind = -2 OR NOT ({_O1} OR {_O2})
"""

SOLVES = {
    "l2_trsv": _solve(_T, _X) + _VECTOR,
    "l2_trsv_t": _solve(_FLIP, "SELECT 24 - i AS i, 0::BIGINT AS c, v FROM x") + f" SELECT (24 - unnest(range(25)))::BIGINT AS i, unnest(xs) AS v FROM ({_LAST})",
    "l2_tbsv": _solve(_BANDED, _X) + _VECTOR,
    "l2_tpsv": _solve(_T, _X) + _VECTOR,
    "l3_trsm": _solve(_T, "SELECT i, j AS c, 2 * v AS v FROM b") + _MATRIX.format("r AS i, c AS j, v"),
    "l3_trsm_right": _solve(_T, "SELECT i, j AS c, v FROM b") + _MATRIX.format("c AS i, r AS j, v"),
    "l2_trsv_whole": _solve(_WT, _X) + _rounded(_VECTOR),
    "l2_trsv_t_whole": _solve(_FLIP.replace("t USING", "wt t USING"), "SELECT 24 - i AS i, 0::BIGINT AS c, v FROM x") + _rounded(f" SELECT (24 - unnest(range(25)))::BIGINT AS i, unnest(xs) AS v FROM ({_LAST})"),
    "l2_tbsv_whole": _solve(_BANDED.replace("t USING", "wt t USING"), _X) + _rounded(_VECTOR),
    "l2_tpsv_whole": _solve(_WT, _X) + _rounded(_VECTOR),
    "l3_trsm_whole": _solve(_WT, "SELECT i, j AS c, 2 * v AS v FROM b") + _rounded(_MATRIX.format("r AS i, c AS j, v"), "i, j"),
    "l3_trsm_right_whole": _solve(_WT, "SELECT i, j AS c, v FROM b") + _rounded(_MATRIX.format("c AS i, r AS j, v"), "i, j"),
    "l2_trsv_blocks": _solve("SELECT i, j, coalesce(v, 0) AS v FROM (SELECT s.range AS i, t.range AS j FROM range(300) s, range(300) t) LEFT JOIN lt USING (i, j)",
        "SELECT range AS i, 0::BIGINT AS c, coalesce(n, 0)::DOUBLE AS v FROM range(300) LEFT JOIN (SELECT c_custkey % 300 AS k, count(*) AS n FROM customer GROUP BY 1) ON k = range",
        """lt AS (SELECT i, j, CASE WHEN i = j THEN 4.0::DOUBLE ELSE v % 3 / 64 END AS v FROM (SELECT range AS i, range AS j, 0.0::DOUBLE AS v FROM range(300)
           UNION ALL SELECT c_custkey % 300, (c_custkey // 300 * 53 + c_custkey % 300 * 7) % 300, count(*)::DOUBLE FROM customer WHERE c_custkey % 300 > (c_custkey // 300 * 53 + c_custkey % 300 * 7) % 300 GROUP BY 1, 2)),""")
        + _rounded(" SELECT unnest(range(300))::BIGINT AS i, unnest(xs) AS v FROM (SELECT xs FROM s WHERE k = 300)"),
    "l1_rotmg": ROTMG_SQL,
    "l3_syrk": """WITH f AS (SELECT [l_quantity, round(l_discount * 100), round(l_tax * 100), 1.0::DOUBLE] AS w FROM lineitem),
p AS (SELECT s.range::BIGINT AS i, t.range::BIGINT AS j FROM range(4) s, range(4) t WHERE s.range <= t.range)
SELECT i, j, sum(w[i + 1] * w[j + 1]) AS v FROM f, p GROUP BY i, j""",
    "l3_array_gram": """WITH p AS (SELECT s.range::BIGINT AS i, t.range::BIGINT AS j FROM range(64) s, range(64) t WHERE s.range <= t.range)
SELECT i, j, (floor(sum(embedding[i + 1]::DOUBLE * embedding[j + 1]::DOUBLE) * 1000 + 0.5) + 0) / 1000 AS v FROM embeddings, p GROUP BY i, j""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, run=run: run(Operands(spark, sf_dir))) for name, (run, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in Q.items() if sql} | SOLVES
