"""Table functions of SQL over views: a session's ``SELECT * FROM name(...)``.

``create`` makes one temporary function of the routine over named views, in SQL
itself, so Catalyst sees through it: ``spark.sql`` alone runs it, predicates and
columns are pruned, and nothing is registered in Python.  Vectors are views
``(i, v)``, matrices ``(i, j, v)``, both real.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from ..operators.level1 import DOWN, LARGE, SMALL, UP

_SCALES = {"large": f"sum(if(a > {LARGE!r}D, a * {DOWN!r}D * (a * {DOWN!r}D), 0D))", "mid": f"sum(if(a <= {LARGE!r}D and a >= {SMALL!r}D, a * a, 0D))", "low": f"sum(if(a < {SMALL!r}D, a * {UP!r}D * (a * {UP!r}D), 0D))"}
#: Routines: parameters, result columns, views and body.
BODIES: dict[str, tuple[str, str, tuple[str, ...], str]] = {
    "dot": ("", "value DOUBLE", ("x", "y"), "SELECT coalesce(sum(x.v * y.v), 0D) FROM {x} x JOIN {y} y ON x.i = y.i"),
    "asum": ("", "value DOUBLE", ("x",), "SELECT coalesce(sum(abs(v)), 0D) FROM {x}"),
    "nrm2": ("", "value DOUBLE", ("x",), f"""
        SELECT CASE WHEN isnan(top) OR top = double('infinity') THEN top
                    WHEN large > 0 THEN sqrt(large + mid * {DOWN!r}D * {DOWN!r}D) / {DOWN!r}D
                    ELSE sqrt(mid + low / {UP!r}D / {UP!r}D) END
        FROM (SELECT coalesce(max(a), 0D) AS top, {", ".join(f"coalesce({sql}, 0D) AS {name}" for name, sql in _SCALES.items())} FROM (SELECT abs(v) AS a FROM {{x}}))"""),
    "axpy": ("alpha DOUBLE", "i BIGINT, v DOUBLE", ("x", "y"), "SELECT coalesce(x.i, y.i), alpha * coalesce(x.v, 0D) + coalesce(y.v, 0D) FROM {x} x FULL JOIN {y} y ON x.i = y.i"),
    "gemv": ("alpha DOUBLE, beta DOUBLE", "i BIGINT, v DOUBLE", ("a", "x", "y"), """
        SELECT i, sum(v) FROM (
          SELECT a.i, alpha * a.v * x.v AS v FROM {a} a JOIN {x} x ON x.i = a.j WHERE alpha <> 0
          UNION ALL SELECT i, beta * v FROM {y} WHERE beta <> 0) GROUP BY i"""),
    "gemm": ("alpha DOUBLE, beta DOUBLE", "i BIGINT, j BIGINT, v DOUBLE", ("a", "b", "c"), """
        SELECT i, j, sum(v) FROM (
          SELECT a.i, b.j, alpha * a.v * b.v AS v FROM {a} a JOIN {b} b ON b.i = a.j WHERE alpha <> 0
          UNION ALL SELECT i, j, beta * v FROM {c} WHERE beta <> 0) GROUP BY i, j"""),
}


def create(spark: SparkSession, routine: str, name: str | None = None, **views: str) -> str:
    """Create (or replace) the table function ``name`` of a routine over views, which are given by their role; its name is returned."""
    parameters, columns, roles, body = BODIES[routine]
    if set(views) != set(roles):
        raise ValueError(f"{routine} takes the views {', '.join(roles)}")
    name = name or routine
    if not all(re.fullmatch(r"\w+", n) for n in (name, *views.values())):
        raise ValueError("names are letters, digits and underscores")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body.format(**views)}")
    return name
