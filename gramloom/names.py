"""Classic routine names as thin lookups: ``lookup("dgemm_")``, ``lookup("cblas_dgemm")``.

Names follow from families and type letters by rule.  Increments, leading
dimensions and layouts belong to buffers, so they are arguments of
``sources.layout`` and not of the operators; output arguments are return values.
"""

from __future__ import annotations

from collections.abc import Callable

from .arguments import check
from .operators import level1, level2, level3, solve
from .types import IllegalArgument

#: Families and the type letters each exists for.
FAMILIES: dict[str, str] = {
    "swap": "s d c z", "copy": "s d c z", "axpy": "s d c z", "axpby": "s d c z", "scal": "s d c z cs zd", "dot": "s d", "dotu": "c z", "dotc": "c z",
    "nrm2": "s d sc dz", "asum": "s d sc dz", "amax": "is id ic iz", "rotg": "s d c z", "rot": "s d cs zd", "rotm": "s d", "rotmg": "s d", "cabs1": "s d",
    "gemv": "s d c z", "gbmv": "s d c z", "symv": "s d", "sbmv": "s d", "spmv": "s d", "hemv": "c z", "hbmv": "c z", "hpmv": "c z",
    "trmv": "s d c z", "tbmv": "s d c z", "tpmv": "s d c z", "trsv": "s d c z", "tbsv": "s d c z", "tpsv": "s d c z",
    "ger": "s d", "geru": "c z", "gerc": "c z", "syr": "s d", "spr": "s d", "syr2": "s d", "spr2": "s d", "her": "c z", "hpr": "c z", "her2": "c z", "hpr2": "c z",
    "gemm": "s d c z", "symm": "s d c z", "hemm": "c z", "syrk": "s d c z", "herk": "c z", "syr2k": "s d c z", "her2k": "c z", "trmm": "s d c z", "trsm": "s d c z",
}
_ELSEWHERE = {"amax": level1.iamax, "geru": level2.ger}


def _routine(family: str) -> Callable:
    return _ELSEWHERE.get(family) or next(getattr(m, family) for m in (level1, level2, level3, solve) if hasattr(m, family))


def same_letter(a: str, b: str) -> bool:
    """Case-insensitive comparison of flag characters."""
    return a[:1].upper() == b[:1].upper()


def checked(name: str, **given) -> None:
    """Raise ``IllegalArgument``, with its number, for the first illegal argument of a routine by name."""
    family = name.removeprefix("cblas_").rstrip("_")
    check(next(f for f in sorted(FAMILIES, key=len, reverse=True) if family.endswith(f)), **given)


def report(routine: str, info: int) -> None:
    """Raise for an illegal argument, numbered from 1."""
    raise IllegalArgument(routine, info)


def release(*frames) -> None:
    """Drop cached operands; there are no helper threads to stop."""
    for f in frames:
        f.unpersist()


def _table() -> dict[str, tuple[Callable, str]]:
    found: dict[str, tuple[Callable, str]] = {"dsdot_": (level1.dsdot, "s"), "sdsdot_": (level1.sdsdot, "s"), "cblas_dsdot": (level1.dsdot, "s"), "cblas_sdsdot": (level1.sdsdot, "s")}
    for family, kinds in FAMILIES.items():
        for kind in kinds.split():
            dtype = {"cs": "c", "zd": "z", "sc": "c", "dz": "z"}.get(kind, kind[-1])
            if family == "cabs1":
                dtype = {"s": "c", "d": "z"}[dtype]
            found[f"{kind}{family}_"] = (_routine(family), dtype)
            if family in ("dotu", "dotc"):
                found[f"{kind}{family}_sub_"] = found[f"cblas_{kind}{family}_sub"] = (_routine(family), dtype)
            elif family != "cabs1":
                found[f"cblas_{kind}{family}"] = (level1.iamax_from_zero if family == "amax" else _routine(family), dtype)
    return found | {"lsame_": (same_letter, ""), "xerbla_": (report, ""), "xerbla_array_": (report, "")}


ROUTINES = _table()


def lookup(name: str) -> tuple[Callable, str]:
    """The operator and scalar type behind a routine name."""
    if name not in ROUTINES:
        raise KeyError(f"no routine {name}")
    return ROUTINES[name]
