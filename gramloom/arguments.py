"""Arguments of the classic routines by place: flags, dimensions, leading dimensions and increments.

An illegal argument is reported by its number in the routine's own list, the
first one that is wrong.
"""

from __future__ import annotations

from .types import DIAG, SIDE, TRANS, UPLO, DimensionMismatch, IllegalArgument

#: Argument lists of the routine families, in order.
LISTS: dict[str, str] = {
    "swap copy dot dotu dotc dsdot": "n x incx y incy",
    "sdsdot": "n sb x incx y incy",
    "axpy": "n alpha x incx y incy",
    "axpby": "n alpha x incx beta y incy",
    "scal": "n alpha x incx",
    "nrm2 asum amax": "n x incx",
    "rot": "n x incx y incy c s",
    "rotm": "n x incx y incy param",
    "rotg": "a b c s",
    "rotmg": "d1 d2 x1 y1 param",
    "cabs1": "z",
    "gemv": "trans m n alpha a lda x incx beta y incy",
    "gbmv": "trans m n kl ku alpha a lda x incx beta y incy",
    "symv hemv": "uplo n alpha a lda x incx beta y incy",
    "sbmv hbmv": "uplo n k alpha a lda x incx beta y incy",
    "spmv hpmv": "uplo n alpha ap x incx beta y incy",
    "trmv trsv": "uplo trans diag n a lda x incx",
    "tbmv tbsv": "uplo trans diag n k a lda x incx",
    "tpmv tpsv": "uplo trans diag n ap x incx",
    "ger geru gerc": "m n alpha x incx y incy a lda",
    "syr her": "uplo n alpha x incx a lda",
    "spr hpr": "uplo n alpha x incx ap",
    "syr2 her2": "uplo n alpha x incx y incy a lda",
    "spr2 hpr2": "uplo n alpha x incx y incy ap",
    "gemm": "transa transb m n k alpha a lda b ldb beta c ldc",
    "symm hemm": "side uplo m n alpha a lda b ldb beta c ldc",
    "syrk herk": "uplo trans n k alpha a lda beta c ldc",
    "syr2k her2k": "uplo trans n k alpha a lda b ldb beta c ldc",
    "trmm trsm": "side uplo trans diag m n alpha a lda b ldb",
}
#: Vector routines take any n and increment: nothing below is illegal for them.
_ANY = set("swap copy dot dotu dotc dsdot sdsdot axpy axpby scal nrm2 asum amax rot rotm".split())
PLACES = {family: names.split() for families, names in LISTS.items() for family in families.split()}
_FLAGS = {"trans": TRANS, "transa": TRANS, "transb": TRANS, "uplo": UPLO, "diag": DIAG, "side": SIDE}


def place(routine: str, name: str) -> int:
    """The number of an argument, from 1."""
    return PLACES[routine].index(name) + 1


def _rows(routine: str, name: str, given: dict) -> int:
    """Least leading dimension of a buffer, from the dimensions that are given."""
    plain = lambda flag: str(given.get(flag, "N"))[:1].upper() == "N"
    m, n, k = (given.get(d, 0) for d in ("m", "n", "k"))
    if routine == "gbmv":
        return given.get("kl", 0) + given.get("ku", 0) + 1
    if routine in ("sbmv", "hbmv", "tbmv", "tbsv"):
        return k + 1
    if routine == "gemm":
        return {"lda": m if plain("transa") else k, "ldb": k if plain("transb") else n, "ldc": m}[name]
    if "side" in PLACES[routine]:
        return m if name != "lda" or str(given.get("side", "L"))[:1].upper() == "L" else n
    if routine.endswith("k"):
        return n if name == "ldc" or plain("trans") else k
    return m if "m" in PLACES[routine] else n


def check(routine: str, **given) -> None:
    """Check the arguments that are given, in the order of the routine's list."""
    if routine in _ANY:
        return
    for number, name in enumerate(PLACES[routine], 1):
        if name not in given:
            continue
        value = given[name]
        wrong = (
            str(value)[:1].upper() not in _FLAGS[name] if name in _FLAGS
            else value < 0 if name in ("m", "n", "k", "kl", "ku")
            else value < max(1, _rows(routine, name, given)) if name.startswith("ld")
            else name.startswith("inc") and value == 0
        )
        if wrong:
            raise IllegalArgument(routine, number, f"{name} = {value!r}")


def fits(routine: str, **found: tuple[int, int]) -> None:
    """Raise ``DimensionMismatch`` with the number of the first argument whose size (given, wanted) is another."""
    for name, (given, wanted) in found.items():
        if given != wanted:
            raise DimensionMismatch(f"{name} has {given}, not {wanted}", routine, place(routine, name))
