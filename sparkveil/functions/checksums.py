"""Check digits as column expressions: Verhoeff by folding, Luhn by the built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dihedral(a: int, b: int) -> int:
    """Product in the dihedral group of ten elements; 5 to 9 are the reflections."""
    turn = (a + b if a < 5 else a - b) % 5
    return turn if (a < 5) == (b < 5) else 5 + turn


#: The position permutation of the Verhoeff scheme, applied once for each position to the left.
_SHUFFLE = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def _products() -> list[int]:
    return [_dihedral(a, b) for a in range(10) for b in range(10)]


def _permutations() -> list[int]:
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([_SHUFFLE[x] for x in rows[-1]])
    return [x for row in rows for x in row]


def _register(digits: Column, shift: int) -> Column:
    """Verhoeff register after all digits, the rightmost at position ``shift``."""
    d, p = F.lit(_products()), F.lit(_permutations())
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda c, i: F.get(d, c * 10 + F.get(p, ((i + shift) % 8) * 10 + digit(i))))


def _all_digits(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit("^[0-9]+$")), F.lit(False))


def verhoeff_valid(text: Column) -> Column:
    """Whether a digit string ends in its Verhoeff check digit; false for anything else."""
    return F.when(_all_digits(text), _register(text, 0) == 0).otherwise(F.lit(False))


def verhoeff_digit(payload: Column) -> Column:
    """Verhoeff check digit of a digit string, null for anything else."""
    inverse = F.lit([next(b for b in range(10) if _dihedral(a, b) == 0) for a in range(10)])
    return F.when(_all_digits(payload), F.get(inverse, _register(payload, 1)).cast("string"))


def luhn_valid(text: Column) -> Column:
    """Whether a digit string of two or more digits ends in its Luhn check digit."""
    return F.when(_all_digits(text) & (F.length(text) >= 2), F.call_function("luhn_check", text)).otherwise(F.lit(False))


def luhn_digit(payload: Column) -> Column:
    """Luhn check digit of a digit string, null for anything else."""
    n = F.length(payload)
    def term(i: Column) -> Column:
        digit = F.substring(payload, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return digit % 10 + F.floor(digit / 10).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + term(i))
    return F.when(_all_digits(payload), ((10 - total % 10) % 10).cast("string"))


# ---------------------------------------------------------------- of strings inside a batch

_D, _P = _products(), _permutations()
_INVERSE = [next(b for b in range(10) if _dihedral(a, b) == 0) for a in range(10)]


def verhoeff_of(payload: str) -> int:
    """Verhoeff check digit of a string of ASCII digits."""
    c = 0
    for i, digit in enumerate(reversed(payload), 1):
        c = _D[c * 10 + _P[i % 8 * 10 + int(digit)]]
    return _INVERSE[c]


def luhn_of(payload: str) -> int:
    """Luhn check digit of a string of ASCII digits."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in payload[::-2])
    return -(doubled + sum(map(int, payload[-2::-2]))) % 10
