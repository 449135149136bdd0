"""Mixed-radix numbers as column expressions: symbols to one integer and back."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def domain_size(radixes: list[int]) -> int:
    """Number of values of the symbols."""
    return math.prod(radixes)


def encode(symbols: list[Column], radixes: list[int]) -> Column:
    """The integer of a symbol list, first symbol most significant."""
    total = F.lit(0).cast("long")
    for symbol, radix in zip(symbols, radixes, strict=True):
        total = total * radix + symbol.cast("long")
    return total


def decode(value: Column, radixes: list[int]) -> list[Column]:
    """The symbols of an integer below the domain size."""
    out, weight = [], domain_size(radixes)
    for radix in radixes:
        weight //= radix
        quotient = value if weight == 1 else ((value - value % weight).cast("decimal(20,0)") / F.lit(weight).cast("decimal(20,0)")).cast("long")
        out.append(quotient % radix)
    return out
