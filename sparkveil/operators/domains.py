"""Reversible, format-preserving surrogates for the six structured entity types.

Each domain maps a value to another of its own shape by FF1; the same column with
``decrypt`` restores it. Values that do not have the shape give null, so callers
report a status instead of passing a real value on. A value becomes the number of
its shape and an integer, the integers of a batch are permuted together, and each
is written out again.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkveil.functions.checksums import luhn_of, verhoeff_of
from sparkveil.functions.ff1 import Permutation, moved, walking

SURROGATE_TYPES = ("AADHAAR", "CARD", "PAN", "IFSC", "PHONE", "VEHICLE_REG")
#: Types with values that no domain covers; a body that holds one is refused.
UNSUPPORTED = ("UPI", "EMAIL")

_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALPHABETS = {"9": _DIGITS, "A": _UPPER, "X": _DIGITS + _UPPER}


@dataclass(frozen=True)
class Shape:
    """Values of a type that one permutation covers: which ones, the integer of a value, and the value that a new integer stands for."""

    pattern: re.Pattern
    permutation: Permutation
    number: Callable[[str], int]
    text: Callable[[str, int], str]


def _marks(tweak: bytes, shape: str, order: list[int]) -> Shape:
    """Mixed-radix permutation of the positions in ``order``; other positions of ``shape`` are kept.

    ``shape`` has A for a letter, 9 for a digit, X for either, * for a letter that stays, anything else for itself.
    """
    signs = [_ALPHABETS[shape[i]] for i in order]
    size = 1
    for s in signs:
        size *= len(s)

    def number(value: str) -> int:
        total = 0
        for i, s in zip(order, signs):
            total = total * len(s) + s.index(value[i])
        return total

    def text(value: str, number: int) -> str:
        out = list(value)
        for i, s in zip(reversed(order), reversed(signs)):
            number, at = divmod(number, len(s))
            out[i] = s[at]
        return "".join(out)

    classes = {"A": "[A-Z]", "9": "[0-9]", "X": "[A-Z0-9]", "*": "[A-Z]"}
    return Shape(re.compile("".join(classes.get(c, c) for c in shape)), walking(size, tweak), number, text)


def _card(n: int) -> Shape:
    """``n`` digits permuted, the Luhn digit derived again."""
    def text(_: str, number: int) -> str:
        body = f"{number:0{n}d}"
        return f"{body}{luhn_of(body)}"
    return Shape(re.compile(f"[0-9]{{{n + 1}}}"), Permutation(10, n, b"CARD"), lambda v: int(v[:n]), text)


def _aadhaar() -> Shape:
    """Eleven digits permuted, the Verhoeff digit derived again."""
    def text(_: str, number: int) -> str:
        body = f"{number:011d}"
        return f"{body}{verhoeff_of(body)}"
    return Shape(re.compile("[0-9]{12}"), Permutation(10, 11, b"AADHAAR"), lambda v: int(v[:11]), text)


def _vehicle(shape: str) -> Shape:
    return _marks(b"VEHICLE_REG", shape, [i for i, c in enumerate(shape) if c in "A9"])


#: Cards: all digits but the last, 12 to 19 digits. Phone: prefix and leading digit kept, nine digits permuted. PAN: five
#: letters and four digits, the category letter stays. IFSC: bank letters and branch signs, the zero stays. Vehicle marks:
#: all letters and digits within the lengths of the mark, the literal BH stays.
SHAPES: dict[str, tuple[Shape, ...]] = {
    "AADHAAR": (_aadhaar(),),
    "CARD": tuple(_card(n) for n in range(11, 19)),
    "PAN": (_marks(b"PAN", "AAA*A9999A", [0, 1, 2, 4, 9, 5, 6, 7, 8]),),
    "IFSC": (_marks(b"IFSC", "AAAA0XXXXXX", [0, 1, 2, 3, 5, 6, 7, 8, 9, 10]),),
    "PHONE": (Shape(re.compile(r"(?:\+91|91|0)?[6-9][0-9]{9}"), Permutation(10, 9, b"PHONE"), lambda v: int(v[-9:]), lambda v, x: f"{v[:-9]}{x:09d}"),),
    "VEHICLE_REG": (*(_vehicle("AA" + "9" * d + "A" * s + "9999") for d in (1, 2) for s in (1, 2, 3)), *(_vehicle("99BH9999" + "A" * s) for s in (1, 2))),
}
_ALL = [s for t in SURROGATE_TYPES for s in SHAPES[t]]
_NUMBERED = {t: [(_ALL.index(s), s) for s in SHAPES[t]] for t in SURROGATE_TYPES}


def exchanged(types: list[str | None], values: list[str | None], keys: pa.Array, decrypt: bool = False) -> list[str | None]:
    """Surrogates of values of these types under these keys; None for types, values and keys without one."""
    held, which, number = [], [], []
    for i, (kind, value) in enumerate(zip(types, values)):
        for n, shape in _NUMBERED.get(kind, ()) if value is not None else ():
            if shape.pattern.fullmatch(value):
                held.append(i)
                which.append(n)
                number.append(shape.number(value))
                break
    coded = keys.take(pa.array(held, pa.int64())).dictionary_encode()
    key = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    which, known = np.array(which, dtype=np.int64), key >= 0
    new = moved(np.array(number, dtype=np.int64)[known], which[known], key[known].astype(np.int64), coded.dictionary.to_pylist(), [s.permutation for s in _ALL], decrypt)
    out: list[str | None] = [None] * len(values)
    for i, n, x in zip(np.array(held, dtype=np.int64)[known].tolist(), which[known].tolist(), new.tolist()):
        out[i] = _ALL[n].text(values[i], x)
    return out


def surrogate(entity_type: Column, value: Column, key: Column, decrypt: bool = False) -> Column:
    """Surrogate of a value by its type; null for types and values without a domain."""
    @F.arrow_udf("string")
    def surrogate_of(types: pa.Array, values: pa.Array, keys: pa.Array) -> pa.Array:
        return pa.array(exchanged(types.to_pylist(), values.to_pylist(), keys, decrypt), pa.string())

    return surrogate_of(entity_type, value, key)


def surrogates(text: Column, spans: Column, key: Column) -> Column:
    """Array of the surrogates of the spans of a text."""
    @F.arrow_udf("array<string>")
    def surrogates_of(texts: pa.Array, spans: pa.Array, keys: pa.Array) -> pa.Array:
        rows = [s or [] for s in spans.to_pylist()]
        at = np.repeat(np.arange(len(rows)), [len(s) for s in rows])
        flat = [(s["entity_type"], t[s["start"]: s["end"]]) for t, found in zip(texts.to_pylist(), rows) for s in found]
        new = exchanged([t for t, _ in flat], [v for _, v in flat], keys.take(pa.array(at)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(s) for s in rows]))), pa.int32()), pa.array(new, pa.string()))

    return surrogates_of(text, spans, key)


def _domain(entity_type: str) -> Callable[..., Column]:
    def domain(value: Column, key: Column, decrypt: bool = False) -> Column:
        return surrogate(F.lit(entity_type), value, key, decrypt)
    domain.__name__ = entity_type.lower().removesuffix("_reg")
    domain.__doc__ = f"Surrogate of a value of the type {entity_type}; null if it does not have the shape."
    return domain


_BY_TYPE = {t: _domain(t) for t in SURROGATE_TYPES}
aadhaar, card, pan, ifsc, phone, vehicle = (_BY_TYPE[t] for t in SURROGATE_TYPES)


#: Longest surrogate of the structured types.
MAX_LENGTH = 19
