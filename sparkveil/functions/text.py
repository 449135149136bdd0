"""Text pieces and splices as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_into_n(text: Column, n: int) -> Column:
    """``n`` neighbouring pieces, the first ``length % n`` one longer; pieces may be empty."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    size = F.length(text)
    base, longer = F.floor(size / n).cast("int"), (size % n).cast("int")
    start = lambda i: i * base + F.least(i, longer)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(
        text, start(i) + 1, base + F.when(i < longer, 1).otherwise(0)))


def split_on_space(text: Column) -> Column:
    """Runs of non-space and runs of space, in order; together the text."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+|\s+"), F.lit(0))


def splice(text: Column, spans: Column, replacement) -> Column:
    """``text`` with each of the disjoint spans, sorted by start, replaced by ``replacement(span)``."""
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(spans, begin, lambda acc, s: F.struct(
        F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), replacement(s)).alias("out"),
        s["end"].alias("at")), lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
