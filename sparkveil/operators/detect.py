"""Detectors, span resolution and ingress marking as column expressions.

A span is struct<start, end, entity_type, tier, det_idx, emit_pos>, offsets in
code points, end exclusive. Everything here is a projection: text in, spans
out, no shuffle. The model seam (:func:`model_spans`) is the one Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.checksums import luhn_valid, verhoeff_valid

SPAN = "struct<start:int,end:int,entity_type:string,tier:int,det_idx:int,emit_pos:int>"
SPANS = f"array<{SPAN}>"

#: Entity types in registration order, which breaks ties.
TYPES = ("AADHAAR", "CARD", "PAN", "IFSC", "UPI", "VEHICLE_REG", "EMAIL", "PHONE", "PERSON", "ORG", "ADDRESS")
DETERMINISTIC, MODEL_TYPES = TYPES[:8], TYPES[8:]

#: Candidate patterns. (?U) makes digits and word boundaries Unicode-aware.
PATTERNS = {
    "AADHAAR": r"(?U)\b\d{12}\b",
    "CARD": r"(?U)\b\d{12,19}\b",
    "PAN": r"(?U)\b[A-Z]{5}\d{4}[A-Z]\b",
    "IFSC": r"(?U)\b[A-Z]{4}0[A-Z0-9]{6}\b",
    "UPI": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,256}@[A-Za-z][A-Za-z0-9]{1,64}(?![A-Za-z0-9.])",
    "VEHICLE_REG": r"(?U)\b(?:[A-Z]{2}\d{1,2}[A-Z]{1,3}\d{4}|\d{2}BH\d{4}[A-Z]{1,2})\b",
    "EMAIL": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9.-])",
    "PHONE": r"(?U)(?<![A-Za-z0-9])(?:\+91|91|0)?[6-9]\d{9}(?![0-9])",
}
#: Permitted holder categories, the fourth letter of a PAN.
PAN_CATEGORIES = "PCHABGJLFT"


@dataclass(frozen=True)
class Detector:
    """A pattern and a check of each match."""

    entity_type: str
    pattern: str
    valid: Callable[[Column], Column] | None = None

    def possible(self, text: Column) -> Column:
        """A cheap condition that every text with a match meets."""
        if "@" in self.pattern:
            return F.contains(text, F.lit("@"))
        return F.regexp_like(text, F.lit(r"[A-Z]{4}0" if self.entity_type == "IFSC" else r"(?U)\d{4}"))


DETECTORS = tuple(
    Detector(t, PATTERNS[t], {"AADHAAR": verhoeff_valid, "CARD": luhn_valid,
                              "PAN": lambda m: F.substring(m, 4, 1).isin(*PAN_CATEGORIES)}.get(t))
    for t in DETERMINISTIC)


def detector_spans(text: Column, detector: Detector, checked: bool = True) -> Column:
    """Spans of one detector: leftmost non-overlapping matches; offsets from the lengths of the pieces between them."""
    matches = F.regexp_extract_all(text, F.lit(detector.pattern), F.lit(0))
    between = F.split(text, detector.pattern, -1)
    idx = TYPES.index(detector.entity_type)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,m:string>>").alias("found"))
    placed = F.aggregate(
        F.transform(matches, lambda m, i: F.struct(F.length(F.get(between, i)).alias("gap"), m.alias("m"))), begin,
        lambda acc, x: F.struct((acc["at"] + x["gap"] + F.length(x["m"])).alias("at"), F.array_append(
            acc["found"], F.struct((acc["at"] + x["gap"]).alias("start"), x["m"].alias("m"))).alias("found")), lambda acc: acc["found"])
    if checked and detector.valid:
        placed = F.filter(placed, lambda x: detector.valid(x["m"]))
    spans = F.transform(placed, lambda x, i: F.struct(
        x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), F.lit(detector.entity_type).alias("entity_type"),
        F.lit(1).alias("tier"), F.lit(idx).alias("det_idx"), i.alias("emit_pos")))
    # cheap tests first: most texts hold no candidate at all
    return F.when(detector.possible(text) & F.regexp_like(text, F.lit(detector.pattern)), spans).otherwise(F.array().cast(SPANS))


#: What may hold a match: runs of word characters and of the signs that patterns use, with an @, four digits or the
#: beginning of a bank code. No match crosses the ends of such a run, and no pattern looks beyond them.
_SIGNS = r"[\w.%+@-]"
_CORE = r"@|\d{4}|[A-Z]{4}0"
CANDIDATE = rf"(?U)(?<!{_SIGNS}){_SIGNS}*?(?:{_CORE}){_SIGNS}*+"


def deterministic_spans(text: Column, types=DETERMINISTIC, checked: bool = True) -> Column:
    """Unresolved spans of the deterministic detectors.

    One pass finds the candidates, runs that may hold a match; the detectors see
    these only. ``emit_pos`` is the place of a span, which orders those of a detector.
    """
    between = F.split(text, CANDIDATE, -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,run:string>>").alias("found"))

    def placed(runs: Column) -> Column:
        gaps = F.transform(runs, lambda r, i: F.struct(F.length(F.get(between, i)).alias("gap"), r.alias("run")))
        return F.aggregate(gaps, begin, lambda acc, x: F.struct((acc["at"] + x["gap"] + F.length(x["run"])).alias("at"), F.array_append(
            acc["found"], F.struct((acc["at"] + x["gap"]).alias("at"), x["run"].alias("run"))).alias("found")), lambda acc: acc["found"])

    def moved(c: Column, detector: Detector) -> Column:
        return F.transform(detector_spans(c["run"], detector, checked), lambda s: F.struct(
            (s["start"] + c["at"]).alias("start"), (s["end"] + c["at"]).alias("end"), s["entity_type"].alias("entity_type"), s["tier"].alias("tier"),
            s["det_idx"].alias("det_idx"), (s["start"] + c["at"]).alias("emit_pos")))

    wanted = [d for d in DETECTORS if d.entity_type in types]
    judged = lambda runs: F.flatten(F.transform(placed(runs), lambda c: F.concat(*[moved(c, d) for d in wanted])))
    runs = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    none = F.array().cast(SPANS)
    found = once(runs, judged) if wanted else none
    return F.when(F.regexp_like(text, F.lit(f"(?U){_CORE}")), found).otherwise(none)  # most texts hold nothing


#: Up to so many spans are compared with all that were taken before; more are looked up by halving.
FEW_SPANS = 32


def resolve(spans: Column) -> Column:
    """Disjoint spans by (tier, longest, registration, emission), greedily, sorted by start.

    A span beaten only by a span that was itself rejected survives, so this is a fold and no anti-join.
    Those taken are disjoint and kept in order, so only the last that begins before a span's end can overlap it.
    """
    def in_order(spans: Column) -> Column:
        return F.array_sort(F.transform(spans, lambda s: F.struct(
            s["tier"].alias("tier"), (s["start"] - s["end"]).alias("size"), s["det_idx"].alias("det_idx"), s["emit_pos"].alias("emit_pos"), s.alias("span"))))

    none = F.array().cast(SPANS)

    def compared(acc: Column, r: Column) -> Column:
        return F.when(F.exists(acc, lambda a: overlaps(a, r["span"])), acc).otherwise(F.array_append(acc, r["span"]))

    def before(acc: Column, end: Column) -> Column:
        """How many of the taken spans begin before ``end``."""
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(acc) + 1.0)).cast("int"))
        middle = lambda b: F.floor((b["lo"] + b["hi"]) / 2).cast("int")
        begin = F.struct(F.lit(0).alias("lo"), F.size(acc).alias("hi"))
        return F.aggregate(steps, begin, lambda b, _: F.when(b["lo"] >= b["hi"], b).when(F.get(acc, middle(b))["start"] < end, F.struct(
            (middle(b) + 1).alias("lo"), b["hi"].alias("hi"))).otherwise(F.struct(b["lo"].alias("lo"), middle(b).alias("hi"))), lambda b: b["lo"])

    def taken(acc: Column, r: Column) -> Column:
        put = lambda n: F.when((n > 0) & (F.get(acc, n - 1)["end"] > r["span"]["start"]), acc).otherwise(
            F.concat(F.slice(acc, F.lit(1), n), F.array(r["span"]), F.slice(acc, n + 1, F.size(acc))))
        return F.get(F.transform(F.array(before(acc, r["span"]["end"])), put), F.lit(0))

    judged = lambda spans: F.when(F.size(spans) <= 1, spans).when(F.size(spans) <= FEW_SPANS, F.array_sort(
        F.aggregate(in_order(spans), none, compared))).otherwise(F.aggregate(in_order(spans), none, taken))
    return once(spans, judged)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def exploded(found: DataFrame, *ids: str) -> DataFrame:
    """(ids, s) for each of ``spans``.

    The outer form is used because the inner one makes the planner test the array beforehand, and so detect everything three times.
    """
    return found.select(*ids, F.explode_outer("spans").alias("s")).where("s is not null")


def overlaps(a: Column, b: Column) -> Column:
    """Whether two half-open spans share a position; neighbours do not."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def detect(df: DataFrame, text: str = "text", model: Column | None = None, skipped: Column | None = None) -> DataFrame:
    """Adds ``spans``, the resolved spans of ``text``; ``model`` adds unresolved spans of a model. Texts that are ``skipped`` have none."""
    found = deterministic_spans(F.coalesce(F.col(text), F.lit("")))
    spans = resolve(F.concat(found, model) if model is not None else found)
    return df.withColumn("spans", spans if skipped is None else F.when(skipped, F.array().cast(SPANS)).otherwise(spans))


def only_type(text: Column, entity_type: str) -> Column:
    """Whether the whole text resolves to one span of a type: a value that no other detector claims."""
    spans = resolve(deterministic_spans(text))
    first = F.get(spans, F.lit(0))
    return (F.size(spans) == 1) & (first["entity_type"] == entity_type) & (first["start"] == 0) & (first["end"] == F.length(text))


def gazetteer_model(phrases: dict[str, list[str]]) -> Callable[[str], list[tuple[int, int, str]]]:
    """A stand-in model: exact phrases of each model type."""
    def run(text: str) -> list[tuple[int, int, str]]:
        found = []
        for kind, names in phrases.items():
            for name in names:
                at = text.find(name)
                while at >= 0:
                    found.append((at, at + len(name), kind))
                    at = text.find(name, at + len(name))
        return sorted(found)
    return run


def model_spans(predict: Callable[[str], list[tuple[int, int, str]]], fail_mode: str):
    """Arrow UDF text -> struct<spans, error>: a model called once a text, its output filtered by type and bounds.

    ``fail_mode`` has no default: ``open`` drops a failing model's spans, ``closed`` reports the error of the row.
    """
    if fail_mode not in ("open", "closed"):
        raise ValueError("fail_mode must be open or closed")

    @F.pandas_udf(f"spans {SPANS}, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows, errors = [], []
        for text in texts:
            spans, error = [], None
            try:
                count: dict[str, int] = {}
                for start, end, kind in predict(text) if text else []:
                    if kind not in MODEL_TYPES:
                        continue
                    if not 0 <= start < end <= len(text):
                        raise ValueError(f"span out of bounds for a text of length {len(text)}")
                    count[kind] = count.get(kind, -1) + 1
                    spans.append({"start": start, "end": end, "entity_type": kind, "tier": 2,
                                  "det_idx": TYPES.index(kind), "emit_pos": count[kind]})
            except Exception as problem:  # the model is foreign code; errors never carry texts
                spans, error = [], type(problem).__name__ if fail_mode == "closed" else None
            rows.append(spans)
            errors.append(error)
        return pd.DataFrame({"spans": rows, "error": errors})

    return run
