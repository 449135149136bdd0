"""Operator 5: secret scans.

Two finders over every whole text. The base patterns (assignments, access key
ids, hex runs) are exact and always reported. The method adds spans: every
candidate string is swept by a fixed window whose character counts are updated
incrementally (one in, one out), giving the Shannon entropy of each window for
the candidate's character class; windows over the class threshold are merged to
a span. Parts of a candidate (between ``/`` and ``=``) that the allow list names
are left out, what stands beside them is judged by itself. Of the added spans
what lies outside the base spans is reported.

Offsets are code points, end exclusive. A null text counts as empty and yields
no spans; repeated rows give repeated results; a text is read as a whole
whatever its length; an empty table gives no rows; columns besides ``doc_id``
and ``text`` are not read.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")

#: Strings the entropy sweep looks at.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Entropy, in bits, from which a window of a class is suspicious. Letters alone need more, as long plain words reach 3.9;
#: digits alone stay below 3.33, so numbers are never reported.
ENTROPY_LIMITS = {"digits": 3.33, "hex": 3.0, "letters": 4.05, "alphanumeric": 3.7, "base64": 3.9}
WINDOW = 20
#: Candidates that look random and are public: identifiers, addresses, the alphabet, one sign repeated ...
PUBLIC = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"(?i:(https?|www|ftp)[/_.=-].*)",
    r"(?i:abcdefghijklmnopqrstuvwxyz.*)",
    r"(.)\1*",
)
#: ... and parts of candidates named as placeholders.
PLACEHOLDERS = (r"(?i:.*(example|placeholder|changeme|dummy|sample|xxxx).*)",)

_XLOG = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def character_class(candidate: str) -> str:
    """Class of a candidate by the signs in it."""
    if candidate.isdigit():
        return "digits"
    if candidate.replace("_", "").replace("-", "").isalpha():
        return "letters"
    if all(c in "0123456789abcdefABCDEF" for c in candidate):
        return "hex"
    return "alphanumeric" if candidate.isalnum() else "base64"


def entropy_windows(candidate: str, window: int = WINDOW):
    """(start, entropy) of every window; counts change by one character in and one out."""
    counts: dict[str, int] = {}
    total = 0.0  # sum of count * log2(count)
    for i, char in enumerate(candidate):
        n = counts.get(char, 0)
        total += _XLOG[n + 1] - _XLOG[n]
        counts[char] = n + 1
        if i >= window:
            out = candidate[i - window]
            n = counts[out]
            total += _XLOG[n - 1] - _XLOG[n]
            counts[out] = n - 1
        if i >= window - 1:
            yield i - window + 1, math.log2(window) - total / window


_PUBLIC, _PLACEHOLDERS = (tuple(re.compile(p) for p in patterns) for patterns in (PUBLIC, PLACEHOLDERS))
_PART = re.compile(r"[^/=]+")


def judged_parts(candidate: str) -> list[tuple[int, int]]:
    """(start, end) of what the allow list leaves of a candidate."""
    if any(p.fullmatch(candidate) for p in _PUBLIC):
        return []
    out, at = [], 0
    for part in _PART.finditer(candidate):
        if any(p.fullmatch(part.group()) for p in _PUBLIC[:1] + _PLACEHOLDERS):
            out.append((at, part.start()))
            at = part.end() + 1  # and the sign behind it
    return [(a, b) for a, b in [*out, (at, len(candidate))] if b - a >= WINDOW]


def high_entropy_spans(text: str) -> list[tuple[int, int]]:
    """Spans of windows at or over their class limit, overlapping windows merged."""
    spans = []
    for match in _CANDIDATE.finditer(text):
        for a, b in judged_parts(match.group()):
            judged = match.group()[a:b]
            limit, at = ENTROPY_LIMITS[character_class(judged)], match.start() + a
            runs: list[list[int]] = []
            for start, entropy in entropy_windows(judged):
                if entropy < limit:
                    continue
                if runs and start <= runs[-1][1]:
                    runs[-1][1] = start + WINDOW
                else:
                    runs.append([start, start + WINDOW])
            spans += [(at + i, at + j) for i, j in runs]
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then as listed in :data:`KINDS`."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 12]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return _ordered(found)


def _ordered(spans):
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def outside(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the disjoint, ordered ``spans`` have outside ``taken`` (ordered by start); one sweep over both."""
    out, i = [], 0
    for start, end in spans:
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        j = i
        while j < len(taken) and taken[j][0] < end:
            if start < taken[j][0]:
                out.append((start, taken[j][0]))
            start = max(start, taken[j][1])
            j += 1
        if start < end:
            out.append((start, end))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def scan_text(text: str | None) -> tuple[list, list]:
    """(base spans, all spans) of one text; added spans never overlap a base span."""
    if not text:
        return [], []
    base = base_spans(text)
    added = outside(high_entropy_spans(text), _merged([(s, e) for s, e, _ in base]))
    return base, _ordered(base + [(a, b, "entropy") for a, b in added])


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``spans`` array<struct<kind, start, end, base>> for every row; no shuffle."""
    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                _, spans = scan_text(text)
                rows.append([{"kind": k, "start": s, "end": e, "base": k != "entropy"} for s, e, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, arrow)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of :func:`find_secrets` rows, by built-in functions."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        count("entropy").alias("n_entropy"))
