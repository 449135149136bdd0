"""Operator 11: fill-in-the-middle transformation by a table-driven byte automaton.

A text is read as bytes by one deterministic automaton, the product of three
small ones: UTF-8 (how many continuation bytes are due), units (where a code
point, word or line begins) and sentinels (how much of one has been read). Its
table is filled once; each transition says whether a unit begins, a sentinel
ends or the byte is malformed, and the scan counts these per lane.

Lanes make the scan a matter of array steps: texts are cut into lanes of equal
length, all lanes take a step at once. Where a lane inside a text begins, the
state depends on the few bytes before it only (no sentinel or UTF-8 sequence is
longer), so a lane starts that many bytes early. A second pass finds the cuts:
the counts tell the lane in which the wanted unit begins, and only such lanes
are scanned again for its byte.

Defined cases: a null or empty text is plain and its output empty; texts of any
length are read whole, segment by segment; a null doc_id counts as an empty one
(equal texts without id get the same cuts); equal rows get equal outputs; an
empty table gives no rows; other columns stay, one named like the added struct
is replaced; units before the first word belong to the first cut. Rows are
independent, there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_buffers

#: Sentinels before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Percent of texts that stay plain, and percent of the others that put the suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
#: Bytes of a lane, and bytes scanned at a time.
LANE, SEGMENT = 128, 1 << 20
#: What a transition may emit.
UNIT, SENTINEL, MALFORMED = 1, 2, 4

SCHEMA = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string,n_sentinels:long,n_malformed:long>"


@dataclass(frozen=True)
class Automaton:
    """``state * 256 + byte`` indexes the next state and what is emitted; ``memory`` bytes determine a state."""

    follow: np.ndarray
    emit: np.ndarray
    memory: int


def _unit_step(unit: str, inside: bool, byte: int, leads: bool) -> tuple[bool, bool]:
    """(next state, whether a unit begins) of the unit automaton."""
    if unit == "char":
        return False, leads
    if unit == "line":  # inside: the line has begun
        return byte != 10, leads and not inside
    word = byte > 127 or not (byte == 32 or 9 <= byte <= 13)
    return word, word and not inside


def _sentinel_step(marks: Sequence[bytes], read: bytes, byte: int) -> tuple[bytes, bool]:
    """(longest beginning of a sentinel that ends here, whether a sentinel ends here)."""
    read += bytes([byte])
    if read in marks:
        return b"", True
    while read and not any(m.startswith(read) for m in marks):
        read = read[1:]
        if read in marks:
            return b"", True
    return read, False


@cache
def automaton(unit: str = "char", sentinels: tuple[str, ...] = SENTINELS) -> Automaton:
    """The table for a unit (``char``, ``word`` or ``line``) and sentinels that cannot overlap each other."""
    if unit not in ("char", "word", "line"):
        raise ValueError("a unit is char, word or line")
    marks = tuple(s.encode() for s in sentinels)
    for a in marks:
        for b in marks:
            if not a or (a != b and a in b) or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))):
                raise ValueError("sentinels must not be empty, contain or overlap each other")
    start = (0, False, b"")
    numbers, queue, follow, emit = {start: 0}, [start], [], []
    for due, inside, read in queue:  # grows while new states appear
        for byte in range(256):
            continues = 128 <= byte < 192
            leads = not continues
            bad = continues != (due > 0)
            left = max(due - 1, 0) if continues else 3 if byte >= 240 else 2 if byte >= 224 else 1 if byte >= 192 else 0
            within, begins = _unit_step(unit, inside, byte, leads)
            rest, ends = _sentinel_step(marks, read, byte)
            new = (left, within, rest)
            if new not in numbers:
                numbers[new] = len(numbers)
                queue.append(new)
            follow.append(numbers[new])
            emit.append(UNIT * begins | SENTINEL * ends | MALFORMED * bad)
    memory = max([4, *(len(m) for m in marks)])
    return Automaton(np.array(follow, dtype=np.uint16), np.array(emit, dtype=np.uint8), memory)


def _scan(table: Automaton, symbols: np.ndarray, warm: np.ndarray, state: np.ndarray) -> np.ndarray:
    """What each byte of the lanes emits: ``symbols`` is (step, lane), -1 is past the end; ``warm`` are the bytes before."""
    for column in warm:
        real = column >= 0
        state = np.where(real, table.follow[state.astype(np.int32) * 256 + np.maximum(column, 0)], state)
    out = np.zeros(symbols.shape, dtype=np.uint8)
    for step, column in enumerate(symbols):
        real = column >= 0
        at = state.astype(np.int32) * 256 + np.maximum(column, 0)
        out[step] = np.where(real, table.emit[at], 0)
        state = np.where(real, table.follow[at], state)
    return out


def _lanes(table: Automaton, data: np.ndarray, begins: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Emissions of the lanes that start at ``begins`` inside texts that start at ``first`` and end at ``ends``."""
    def read(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        inside = (at >= low) & (at < high)
        return np.where(inside, data[np.where(inside, at, 0)].astype(np.int16) if len(data) else 0, np.int16(-1))

    steps = np.arange(LANE)[:, None]
    before = np.arange(-table.memory, 0)[:, None]
    return _scan(table, read(begins + steps, first, ends), read(begins + before, first, ends), np.zeros(len(begins), dtype=np.uint16))


class Scan:
    """Counts of a batch of texts after the first pass, and places of units by the second."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: Automaton):
        self.data, self.table, self.begin, self.end = data, table, offsets[:-1], offsets[1:]
        lanes = np.maximum((self.end - self.begin + LANE - 1) // LANE, 1)
        self.first_lane = np.concatenate(([0], np.cumsum(lanes)))
        self.owner = np.repeat(np.arange(len(lanes)), lanes)
        self.lane_begin = self.begin[self.owner] + (np.arange(len(self.owner)) - self.first_lane[self.owner]) * LANE
        counts = np.zeros((3, len(self.owner)), dtype=np.int64)
        step = max(1, SEGMENT // LANE)
        for a in range(0, len(self.owner), step):
            seen = self._emitted(slice(a, a + step))
            for i, bit in enumerate((UNIT, SENTINEL, MALFORMED)):
                counts[i, a: a + step] = ((seen & bit) != 0).sum(axis=0)
        total = np.concatenate((np.zeros((3, 1), dtype=np.int64), counts.cumsum(axis=1)), axis=1)
        self.upto = total[0]
        self.units, self.sentinels, self.malformed = total[:, self.first_lane[1:]] - total[:, self.first_lane[:-1]]

    def _emitted(self, lanes) -> np.ndarray:
        owner = self.owner[lanes]
        return _lanes(self.table, self.data, self.lane_begin[lanes], self.begin[owner], self.end[owner])

    def places(self, rows: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Where in the data unit ``unit[i]`` (from 0) of text ``rows[i]`` begins; unit 0 is the text's begin, one past the last its end."""
        out = np.where(unit <= 0, self.begin[rows], self.end[rows])
        inner = np.flatnonzero((unit > 0) & (unit < self.units[rows]))
        wanted = self.upto[self.first_lane[rows[inner]]] + unit[inner]  # units of the batch before the wanted one
        lane = np.searchsorted(self.upto, wanted, side="right") - 1
        step = max(1, SEGMENT // LANE)
        for a in range(0, len(inner), step):
            some = lane[a: a + step]
            nth = np.cumsum((self._emitted(some) & UNIT) != 0, axis=0)
            at = (nth <= wanted[a: a + step] - self.upto[some]).sum(axis=0)
            out[inner[a: a + step]] = self.lane_begin[some] + at
        return out


def transform_batch(texts: pa.Array, groups: Sequence[np.ndarray], unit: str, sentinels: tuple[str, ...], plain: int, suffix_first: int) -> pa.StructArray:
    """The struct of :data:`SCHEMA` for each text; ``groups`` are the four numbers h1 to h4 of each row."""
    h1, h2, h3, h4 = (np.asarray(h, dtype=np.int64) for h in groups)
    data, offsets = text_buffers(texts)
    scan = Scan(data, offsets, automaton(unit, sentinels))
    n = scan.units
    whole = (n == 0) | (scan.sentinels > 0) | (h3 % 100 >= 100 - plain)
    a, b = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    cut = np.flatnonzero(~whole)
    one, two = scan.places(cut, low[cut]), scan.places(cut, high[cut])
    spm = h4 % 100 < suffix_first
    mark_p, mark_s, mark_m = (s.encode() for s in sentinels)
    raw = memoryview(data)
    out = [bytes(raw[s:e]) for s, e in zip(scan.begin, scan.end)] if len(data) else [b""] * len(n)
    for i, x, y in zip(cut, one, two):
        prefix, middle, suffix = raw[scan.begin[i]: x], raw[x:y], raw[y: scan.end[i]]
        out[i] = b"".join((mark_s, suffix, mark_p, prefix, mark_m, middle) if spm[i] else (mark_p, prefix, mark_s, suffix, mark_m, middle))
    form = np.where(whole, "plain", np.where(spm, "spm", "psm"))
    size = lambda x: pa.array(x, pa.int64(), mask=whole)
    text = pa.Array.from_buffers(pa.string(), len(out), pa.array(out, pa.binary()).buffers())
    return pa.StructArray.from_arrays(
        [pa.array(n), pa.array(form.tolist(), pa.string()), size(low), size(high - low), text, pa.array(scan.sentinels), pa.array(scan.malformed)],
        ["n", "form", "prefix_chars", "middle_chars", "output", "n_sentinels", "n_malformed"])


def fill_in_middle(docs: DataFrame, seed: str = "1", unit: str = "char", sentinels: tuple[str, ...] = SENTINELS,
                   plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, column: str = "fim") -> DataFrame:
    """``docs`` with the struct ``column`` of :data:`SCHEMA`: each text cut in three by a digest of ``seed`` and doc_id.

    ``prefix_chars`` and ``middle_chars`` count units; both are null for plain
    texts. A text that holds a sentinel stays plain, so :func:`restored` is exact.
    """
    automaton(unit, tuple(sentinels))  # wrong parameters fail here, not in a task

    @F.arrow_udf(SCHEMA)
    def cut(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        return transform_batch(texts, [h.to_numpy(zero_copy_only=False) for h in (h1, h2, h3, h4)], unit, tuple(sentinels), plain_percent, suffix_first_percent)

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    group = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    return docs.withColumn(column, cut(F.coalesce(F.col("text").cast("string"), F.lit("")), *group))


def restored(output: Column, form: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """The text of a transformed one, from its output and form alone."""
    part = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels), -1)  # nothing, two parts by form, the middle
    prefix = F.get(part, F.when(form == "spm", 2).otherwise(1))
    suffix = F.get(part, F.when(form == "spm", 1).otherwise(2))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(part, F.lit(3)), suffix))


def fim_digest(cut: DataFrame, column: str = "fim") -> DataFrame:
    """Counts, form and digests of :func:`fill_in_middle` rows."""
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    fim = F.col(column)
    return cut.select("doc_id", fim["n"].alias("n"), fim["form"].alias("form"), fim["prefix_chars"].alias("prefix_chars"), fim["middle_chars"].alias("middle_chars"),
                      sha(fim["output"]).alias("output_sha256"), sha(restored(fim["output"], fim["form"])).alias("restored_sha256"))
