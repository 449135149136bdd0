"""Server-sent events and the rehydrating window, in batch and as a stream.

Spark has no arrival order, so every fragment has ``chunk_seq``. The batch forms
put fragments together per stream; the streaming form keeps of each stream the
open line, the open event and the undecided tail as state. A position is decided
once the longest surrogate fits behind it, and decided text is never looked at
again, so all forms agree. Names are those of the stream's session.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass, field
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkveil.operators.sanitize import known_surrogates
from sparkveil.operators.sealing import opened, sealed

#: The data of the last event.
DONE = "[DONE]"
#: Seconds that the state of a stream lives without a fragment.
TTL_SECONDS = 3600


def stream_text(chunks: DataFrame) -> DataFrame:
    """(stream_id, text): the fragments of each stream in order of ``chunk_seq``."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_seq", "chunk")))
    return chunks.groupBy("stream_id").agg(F.array_join(F.transform(ordered, lambda c: c["chunk"]), "").alias("text"))


def event_data(text: Column) -> Column:
    """Data of the events of a stream's text.

    Lines end at CR LF, LF or CR. A blank line ends an event; data lines are
    joined by LF, one space after the colon dropped; other fields and comments
    are skipped; an event left open at the end still counts.
    """
    lines = F.split(text, "\r\n|\n|\r", -1)
    start = F.struct(F.array().cast("array<string>").alias("events"), F.array().cast("array<string>").alias("data"))
    close = lambda s: F.struct(F.when(F.size(s["data"]) > 0, F.array_append(s["events"], F.array_join(s["data"], "\n"))).otherwise(
        s["events"]).alias("events"), F.array().cast("array<string>").alias("data"))

    def step(state: Column, line: Column) -> Column:
        value = F.regexp_replace(F.substring(line, F.lit(6), F.length(line)), "^ ", "")
        return F.when(line == "", close(state)).when(line.startswith("data:"), F.struct(
            state["events"].alias("events"), F.array_append(state["data"], value).alias("data"))).otherwise(state)

    return F.aggregate(lines, start, step, lambda s: close(s)["events"])


def parse_event(data: Column) -> Column:
    """struct<kind, content>: ``done``, ``delta`` with its content, or ``error``."""
    parsed = F.try_parse_json(data)
    choices = F.try_variant_get(parsed, "$.choices", "variant")
    content = F.when(F.schema_of_variant(F.try_variant_get(parsed, "$.choices[0].delta.content", "variant")) == "STRING",
                     F.try_variant_get(parsed, "$.choices[0].delta.content", "string"))
    kind = F.when(data == "[DONE]", "done").when(choices.isNotNull(), "delta").otherwise("error")
    return F.struct(kind.alias("kind"), F.coalesce(content, F.lit("")).alias("content"))


def frame_events(chunks: DataFrame) -> DataFrame:
    """(stream_id, event_seq, data, kind, content) of each stream."""
    rows = stream_text(chunks).select("stream_id", F.posexplode(event_data(F.col("text"))).alias("event_seq", "data"))
    return rows.select("stream_id", "event_seq", "data", parse_event(F.col("data")).alias("p")).select("stream_id", "event_seq", "data", "p.kind", "p.content")


class Window:
    """The surrogates of a session as an automaton, built once, and what takes the place of each.

    ``known`` maps surrogates to anything that ``transform`` makes a replacement
    of. Whatever the number of surrogates, a character costs one step.
    """

    def __init__(self, known: dict[str, object], transform: Callable[[object], object] = lambda x: x):
        self.known, self.transform = known, transform
        self.automaton = ahocorasick.Automaton()
        for surrogate in known:
            if surrogate:
                self.automaton.add_word(surrogate, surrogate)
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, text: str, last: int) -> list[tuple[int, str]]:
        """(start, surrogate), disjoint, from the left, the longest at each place, that start at ``last`` at the latest."""
        if not len(self.automaton) or not text:
            return []
        found = sorted(((end + 1 - len(s), s) for end, s in self.automaton.iter(text)), key=lambda h: (h[0], -len(h[1])))
        out, at = [], 0
        for start, surrogate in found:
            if at <= start <= last:
                out.append((start, surrogate))
                at = start + len(surrogate)
        return out


@lru_cache(maxsize=64)
def _window(names: tuple[tuple[str, object], ...], replace: Callable[[object], object]) -> Window:
    """The automaton of a session; those used last are kept between events."""
    return Window(dict(names), replace)


def release(buffer: str, final: bool, window: Window, hold: int) -> tuple[list, str]:
    """(parts released, text kept): parts are texts and replacements, longest surrogate first at each position that is decided."""
    if hold < 0:
        raise ValueError("hold must not be negative")
    last = len(buffer) if final else len(buffer) - max(hold, 1)  # the last position that is decided
    parts, at = [], 0
    for start, surrogate in window.hits(buffer, last):
        parts += [buffer[at:start]] * (start > at) + [window.transform(window.known[surrogate])]
        at = start + len(surrogate)
    stop = max(at, min(last + 1, len(buffer)))
    return parts + [buffer[at:stop]] * (stop > at), buffer[stop:]


def split_lines(partial: str, held_cr: bool, text: str) -> tuple[list[str], str, bool]:
    """(complete lines, open line, whether a CR waits) after ``text``: a CR at its end may be half of CR LF."""
    text = partial + "\r" * held_cr + text
    held = text.endswith("\r")
    *lines, rest = re.split("\r\n|\n|\r", text[:-1] if held else text)
    return lines, rest, held


def parsed_event(data: str) -> dict | None:
    """The JSON object of an event with ``choices``; None for anything else."""
    try:
        found = json.loads(data)
    except ValueError:
        return None
    return found if isinstance(found, dict) and "choices" in found else None


def _delta(event: dict) -> dict:
    """``choices[0].delta`` of an event, or an empty object."""
    choices = event["choices"]
    first = choices[0] if isinstance(choices, list) and choices else None
    delta = first.get("delta") if isinstance(first, dict) else None
    return delta if isinstance(delta, dict) else {}


def written_event(data: str, parts: list) -> str:
    """An event as text, with the joined ``parts`` for its content if it had one."""
    event = json.loads(data)
    delta = _delta(event)
    if "content" in delta:
        delta["content"] = "".join(parts)
    return f"data: {json.dumps(event)}\n\n"


@dataclass(frozen=True)
class Sealed:
    """A replacement that is opened only when the event is written."""

    box: bytes


def cut_event(data: str, parts: list) -> dict:
    """An event as text before its content, parts of the content (text or sealed), and text behind it."""
    event = json.loads(data)
    delta = _delta(event)
    if "content" not in delta:
        return {"head": f"data: {json.dumps(event)}\n\n", "parts": None, "tail": ""}
    mark = "\ue000"
    while mark in data or json.dumps(mark)[1:-1] in data:
        mark += "\ue001"
    delta["content"] = mark
    head, _, tail = json.dumps(event).partition(json.dumps(mark))
    pieces = [{"text": None, "box": p.box} if isinstance(p, Sealed) else {"text": p, "box": None} for p in parts]
    return {"head": f"data: {head}", "parts": pieces, "tail": f"{tail}\n\n"}


@dataclass
class Reply:
    """State of one reply between fragments; fields are what Spark keeps."""

    expected: int = 0
    out_seq: int = 0
    closed: bool = False
    partial: str = ""
    held_cr: bool = False
    data: list[str] = field(default_factory=list)
    buffer: str = ""
    slot: str = ""  # the last event with a content
    finish: str = ""  # an event without one waits for the end
    early_seq: list[int] = field(default_factory=list)
    early_chunk: list[str] = field(default_factory=list)
    early_last: list[bool] = field(default_factory=list)

    SCHEMA = ("expected long, out_seq long, closed boolean, partial string, held_cr boolean, data array<string>, buffer string, "
              "slot string, finish string, early_seq array<long>, early_chunk array<string>, early_last array<boolean>")


def _take_lines(state: Reply, lines: list[str]) -> list[str]:
    """Data of the events that ``lines`` complete."""
    events = []
    for line in lines:
        if line == "":
            if state.data:
                events.append("\n".join(state.data))
            state.data = []
        elif line.startswith("data:"):
            state.data.append(line[5:].removeprefix(" "))
    return events


def _take_events(state: Reply, events: list[str], window: Window, hold: int, write: Callable, lenient: bool = False) -> tuple[list, str | None]:
    """(events to write, why the reply ends, if it does); ``lenient`` skips what cannot be read."""
    out = []
    for data in events:
        if data == DONE:
            if lenient:
                continue
            return out, "ok"
        event = parsed_event(data)
        if event is None:
            if lenient:
                continue
            return out, "malformed_event"
        delta = _delta(event)
        if "content" not in delta:
            state.finish = data
            continue
        state.slot = data
        content = delta["content"] if isinstance(delta["content"], str) else ""
        parts, state.buffer = release(state.buffer + content, False, window, hold)
        if parts:
            out.append(write(data, parts))
    return out, None


def _end(state: Reply, window: Window, hold: int, why: str, write: Callable) -> list:
    """The last events: what the window holds, the finish event, and always :data:`DONE`."""
    out = []
    if why != "ok":  # an honest end: what came so far is still delivered
        rest = [state.partial] if state.partial or state.held_cr else []
        out, _ = _take_events(state, _take_lines(state, [*rest, ""]), window, hold, write, lenient=True)
    parts, state.buffer = release(state.buffer, True, window, hold)
    if parts and state.slot:
        out.append(write(state.slot, parts))
    if state.finish:
        out.append(write(state.finish, []))
    out.append(write("", DONE))
    closed = Reply(expected=state.expected, out_seq=state.out_seq, closed=True)
    state.__dict__.update(closed.__dict__)
    return out


def _as_text(data: str, parts) -> str:
    return f"data: {DONE}\n\n" if parts == DONE else written_event(data, parts)


def _as_cut(data: str, parts) -> dict:
    return {"head": f"data: {DONE}\n\n", "parts": None, "tail": ""} if parts == DONE else cut_event(data, parts)


def take_fragments(state: Reply, fragments: list[tuple[int, str, bool]], window: Window, hold: int, write: Callable = _as_text) -> list[tuple]:
    """(event to write, status) for new (chunk_seq, chunk, is_last); the status of an end says why, of others it is ``open``.

    A fragment after the end writes nothing and has the status ``after_end``.
    """
    rows: list[tuple] = []
    waiting = {n: (c, last) for n, c, last in zip(state.early_seq, state.early_chunk, state.early_last)}
    for n, chunk, last in fragments:
        if state.closed:
            rows.append((None, "after_end"))
        elif n >= state.expected:
            waiting[n] = (chunk, last)
    while not state.closed and state.expected in waiting:
        chunk, last = waiting.pop(state.expected)
        state.expected += 1
        lines, state.partial, state.held_cr = split_lines(state.partial, state.held_cr, chunk)
        events, why = _take_events(state, _take_lines(state, lines), window, hold, write)
        rows += [(e, "open") for e in events]
        if why or last:
            rows += [(e, why or "no_done") for e in _end(state, window, hold, why or "no_done", write)]
            rows += [(None, "after_end")] * len(waiting)
            waiting = {}
    if not state.closed:
        state.early_seq, state.early_chunk, state.early_last = list(waiting), [c for c, _ in waiting.values()], [x for _, x in waiting.values()]
    return rows


def _with_names(chunks: DataFrame, registry: DataFrame, value) -> DataFrame:
    """``chunks`` with ``names``, the (surrogate, value) of their session, on the first fragment of a stream only: nothing is written before it."""
    known = known_surrogates(registry).where("original is not null")
    names = known.groupBy(F.col("session_id").alias("_session")).agg(F.array_sort(F.collect_list(F.struct("surrogate", value.alias("value")))).alias("names"))
    return chunks.join(names, (F.col("session_id") == F.col("_session")) & (F.col("chunk_seq") == 0), "left").drop("_session")


def _names(rows: pd.DataFrame) -> tuple:
    held = [n for n in rows["names"] if n is not None]
    return tuple((n["surrogate"], n["value"]) for n in held[0]) if held else ()


def _fragments(rows: pd.DataFrame) -> list[tuple[int, str, bool]]:
    return [(int(n), c or "", bool(last)) for n, c, last in zip(rows["chunk_seq"], rows["chunk"], rows["is_last"])]


REPLY_ROWS = "stream_id string, out_seq long, payload string, status string"
_CUT_ROWS = "stream_id string, session_id string, out_seq long, head string, parts array<struct<text:string,box:binary>>, tail string, status string"


def reply_events(chunks: DataFrame, registry: DataFrame, hold: int) -> DataFrame:
    """(stream_id, out_seq, payload, status): complete replies (stream_id, session_id, chunk_seq, chunk, is_last) rewritten; a group is one reply."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        window = _window(_names(rows), str)
        state = Reply()
        out = take_fragments(state, sorted(_fragments(rows)), window, hold)
        if not state.closed:  # a fragment is missing or the last one is not marked
            out += [(e, "dropped") for e in _end(state, window, hold, "dropped", _as_text)]
        return pd.DataFrame({"stream_id": rows["stream_id"].iloc[0], "out_seq": range(len(out)), "payload": [p or "" for p, _ in out], "status": [s for _, s in out]})

    return _with_names(chunks, registry, F.col("original")).groupBy("stream_id").applyInPandas(run, REPLY_ROWS)


def reply_stream(chunks: DataFrame, registry: DataFrame, hold: int, key: Column, ttl_seconds: int | None = TTL_SECONDS) -> DataFrame:
    """:func:`reply_events` of a streaming ``chunks``; ``registry`` is a table with its originals in the open.

    Originals are sealed with ``key`` before they enter the stateful operator and
    opened behind it, so neither its state nor its output files hold one.
    Fragments may come in any order. A reply that gets none for ``ttl_seconds``
    ends honestly, with the status ``dropped``; what is kept of an ended reply is
    a few numbers, by which late fragments are known to be ``after_end``, for the
    same time again after its last fragment. Such a query never ends by itself; a
    run over what is there (``availableNow``) has to set None, no timeout.
    """
    if hold < 0:
        raise ValueError("hold must not be negative")

    def step(group, frames: Iterator[pd.DataFrame], state: GroupState):
        kept = list(state.get) if state.exists else None
        reply = Reply(*[list(v) if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0) else v for v in kept[:-2]]) if kept else Reply()
        session, names = (kept[-2], tuple((s, bytes.fromhex(b)) for s, b in json.loads(kept[-1]))) if kept else (None, ())
        out: list[tuple] = []
        forget = state.hasTimedOut and reply.closed
        if state.hasTimedOut:
            if not reply.closed:
                out = [(e, "dropped") for e in _end(reply, _window(names, Sealed), hold, "dropped", _as_cut)]
        else:
            for rows in frames:
                session = session or rows["session_id"].iloc[0]
                names = names or tuple((s, bytes(b)) for s, b in _names(rows))
                out += take_fragments(reply, _fragments(rows), _window(names, Sealed), hold, _as_cut)
        if out:
            cut = [e or {"head": "", "parts": None, "tail": ""} for e, _ in out]
            yield pd.DataFrame({"stream_id": [group[0]] * len(out), "session_id": [session] * len(out), "out_seq": range(reply.out_seq, reply.out_seq + len(out)),
                                **{c: [e[c] for e in cut] for c in ("head", "parts", "tail")}, "status": [s for _, s in out]})
            reply.out_seq += len(out)
        if forget:
            state.remove()
            return
        state.update((*astuple(reply), session, json.dumps([] if reply.closed else [(s, b.hex()) for s, b in names])))
        if ttl_seconds is not None:
            state.setTimeoutDuration(ttl_seconds * 1000)

    closed = _with_names(chunks, registry, sealed(F.col("original"), key, F.col("session_id")))
    cut = closed.groupBy("stream_id").applyInPandasWithState(
        step, _CUT_ROWS, Reply.SCHEMA + ", session string, known string", "append", GroupStateTimeout.NoTimeout if ttl_seconds is None else GroupStateTimeout.ProcessingTimeTimeout)
    content = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], opened(p["box"], key, F.col("session_id")))), "")
    quoted = F.to_json(F.struct(content.alias("c")))  # {"c":...}
    payload = F.concat("head", F.when(F.col("parts").isNull(), F.lit("")).otherwise(F.substring(quoted, F.lit(6), F.length(quoted) - 6)), "tail")
    return cut.select("stream_id", "out_seq", payload.alias("payload"), "status")
