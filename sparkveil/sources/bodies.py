"""JSON request bodies: validation, walking to text regions, rebuilding.

Bodies have any shape and must keep key order and number spelling, which typed
or variant columns do not, so walking and rebuilding are two small Arrow UDFs;
everything between them is relational.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATH = "array<struct<key:string,idx:int>>"
REGIONS = f"array<struct<path:{PATH},text:string>>"
#: Roles that are protocol words in messages[*].role.
PROTOCOL_ROLES = ("system", "user", "assistant", "tool", "function")


def _inner(path: tuple, text: str):
    """Container inside a string that is the last segment ``arguments``, else None."""
    if path and path[-1] == "arguments":
        try:
            value = json.loads(text)
        except ValueError:
            return None
        return value if isinstance(value, dict | list) else None
    return None


def walk(value, path: tuple = ()):
    """(path, text) of every string leaf, in document order; keys are never regions."""
    if isinstance(value, str):
        inner = _inner(path, value)
        if inner is None:
            yield path, value
        else:
            yield from walk(inner, path)
    elif isinstance(value, dict | list):
        for key, child in value.items() if isinstance(value, dict) else enumerate(value):
            yield from walk(child, (*path, key))


def rebuild(value, texts: dict, applied: set, path: tuple = ()):
    """A new body with the texts of ``texts`` (by path); ``applied`` gets the paths that were found."""
    if isinstance(value, str):
        inner = _inner(path, value)
        if inner is not None:
            before = len(applied)
            new = rebuild(inner, texts, applied, path)
            return json.dumps(new, ensure_ascii=False) if len(applied) > before else value
        if path in texts:
            applied.add(path)
            return texts[path]
        return value
    if isinstance(value, dict):
        return {k: rebuild(v, texts, applied, (*path, k)) for k, v in value.items()}
    if isinstance(value, list):
        return [rebuild(v, texts, applied, (*path, i)) for i, v in enumerate(value)]
    return value


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64)))), pa.int32())


#: Bodies whose regions are in Python at once; between them only Arrow buffers grow.
SLICE = 256


def _walk_slice(bodies: pa.Array) -> pa.Array:
    """Regions of some bodies as an Arrow array, made from flat columns."""
    regions, steps, texts, keys, places = [], [], [], [], []
    for body in bodies.to_pylist():
        try:
            found = list(walk(json.loads(body)))
        except (TypeError, ValueError):
            found = []
        regions.append(len(found))
        for path, text in found:
            steps.append(len(path))
            texts.append(text)
            keys += [p if isinstance(p, str) else None for p in path]
            places += [None if isinstance(p, str) else p for p in path]
    step = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.int32())], ["key", "idx"])
    region = pa.StructArray.from_arrays([pa.ListArray.from_arrays(_offsets(steps), step), pa.array(texts, pa.string())], ["path", "text"])
    return pa.ListArray.from_arrays(_offsets(regions), region)


def _rebuild_slice(bodies: pa.Array, changes: pa.Array) -> pa.Array:
    region, sizes = changes.flatten(), pc.fill_null(pc.list_value_length(changes), 0).to_pylist()
    path, new = region.field("path"), region.field("text").to_pylist()
    step, depths = path.flatten(), pc.fill_null(pc.list_value_length(path), 0).to_pylist()
    steps = [i if k is None else k for k, i in zip(step.field("key").to_pylist(), step.field("idx").to_pylist())]
    out, n_applied, n_unmatched, at, first = [], [], [], 0, 0
    for body, size in zip(bodies.to_pylist(), sizes):
        texts: dict = {}
        for i in range(first, first + size):
            texts[tuple(steps[at: at + depths[i]])] = new[i]
            at += depths[i]
        first += size
        applied: set = set()
        whole = rebuild(json.loads(body), texts, applied) if size else None
        out.append(json.dumps(whole, ensure_ascii=False) if applied else body)
        n_applied.append(len(applied))
        n_unmatched.append(len(texts) - len(applied))
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(n_applied, pa.int32()), pa.array(n_unmatched, pa.int32())], ["body", "applied", "unmatched"])


def _sliced(run: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    return pa.concat_arrays([run(*(c.slice(i, SLICE) for c in columns)) for i in range(0, max(1, len(columns[0])), SLICE)])


def walk_json(body) -> Column:
    """Text regions of each body; a body that is no JSON has none."""
    @F.arrow_udf(REGIONS)
    def regions_of(bodies: pa.Array) -> pa.Array:
        return _sliced(_walk_slice, bodies)

    return regions_of(body)


def rebuild_json(body, changes) -> Column:
    """struct<body, applied, unmatched>: bodies with changed regions (array of path and text) written back."""
    @F.arrow_udf("body string, applied int, unmatched int")
    def rebuilt(bodies: pa.Array, changes: pa.Array) -> pa.Array:
        return _sliced(_rebuild_slice, bodies, changes)

    return rebuilt(body, changes)


def request_status(body: Column, session_id: Column) -> Column:
    """``ok`` or why a request is refused before anything is detected."""
    parsed = F.try_parse_json(body)
    return F.when(session_id.isNull() | (session_id == ""), "missing_session").when(
        parsed.isNull() | ~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), "not_a_json_object").otherwise("ok")


def is_protocol_value(path: Column, text: Column) -> Column:
    """Whether a region is a role word at messages[any].role."""
    return (F.size(path) == 3) & (F.get(path, F.lit(0))["key"] == "messages") & (F.get(path, F.lit(2))["key"] == "role") & text.isin(*PROTOCOL_ROLES)


def text_regions(requests: DataFrame) -> DataFrame:
    """(session_id, request_seq, region_no, path, text) of valid requests, protocol words left out."""
    valid = requests.where(request_status(F.col("body"), F.col("session_id")) == "ok")
    region = valid.select("session_id", "request_seq", F.posexplode(walk_json("body")).alias("region_no", "r"))
    region = region.select("session_id", "request_seq", "region_no", "r.path", "r.text")
    return region.where(~F.coalesce(is_protocol_value(F.col("path"), F.col("text")), F.lit(False)))


def gateway_log(lines: DataFrame) -> DataFrame:
    """Rows of a text log (``value``, and ``line_no`` if there is one) that are JSON of the logger ``gateway``; noise is skipped."""
    schema = "logger string, event string, correlation_id string, timestamp_ms double, latency_ms double, tier int"
    number = [c for c in lines.columns if c == "line_no"]
    row = lines.select(*number, F.from_json("value", schema).alias("r")).select(*number, "r.*")
    return row.where("logger = 'gateway'")
