"""Sessions as keyed state of a stream: expiry, first log lines, and names handed out while requests arrive.

State is that of ``transformWithState``; it needs the RocksDB state store, which
:func:`keyed_state` sets for the session. State never holds an original: names
are known by keyed digests and surrogates only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sparkveil.operators import detect, domains, pools
from sparkveil.operators.sanitize import MAX_REGIONS, _key_status
from sparkveil.operators.sealing import _session_key, sealed, tag
from sparkveil.sources import bodies

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Streams of this module keep their state in RocksDB."""
    spark.conf.set(_PROVIDER, ROCKS)


def _joined(rows: Iterator[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    """Some columns of a group: most groups have a few rows, so no table is built or sorted for each."""
    parts = list(rows)
    return [np.concatenate([p[c].to_numpy() for p in parts]) if len(parts) > 1 else parts[0][c].to_numpy() for c in columns]


# ---------------------------------------------------------------- session store


class SessionStore(StatefulProcessor):
    """The last access of a session; it goes when the watermark has passed its time to live."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_us long")

    def _wait(self, at_us: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at_us // 1000 + self.ttl_ms + 1)  # an access exactly at the limit is in time

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at_us, accesses = _joined(rows, "at_us", "access_id")  # of one session in one micro-batch
        order = np.lexsort((accesses, at_us))
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for at, access in zip(at_us[order], accesses[order]):
            fresh = last is None or at - last > self.ttl_ms * 1000
            out.append((key[0], int(access), "created" if fresh else "touched", int(at)))
            last = int(at) if fresh else max(last, int(at))
        self.last.update((last,))
        self._wait(last)
        yield pd.DataFrame(out, columns=["session_id", "access_id", "event", "at_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None:
            self.last.clear()
            yield pd.DataFrame([(key[0], None, "expired", last)], columns=["session_id", "access_id", "event", "at_us"])

    def close(self) -> None:
        pass


def session_store(accesses: DataFrame, ttl_seconds: float, late_seconds: int = 3600) -> DataFrame:
    """(session_id, access_id, event, at_us) of a stream of accesses (session_id, access_id, ts).

    ``created`` begins a session, ``touched`` finds it alive: it lives through a
    gap of ``ttl_seconds`` and not longer. ``expired`` follows once the watermark
    has passed that, without an access; its state is gone then. Accesses may come
    ``late_seconds`` late; those of one session are taken in order within a micro-batch.
    """
    keyed_state(accesses.sparkSession)
    timed = accesses.withWatermark("ts", f"{late_seconds} seconds").select("session_id", "access_id", F.unix_micros("ts").alias("at_us"), "ts")
    return timed.groupBy("session_id").transformWithStateInPandas(
        SessionStore(round(ttl_seconds * 1000)), "session_id string, access_id long, event string, at_us long", "append", "eventtime")


# ---------------------------------------------------------------- first log lines


class FirstLine(StatefulProcessor):
    """Whether a request has had its first line of an event; forgotten when the watermark is past."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "line_no long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        number, latency, at_ms = _joined(rows, "line_no", "latency_ms", "at_ms")
        if not self.seen.exists():
            first = np.argsort(number, kind="stable")[0]  # a null number is last
            self.seen.update((int(number[first]),))
            yield pd.DataFrame({"correlation_id": [key[0]], "event": [key[1]], "line_no": [int(number[first])], "latency_ms": latency[first: first + 1]})
        self.handle.registerTimer(int(at_ms.max()) + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not list(self.handle.listTimers()):
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_log_lines(lines: DataFrame, keep_seconds: int = 3600, late_seconds: int = 3600) -> DataFrame:
    """(correlation_id, event, line_no, latency_ms) of the first line of each request and event in a stream of log lines.

    ``lines`` has correlation_id, event, line_no, latency_ms and ts. Lines that
    come again, or later with another stamp, write nothing; a request is
    remembered for ``keep_seconds`` after its last line.
    """
    keyed_state(lines.sparkSession)
    timed = lines.where("correlation_id is not null and event is not null").withWatermark("ts", f"{late_seconds} seconds")
    timed = timed.select("correlation_id", "event", "line_no", "latency_ms", (F.unix_micros("ts") / 1000).cast("long").alias("at_ms"), "ts")
    return timed.groupBy("correlation_id", "event").transformWithStateInPandas(
        FirstLine(keep_seconds * 1000), "correlation_id string, event string, line_no long, latency_ms double", "append", "eventtime")


# ---------------------------------------------------------------- sanitising

_SPAN = "struct<start:int,end:int,entity_type:string,tag:string,box:binary,structured:string,structured_tag:string>"
_GIVEN = "array<struct<surrogate:string,entity_type:string,original:binary,tag:string,seq:long>>"
_OUT = f"session_id string, request_seq long, body string, status string, changes array<struct<path:{bodies.PATH},text:string>>, given {_GIVEN}"


class SessionNames(StatefulProcessor):
    """Names and surrogates of a session; requests are taken in the order of request_seq within a micro-batch.

    ``names``: digest of a name to its surrogate. ``ranks``: names so far by
    type. ``minted``: digest of a surrogate to the seq it came from, and whether
    it was handed out. ``requests``: the request_seqs that came. All by digests.
    """

    def init(self, handle) -> None:
        self.names = handle.getMapState("names", "tag string", "surrogate string")
        self.ranks = handle.getMapState("ranks", "entity_type string", "n long")
        self.minted = handle.getMapState("minted", "tag string", "since long, handed boolean")
        self.requests = handle.getMapState("requests", "request_seq long", "seen boolean")

    def _tag(self, key: bytes, value: str) -> str:
        return hashlib.sha256(key + value.encode()).hexdigest()[:32]

    def _mint(self, mark: str, seq: int, handed: bool) -> bool:
        """Note a surrogate; whether it is handed out for the first time."""
        old = self.minted.getValue((mark,)) if self.minted.containsKey((mark,)) else None
        since, before = (min(old[0], seq), old[1]) if old else (seq, False)
        if old is None or (since, before or handed) != old:
            self.minted.updateValue((mark,), (since, before or handed))
        return handed and not before

    def _allocate(self, session: str, tag_key: bytes, spans: list, seq: int) -> None:
        new: dict[str, str] = {}
        for s in spans:
            if s["entity_type"] in detect.MODEL_TYPES and not self.names.containsKey((s["tag"],)):
                new[s["tag"]] = min(new.get(s["tag"], s["entity_type"]), s["entity_type"])
        for mark in sorted(new, key=lambda t: (new[t], t)):
            kind = new[mark]
            rank = self.ranks.getValue((kind,))[0] if self.ranks.containsKey((kind,)) else 0
            surrogate = pools.candidate_at(session, kind, rank)
            self.ranks.updateValue((kind,), (rank + 1,))
            self.names.updateValue((mark,), (surrogate or "",))
            if surrogate:
                self._mint(self._tag(tag_key, surrogate), seq, False)

    def _region(self, session: str, tag_key: bytes, text: str | None, spans: list, seq: int) -> tuple[str | None, str | None, list]:
        """(new text, why it is refused, surrogates handed out)."""
        self._allocate(session, tag_key, spans, seq)
        for s in spans:
            if s["structured"] is not None:
                self._mint(s["structured_tag"], seq, False)
        out, at, given, refused = [], 0, [], []
        for s in sorted(spans, key=lambda s: s["start"]):
            if self.minted.containsKey((s["tag"],)) and self.minted.getValue((s["tag"],))[0] < seq:
                continue  # a surrogate that comes back
            named = s["entity_type"] in detect.MODEL_TYPES
            new = self.names.getValue((s["tag"],))[0] or None if named else s["structured"]
            if new is None:
                refused.append(("name_list_exhausted:" if named else "surrogate_domain:") + s["entity_type"])
                continue
            if self._mint(self._tag(tag_key, new) if named else s["structured_tag"], seq, True):
                given.append({"surrogate": new, "entity_type": s["entity_type"], "original": s["box"], "tag": s["tag"], "seq": seq})
            out += text[at: s["start"]], new
            at = s["end"]
        return (None if refused else "".join(out) + text[at:] if text is not None else None), min(refused, default=None), given

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        session, whole = key[0], pd.concat(list(rows))  # the requests of one session in one micro-batch
        out = []
        for request_seq, region in whole.groupby("request_seq", sort=True):
            request_seq, region = int(request_seq), region.sort_values("region_no", kind="stable")
            first = region.iloc[0]
            status, changes, given = first["status"], [], []
            twice = self.requests.containsKey((request_seq,)) or region["copy"].nunique() > 1
            self.requests.updateValue((request_seq,), (True,))
            if twice:
                status = "repeated_seq"
            elif status == "ok":
                reasons = []
                for text, path, spans, number, failed in zip(region["text"], region["path"], region["spans"], region["region_no"], region["failed"]):
                    if number < 0:
                        continue
                    new, refused, handed = self._region(session, bytes(first["tag_key"]), text, list(spans), request_seq * MAX_REGIONS + int(number))
                    reasons += [r for r in (refused, failed) if r]
                    given += handed
                    if new is not None and new != text:
                        changes.append({"path": list(path), "text": new})
                status = min(reasons, default="ok")
            ok = status == "ok"
            out.append((session, request_seq, first["body"] if ok else None, status, changes if ok else [], given))
        yield pd.DataFrame(out, columns=["session_id", "request_seq", "body", "status", "changes", "given"])

    def close(self) -> None:
        pass


def sanitize_stream(requests: DataFrame, key: Column, model=None) -> DataFrame:
    """(session_id, request_seq, body, status, given) of a stream of requests, one row each.

    Equals :func:`sanitize.sanitize_requests` if the requests of a session come in
    the order of request_seq, however they are cut into micro-batches: names and
    surrogates are state of the session, nothing is read again. ``given`` are the
    surrogates handed out by the request, originals sealed. A request_seq that
    came before is refused; the first is out by then. ``model`` makes the model
    column of a text column.
    """
    keyed_state(requests.sparkSession)
    status = F.coalesce(_key_status(F.col("session_id"), F.col("request_seq")), bodies.request_status(F.col("body"), F.col("session_id")))
    whole = requests.select(F.col("session_id").cast("string"), F.col("request_seq").cast("long"), "body", status.alias("status"))
    refused = whole.where("session_id is null or session_id = '' or request_seq is null").select(
        "session_id", "request_seq", F.lit(None).cast("string").alias("body"), "status", F.lit(None).cast(_GIVEN).alias("given"))
    valid = whole.where("session_id is not null and session_id != '' and request_seq is not null").withColumn("copy", F.expr("uuid()"))
    region = valid.select("session_id", "request_seq", "body", "status", "copy", F.posexplode_outer(F.when(F.col("status") == "ok", bodies.walk_json("body"))).alias("region_no", "r"))
    region = region.select("session_id", "request_seq", "status", "copy", F.when(F.coalesce("region_no", F.lit(0)) == 0, F.col("body")).alias("body"),
                           F.coalesce("region_no", F.lit(-1)).alias("region_no"), "r.path", "r.text")
    protocol = F.coalesce(bodies.is_protocol_value(F.col("path"), F.col("text")), F.lit(False))
    judged = region.withColumn("_model", model(F.col("text"))) if model else region.withColumn("_model", F.lit(None).cast(f"struct<spans:{detect.SPANS},error:string>"))
    found = F.concat(detect.deterministic_spans(F.coalesce("text", F.lit(""))), F.coalesce("_model.spans", F.array().cast(detect.SPANS)))
    judged = judged.withColumn("_spans", F.when(protocol | F.col("_model.error").isNotNull(), F.array().cast(detect.SPANS)).otherwise(detect.resolve(found)))
    session = F.col("session_id")
    value = lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
    judged = judged.withColumn("_own", domains.surrogates(F.col("text"), F.col("_spans"), key))

    def described(s: Column, n: Column) -> Column:
        own = F.get("_own", n)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"), tag(value(s), key, session).alias("tag"),
                        sealed(value(s), key, session).alias("box"), own.alias("structured"), tag(own, key, session).alias("structured_tag"))

    rows = judged.select("session_id", "request_seq", "status", "copy", "body", "region_no", "path", "text",
                         F.when(~protocol & F.col("_model.error").isNotNull(), F.concat(F.lit("model_failed:"), "_model.error")).alias("failed"),
                         F.transform("_spans", described).cast(f"array<{_SPAN}>").alias("spans"), _session_key(key, session, "tag").alias("tag_key"))
    out = rows.groupBy("session_id").transformWithStateInPandas(SessionNames(), _OUT, "append", "none")
    rebuilt = bodies.rebuild_json("body", "changes")["body"]
    out = out.select("session_id", "request_seq", F.when(F.col("status") == "ok", rebuilt).alias("body"), "status", "given")
    return out.unionByName(refused)
