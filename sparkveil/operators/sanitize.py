"""Sanitising and rehydrating tables of texts and of JSON bodies.

``sanitize`` exchanges every detected span for a surrogate; ``rehydrate`` puts
the originals back wherever a surrogate of the session stands in a text. Spans
are exploded for the lookups and spliced back in one aggregate per text. A text
goes out only with the status ``ok``, which it gets on proof: it was judged, and
every span has a surrogate. All else has a status that says why, without the
value, and no output. A body is refused with any of its regions.

Originals are sealed (:mod:`sealing`) wherever a table is written, the registry
included, and looked up by keyed digests.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.text import splice
from sparkveil.operators import detect, domains, pools
from sparkveil.operators.sealing import opened, sealed, tag
from sparkveil.sources import bodies
from sparkveil.sources.scratch import written

#: Columns of a registry; ``original`` is sealed, ``tag`` its keyed digest.
REGISTRY = ("session_id", "surrogate", "entity_type", "original", "tag", "seq")
#: Places of a text.
PLACES = "array<struct<start:int,length:int>>"
#: Regions of a body are numbered below this.
MAX_REGIONS = 1_000_000


def _key_status(session: Column, seq: Column) -> Column:
    """Why a row without a session or an order is refused; null for others."""
    return F.when(session.isNull() | (session == ""), "missing_session").when(seq.isNull(), "missing_seq")


def judged_spans(texts: DataFrame, key: Column, model: Column | None) -> DataFrame:
    """A row for each span, or one without a span, of every text: session_id, seq, _row, failed, s, entity_type, tag, box, structured.

    ``box`` is the sealed value. A text whose model failed has ``failed`` and no span. The table is written,
    in the one pass that runs the model, so it runs once a text.
    """
    session = F.col("session_id")
    rows = texts.withColumn("_row", F.monotonically_increasing_id())
    if model is None:
        found = detect.detect(rows).withColumn("failed", F.lit(None).cast("string"))
    else:
        judged = rows.withColumn("_model", model)
        failed = F.col("_model.error").isNotNull()
        found = detect.detect(judged, model=F.col("_model.spans"), skipped=failed).withColumn("failed", F.when(failed, F.concat(F.lit("model_failed:"), "_model.error")))
    span = found.select("session_id", "seq", "_row", "failed", "text", F.explode_outer("spans").alias("s"))
    value = F.expr("substring(text, s.start + 1, s.end - s.start)")
    span = span.withColumn("_value", value).select(
        "session_id", "seq", "_row", "failed", "s", F.col("s.entity_type").alias("entity_type"), tag(F.col("_value"), key, session).alias("tag"),
        sealed(F.col("_value"), key, session).alias("box"), domains.surrogate(F.col("s.entity_type"), F.col("_value"), key).alias("structured"))
    return written(span, "spans")  # read by four lookups


def sanitize(texts: DataFrame, key: Column, model: Column | None = None, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the texts of :func:`sanitized_texts`, registry of surrogates handed out)."""
    out, given = _exchanged(texts, key, model, registry)
    return out, written(given, "registry")  # the next batch reads it, and must not compute this one again


def sanitized_texts(texts: DataFrame, key: Column, model: Column | None = None, registry: DataFrame | None = None) -> DataFrame:
    """Texts with ``sanitized``, ``status`` and ``kept``; the registry of what they were given is neither computed nor written.

    ``texts`` has session_id, seq (a long, unique in the session, its order) and
    text; a row without session or seq is refused, and so are all rows of a seq
    that occurs twice. ``model`` is a struct<spans, error> of
    :func:`detect.model_spans`; a row with an error is refused. A span whose text
    is a surrogate handed out earlier in the session, by ``registry`` or by a
    smaller seq, is left alone; ``kept`` has its places in ``sanitized``, by which
    :func:`rehydrate` restores the text even if the span was a value of its own that
    equals a surrogate by chance. A null text has no spans and stays null.
    """
    return _exchanged(texts, key, model, registry)[0]


def _exchanged(texts: DataFrame, key: Column, model: Column | None, registry: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(sanitised texts, registry of surrogates handed out); the registry is not written."""
    spark, session = texts.sparkSession, F.col("session_id")
    marked = texts.withColumn("status", _key_status(session, F.col("seq")))
    named_rows = marked.where("status is null").drop("status")
    judged = judged_spans(named_rows.select("session_id", "seq", "text"), key, model)
    span = judged.where("s is not null")
    is_name = F.col("entity_type").isin(*detect.MODEL_TYPES)
    names = pools.allocate_names(
        span.where(is_name).select("session_id", F.col("tag").alias("real"), "entity_type", "seq"), pools.candidate_pools(spark),
        None if registry is None else registry.select("session_id", "surrogate", "entity_type", F.col("tag").alias("original")))
    minted = span.where("structured is not null").select("session_id", F.col("structured").alias("value"), F.col("seq").alias("since"))
    minted = minted.unionByName(names.where("surrogate is not null").select("session_id", F.col("surrogate").alias("value"), F.col("seq").alias("since")))
    if registry is not None:
        minted = minted.unionByName(registry.select("session_id", F.col("surrogate").alias("value"), F.lit(None).cast("long").alias("since")))
    minted = minted.groupBy("session_id", tag(F.col("value"), key, session).alias("tag")).agg(F.min(F.coalesce("since", F.lit(-(2**62)))).alias("since"))
    named = names.select("session_id", F.col("real").alias("tag"), F.col("surrogate").alias("name"))
    span = judged.join(minted, ["session_id", "tag"], "left").join(named, ["session_id", "tag"], "left")
    span = span.withColumn("ingress", F.coalesce(F.col("since") < F.col("seq"), F.lit(False))).withColumn("new", F.when(is_name, F.col("name")).otherwise(F.col("structured")))
    refused = F.when(F.col("s").isNotNull() & ~F.col("ingress") & F.col("new").isNull(), F.concat(
        F.when(is_name, "name_list_exhausted:").otherwise("surrogate_domain:"), "entity_type"))
    exchanged = F.when(F.col("s").isNotNull() & ~F.col("ingress"), F.struct("s.start", "s.end", "new"))
    left = F.when(F.col("s").isNotNull() & F.col("ingress"), F.struct("s.start", "s.end"))
    whole = span.groupBy("session_id", "seq").agg(
        F.array_sort(F.collect_list(exchanged)).alias("spans"), F.collect_list(left).alias("left"), F.min(refused).alias("error"), F.min("failed").alias("failed"),
        (F.min("_row") < F.max("_row")).alias("repeated"))
    proven = F.when(F.col("repeated"), "repeated_seq").otherwise(F.coalesce("failed", "error", F.when(F.col("spans").isNotNull(), "ok"), F.lit("not_judged")))
    out = named_rows.join(whole, ["session_id", "seq"], "left").withColumn("status", proven)
    spliced = F.when(F.col("status") == "ok", F.when(F.size("spans") == 0, F.col("text")).otherwise(splice(F.col("text"), F.col("spans"), lambda s: s["new"])))
    moved = lambda at: F.aggregate(F.filter("spans", lambda s: s["start"] < at), at, lambda n, s: n + F.length(s["new"]) - (s["end"] - s["start"]))
    kept = F.when((F.col("status") == "ok") & (F.size("left") > 0), F.transform("left", lambda x: F.struct(moved(x["start"]).alias("start"), (x["end"] - x["start"]).alias("length"))))
    out = out.withColumns({"sanitized": spliced, "kept": kept.cast(PLACES)}).select(*texts.columns, "sanitized", "status", "kept")
    refused = marked.where("status is not null").withColumns({"sanitized": F.lit(None).cast("string"), "kept": F.lit(None).cast(PLACES)})
    out = out.unionByName(refused.select(*texts.columns, "sanitized", "status", "kept"))
    given = span.where("s is not null and not ingress and new is not null").groupBy("session_id", F.col("new").alias("surrogate")).agg(
        F.min(F.struct("seq", "entity_type", "tag", "box")).alias("f"))
    return out, given.select("session_id", "surrogate", "f.entity_type", F.col("f.box").alias("original"), "f.tag", "f.seq")


def decrypt_registry(registry: DataFrame, key: Column) -> DataFrame:
    """Registry with its originals in the open, for the lookups of :func:`rehydrate`; not to be written.

    Structured originals come from the surrogates themselves, names from their sealed column.
    """
    plain = domains.surrogate(F.col("entity_type"), F.col("surrogate"), key, decrypt=True)
    name = opened(F.col("original"), key, F.col("session_id"))
    return registry.withColumn("original", F.when(F.col("entity_type").isin(*domains.SURROGATE_TYPES), plain).otherwise(name))


def known_surrogates(registry: DataFrame) -> DataFrame:
    """(session_id, surrogate, original) of each surrogate of a session; the original is null if none or more than one is known."""
    one = registry.groupBy("session_id", "surrogate").agg(F.min("original").alias("lo"), F.max("original").alias("hi"))
    return one.select("session_id", "surrogate", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("original"))


#: Characters of a surrogate's beginning by whose kinds a text is searched first; kinds of surrogates that are told apart.
OPENING, MOST_SHAPES = 4, 5000
#: Code points of texts that are searched together, but for a longer text.
TOGETHER = 1 << 18


def shape(text: Column) -> Column:
    """Kinds of the characters of a text: a digit, an upper-case or a lower-case letter of ASCII, anything else."""
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    plain = F.regexp_replace(text, "[^0-9A-Za-z]", "_")
    return F.translate(plain, letters + letters.upper() + digits + "_", "l" * 26 + "u" * 26 + "D" * 10 + "o")


_KINDS = {"o": 0, "l": 1, "u": 2, "D": 3}
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2 ** 64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _kinds(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), dtype=np.uint64)
    for kind, low, high in ((1, 97, 122), (2, 65, 90), (3, 48, 57)):
        out[(points >= low) & (points <= high)] = kind
    return out


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class Shapes:
    """Finds where a text holds something of the shape of a surrogate, by rolling fingerprints of character kinds."""

    def __init__(self, shapes: Iterable[str] | None, lengths: Iterable[int] = ()):
        self.by_length: dict[int, np.ndarray | None] = {}
        if shapes is None:  # too many to tell apart: every place of each length
            self.by_length, self.openings = dict.fromkeys(lengths), None
            return
        by: dict[int, list] = {}
        openings: dict[int, list] = {}
        for s in shapes:
            kinds = np.array([_KINDS[c] for c in s], dtype=np.uint64)
            for store, part in ((by, kinds), (openings, kinds[:OPENING])):
                store.setdefault(len(part), []).append(self._whole(part))
        self.by_length = {n: np.array(sorted(set(v)), dtype=np.uint64) for n, v in by.items()}
        self.openings = {n: np.array(sorted(set(v)), dtype=np.uint64) for n, v in openings.items()}

    @staticmethod
    def _whole(kinds: np.ndarray) -> int:
        with np.errstate(over="ignore"):
            return int((kinds * _powers(_BASE, len(kinds))).sum(dtype=np.uint64))

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, length) of every stretch of a known shape in these texts, searched as one sequence of code points."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        if not whole or not self.by_length:
            return (np.zeros(0, dtype=np.int64),) * 3
        n, end = len(whole), np.cumsum(size)
        row = np.repeat(np.arange(len(texts)), size)
        room = end[row] - np.arange(n)  # signs up to the end of the text
        kinds = _kinds(_code_points(whole))
        with np.errstate(over="ignore"):
            upto = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(kinds * _powers(_BASE, n), dtype=np.uint64)))
            back = _powers(_INVERSE, n)
            window = lambda at, size: (upto[at + size] - upto[at]) * back[at]
            if self.openings is None:
                begin = np.arange(n)
            else:
                opens = np.zeros(n, dtype=bool)
                for length, known in self.openings.items():
                    at = np.flatnonzero(room >= length)
                    opens[at[np.isin(window(at, length), known)]] = True
                begin = np.flatnonzero(opens)
            found = []
            for length, known in self.by_length.items():
                at = begin[room[begin] >= length]
                if known is not None and len(at):
                    at = at[np.isin(window(at, length), known)]
                found.append((at, np.full(len(at), length)))
        at, length = (np.concatenate(x) for x in zip(*found))
        return row[at], at - (end - size)[row[at]], length


def restored_text(text: str, hits: list[tuple[int, int, str | None]], kept: Iterable[tuple[int, int]] = ()) -> str:
    """``text`` with the longest hit (start, length, original) at each place put back, from the left, in one pass.

    A stretch (start, length) of ``kept`` stays as it is, whatever hit overlaps it.
    """
    out, at = [], 0
    for start, length, original in sorted(hits, key=lambda h: (h[0], -h[1])):
        if start < at or any(a < start + length and start < a + n for a, n in kept):
            continue
        if original is None:
            raise ValueError("a surrogate without exactly one original: the name map is broken")
        out += text[at:start], original
        at = start + length
    return "".join(out) + text[at:]


def surrogate_hits(texts: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """(session_id, _text, start, length, original): where a surrogate of its session stands in a text; ``_text`` is the text's hash.

    A text offers the stretches that have the shape of some surrogate; an
    equi-join by session and stretch leaves the surrogates. Neither a session
    nor a text meets the whole of the other in one row.
    """
    named = known.where(F.length("surrogate") > 0)
    shapes = [r[0] for r in named.select(shape(F.col("surrogate"))).distinct().limit(MOST_SHAPES + 1).collect()]
    if len(shapes) > MOST_SHAPES:
        finder = Shapes(None, [r[0] for r in named.select(F.length("surrogate")).distinct().collect()])
    else:
        finder = Shapes(shapes)

    names = ["session_id", "_text", "start", "length", "surrogate"]

    def run(batches):
        for batch in batches:
            bodies = batch.column(2).to_pylist()
            upto = np.cumsum([len(t) for t in bodies]) // TOGETHER
            for part in np.split(np.arange(len(bodies)), np.flatnonzero(np.diff(upto)) + 1):
                texts = [bodies[i] for i in part]
                row, start, length = finder.places(texts)
                for k in range(0, len(row), 1 << 16):
                    r, a, n = (x[k: k + (1 << 16)] for x in (row, start, length))
                    value = [texts[i][x: x + y] for i, x, y in zip(r.tolist(), a.tolist(), n.tolist())]
                    at = pa.array(part[r])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(a, pa.int32()), pa.array(n, pa.int32()), pa.array(value, pa.string())], names)

    asked = texts.where(F.col(text).isNotNull() & F.col("session_id").isNotNull()).select("session_id", F.col(text).alias("_body")).distinct()
    asked = asked.select("session_id", F.xxhash64("_body").alias("_text"), "_body")
    stretch = asked.mapInArrow(run, f"session_id {asked.schema['session_id'].dataType.simpleString()}, _text long, start int, length int, surrogate string")
    return stretch.join(named, ["session_id", "surrogate"]).select("session_id", "_text", "start", "length", "original")


def rehydrate(texts: DataFrame, registry: DataFrame, text: str = "text", kept: str | None = None) -> DataFrame:
    """Adds ``rehydrated``: every surrogate of the text's session put back, longest first, in one pass from the left.

    ``registry`` has its originals in the open. A surrogate in a text that has
    no original, or more than one, is an error. ``kept`` names the column of
    :func:`sanitize` with the places that it left alone: they stay.
    """
    @F.arrow_udf("string")
    def restored(column: pa.Array, hits: pa.Array, places: pa.Array) -> pa.Array:
        return pa.array([t if h is None else restored_text(t, [(x["start"], x["length"], x["original"]) for x in h], [(x["start"], x["length"]) for x in k or ()])
                         for t, h, k in zip(column.to_pylist(), hits.to_pylist(), places.to_pylist())], pa.string())

    hits = surrogate_hits(texts, known_surrogates(registry), text).groupBy("session_id", "_text").agg(
        F.collect_list(F.struct("start", "length", "original")).alias("_hits"))  # the hits of one text
    joined = texts.withColumn("_text", F.xxhash64(F.col(text))).join(hits, ["session_id", "_text"], "left").select(*texts.columns, "_hits")
    back = restored(F.col(text), F.col("_hits"), F.col(kept) if kept else F.lit(None).cast(PLACES))
    return joined.withColumn("rehydrated", F.when(F.col("_hits").isNull(), F.col(text)).otherwise(back)).drop("_hits")


# ---------------------------------------------------------------- bodies


def _rebuilt(whole: DataFrame, region: DataFrame, keys: list[str], new: str) -> DataFrame:
    """``whole`` with ``body`` rebuilt from the regions whose text changed."""
    changed = region.where(F.col(new).isNotNull() & (F.col(new) != F.col("text")))
    change = changed.groupBy(*keys).agg(F.collect_list(F.struct("path", F.col(new).alias("text"))).alias("_changes"))
    joined = whole.join(change, keys, "left")
    rebuilt = bodies.rebuild_json("body", F.coalesce("_changes", F.array().cast(f"array<struct<path:{bodies.PATH},text:string>>")))
    return joined.withColumn("body", F.when(F.col("_changes").isNull(), F.col("body")).otherwise(rebuilt["body"])).drop("_changes")


def _written_sealed(df: DataFrame, name: str, columns: tuple[str, ...], key: Column) -> DataFrame:
    """``df`` written with some columns sealed, read back with them open."""
    session = F.col("session_id")
    back = written(df.withColumns({c: sealed(F.col(c), key, session) for c in columns}), name)
    return back.withColumns({c: opened(F.col(c), key, session) for c in columns})


def sent_texts(out: DataFrame, key: Column) -> DataFrame:
    """Sanitised texts without those that came in, written: :func:`rehydrate` reads its texts twice, and must not sanitise them twice."""
    return _written_sealed(out.drop("text"), "sent", ("sanitized",), key)


def sanitize_requests(requests: DataFrame, key: Column, model=None, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(session_id, request_seq, body, status) of every request, and the registry of surrogates handed out.

    ``requests`` has session_id, request_seq and body. All text regions but
    protocol words are sanitised; one refused region refuses the body, which is
    null then, and so is a body without request_seq, or with one that occurs
    twice. ``model`` makes the model column of a text column.
    """
    keys = ["session_id", "request_seq"]
    region = bodies.text_regions(requests).withColumn("seq", F.col("request_seq").cast("long") * MAX_REGIONS + F.col("region_no"))
    region = _written_sealed(region, "regions", ("text",), key)
    clean, given = sanitize(region, key, model(F.col("text")) if model else None, registry)
    clean = _written_sealed(clean, "clean-regions", ("text", "sanitized"), key)
    refused = clean.where("status != 'ok'").groupBy(*keys).agg(F.min("status").alias("refused"))
    status = F.when(F.col("request_seq").isNull(), "missing_seq").otherwise(bodies.request_status(F.col("body"), F.col("session_id")))
    status = F.coalesce(_key_status(F.col("session_id"), F.col("request_seq")), status)
    twice = requests.where("session_id is not null and request_seq is not null").groupBy(*keys).agg((F.count("*") > 1).alias("twice")).where("twice")
    whole = requests.select(*keys, "body", status.alias("status")).join(refused, keys, "left").join(twice, keys, "left")
    whole = whole.withColumn("status", F.when(F.col("twice"), "repeated_seq").otherwise(F.coalesce("refused", "status"))).drop("refused", "twice")
    whole = _rebuilt(whole, clean, keys, "sanitized")
    return whole.withColumn("body", F.when(F.col("status") == "ok", F.col("body"))), given


def rehydrate_replies(replies: DataFrame, registry: DataFrame) -> DataFrame:
    """(session_id, request_seq, http_status, body): JSON objects of 2xx replies with every surrogate put back, others as they came."""
    keys = ["session_id", "request_seq"]
    parsed = F.try_parse_json("body")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    restored = replies.where((F.floor(F.col("http_status") / 100) == 2) & is_object)
    region = restored.select(*keys, F.explode(bodies.walk_json("body")).alias("r")).select(*keys, "r.path", "r.text")
    region = rehydrate(region, registry)
    return _rebuilt(replies.select(*keys, "http_status", "body"), region, keys, "rehydrated")
