"""Candidate pools of the name-mapped types, and allocation of names to sessions.

Pools are built by crossing small word tables; the words are made from
syllables by rule. Allocation never crosses sessions with pools: the n-th name
of a session gets pool entry ``(a n + b) mod size``, where a (a prime that does
not divide the size) and b come from a digest of session and type. That is a
permutation of the pool for every session, looked up by an equi-join.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Syllables of the word tables; first and second halves of a word.
_FIRST = (("Ar", "Be", "Ca", "Di", "El", "Fa", "Ga", "Ha", "Is"), ("jan", "lin", "mar", "nel", "ros", "sim", "tor", "vik"))
_LAST = (("Bal", "Cor", "Dev", "Fen", "Gor", "Kal", "Men", "Nar", "Pal"), ("akar", "berg", "dano", "eshi", "ford", "ilan", "mont", "ova"))
_FIRM = (("Alto", "Brav", "Cert", "Dyna", "Ever", "Fort", "Gran", "Hori", "Indi", "Juni"), ("bank", "chem", "data", "food", "grid", "line", "tech"))
_KIND = (("Agro", "Auto", "Bio", "Build", "Care", "Cloud", "Craft", "Field", "Gas", "Home"), (" Ltd", " Corp", " Group", " Works", " Trust", " Labs", " Union"))
_STREET = (("Acacia", "Birch", "Cedar", "Date", "Elm", "Fig", "Guava", "Hazel", "Iris", "Jasmin"), (" Road", " Street", " Lane", " Avenue", " Way", " Cross", " Circle"))
_CITY = (("Ash", "Bright", "Clear", "Deep", "East", "Fair", "Green", "High", "Iron"), ("bury", "dale", "ford", "ham", "mere", "pur", "ton", "wick"))
PRIMES = (11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 73)
POOL_SIZES = {"PERSON": 72 * 71, "ORG": 70 * 70, "ADDRESS": 70 * 72}


def _words(spark: SparkSession, parts, name: str, limit: int) -> DataFrame:
    a, b = parts
    rows = [(i * len(b) + j, x + y) for i, x in enumerate(a) for j, y in enumerate(b)][:limit]
    return spark.createDataFrame(rows, f"{name}_no int, {name} string")


def candidate_pools(spark: SparkSession) -> DataFrame:
    """(entity_type, pos, candidate): 5,112 persons, 4,900 organisations, 5,040 addresses."""
    first, last = _words(spark, _FIRST, "a", 72), _words(spark, _LAST, "b", 71)
    firm, kind = _words(spark, _FIRM, "a", 70), _words(spark, _KIND, "b", 70)
    street, city = _words(spark, _STREET, "a", 70), _words(spark, _CITY, "b", 72)
    def crossed(kind_of: str, left: DataFrame, right: DataFrame, size: int, text) -> DataFrame:
        pos = F.col("a_no") * size + F.col("b_no")
        return left.crossJoin(F.broadcast(right)).select(F.lit(kind_of).alias("entity_type"), pos.alias("pos"), text(pos).alias("candidate"))
    house = lambda pos: (pos % 900 + 1).cast("string")
    return (
        crossed("PERSON", first, last, 71, lambda _: F.concat_ws(" ", "a", "b"))
        .unionByName(crossed("ORG", firm, kind, 70, lambda _: F.concat_ws(" ", "a", "b")))
        .unionByName(crossed("ADDRESS", street, city, 72, lambda pos: F.concat(house(pos), F.lit(" "), F.col("a"), F.lit(", "), F.col("b"))))
    )


def _step_and_start(session: Column, entity_type: Column) -> tuple[Column, Column]:
    """a and b of the session's permutation of a pool."""
    digest = F.md5(F.concat_ws("|", session, entity_type).cast("binary"))
    a = F.get(F.lit(list(PRIMES)), F.conv(F.substring(digest, 9, 1), 16, 10).cast("int"))
    return a, F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def candidate_at(session: str, entity_type: str, rank: int) -> str | None:
    """The candidate that the ``rank``-th name of a type in a session gets, outside of a table; None once the pool is exhausted."""
    size = POOL_SIZES[entity_type]
    if rank >= size:
        return None
    digest = hashlib.md5(f"{session}|{entity_type}".encode()).hexdigest()
    pos = (PRIMES[int(digest[8], 16)] * rank + int(digest[:8], 16)) % size
    left, right, width = {"PERSON": (_FIRST, _LAST, 71), "ORG": (_FIRM, _KIND, 70), "ADDRESS": (_STREET, _CITY, 72)}[entity_type]
    word = lambda parts, n: parts[0][n // len(parts[1])] + parts[1][n % len(parts[1])]
    first, second = word(left, pos // width), word(right, pos % width)
    return f"{pos % 900 + 1} {first}, {second}" if entity_type == "ADDRESS" else f"{first} {second}"


def _by_type(values: dict, entity_type: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[entity_type]


def pool_place(session: Column, entity_type: Column, rank: Column) -> Column:
    """Pool position of the ``rank``-th (from 0) name of a type in a session."""
    a, b = _step_and_start(session, entity_type)
    return ((a * rank + b) % _by_type(POOL_SIZES, entity_type)).cast("int")


def pool_rank(session: Column, entity_type: Column, pos: Column) -> Column:
    """Inverse of :func:`pool_place`: which name of its session got this place."""
    a, b = _step_and_start(session, entity_type)
    size = _by_type(POOL_SIZES, entity_type)
    inverse = {(t, p): pow(p, -1, n) for t, n in POOL_SIZES.items() for p in PRIMES}
    inverse = F.create_map(*[F.lit(x) for (t, p), v in inverse.items() for x in (f"{t}|{p}", v)])[F.concat_ws("|", entity_type, a.cast("string"))]
    return (F.pmod(pos - b, size) * inverse % size).cast("long")


def allocate_names(seen: DataFrame, pools: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """(session_id, real, entity_type, surrogate, seq, pos) for (session_id, real, entity_type, seq).

    A real name has one surrogate in its session, whatever its type later; the
    type seen first counts. Names that ``registry`` (session_id, surrogate,
    entity_type, original) knows keep theirs, new ones are ranked behind all
    that it handed out, so no surrogate is given twice in a session.
    ``surrogate`` is null once the pool is exhausted; ``pos`` is then the place
    that another name of the session holds.
    """
    first = seen.groupBy("session_id", "real").agg(F.min(F.struct("seq", "entity_type")).alias("f")).select(
        "session_id", "real", "f.seq", "f.entity_type")
    pools = F.broadcast(pools)  # of fixed size
    before = known = None
    if registry is not None:
        used = registry.where(F.col("entity_type").isin(*POOL_SIZES)).select(
            "session_id", "entity_type", F.col("original").alias("real"), F.col("surrogate").alias("candidate")).join(pools, ["entity_type", "candidate"])
        used = used.withColumn("rank", pool_rank(F.col("session_id"), F.col("entity_type"), F.col("pos")))
        known = used.groupBy("session_id", "real").agg(F.min(F.struct("rank", "candidate", "entity_type", "pos")).alias("k"))
        before = used.groupBy("session_id", "entity_type").agg((F.max("rank") + 1).alias("before"))
        kept = first.join(known, ["session_id", "real"]).select("session_id", "real", "k.entity_type", F.col("k.candidate").alias("surrogate"), "seq", "k.pos")
        first = first.join(known, ["session_id", "real"], "left_anti")
    rank = F.row_number().over(W.partitionBy("session_id", "entity_type").orderBy("seq", "real")) - 1
    ranked = first.withColumn("rank", rank.cast("long"))
    if before is not None:
        ranked = ranked.join(before, ["session_id", "entity_type"], "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0))).drop("before")
    placed = ranked.withColumn("pos", pool_place(F.col("session_id"), F.col("entity_type"), F.col("rank")))
    free = F.when(F.col("rank") < _by_type(POOL_SIZES, F.col("entity_type")), F.col("candidate"))
    named = placed.join(pools, ["entity_type", "pos"], "left").select("session_id", "real", "entity_type", free.alias("surrogate"), "seq", "pos")
    return named if known is None else named.unionByName(kept)

