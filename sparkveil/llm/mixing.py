"""Operator 12: mix sources to target weights by hash-threshold histograms.

Each source has a budget of words, its target. Whole passes over the source are
taken as often as the target holds its size; what is left of the target goes to
the documents whose hash lies below a threshold. The threshold is found without
sorting: words are summed by source and hash bucket, the bucket in which the
running sum passes the budget is refined by the next bits of the hash, and only
its rows are read again, until the bucket is one hash. A document longer than
the rest of the budget ends a threshold early, so the search is repeated for
what is left among the documents that still fit; each of the rounds adds a pair
(longest size, threshold) to its source, and a document is taken if it meets one
of the pairs. A smaller budget meets its pairs with a part of the documents that
a larger one takes in its first round: mixes are nested.

Targets: all words are shared out by weight, no source above ``max_repeats``
times its own size; what exceeds that is shared again by weight.

Defined cases: a null text has no words, such documents are never taken; very
long texts count whole; rows equal in id and text have one hash and are taken
together; a null doc_id counts as empty; a null source is a source; sources
without a weight, or with one that is not positive, get the target 0; an empty
table gives no rows; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_hot, save

#: Times that a document may be taken.
MAX_REPEATS = 3
#: Rounds in which the rest of a budget looks for documents that fit; the rest about halves each time, or better.
ROUNDS = 4
#: Bits of the hash, and bits that one histogram tells apart.
HASH_BITS, LEVEL_BITS = 60, 12
WORD = r"[^\x20\x09-\x0D]+"
_TAKEN = "array<struct<longest:long,below:long>>"


def source_key(source: Column) -> Column:
    """A text for every source, null included."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def document_hash(seed: str = "") -> Column:
    """60 bits of a digest of ``seed``, doc_id and text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, seed: str = "") -> DataFrame:
    """``docs`` with ``_key``, ``_size`` and ``_hash``."""
    return docs.withColumns({"_key": source_key(F.col("source")), "_size": F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long"),
                             "_hash": document_hash(seed)})


def targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds ``target`` to one row a source (_key, source_size, weight).

    Each round caps the sources that their share would fill more than
    ``max_repeats`` times and shares the rest by weight; it ends when none is above.
    """
    cap = F.col("source_size") * max_repeats
    counted = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(0))
    state = save(sizes.select("*", counted.alias("_weight"), (counted <= 0).alias("_full")), "mix-sources")
    total = state.agg(F.sum("source_size")).first()[0] or 0
    while True:
        capped, weights = state.agg(F.coalesce(F.sum(F.when(F.col("_full") & (F.col("_weight") > 0), cap)), F.lit(0)),
                                    F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_weight"))), F.lit(0))).first()
        share = (total - capped) / weights if weights else 0.0
        above = ~F.col("_full") & (F.lit(float(share)) * F.col("_weight") > cap)
        if not weights or not state.where(above).limit(1).count():
            break
        state = save(state.withColumn("_full", F.col("_full") | above), "mix-sources")
    target = F.when(F.col("_weight") <= 0, 0.0).when(F.col("_full"), cap.cast("double")).otherwise(F.lit(float(share)) * F.col("_weight"))
    return state.withColumn("target", target.cast("double")).drop("_weight", "_full")


def is_taken(pairs: Column, size: Column, at: Column) -> Column:
    """Whether a document of this size and hash meets one of the pairs."""
    return F.exists(pairs, lambda p: (size <= p["longest"]) & (at < p["below"]))


def _boundary(rows: DataFrame, budgets: DataFrame, bits: int) -> DataFrame:
    """(_key, longest, rest, low): where the running sum of a source passes its rest, to ``bits`` bits; ``low`` is null if it never does.

    ``rows`` has _key, _bucket (the first bits of the hash) and _size; ``rest`` falls by the words of the buckets before.
    """
    sums = rows.groupBy("_key", "_bucket").agg(F.sum("_size").alias("words"))
    running = F.sum("words").over(W.partitionBy("_key").orderBy("_bucket"))  # 2 ** LEVEL_BITS buckets a source at most
    sums = sums.select("_key", "_bucket", "words", running.alias("upto")).join(budgets.select("_key", "rest"), "_key")
    over = F.struct("_bucket", (F.col("upto") - F.col("words")).alias("before"))
    first = sums.groupBy("_key").agg(F.min(F.when(F.col("upto") > F.col("rest"), over)).alias("f"), F.sum("words").alias("all"))
    joined = budgets.select("_key", "longest", "rest").join(first, "_key", "left")
    return joined.select("_key", "longest", (F.col("rest") - F.coalesce("f.before", "all", F.lit(0))).alias("rest"),
                         (F.col("f._bucket") * (1 << (HASH_BITS - bits))).alias("low"))


def _thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(_key, longest, below, left): the largest hash below which the documents that still fit do so together, and what is left of ``rest``.

    ``rows`` has _key, _size and _hash, ``budgets`` has _key, pairs, longest, rest and n_rows.
    """
    bits = LEVEL_BITS
    fits = join_hot(rows, budgets.select("_key", "longest", "pairs", "n_rows"), ["_key"], "n_rows", budgets.agg(F.sum("n_rows")).first()[0] or 0)
    new = (F.col("_size") > 0) & (F.col("_size") <= F.col("longest")) & ~is_taken(F.col("pairs"), F.col("_size"), F.col("_hash"))
    fits = fits.where(new).select("_key", "_size", "_hash")
    bucket = lambda bits: F.shiftright("_hash", HASH_BITS - bits)
    found = save(_boundary(fits.withColumn("_bucket", bucket(bits)), budgets, bits), "mix-boundary")
    while True:
        inside = fits.join(found.where("low is not null").select("_key", "low"), "_key").where(
            (F.col("_hash") >= F.col("low")) & (F.col("_hash") < F.col("low") + (1 << (HASH_BITS - bits)))).select("_key", "_size", "_hash")
        inside = save(inside, "mix-bucket")  # of each source one bucket
        several = inside.groupBy("_key").agg((F.min("_hash") < F.max("_hash")).alias("several")).where("several")
        if bits == HASH_BITS or not several.limit(1).count():
            break
        bits += LEVEL_BITS
        finer = save(_boundary(inside.withColumn("_bucket", bucket(bits)), found.where("low is not null"), bits), "mix-boundary")
        found, fits = finer.unionByName(found.where("low is null")), inside
    exact = inside.groupBy("_key").agg(F.min("_hash").alias("below"))  # the first hash that does not fit
    return found.join(exact, "_key", "left").select("_key", "longest", F.coalesce("below", F.lit(1 << HASH_BITS)).alias("below"), F.col("rest").alias("left"))


def mix_plan(rows: DataFrame, weights: DataFrame, max_repeats: int = MAX_REPEATS, rounds: int = ROUNDS) -> DataFrame:
    """(_key, n_rows, source_size, target, times, pairs) of each source: whole passes, and the pairs of :func:`is_taken`.

    ``rows`` comes from :func:`sized`, ``weights`` has source and weight.
    """
    rows = rows.select("_key", "_size", "_hash")
    sizes = rows.groupBy("_key").agg(F.count("*").alias("n_rows"), F.sum("_size").alias("source_size"))
    weight = weights.groupBy(source_key(F.col("source")).alias("_key")).agg(F.max("weight").alias("weight"))
    plan = targets(sizes.join(weight, "_key", "left"), max_repeats)
    times = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))).otherwise(0).cast("long")
    plan = plan.withColumn("times", times).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    plan = save(plan.withColumn("pairs", F.array().cast(_TAKEN)), "mix-plan")
    for _ in range(rounds):
        budgets = plan.where("rest >= 1").withColumn("longest", F.floor("rest"))
        if not budgets.limit(1).count():
            break
        pair = F.when(F.col("below").isNotNull(), F.array_append("pairs", F.struct("longest", "below"))).otherwise(F.col("pairs"))
        grown = plan.join(save(_thresholds(rows, budgets), "mix-pairs"), "_key", "left")
        plan = save(grown.withColumn("pairs", pair).withColumn("rest", F.coalesce("left", "rest")).drop("longest", "below", "left"), "mix-plan")
    return plan.drop("rest", "weight")


def mix_sources(docs: DataFrame, weights: DataFrame, seed: str = "", max_repeats: int = MAX_REPEATS, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with the struct ``mix`` (size, source_size, target, times): how often each document is to be taken.

    A column of that name is replaced.
    """
    row = docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text")
    rows = sized(row, seed)
    plan = mix_plan(save(rows.select("_key", "_size", "_hash"), "mix-rows"), weights, max_repeats, rounds)
    placed = _placed(rows, plan)
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c != "mix"]
    return placed.select(*kept, F.struct(F.col("_size").alias("size"), "source_size", "target", "_times").cast("struct<size:long,source_size:long,target:double,times:long>").alias("mix"))


def _placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with what ``plan`` says of their source, and ``_times``."""
    total = plan.agg(F.sum("n_rows")).first()[0] or 0
    joined = join_hot(rows, plan.select("_key", "n_rows", "source_size", "target", "times", "pairs"), ["_key"], "n_rows", total)
    more = is_taken(F.col("pairs"), F.col("_size"), F.col("_hash")) & (F.col("_size") > 0)
    return joined.withColumn("_times", F.col("times") + more.cast("long"))


def mix_digest(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words taken of each document; texts are read once."""
    rows = save(sized(docs.select("doc_id", "source", "text")).select("doc_id", "_key", "_size", "_hash"), "mix-rows")
    placed = _placed(rows, mix_plan(rows, weights))
    return placed.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_times") * F.col("_size")).alias("taken"))


def ranked_weights(docs: DataFrame, pattern: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, weight): sources by code point, null last, get the weights of ``pattern`` in turn."""
    source = docs.select(F.col("source").cast("string")).distinct()  # one row a source from here on
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return source.select("source", F.get(F.lit(list(pattern)), (place % len(pattern)).cast("int")).alias("weight"))
