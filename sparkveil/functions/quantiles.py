"""Exact order statistics of groups without holding a group: counted histograms, refined where a wanted rank lies.

A first pass counts the values of each group in buckets between its least and
greatest; each wanted rank then lies in one bucket, whose own least and greatest
value are known. Buckets that hold many unlike values are counted again, more
finely; the few distinct values of the last buckets are counted one by one. No
step needs more than the counts of a group together, whatever its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkveil.sources.scratch import written

#: Buckets of a histogram, and values of a bucket that are counted one by one.
BUCKETS, FEW = 4096, 4096
#: The largest finite number: infinite values are told apart from it by their bucket.
LARGEST = 1.7976931348623157e308


def ranked_values(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, rank, value): the value of each rank (from 0) of ``wanted`` (g, rank) among the ``rows`` (g, v) of its group.

    Nulls are no values; a NaN counts as the greatest. Ranks that a group does not have give no row.
    """
    rows = rows.where("v is not null")
    finite = F.when(~F.isnan("v"), F.col("v"))
    extent = rows.groupBy("g").agg(F.count("*").alias("n"), F.count(finite).alias("m"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    asked = wanted.join(extent, "g").where("rank >= 0 and rank < n").select("g", "rank", "m", "lo", "hi", F.lit(0).cast("long").alias("before"))
    nans = asked.where("rank >= m").select("g", "rank", F.lit(float("nan")).alias("value"))
    found = asked.where("rank < m").select("g", "rank", "lo", "hi", "before")
    real = rows.where(~F.isnan("v"))

    def inside() -> DataFrame:
        cells = found.select("g", "lo", "hi", "before").distinct()  # as many as there are ranks, at most
        return real.join(cells, "g").where("v between lo and hi")

    while True:
        low, high = (F.greatest(F.least(F.col(c), F.lit(LARGEST)), F.lit(-LARGEST)) for c in ("lo", "hi"))
        width = high / BUCKETS - low / BUCKETS
        bucket = F.when(width > 0, F.greatest(F.least((F.col("v") - low) / width, F.lit(BUCKETS - 1.0)), F.lit(0.0))).otherwise(F.lit(0.0))
        counted = inside().groupBy("g", "lo", "before", bucket.cast("int").alias("bucket")).agg(
            F.count("*").alias("size"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("size").over(W.partitionBy("g", "lo", "before").orderBy("bucket")) + F.col("before")
        counted = counted.select("g", "lo", "before", "size", "least", "most", upto.alias("upto"))
        found = found.select("g", "rank", "lo", "before").join(counted, ["g", "lo", "before"]).where("rank < upto and rank >= upto - size").select(
            "g", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("upto") - F.col("size")).alias("before"), "size")
        found = written(found, "ranks")
        unlike = F.col("hi") / BUCKETS > F.col("lo") / BUCKETS
        if not found.where((F.col("size") > FEW) & unlike).limit(1).count():
            break
    single = inside().groupBy("g", "lo", "before", "v").count()
    upto = F.sum("count").over(W.partitionBy("g", "lo", "before").orderBy("v")) + F.col("before")
    single = single.select("g", "lo", "before", "v", "count", upto.alias("upto"))
    exact = found.join(single, ["g", "lo", "before"]).where("rank < upto and rank >= upto - count").select("g", "rank", F.col("v").alias("value"))
    return exact.unionByName(nans)


def quantiles(df: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """(g, q0, q1, ...): exact quantiles by linear interpolation of the non-null values of each group; ``g`` is a struct of ``by``.

    Groups without values give no row.
    """
    rows = df.select(F.struct(*by).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    counted = rows.groupBy("g").agg(F.count("*").alias("n"))
    place = [(F.col("n") - 1) * F.lit(float(q)) for q in fractions]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in place])))
    found = ranked_values(rows, counted.select("g", F.explode(ranks).alias("rank")))
    held = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))  # two ranks a fraction
    joined = held.join(counted, "g")
    low, high = [F.col("at")[F.floor(p)] for p in place], [F.col("at")[F.ceil(p)] for p in place]
    return joined.select("g", *[(a + (b - a) * (p - F.floor(p))).alias(f"q{i}") for i, (a, b, p) in enumerate(zip(low, high, place))])


def greatest(df: DataFrame, value: str, ties: str, count: int) -> DataFrame:
    """The ``count`` rows of greatest ``value``, ties by the greater ``ties``; no sort but of the rows that tie at the limit."""
    numbered = df.withColumn("_v", F.col(value).cast("double"))
    total = numbered.where("_v is not null").count()
    if total <= count:
        return df.where(F.col(value).isNotNull())
    spark = df.sparkSession
    wanted = spark.range(total - count, total - count + 1).select(F.struct(F.lit(0).alias("_")).alias("g"), F.col("id").alias("rank"))
    if count <= 0:
        return df.where("false")
    limit = ranked_values(numbered.select(F.struct(F.lit(0).alias("_")).alias("g"), F.col("_v").alias("v")), wanted).first().value
    above = numbered.where(F.col("_v") > limit)
    return above.unionByName(numbered.where(F.col("_v") == limit).orderBy(F.desc(ties)).limit(count - above.count())).drop("_v")
