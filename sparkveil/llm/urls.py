"""Operator 8 (built-in functions only): URL filters as a sort-merge range join.

Reversed-host keys turn "this host and its subdomains, this path prefix" into
key intervals: a url of host ``a.b.c`` is looked up under ``c``, ``c.b`` and
``c.b.a``, where a rule covers the paths from its own to its own plus 0xFF.
Rules and urls are sorted together by (reversed host, path) and swept once: a
window carries the last rule begun, with the stack of the rules it is nested
in, over the urls that follow; whatever covers a url is on that stack, because
intervals of prefixes are nested or disjoint.

Hosts with many urls are split: their urls are salted and their rules repeated
for each salt. The number of such hosts is bounded by the number of tasks.

Defined cases: a null url, or one without ``://``, has empty host and path and
matches no rule; a rule with a null part is dropped; of equal rules a block
wins; of several matching rules the longest (host plus path) wins, then the
longer host; repeated rows are each returned; columns besides ``page_id`` and
``url`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower

#: Rule hosts are broadcast up to this many, joined with a shuffle beyond.
BROADCAST_HOSTS = 100_000


def url_host(url: Column) -> Column:
    """Host of a url: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """Path of a url: what follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path)."""
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def reversed_host(host: Column) -> Column:
    """``c.b.a`` of ``a.b.c``."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _stacked_rules(rules: DataFrame) -> DataFrame:
    """Each rule with the rules of its host that enclose it, itself included: (anc, path, stack)."""
    clean = (
        rules.where("verdict is not null and rule_host is not null and rule_path is not null")
        .groupBy(ascii_lower(F.col("rule_host")).alias("rule_host"), "rule_path")
        .agg(F.max(F.col("verdict") == "block").alias("blocks"))
        .withColumn("anc", reversed_host(F.col("rule_host")))
    )
    cut = F.transform(F.sequence(F.lit(0), F.length("rule_path")), lambda n: F.substring(F.col("rule_path"), F.lit(1), n))
    inner = clean.select("anc", F.col("rule_path").alias("path"), F.explode(cut).alias("outer_path"))
    outer = clean.select(F.col("anc").alias("o_anc"), F.col("rule_path").alias("o_path"), F.struct(
        F.length(F.concat("rule_host", "rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
        F.col("rule_path").alias("path"), F.concat("rule_host", "rule_path").alias("rule"), "blocks").alias("r"))
    return (
        inner.join(outer, (F.col("anc") == F.col("o_anc")) & (F.col("outer_path") == F.col("o_path")))
        .groupBy("anc", "path").agg(F.sort_array(F.collect_list("r"), asc=False).alias("stack"))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` of every page."""
    spark = pages.sparkSession
    stacked = _stacked_rules(rules)
    hosts = stacked.select("anc").distinct()
    base = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labels = F.reverse(F.split("host", r"\."))
    ancestors = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))
    looked = base.withColumn("anc", F.explode_outer(ancestors))
    few = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    looked = looked.join(F.broadcast(hosts) if few else hosts, "anc", "left_semi")

    # salts for hosts that many urls fall under; at most 4 * tasks such hosts can exist
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = looked.groupBy("anc").count()
    total = sizes.agg(F.sum("count")).first()[0] or 0
    per_task = max(500, total // (4 * tasks))
    hot = sizes.where(F.col("count") > per_task).select("anc", F.ceil(F.col("count") / per_task).cast("int").alias("salts"))
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("page_id", "host", "path"), F.col("salts"))).otherwise(F.lit(0)).cast("int")
    urls = looked.join(F.broadcast(hot), "anc", "left").select(
        "anc", F.col("path").cast("binary").alias("key"), salt.alias("salt"), F.lit(1).alias("is_url"),
        "page_id", "host", "path", F.lit(None).cast(stacked.schema["stack"].dataType).alias("stack"))
    begun = stacked.join(F.broadcast(hot), "anc", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    begun = begun.select("anc", F.col("path").cast("binary").alias("key"), "salt", F.lit(0).alias("is_url"),
                         F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"),
                         F.lit(None).cast("string").alias("path"), "stack")
    sweep = W.partitionBy("anc", "salt").orderBy("key", "is_url").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = urls.unionByName(begun).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("is_url = 1")
    path = F.col("path")
    match = F.get(F.filter("stack", lambda r: F.startswith(path, r["path"])), F.lit(0))
    found = swept.select("page_id", "host", "path", match.alias("r"), F.lit(0).alias("copies")).where("r is not null")
    everyone = base.select("page_id", "host", "path", F.lit(None).cast(found.schema["r"].dataType).alias("r"), F.lit(1).alias("copies"))
    judged = everyone.unionByName(found).groupBy("page_id", "host", "path").agg(F.max("r").alias("r"), F.sum("copies").alias("copies"))
    verdict = F.when(F.col("r.blocks"), F.lit("block")).when(F.col("r").isNotNull(), F.lit("allow")).otherwise(F.lit(default))
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"),
                         F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
