"""Session operators: sliding-expiry epochs, registry snapshots, least-recently-used eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkveil.functions.quantiles import greatest


def session_epochs(touches: DataFrame, ttl_seconds: float, key: str = "session_id", ts: str = "ts") -> DataFrame:
    """Adds ``epoch``: it grows when a touch comes more than ``ttl_seconds`` after the one before; exactly that stays."""
    w = W.partitionBy(key).orderBy(ts)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = at - F.lag(at).over(w)
    marked = touches.withColumn("_new", F.when(gap > int(ttl_seconds * 1_000_000), 1).otherwise(0))
    return marked.withColumn("epoch", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_new")


def latest_known(registry: DataFrame) -> DataFrame:
    """The last record of every (session_id, surrogate)."""
    last = F.max_by(F.struct("entity_type", "created_at"), F.struct("created_at", "entity_type"))
    return registry.groupBy("session_id", "surrogate").agg(last.alias("r")).select("session_id", "surrogate", "r.entity_type", "r.created_at")


def evict_least_recent(sessions: DataFrame, capacity: int) -> DataFrame:
    """(session_id, last_access) of the ``capacity`` sessions used last; ties keep the larger id.

    The access time of the last one to stay is selected from counted histograms, the sessions are never sorted.
    """
    last = sessions.groupBy("session_id").agg(F.max("ts").alias("last_access"))
    kept = greatest(last.withColumn("_at", F.unix_micros(F.col("last_access").cast("timestamp"))), "_at", "session_id", capacity)
    return kept.drop("_at")
