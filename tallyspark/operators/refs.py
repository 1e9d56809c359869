"""Incremental sync: content-hash diffs, and references resolved against live and cached ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, hash) of the current files that are new or have another hash. Deleted paths are not reported."""
    old = previous.select("path", F.col("hash").alias("old_hash")).dropDuplicates(["path"])
    return current.join(old, "path", "left").where(~F.col("hash").eqNullSafe(F.col("old_hash"))).select("path", "hash")


def unchanged(current: DataFrame, previous: DataFrame) -> DataFrame:
    old = previous.select("path", F.col("hash").alias("old_hash")).dropDuplicates(["path"])
    return current.join(old, "path", "left").where(F.col("hash").eqNullSafe(F.col("old_hash"))).select("path", "hash")


def reduction(current: DataFrame, previous: DataFrame) -> DataFrame:
    """One row: total, changed, factor (infinite if nothing changed)."""
    old = previous.select("path", F.col("hash").alias("old_hash")).dropDuplicates(["path"])
    both = current.join(old, "path", "left")
    counts = both.agg(F.count("*").alias("total"), F.count_if(~F.col("hash").eqNullSafe(F.col("old_hash"))).alias("changed"))
    factor = F.when(F.col("changed") == 0, F.lit(float("inf"))).otherwise(F.col("total") / F.when(F.col("changed") != 0, F.col("changed")))
    return counts.withColumn("factor", factor)


def resolve(edges: DataFrame, live: DataFrame, cached: DataFrame, key: str = "to_id") -> DataFrame:
    """Edges plus status: LIVE, else STALE_CACHED, else DANGLING. Right sides are distinct, so edges never multiply."""
    a = live.select(F.col("id").alias("live_id")).distinct()
    b = cached.select(F.col("id").alias("cached_id")).distinct()
    both = edges.join(a, edges[key] == a["live_id"], "left").join(b, edges[key] == b["cached_id"], "left")
    status = F.when(F.col("live_id").isNotNull(), "LIVE").when(F.col("cached_id").isNotNull(), "STALE_CACHED").otherwise("DANGLING")
    return both.withColumn("status", status).drop("live_id", "cached_id")


def closure(edges: DataFrame, live: DataFrame, key: str = "to_id") -> DataFrame:
    """Edges whose target is not live, whatever is cached."""
    return edges.join(live.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def gate(resolved: DataFrame) -> DataFrame:
    """One row: counts by status and whether the sync passes (stale references don't fail it)."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return resolved.agg(n("LIVE"), n("STALE_CACHED"), n("DANGLING")).withColumn("passed", F.col("dangling") == 0)
