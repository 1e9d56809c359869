"""Snapshot against snapshot: one full outer join for every kind of drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-9
#: How bad each severity is.
SEVERITY_RANK = {"adequate": 0, "thin": 1, "orphan": 2}


def ratio_drift(previous: DataFrame, current: DataFrame, key: list[str], value: str = "ratio", default: float = 1.0, eps: float = EPSILON) -> DataFrame:
    """Keys of either side with previous, current and regressed (lower by more than eps); absent values are the default."""
    a = previous.select(*key, F.col(value).alias("previous"))
    b = current.select(*key, F.col(value).alias("current"))
    both = a.join(b, key, "full_outer").select(*key, F.coalesce("previous", F.lit(default)).alias("previous"), F.coalesce("current", F.lit(default)).alias("current"))
    return both.withColumn("regressed", F.col("current") < F.col("previous") - eps)


def rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, r in SEVERITY_RANK.items():
        out = F.when(severity == name, r).otherwise(out)
    return out


def severity_drift(previous: DataFrame, current: DataFrame, key: str = "entity") -> DataFrame:
    """Keys of either side, with severities (absent: adequate) and worse."""
    a = previous.select(key, F.col("severity").alias("previous"))
    b = current.select(key, F.col("severity").alias("current"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("previous", F.lit("adequate")).alias("previous"), F.coalesce("current", F.lit("adequate")).alias("current"))
    return both.withColumn("worse", rank(F.col("current")) > rank(F.col("previous")))
