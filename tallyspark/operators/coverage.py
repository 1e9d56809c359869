"""Corroboration audit: which registered entities do other source types mention, and how broadly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THIN_COVERAGE = 1 / 3
THIN_MENTIONS = 3


def severity(coverage: Column, mentions: Column) -> Column:
    return F.when(coverage == 0, "orphan").when((coverage <= THIN_COVERAGE) | (mentions < THIN_MENTIONS), "thin").otherwise("adequate")


def audit(registry: DataFrame, mentions: DataFrame, own_type: str, other_types: list[str]) -> DataFrame:
    """A row for each registered entity: type_coverage, mentions by others, their types, severity.

    The own type never corroborates. Types outside ``other_types`` count too, so coverage can exceed 1; without
    other types it is 1. Mentions aggregate before they meet the registry.
    """
    per = mentions.where(F.col("source_type") != own_type).groupBy("entity").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("source_type")).alias("types"))
    out = registry.select("entity").distinct().join(per, "entity", "left")
    types = F.coalesce("types", F.array().cast("array<string>"))
    coverage = F.size(types) / len(set(other_types)) if other_types else F.lit(1.0)
    out = out.select("entity", coverage.alias("type_coverage"), F.coalesce("n", F.lit(0)).cast("bigint").alias("total_other_mentions"), types.alias("mentioning_types"))
    return out.withColumn("severity", severity(F.col("type_coverage"), F.col("total_other_mentions")))


def keyword_count(registry: DataFrame, mentions: DataFrame, least: int = 5) -> DataFrame:
    """The naive baseline: an entity is covered by ``least`` mentions of any type."""
    per = mentions.groupBy("entity").agg(F.count("*").alias("n"))
    out = registry.select("entity").distinct().join(per, "entity", "left").select("entity", F.coalesce("n", F.lit(0)).cast("bigint").alias("mentions"))
    return out.withColumn("covered", F.col("mentions") >= least)
