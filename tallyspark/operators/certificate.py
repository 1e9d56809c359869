"""Embedder certificates: do live vectors of the anchor probes reproduce the certified ones, and if not, how not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import vec

SAME_MODEL_COSINE = 0.98
NORM_TOLERANCE = 0.05


def digest(probes: DataFrame) -> DataFrame:
    """One row: the canonical digest of the vectors in probe order (a certificate has a dozen probes)."""
    rows = probes.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("rows"))
    return rows.select(vec.float32_digest(F.col("rows")).alias("digest"))


def compare(reference: DataFrame, live: DataFrame, key: list[str] | None = None) -> DataFrame:
    """A row for each group of ``key`` (one without): dim_matches, identical, mean_cosine, min_cosine, max_norm_error, verdict.

    Inputs are (key..., pos, v). Only the first live vector's width is compared. Decisions in order: dim-mismatch,
    reproduced, lost-l2-norm, quant-dtype-drift, wrong-weights.
    """
    key = key or []
    f32 = lambda v: F.transform(v, lambda x: x.cast("float"))
    both = reference.select(*key, "pos", f32(F.col("v")).alias("rv")).join(live.select(*key, "pos", f32(F.col("v")).alias("lv")), [*key, "pos"], "left")
    out = both.groupBy(*key).agg(
        F.min_by(F.size("lv") == F.size("rv"), "pos").alias("dim_matches"),
        F.bool_and(F.coalesce(F.col("lv") == F.col("rv"), F.lit(False))).alias("identical"),
        F.avg(vec.cosine(F.col("lv"), F.col("rv"))).alias("mean_cosine"),
        F.min(vec.cosine(F.col("lv"), F.col("rv"))).alias("min_cosine"),
        F.max(F.abs(vec.norm(F.col("lv")) - 1)).alias("max_norm_error"),
    )
    same = F.col("mean_cosine") >= SAME_MODEL_COSINE
    verdict = F.when(~F.col("dim_matches"), "dim-mismatch").when(F.col("identical"), "reproduced").when(same & (F.col("max_norm_error") > NORM_TOLERANCE), "lost-l2-norm").when(same, "quant-dtype-drift").otherwise("wrong-weights")
    return out.withColumn("verdict", verdict)


def fingerprint_only(reference: DataFrame, live: DataFrame) -> DataFrame:
    """The naive baseline: equal (name, dim)."""
    return reference.crossJoin(live.select(F.col("name").alias("live_name"), F.col("dim").alias("live_dim"))).select(((F.col("name") == F.col("live_name")) & (F.col("dim") == F.col("live_dim"))).alias("accepted"))


def margin(scored: DataFrame) -> DataFrame:
    """One row: least cosine of the same model less the largest of another one, over (same, mean_cosine)."""
    return scored.agg((F.min(F.when(F.col("same"), F.col("mean_cosine"))) - F.max(F.when(~F.col("same"), F.col("mean_cosine")))).alias("margin"))


def detection_rate(verdicts: DataFrame) -> DataFrame:
    """By fault family: samples and how many each detector caught, over (family, verdict, accepted)."""
    return verdicts.groupBy("family").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") != "reproduced").alias("caught"), F.count_if(~F.col("accepted")).alias("caught_by_name"))
