"""Per-hop telemetry governor: allow, defer or deny the next hop from observed state and its slope.

Telemetry rows are (run, hop, vram_mb, temp_c, hop_ms); hop 0 is the baseline. Limits are columns of a one-row profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Two illustrative cards, and the margins they share.
PROFILES = {
    "card-a": {"vram_total_mb": 16384.0, "vram_hard_mb": 15000.0, "abort_temp_c": 90.0, "deadline_ms": 6000.0},
    "card-b": {"vram_total_mb": 24000.0, "vram_hard_mb": 21000.0, "abort_temp_c": 95.0, "deadline_ms": 8000.0},
}
MARGINS = {"vram_margin_mb": 1024.0, "thermal_margin_c": 2.0, "vram_defer_mb": 1536.0, "thermal_defer_c": 3.5}
GENERATION_TOKENS, TOKEN_BUDGET, TOKENS_PER_HOP = 400, 8192, 412


def profile(spark: SparkSession, name: str = "card-a", **changes: float) -> DataFrame:
    """One row of limits."""
    values = {**PROFILES[name], **MARGINS, **changes}
    return spark.createDataFrame([(name, *values.values())], "profile string, " + ", ".join(f"{k} double" for k in values))


def decide() -> tuple[Column, Column]:
    """(decision, reason) over columns temp_c, vram_mb, hop_ms, elapsed_ms, their slopes d_*, and a profile's limits."""
    c = F.col
    temp, vram = c("temp_c") + c("d_temp"), c("vram_mb") + c("d_vram")
    hop = F.greatest(c("hop_ms") + c("d_ms"), c("hop_ms"))
    rules = [
        ("DENY", "thermal-observed", c("temp_c") >= c("abort_temp_c") - c("thermal_margin_c")),
        ("DENY", "vram-observed", c("vram_mb") >= c("vram_hard_mb") - c("vram_margin_mb")),
        ("DENY", "thermal-predicted", temp >= c("abort_temp_c")),
        ("DENY", "vram-predicted", vram >= c("vram_hard_mb")),
        ("DEFER", "thermal-band", temp >= c("abort_temp_c") - c("thermal_defer_c")),
        ("DEFER", "vram-band", vram >= c("vram_hard_mb") - c("vram_defer_mb")),
        ("DEFER", "latency", c("elapsed_ms") + hop > c("deadline_ms")),
    ]
    decision, reason = F.when(c("temp_c").isNull(), "ALLOW"), F.when(c("temp_c").isNull(), "cold-start")
    for d, r, test in rules:
        decision, reason = decision.when(test, d), reason.when(test, r)
    return decision.otherwise("ALLOW"), reason.otherwise("headroom ok")


def gates(telemetry: DataFrame, limits: DataFrame) -> DataFrame:
    """A row for each observed hop: the decision before the hop after it. Slopes come from the last two observations."""
    w = Window.partitionBy("run").orderBy("hop")
    slope = lambda x: F.coalesce(F.col(x) - F.lag(x).over(w), F.lit(0.0))
    x = telemetry.withColumns({"d_temp": slope("temp_c"), "d_vram": slope("vram_mb"), "d_ms": slope("hop_ms"), "elapsed_ms": F.sum("hop_ms").over(w)})
    decision, reason = decide()
    return x.crossJoin(F.broadcast(limits)).select("run", "hop", decision.alias("decision"), reason.alias("reason"), (F.col("temp_c") + F.col("d_temp")).alias("predicted_temp_c"), (F.col("vram_mb") + F.col("d_vram")).alias("predicted_vram_mb"), "elapsed_ms")


def runs(telemetry: DataFrame, limits: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """A row for each run: hops_executed, breached, stopped_by, peaks; ungoverned without decisions.

    A run ends at the first decision other than ALLOW (before that hop), at the first breach, or with its schedule;
    the gate comes before the hop that would breach. The baseline counts for the peaks.
    """
    x = telemetry.crossJoin(F.broadcast(limits.select("vram_hard_mb", "abort_temp_c")))
    x = x.withColumn("breach", (F.col("hop") >= 1) & ((F.col("temp_c") >= F.col("abort_temp_c")) | (F.col("vram_mb") >= F.col("vram_hard_mb"))))
    if decisions is not None:
        x = x.join(decisions.select("run", "hop", "decision"), ["run", "hop"], "left")
    else:
        x = x.withColumn("decision", F.lit("ALLOW"))
    far = 1 << 30
    w = Window.partitionBy("run")
    x = x.withColumns({"last": F.max("hop").over(w), "stop": F.min(F.when(F.coalesce("decision", F.lit("ALLOW")) != "ALLOW", F.col("hop"))).over(w), "hit": F.min(F.when(F.col("breach"), F.col("hop"))).over(w)})
    x = x.withColumns({"stop": F.when(F.col("stop") < F.col("last"), F.col("stop")), "end": F.least(F.coalesce("stop", F.lit(far)), F.coalesce("hit", F.lit(far)), F.col("last"))})
    x = x.where(F.col("hop") <= F.col("end"))
    out = x.groupBy("run").agg(F.max("hop").alias("hops_executed"), F.max("temp_c").alias("peak_temp_c"), F.max("vram_mb").alias("peak_vram_mb"), F.first("end").alias("end"), F.first("hit").alias("hit"), F.first("stop").alias("stop"))
    breached = F.coalesce(F.col("hit") == F.col("end"), F.lit(False))
    return out.select("run", "hops_executed", breached.alias("breached"), F.when(breached, "abort").when(F.col("stop") == F.col("end"), "governor").otherwise("schedule-end").alias("stopped_by"), "peak_temp_c", "peak_vram_mb")


def cost_gates(telemetry: DataFrame, budget: float = TOKEN_BUDGET, per_hop: float = TOKENS_PER_HOP, sufficient_after: int | None = None) -> DataFrame:
    """The token-economics baseline: it reads the hop number and nothing else."""
    enough = F.lit(False) if sufficient_after is None else F.col("hop") >= sufficient_after
    decision = F.when(enough, "DENY").when((F.col("hop") + 1) * per_hop > budget, "DENY").otherwise("ALLOW")
    return telemetry.select("run", "hop", decision.alias("decision"))


def tokens_per_hop(texts: DataFrame) -> DataFrame:
    """One row: mean of round(words * 1.3), halves to even, plus the generation's tokens."""
    n = F.rint(F.size(F.filter(F.split("text", r"\s+"), lambda t: t != "")) * 1.3)
    return texts.agg((F.avg(n) + GENERATION_TOKENS).alias("tokens"))


def breach_rate(results: DataFrame) -> DataFrame:
    """By governor: runs, breaches, rate over (governor, breached)."""
    return results.groupBy("governor").agg(F.count("*").alias("runs"), F.count_if("breached").alias("breaches"), F.avg(F.col("breached").cast("int")).alias("rate"))
