"""Answer forensics: is a bad answer the retriever's fault or the generator's, and does it come from memory.

Calls of an answerer are rows (qid, variant, answer): ``full`` context, ``empty`` context, ``resample_0`` and so on, so
that an opaque model is asked once for each row and everything after is relational.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import text as T

MARGIN, FLOOR, CEIL = 0.15, 0.35, 0.95
RETRIEVAL_K, RETRIEVAL_SHARE = 4, 0.5
PARAMETRIC_FLOOR, CONTEXT_FLOOR = 0.35, 0.15
RESAMPLES, FIXED_CUTOFF = 5, 0.5
DONT_KNOW = "IDK"


def is_answer(answer: Column) -> Column:
    return (F.length(answer) > 0) & (F.upper(F.trim(answer)) != DONT_KNOW)


def supported(answer: Column, context_tokens: Column) -> Column:
    """Every token of the answer stands in the context."""
    return is_answer(answer) & (F.size(F.array_except(T.tokens(answer), context_tokens)) == 0)


def invariance(full: Column, empty: Column) -> Column:
    """How much of the answer survives without context; 0 if there was no answer."""
    return F.when(is_answer(full), T.jaccard(full, F.coalesce(empty, F.lit("")))).otherwise(0.0)


def pivot_calls(calls: DataFrame) -> DataFrame:
    """(qid, full, empty, consistency): consistency is the modal answer's share of the full and resampled answers."""
    n = calls.where("variant <> 'empty'").groupBy("qid", "answer").agg(F.count("*").alias("n")).groupBy("qid").agg((F.max("n") / F.sum("n")).alias("consistency"))
    ends = calls.groupBy("qid").agg(F.max(F.when(F.col("variant") == "full", F.col("answer"))).alias("full"), F.max(F.when(F.col("variant") == "empty", F.col("answer"))).alias("empty"))
    return ends.join(n, "qid", "left")


def calibrate(calls: DataFrame, margin: float = MARGIN, floor: float = FLOOR, ceil: float = CEIL) -> DataFrame:
    """One row: threshold, q90, n. The threshold is the 90th percentile of the invariance plus a margin, clamped."""
    inv = pivot_calls(calls).select(invariance(F.col("full"), F.col("empty")).alias("i"))
    q = inv.agg(F.coalesce(F.percentile("i", F.lit(0.9)), F.lit(0.0)).alias("q90"), F.count("*").alias("n"))
    return q.select(F.greatest(F.lit(floor), F.least(F.lit(ceil), F.col("q90") + margin)).alias("threshold"), "q90", "n")


def retrieval_floor(best: DataFrame, share: float = RETRIEVAL_SHARE) -> DataFrame:
    """One row: a share of the median of the best cosines (quality) of calibration queries; 0 without any."""
    return best.agg((F.coalesce(F.median("quality"), F.lit(0.0)) * share).alias("floor"))


def verdicts(calls: DataFrame, context: DataFrame, calibration: DataFrame, floor: DataFrame) -> DataFrame:
    """A row for each query: answer, invariance, consistency, quality, supported, leak, attribution.

    context is (qid, quality, tokens): the best cosine and the context's tokens. The leak flag compares the
    unrounded invariance; the output rounds to four places.
    """
    x = pivot_calls(calls).join(context, "qid", "left").crossJoin(F.broadcast(calibration.select("threshold"))).crossJoin(F.broadcast(floor))
    x = x.withColumns({"i": invariance(F.col("full"), F.col("empty")), "q": F.coalesce("quality", F.lit(0.0)), "s": supported(F.col("full"), F.coalesce("tokens", F.array().cast("array<string>")))})
    attribution = F.when(F.col("q") < F.col("floor"), "retriever").when(~F.col("s"), "generator").otherwise("ok")
    leak = (F.col("i") >= F.col("threshold")) & is_answer(F.col("full"))
    return x.select("qid", F.col("full").alias("answer"), F.round("i", 4).alias("invariance"), F.round("consistency", 4).alias("consistency"), F.round("q", 4).alias("quality"), F.col("s").alias("supported"), leak.alias("leak"), attribution.alias("attribution"))


def simulate(queries: DataFrame, support: DataFrame) -> DataFrame:
    """(qid, answer) of a simulated generator over (qid, parametric, confidence, hallucinate) and support(qid, sim, token).

    Support is the best cosine over passages that carry a token. A hallucination needs support; memory wins over
    context at equal confidence; both have floors; else it does not know.
    """
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "token")
    best = support.where("token is not null and sim > 0").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    x = queries.join(best, "qid", "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    answer = (
        F.when(F.col("hallucinate").isNotNull(), F.when(F.col("sim") >= CONTEXT_FLOOR, F.col("hallucinate")).otherwise(DONT_KNOW))
        .when(F.col("parametric").isNotNull() & (F.col("confidence") >= F.col("sim")) & (F.col("confidence") >= PARAMETRIC_FLOOR), F.col("parametric"))
        .when((F.col("sim") >= CONTEXT_FLOOR) & F.col("token").isNotNull(), F.col("token"))
        .otherwise(DONT_KNOW)
    )
    return x.select("qid", answer.alias("answer"))


def ablation(calls: DataFrame, truth: DataFrame, calibration: DataFrame) -> DataFrame:
    """Two rows: precision, recall and F1 of the leak flag under the fixed and the calibrated threshold; truth is (qid, leak)."""
    from .stats import precision_recall

    x = pivot_calls(calls).join(truth, "qid").crossJoin(F.broadcast(calibration.select("threshold"))).withColumn("i", invariance(F.col("full"), F.col("empty")))
    out = None
    for name, at in (("fixed", F.lit(FIXED_CUTOFF)), ("calibrated", F.col("threshold"))):
        flagged = x.select(((F.col("i") >= at) & is_answer(F.col("full"))).alias("p"), F.col("leak").alias("a"))
        row = precision_recall(flagged, "p", "a").withColumn("gate", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
