"""Pipeline liveness: the first failing invariant over ingest, index, embed, retrieve and score.

Inputs: docs(id, text), index(pos, id), emb(pos, v), queries(qi, text), retrieval(qi, rank, id, score).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import vec

STAGES = ("ingest", "index", "embed", "retrieve", "score")
NORM_EPS, ANISOTROPY_MAX, SCORE_EPS = 1e-6, 0.98, 1e-9


def anisotropy(emb: DataFrame) -> DataFrame:
    """One row: n, mean off-diagonal cosine. The closed form over dimension sums: no pairs are formed.

    Zero vectors count as zero rows; null with fewer than two vectors.
    """
    unit = emb.select(F.posexplode(vec.normalized(F.col("v"))).alias("d", "u"))
    total = unit.groupBy("d").agg(F.sum("u").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    own = emb.agg(F.count("*").alias("n"), F.sum(vec.dot(vec.normalized(F.col("v")), vec.normalized(F.col("v")))).alias("own"))
    n = F.col("n").cast("double")
    return own.crossJoin(total).select("n", F.when(F.col("n") >= 2, (F.col("ss") - F.col("own")) / (n * F.when(n > 1, n - 1))).alias("mean_cosine"))


def embedding_health(emb: DataFrame, dim: int | None = None) -> DataFrame:
    """One row: n, wrong_width, non_finite, zero_norm (counts of vectors)."""
    bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull()
    wide = F.size("v") != (F.lit(dim) if dim is not None else F.first(F.size("v")).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    x = emb.select(wide.alias("w"), F.exists("v", bad).alias("f"), (vec.norm(F.col("v")) < NORM_EPS).alias("z"))
    return x.agg(F.count("*").alias("n"), F.count_if("w").alias("wrong_width"), F.count_if("f").alias("non_finite"), F.count_if("z").alias("zero_norm"))


def checks(docs: DataFrame, index: DataFrame, emb: DataFrame, queries: DataFrame, retrieval: DataFrame, dim: int | None = None) -> DataFrame:
    """A row for each stage in order: ord, stage, reason (null if it holds). All stages are judged, none depends on another."""
    d = docs.agg(F.count("*").alias("n"), F.count_if(F.trim("text") != "").alias("full"))
    ingest = d.select(F.lit(0).alias("ord"), F.when(F.col("n") == 0, "no-docs").when(F.col("full") == 0, "no-text").alias("reason"))

    ids = index.agg(F.count("*").alias("ni"), F.countDistinct("id").alias("nd"))
    dangling = index.join(docs.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("lost"))
    idx = d.crossJoin(ids).crossJoin(dangling).select(F.lit(1).alias("ord"), F.when(F.col("ni") != F.col("n"), "count-mismatch").when(F.col("nd") != F.col("ni"), "duplicate-ids").when(F.col("lost") > 0, "dangling-ids").alias("reason"))

    health = embedding_health(emb, dim).withColumnRenamed("n", "ne").crossJoin(ids).crossJoin(anisotropy(emb).select("mean_cosine"))
    e = health.select(
        F.lit(2).alias("ord"),
        F.when(F.col("ne") != F.col("ni"), "shape-mismatch").when(F.col("wrong_width") > 0, "width-mismatch").when(F.col("non_finite") > 0, "non-finite").when(F.col("zero_norm") > 0, "zero-norm").when((F.col("ne") >= 2) & (F.col("mean_cosine") > ANISOTROPY_MAX), "anisotropic").alias("reason"),
    )

    hits = retrieval.join(index.select("id", F.lit(True).alias("known")).distinct(), "id", "left")
    per = queries.select("qi").join(hits.groupBy("qi").agg(F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("lost")), "qi", "left")
    failed = per.select("qi", F.when(F.coalesce("n", F.lit(0)) == 0, "empty-result").when(F.col("lost") > 0, "unknown-id").alias("reason")).where("reason is not null")
    r = failed.agg(F.min_by("reason", "qi").alias("reason")).select(F.lit(3).alias("ord"), "reason")

    w = Window.partitionBy("qi").orderBy("rank")
    s = retrieval.withColumn("next", F.lead("score").over(w)).groupBy("qi").agg(
        F.count("*").alias("n"), F.count_if(F.isnan("score") | (F.abs("score") == float("inf")) | F.col("score").isNull()).alias("odd"), F.count_if(F.col("score") < F.col("next") - 1e-12).alias("up"), (F.max("score") - F.min("score")).alias("span")
    )
    failed = s.select("qi", F.when(F.col("odd") > 0, "non-finite").when(F.col("up") > 0, "not-descending").when((F.col("n") >= 2) & (F.col("span") <= SCORE_EPS), "tied-scores").alias("reason")).where("reason is not null")
    sc = failed.agg(F.min_by("reason", "qi").alias("reason")).select(F.lit(4).alias("ord"), "reason")
    out = ingest.unionByName(idx).unionByName(e).unionByName(r).unionByName(sc)
    return out.select("ord", F.array(*[F.lit(x) for x in STAGES])[F.col("ord")].alias("stage"), "reason")


def stage_status(checked: DataFrame) -> DataFrame:
    """stage, status: ok up to the first failure, dead there, skipped after it."""
    first = checked.where("reason is not null").agg(F.coalesce(F.min("ord"), F.lit(99)).alias("dead"))
    status = F.when(F.col("ord") < F.col("dead"), "ok").when(F.col("ord") == F.col("dead"), "dead").otherwise("skipped")
    return checked.crossJoin(first).select("ord", "stage", status.alias("status"), F.when(F.col("ord") == F.col("dead"), F.col("reason")).alias("reason"))


def first_dead(checked: DataFrame) -> DataFrame:
    """One row: the root cause (null if all hold)."""
    f = F.col("reason").isNotNull()
    return checked.agg(F.min_by(F.when(f, F.col("stage")), F.when(f, F.col("ord"))).alias("dead_stage"), F.min_by(F.when(f, F.col("reason")), F.when(f, F.col("ord"))).alias("reason"))


def last_dead(checked: DataFrame) -> DataFrame:
    """One row: the deepest failing stage, as a symptom-based reading would name it."""
    f = F.col("reason").isNotNull()
    return checked.agg(F.max_by(F.when(f, F.col("stage")), F.when(f, F.col("ord"))).alias("dead_stage"))
