"""Statistics whose edge cases are part of the contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / F.when(b != 0, b))


def precision_recall(df: DataFrame, predicted: str, actual: str, empty: float = 1.0) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1; empty denominators give ``empty`` (f1: 0)."""
    p, a = F.col(predicted), F.col(actual)
    c = df.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"), empty)).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"), empty))
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """By class: support, predicted count, precision, recall (0 for empty denominators)."""
    pairs = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hit")))).alias("x")).select("x.*")
    out = both.groupBy("class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    return out.select("class", "support", "predicted", ratio(F.col("hit"), F.col("predicted"), 0.0).alias("precision"), ratio(F.col("hit"), F.col("support"), 0.0).alias("recall"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rate of agreement of two booleans and Cohen's kappa (0 without rows, 1 if chance is certain)."""
    c = df.agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"), F.count_if(F.col(a)).alias("na"), F.count_if(F.col(b)).alias("nb"))
    n = F.when(F.col("n") > 0, F.col("n"))
    po = F.col("same") / n
    pe = (F.col("na") / n) * (F.col("nb") / n) + (1 - F.col("na") / n) * (1 - F.col("nb") / n)
    kappa = F.when(F.col("n") == 0, 0.0).when(pe >= 1, 1.0).otherwise((po - pe) / F.when(pe < 1, 1 - pe))
    return c.select("n", F.coalesce(po, F.lit(0.0)).alias("agreement"), kappa.alias("kappa"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: correlation; 0 with fewer than two rows or a constant side."""
    c = df.agg(F.count("*").alias("n"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), F.covar_pop(x, y).alias("cov"))
    flat = (F.col("n") < 2) | (F.col("sx") == 0) | (F.col("sy") == 0)
    return c.select(F.when(flat, 0.0).otherwise(F.col("cov") / F.when(~flat, F.col("sx") * F.col("sy"))).alias("pearson"))


def kendall(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """One row: tau with ties of both counted in both tie totals. Rows are scenarios (few); pairs are joined by key order."""
    a, b = df.select(F.col(key).alias("ka"), F.col(x).alias("xa"), F.col(y).alias("ya")), df.select(F.col(key).alias("kb"), F.col(x).alias("xb"), F.col(y).alias("yb"))
    p = a.join(b, F.col("ka") < F.col("kb")).select(F.signum(F.col("xa") - F.col("xb")).alias("dx"), F.signum(F.col("ya") - F.col("yb")).alias("dy"))
    s = F.col("dx") * F.col("dy")
    c = p.agg(F.count_if(s > 0).alias("con"), F.count_if(s < 0).alias("dis"), F.count_if(F.col("dx") == 0).alias("tx"), F.count_if(F.col("dy") == 0).alias("ty"))
    base = F.sqrt((F.col("con") + F.col("dis") + F.col("tx")).cast("double") * (F.col("con") + F.col("dis") + F.col("ty")))
    return c.select(F.when(base == 0, 0.0).otherwise((F.col("con") - F.col("dis")) / F.when(base != 0, base)).alias("tau"))


def bootstrap_mean(df: DataFrame, value: str, order: str, replicates: int = 2000, seed: int = 1234, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """One row: mean and percentile interval of the mean under resampling with replacement.

    Draw i of replicate b is the row number md5(seed:b:i) mod n, so any engine draws alike. The input is a gate's
    per-query differences: they are read once, sorted into one array, and that one row is sent to the replicates, which
    are spread over all cores. No draw is ever broadcast or sent to the driver.
    """
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    one = df.agg(F.avg(value).alias("mean"), F.transform(held, lambda x: x["v"]).alias("vs")).where(F.size("vs") > 0)
    n = F.size("vs")
    pick = lambda d: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b"), d)), 1, 12), 16, 10).cast("bigint") % n
    drawn = F.transform(F.sequence(F.lit(0), n - 1), lambda d: F.get("vs", pick(d).cast("int")))
    draws = df.sparkSession.range(replicates).withColumnRenamed("id", "b").crossJoin(F.broadcast(one)).select("b", "mean", F.explode(drawn).alias("v"))
    means = draws.groupBy("b").agg(F.max("mean").alias("mean"), F.avg("v").alias("m"))
    ci = means.agg(F.max("mean").alias("mean"), F.percentile("m", F.array(F.lit(low), F.lit(high))).alias("q"))
    return ci.select("mean", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))
