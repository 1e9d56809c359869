"""Provenance: where in a source does a quotation stand, and how did that change between two versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text as T


def exact_spans(source: Column, quote: Column) -> Column:
    """The plain-substring resolver: struct(status, start, stop) without any folding."""
    n = T.occurrences(source, quote)
    at = F.instr(source, quote)
    status = F.when(n == 0, "UNRESOLVED").when(n > 1, "AMBIGUOUS").otherwise("RESOLVED")
    return F.struct(status.alias("status"), F.when(n == 1, at - 1).alias("start"), F.when(n == 1, at - 1 + F.length(quote)).alias("stop"))


def manifest(sources: DataFrame, citations: DataFrame) -> DataFrame:
    """source_id, cite_id, quote, status, start, stop (code points of the source, null unless RESOLVED).

    Sources are folded once each; a quotation that stands more than once (counted without overlap) is AMBIGUOUS.
    Citations join their source on source_id. Offsets are looked up for resolved ones only.
    """
    folded = sources.select("source_id", "source", T.canonicalize(F.col("source")).alias("canon"))
    quotes = citations.select("source_id", "cite_id", "quote", T.canonicalize(F.col("quote")).alias("needle"))
    both = quotes.join(folded, "source_id", "left")
    n = F.coalesce(T.occurrences(F.col("canon"), F.col("needle")), F.lit(0))
    both = both.withColumn("n", n).withColumn("at", F.when(F.col("n") == 1, F.expr("locate(needle, canon)")))
    status = F.when(F.col("n") == 0, "UNRESOLVED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("RESOLVED")
    offset = lambda at: F.when(F.col("at") > 0, T.source_offset(F.col("source"), F.col("canon"), at))
    start, stop = offset(F.col("at") - 1), offset(F.col("at") + F.length("needle") - 2) + 1
    return both.select("source_id", "cite_id", "quote", status.alias("status"), start.alias("start"), stop.alias("stop"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Citations of the old manifest: AMBIGUOUS, LOST, GAINED, DRIFTED (with delta) or STABLE. New ones are not reported."""
    b = new.select("cite_id", F.col("status").alias("new_status"), F.col("start").alias("new_start"), F.col("stop").alias("new_stop"))
    both = old.join(b, "cite_id", "left").withColumn("new_status", F.coalesce("new_status", F.lit("UNRESOLVED")))
    has, had = F.col("new_status") == "RESOLVED", F.col("status") == "RESOLVED"
    moved = had & has & ((F.col("start") != F.col("new_start")) | (F.col("stop") != F.col("new_stop")))
    change = (
        F.when((F.col("status") == "AMBIGUOUS") | (F.col("new_status") == "AMBIGUOUS"), "AMBIGUOUS").when(had & ~has, "LOST").when(~had & has, "GAINED").when(moved, "DRIFTED").otherwise("STABLE")
    )
    return both.select("cite_id", change.alias("change"), F.when(moved, F.col("new_start") - F.col("start")).alias("delta"))


def recall(resolved: DataFrame, truth: DataFrame) -> DataFrame:
    """By degradation class: share of citations resolved at their true start (0 without citations)."""
    both = truth.join(resolved.select("cite_id", "status", "start"), "cite_id", "left")
    hit = ((F.col("status") == "RESOLVED") & (F.col("start") == F.col("true_start"))).cast("int")
    return both.groupBy("degradation").agg(F.coalesce(F.avg(F.coalesce(hit, F.lit(0))), F.lit(0.0)).alias("recall"))


def false_positive_rate(resolved: DataFrame) -> DataFrame:
    """Share of (negative) citations that got any answer, ambiguous ones included."""
    return resolved.agg(F.coalesce(F.avg((F.col("status") != "UNRESOLVED").cast("int")), F.lit(0.0)).alias("false_positive_rate"))


def render(manifest_: DataFrame) -> DataFrame:
    """A JSON line for each citation, ordered by id."""
    return manifest_.orderBy("cite_id").select(F.to_json(F.struct("cite_id", "quote", "start", "status", "stop")).alias("value"))
