"""PII reachability: which private spans can retrieval surface from their context alone, and what must be masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text as T

from . import retrieval

K, WINDOW = 3, 6
# Patterns, a closed list of known names, query words for each kind, and the mask.
EMAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
PHONE = r"\b[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}\b"
NAMES = ("jane doe", "john roe", "mary major", "richard miles")
KEYWORDS = {"email": "email address contact", "ssn": "social security number ssn", "phone": "phone number call", "name": "name person who"}
MASK = " redactedtoken redactedtoken redactedtoken redactedtoken "


def detect(chunks: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """(id, kind, value, start, stop) over (id, text): emails, then SSNs, phones and names; earlier kinds claim their spans."""
    patterns = [("email", EMAIL), ("ssn", SSN), ("phone", PHONE)] + [("name", "(?i)" + "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in n)) for n in names]
    kind = "array<struct<start:int,stop:int,kind:string,value:string>>"
    found = F.array().cast(kind)
    for name, pattern in patterns:
        found = F.concat(found, _tagged(T.finditer(F.col("text"), pattern), name))
    free = lambda acc, x: F.forall(acc, lambda y: (x["stop"] <= y["start"]) | (x["start"] >= y["stop"]))
    claimed = F.aggregate(found, F.array().cast(kind), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return chunks.select("id", F.explode(claimed).alias("s")).select("id", "s.kind", "s.value", "s.start", "s.stop")


def _tagged(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("stop"), F.lit(kind).alias("kind"), x["value"].alias("value")))


def queries(chunks: DataFrame, spans: DataFrame, window: int = WINDOW) -> DataFrame:
    """Spans plus query: words for the kind and the context on both sides, without the secret."""
    words = F.lit(None).cast("string")
    for kind, text in KEYWORDS.items():
        words = F.when(F.col("kind") == kind, text).otherwise(words)
    ctx = F.array_join(T.context_words(F.col("text"), F.col("start"), F.col("stop"), window), " ")
    return spans.join(chunks.select("id", "text"), "id").withColumn("query", F.concat_ws(" ", words, F.when(ctx != "", ctx))).drop("text")


def reachability(chunks: DataFrame, spans: DataFrame, slots, k: int = K, window: int = WINDOW) -> DataFrame:
    """Spans plus query, rank (1..k, else -1) of the span's own chunk for its query, reachable. ``slots`` hashes tokens."""
    q = queries(chunks, spans, window).withColumn("qid", F.concat_ws(":", "id", "kind", "start"))
    index = chunks.select("id", slots(T.tokens(F.col("text"))).alias("slots"))
    qv = retrieval.sparse(q.select("qid", "query"), ["qid"], slots(T.tokens(F.col("query"))))
    ranked = retrieval.best_k(qv, index, "qid", ["id"], k).select("qid", "id", "rank")
    out = q.join(ranked, ["qid", "id"], "left").withColumn("rank", F.coalesce("rank", F.lit(-1)))
    return out.withColumn("reachable", F.col("rank") > 0).drop("qid")


def redact(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, text) with the spans masked."""
    per = spans.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # the spans of one chunk
    return chunks.join(per, "id", "left").select("id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(T.redact(F.col("text"), F.col("spans"), MASK)).alias("text"))


def audit(chunks: DataFrame, slots, k: int = K, window: int = WINDOW, names: tuple[str, ...] = NAMES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored spans, minimal redaction: the reachable ones, spared: the rest)."""
    scored = reachability(chunks, detect(chunks, names), slots, k, window)
    return scored, scored.where("reachable"), scored.where("not reachable")


def over_redaction(scored: DataFrame) -> DataFrame:
    """One row: share of blanket redaction that minimal redaction spares; 0 without spans."""
    return scored.agg(F.when(F.count("*") == 0, 0.0).otherwise(F.count_if(~F.col("reachable")) / F.when(F.count("*") > 0, F.count("*"))).alias("over_redaction"))


def recall_curve(chunks: DataFrame, scored: DataFrame, gold: DataFrame, slots, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(policy, k, recall) for no, minimal and blanket redaction; gold is (qid, query, id)."""
    out = None
    for policy, spans in (("none", None), ("minimal", scored.where("reachable")), ("blanket", scored)):
        held = chunks if spans is None else redact(chunks, spans)
        index = held.select("id", slots(T.tokens(F.col("text"))).alias("slots"))
        q = retrieval.sparse(gold.select("qid", "query"), ["qid"], slots(T.tokens(F.col("query"))))
        ranked = retrieval.best_k(q, index, "qid", ["id"], max(ks))
        for k in ks:
            row = retrieval.recall_at_k(ranked.where(F.col("rank") <= k), gold, "qid", "id").select(F.lit(policy).alias("policy"), F.lit(k).alias("k"), "recall")
            out = row if out is None else out.unionByName(row)
    return out
