"""Perplexity and heuristic quality filter, calibrated on texts that count as clean."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text as T

# Common English words.
STOPWORDS = "the and of to a in is it for on with as are was at by an be this that from or they their its into each both have has".split()


def _prepared(text: Column) -> Column:
    return F.concat(F.lit("  "), F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), F.lit(" "))


def trigrams(docs: DataFrame) -> DataFrame:
    """(id, grams): each text of (id, text) with its character trigrams and their counts, in one row."""
    import pyarrow as pa

    p = docs.where("text is not null").select("id", _prepared(F.col("text")).alias("s"))

    def count(batches):
        for batch in batches:
            made = []
            for s in batch.column("s").to_pylist():
                made.append(list(Counter(map("".join, zip(s, s[1:], s[2:], strict=False))).items()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.map_(pa.string(), pa.int64()))], ["id", "grams"])

    return p.mapInArrow(count, f"id {dict(p.dtypes)['id']}, grams map<string,bigint>")


def train(grams: DataFrame) -> DataFrame:
    """(gram, count): the model; it grows with the alphabet, not with the texts."""
    return grams.select(F.explode("grams").alias("gram", "n")).groupBy("gram").agg(F.sum("n").alias("count"))


#: Trigrams of a model that is sent to every task; a larger one is joined.
BROADCAST_GRAMS = 2_000_000


def perplexity(grams: DataFrame, model: DataFrame) -> DataFrame:
    """(id, ppl): mean negative log probability with add-one smoothing over the model's vocabulary.

    A model of a checked size is held by each worker and each text is scored in its row; the texts are never shuffled.
    """
    import pyarrow as pa

    rows = model.limit(BROADCAST_GRAMS + 1).collect()
    if len(rows) > BROADCAST_GRAMS:
        return _joined_perplexity(grams, model)
    total: Counter = Counter()
    for r in rows:
        total[r["gram"][:2]] += r["count"]
    size = max(1, len({r["gram"][2] for r in rows}))
    shared = grams.sparkSession.sparkContext.broadcast(({r["gram"]: -math.log((r["count"] + 1) / (total[r["gram"][:2]] + size)) for r in rows}, {c: -math.log(1 / (n + size)) for c, n in total.items()}, -math.log(1 / size)))

    def score(batches):
        known, context, other = shared.value
        for batch in batches:
            out = []
            for held in batch.column("grams").to_pylist():
                n = sum(c for _, c in held)
                lost = sum(c * (known[g] if g in known else context.get(g[:2], other)) for g, c in held)
                out.append(lost / n if n else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.float64())], ["id", "ppl"])

    return grams.mapInArrow(score, f"id {dict(grams.dtypes)['id']}, ppl double").where("ppl is not null")


def _joined_perplexity(grams: DataFrame, model: DataFrame) -> DataFrame:
    context = model.groupBy(F.substring("gram", 1, 2).alias("ctx")).agg(F.sum("count").alias("total"))
    v = model.agg(F.greatest(F.countDistinct(F.substring("gram", 3, 1)), F.lit(1)).alias("v"))
    rows = grams.select("id", F.explode("grams").alias("gram", "n")).withColumn("ctx", F.substring("gram", 1, 2))
    both = rows.join(model, "gram", "left").join(context, "ctx", "left").crossJoin(F.broadcast(v))  # one row
    lp = -F.ln((F.coalesce("count", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + F.col("v")))
    return both.groupBy("id").agg((F.sum(F.col("n") * lp) / F.sum("n")).alias("ppl"))


def features(text: Column) -> dict[str, Column]:
    """symbol_ratio, non_alnum, mean_word, stopword_ratio of a text."""
    words = lambda p, x: F.regexp_extract_all(x, F.lit(p), F.lit(0))
    w, s = words("[A-Za-z]+", text), words("[A-Za-z']+", F.lower(text))
    solid = F.regexp_replace(text, r"\s", "")
    part = lambda a, b, empty: F.when(b == 0, F.lit(empty)).otherwise(a / F.when(b != 0, b))
    return {
        "symbol_ratio": part(F.size(words("[#.]", text)), F.size(w), 0.0),
        "non_alnum": part(F.length(F.regexp_replace(solid, "[A-Za-z0-9]", "")), F.length(solid), 1.0),
        "mean_word": part(F.length(F.array_join(w, "")), F.size(w), 0.0),
        "stopword_ratio": part(F.size(F.filter(s, lambda x: x.isin(STOPWORDS))), F.size(s), 0.0),
    }


def table(docs: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """(id, ppl, features...) over (id, text); the model defaults to that of the texts themselves."""
    grams = trigrams(docs)
    ppl = perplexity(grams, train(grams) if model is None else model)
    return docs.select("id", *[c.alias(n) for n, c in features(F.col("text")).items()]).join(ppl, "id", "left")


def calibrate(clean: DataFrame, margin: float = 0.15) -> DataFrame:
    """One row of bounds that every clean row passes."""
    return clean.agg(
        (F.max("ppl") * (1 + margin)).alias("ppl_max"), (F.min("mean_word") - 1).alias("word_lo"), (F.max("mean_word") + 1).alias("word_hi"), (F.max("symbol_ratio") + 0.1).alias("symbol_max"), (F.max("non_alnum") + 0.05).alias("non_alnum_max"), F.greatest(F.lit(0.0), F.min("stopword_ratio") - 0.05).alias("stopword_min")
    )


def judge(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """(id, reasons, dropped) of feature rows under one row of bounds."""
    x = rows.crossJoin(F.broadcast(bounds))
    flags = [("perplexity", F.col("ppl") > F.col("ppl_max")), ("symbols", F.col("symbol_ratio") > F.col("symbol_max")), ("non-alphanumeric", F.col("non_alnum") > F.col("non_alnum_max")), ("word length", ~F.col("mean_word").between(F.col("word_lo"), F.col("word_hi"))), ("stopwords", F.col("stopword_ratio") < F.col("stopword_min"))]
    reasons = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags]), lambda r: r.isNotNull())
    return x.select("id", reasons.alias("reasons")).withColumn("dropped", F.size("reasons") > 0)
