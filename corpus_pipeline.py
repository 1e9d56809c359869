"""A training-corpus pipeline: quality filter, near-duplicate removal, decontamination, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of ``docs``. Null and empty texts pass every filter that doesn't judge them; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, ngram_join, packing, pii, quality
from tallyspark.llm.queries import fold, pii_key, table, tokenizer_path

#: SQL can express neither the classifier nor the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted quality of 1; the model learns from the labels outside fold 0.

    Null and empty texts have no features and are judged by the bias alone; repeated rows are judged alike.
    Without labels every score is 0.5, above the threshold, and all stay.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    scored = quality.score(_own(docs), model, [f"d_{c}" for c in docs.columns], "d_text")
    return scored.where("predicted = 1").select(*[F.col(f"`d_{c}`").alias(c) for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id (a null id before all others).

    Of rows that share this id the one whose text has the least hash stays, once. Null, empty and wordless texts are no
    copies of anything and stay.
    """
    return ngram_join.one_of_each_class(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents; fewer benchmark words than that are cut out of the text.

    Null and empty texts have no hit and stay as they are, as does everything where the benchmark is empty; repeated
    rows are cut alike.
    """
    own = _own(docs)
    found = decontaminate.find_contamination(own, table(spark, sf_dir, "benchmark"), own.columns, "d_text")
    clean = found.where(~decontaminate.contaminated())
    text = F.when(F.col("n_hit") > 0, decontaminate.excise(F.col("d_text"), F.col("spans"))).otherwise(F.col("d_text"))
    clean = clean.withColumn("new_text", text)
    return _with_text(clean, docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values replaced by pseudonyms of the same format; null and empty texts stay, repeated rows change alike."""
    own = _own(docs).withColumn("new_text", F.col("d_text"))
    return _with_text(pii.pseudonymise(own, pii_key(spark), "new_text"), docs.columns)


def _own(docs: DataFrame) -> DataFrame:
    """All columns under names that no operator's output has."""
    return docs.select(*[F.col(f"`{c}`").alias(f"d_{c}") for c in docs.columns])


def _with_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns again, with the new text and its length where it changed."""
    changed = ~F.col("new_text").eqNullSafe(F.col("d_text"))
    new = {"text": F.col("new_text"), "n_chars": F.when(changed, F.length("new_text").cast("bigint")).otherwise(F.col("d_n_chars")) if "n_chars" in columns else None}
    return df.select(*[(new[c] if c in new else F.col(f"`d_{c}`")).alias(c) for c in columns])


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. A null or empty text is the end id alone; repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pseudonyms),
    ("packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
