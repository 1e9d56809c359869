"""Sources and sinks: JSON documents, maps, lists, edges and pipelines; whole texts; snapshots and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_SCHEMA = "array<struct<`from`:string,`to`:string,reason:string>>"
MENTION_SCHEMA = "array<struct<entity:string,source_type:string,detail:string>>"
ARTIFACT_SCHEMA = "docs array<struct<id:string,text:string>>, index_ids array<string>, embeddings array<array<float>>, queries array<string>, retrieval array<array<array<string>>>, dim int, k int"


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): each file as one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document under an explicit schema; malformed input fails, absent keys are null."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_map(spark: SparkSession, path: str, key: str = "path", value: str = "hash") -> DataFrame:
    """A JSON object as rows, such as paths with hashes or citation ids with quotations."""
    return whole_text(spark, path).select(F.explode(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})).alias(key, value))


def json_list(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """(pos, name): a JSON list of strings; the position matters for chunks."""
    return whole_text(spark, path).select(F.posexplode(F.from_json("value", "array<string>", {"mode": "FAILFAST"})).alias("pos", name))


def json_edges(spark: SparkSession, path: str) -> DataFrame:
    """(from_id, to_id, reason)."""
    rows = whole_text(spark, path).select(F.inline(F.from_json("value", EDGE_SCHEMA, {"mode": "FAILFAST"})))
    return rows.select(F.col("from").alias("from_id"), F.col("to").alias("to_id"), "reason")


def json_mentions(spark: SparkSession, path: str) -> DataFrame:
    rows = whole_text(spark, path).select(F.inline(F.from_json("value", MENTION_SCHEMA, {"mode": "FAILFAST"})))
    return rows.select("entity", "source_type", F.coalesce("detail", F.lit("")).alias("detail"))


def pipeline_artifacts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """docs, index, emb, queries, retrieval and params of a captured pipeline; absent parts are empty, k is 3 by default.

    Hits are [id, score] pairs of mixed type, read as strings and cast.
    """
    one = json_document(spark, path, ARTIFACT_SCHEMA)
    hits = one.select(F.posexplode("retrieval").alias("qi", "hits")).select("qi", F.posexplode("hits").alias("rank", "hit"))
    width = F.size(F.col("embeddings")[0])
    return {
        "docs": one.select(F.inline("docs")),
        "index": one.select(F.posexplode("index_ids").alias("pos", "id")),
        "emb": one.select(F.posexplode("embeddings").alias("pos", "v")),
        "queries": one.select(F.posexplode("queries").alias("qi", "text")),
        "retrieval": hits.select("qi", (F.col("rank") + 1).alias("rank"), F.col("hit")[0].alias("id"), F.col("hit")[1].cast("double").alias("score")),
        "params": one.select(F.coalesce("dim", F.when(width > 0, width), F.lit(256)).alias("dim"), F.coalesce("k", F.lit(3)).alias("k")),
    }


def build_pipeline(docs: DataFrame, queries: DataFrame, slots, dim: int = 256, k: int = 3) -> dict[str, DataFrame]:
    """The same parts made here: embeds docs(id, text) and queries(qi, text) by ``slots`` and retrieves the k nearest."""
    from pyspark.sql import Window

    from tallyspark.functions import text as T
    from tallyspark.operators import retrieval

    placed = docs.withColumn("pos", F.row_number().over(Window.orderBy("id")) - 1)
    v = retrieval.sparse(placed, ["id"], slots(T.tokens(F.col("text"))))
    q = retrieval.sparse(queries, ["qi"], slots(T.tokens(F.col("text"))))
    held = v.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w")).cast("double")).alias("n"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.coalesce(F.try_element_at("m", b) / F.col("n"), F.lit(0.0)).cast("float"))
    hits = retrieval.top_k(retrieval.scores(q, v, "qi", ["id"]), "qi", ["id"], k).select("qi", "rank", "id", F.col("sim").alias("score"))
    emb = placed.join(held, "id", "left").select("pos", dense.alias("v"))
    return {"docs": docs, "index": placed.select("pos", "id"), "emb": emb, "queries": queries, "retrieval": hits}


def spread(df: DataFrame) -> DataFrame:
    """A read table with its rows over all cores, where it has fewer splits than there are cores: a small file is one row group.

    A table of many splits is returned as it is, so a large one is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A run's result for a later drift comparison."""
    df.write.mode("overwrite").format(fmt).save(path)


def read_snapshot(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def report_lines(df: DataFrame, most: int = 200) -> list[str]:
    """A result as text, a line for each row; of a longer one the first ``most`` rows, and a last line that says so."""
    rows = df.limit(most + 1).collect()
    out = [" ".join(f"{k}={v}" for k, v in row.asDict().items()) for row in rows[:most]]
    return out if len(rows) <= most else [*out, f"... {df.count() - most} more rows"]
