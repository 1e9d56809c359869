"""Command line over the gates. Exit codes: 0 clean; 2 drift, dead stage or dangling reference; 1 failed or unresolved."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from tallyspark.operators import conservation, coverage, drift, liveness, provenance, refs
from tallyspark.sources import files


def _print(df: DataFrame) -> None:
    print("\n".join(files.report_lines(df)))


def sync(spark: SparkSession, a: argparse.Namespace) -> int:
    edges = files.json_edges(spark, a.edges)
    status = refs.gate(refs.resolve(edges, files.json_list(spark, a.live), files.json_list(spark, a.cached)))
    _print(refs.reduction(files.json_map(spark, a.current), files.json_map(spark, a.previous)))
    _print(status)
    return 0 if status.first()["passed"] else 2


def audit(spark: SparkSession, a: argparse.Namespace) -> int:
    registry = files.json_list(spark, a.registry, "entity")
    run = lambda path: coverage.audit(registry, files.json_mentions(spark, path), a.own, a.others.split(","))
    now = run(a.mentions)
    _print(now.orderBy("entity"))
    if not a.previous:
        return 0
    worse = drift.severity_drift(run(a.previous), now).where("worse")
    _print(worse)
    return 0 if worse.isEmpty() else 2


def conserve(spark: SparkSession, a: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    source = files.whole_text(spark, a.source).select(F.lit("doc").alias("doc_id"), F.col("value").alias("source"))
    run = lambda path: conservation.per_type(conservation.manifest(source, files.json_list(spark, path, "chunk").withColumn("doc_id", F.lit("doc"))), source)
    now = run(a.chunks)
    _print(now)
    if not a.previous:
        return 0
    lost = drift.ratio_drift(run(a.previous), now, ["doc_id", "type"]).where("regressed")
    _print(lost)
    return 0 if lost.isEmpty() else 2


def live(spark: SparkSession, a: argparse.Namespace) -> int:
    p = files.pipeline_artifacts(spark, a.artifacts)
    checked = liveness.checks(p["docs"], p["index"], p["emb"], p["queries"], p["retrieval"], p["params"].first()["dim"])
    _print(liveness.stage_status(checked))
    return 2 if liveness.first_dead(checked).first()["dead_stage"] else 0


def cite(spark: SparkSession, a: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    source = files.whole_text(spark, a.source).select(F.lit("doc").alias("source_id"), F.col("value").alias("source"))
    quotes = files.json_map(spark, a.citations, "cite_id", "quote").withColumn("source_id", F.lit("doc"))
    found = provenance.manifest(source, quotes)
    _print(provenance.render(found))
    return 0 if found.where("status <> 'RESOLVED'").isEmpty() else 1


def regression(spark: SparkSession, a: argparse.Namespace) -> int:
    """Passes unless the whole interval of the pooled nDCG difference lies below the margin."""
    from pyspark.sql import functions as F

    from tallyspark.functions import text as T
    from tallyspark.functions import vec
    from tallyspark.operators import reindex, retrieval

    docs = files.json_list(spark, a.docs, "text").select(F.col("pos").alias("id"), "text")
    probes = retrieval.mine_probes(docs).select(F.col("id").alias("qid"), "query")
    oracle = reindex.similarity_oracle(docs, vec.blake_slots(T.tokens(F.col("text")), "keyed128", 256, vec.ORACLE_SEED))
    old, new = (reindex.search(docs, probes, *_index(x)).drop("chunk_no") for x in (a.old, a.new))
    verdict = reindex.gate(old, new, oracle, "qid", "id")
    _print(verdict)
    return 0 if verdict.first()["passed"] else 1


def _index(given: str) -> tuple[str, str, int, int]:
    """chunker:dim:seed, such as whole:256:1."""
    chunker, dim, seed = given.split(":")
    return chunker, "keyed64", int(dim), int(seed)


COMMANDS = {
    "reindex": (regression, ["docs", "old", "new"], []),
    "sync": (sync, ["current", "previous", "edges", "live", "cached"], []),
    "coverage": (audit, ["registry", "mentions", "own", "others"], ["previous"]),
    "conservation": (conserve, ["source", "chunks"], ["previous"]),
    "liveness": (live, ["artifacts"], []),
    "provenance": (cite, ["source", "citations"], []),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyspark")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (_, needed, optional) in COMMANDS.items():
        p = sub.add_parser(name)
        for x in needed:
            p.add_argument(f"--{x}", required=True)
        for x in optional:
            p.add_argument(f"--{x}")
    args = parser.parse_args(argv)
    return COMMANDS[args.command][0](spark or SparkSession.builder.appName("tallyspark").getOrCreate(), args)


if __name__ == "__main__":
    raise SystemExit(main())
