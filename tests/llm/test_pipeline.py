"""The pipeline's stages against plain versions of what each may do."""

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import ngram_join

RNG = np.random.default_rng(8)
VOCAB = [f"word{i}" for i in range(90)] + ["the", "of", "and"]


def prose(n):
    return " ".join(RNG.choice(VOCAB, n))


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    passage = prose(40)
    good = [(i, prose(90), "en", "s", 1) for i in range(60)]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in prose(60).split()), "en", "s", 1) for i in range(40)]
    copy = [(200, good[7][1], "en", "s", 1), (201, good[8][1].replace(good[8][1].split()[40], "other", 1), "en", "s", 1)]
    leak = [(300, passage, "en", "s", 1), (301, prose(900) + " " + passage + " " + prose(60), "en", "s", 1)]
    private = [(400, prose(60) + " card 4041894974608795 " + prose(20), "en", "s", 1)]
    docs = spark.createDataFrame(good + bad + copy + leak + private, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash"))
    docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(60), *range(100, 140)]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    held, kept = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        held = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(held)
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in kept]
    clean = set(range(60))
    assert clean <= ids[0] and len(ids[0] & set(range(100, 140))) <= 2
    assert clean <= ids[1] and not ids[1] & {200, 201} and {300, 301, 400} <= ids[1]
    assert clean <= ids[2] and 300 not in ids[2] and 301 in ids[2]
    cut = kept[2].where("doc_id = 301").first()
    assert passage not in cut["text"] and cut["n_chars"] == len(cut["text"])
    text = {r["doc_id"]: r["text"] for r in kept[3].collect()}
    assert "4041894974608795" not in text[400] and re.search(r" card 4\d{15} ", text[400])
    assert all(text[i] == t for i, t, *_ in good)
    assert ids[4] == ids[3]


def test_pipeline_stages_and_empty_input(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "pii", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and ngram_join.WORDS == 5 and ngram_join.SIMILARITY == 0.8
