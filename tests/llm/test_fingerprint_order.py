"""Fingerprints: followers across parts by brute force, ids of any type, rows that share an id, and repeated rows."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import fingerprint

RNG = np.random.default_rng(41)


def prose(n):
    return " ".join(RNG.choice([f"w{i}" for i in range(70)], n))


def want(texts):
    out = []
    for k, t in enumerate(texts):
        after, half = texts[(k + 1) % len(texts)], len(t) // 2
        out.append((len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    return out


def test_followers_across_many_parts_and_textual_ids(spark):
    texts = [prose(int(n)) for n in RNG.integers(0, 60, 400)]
    df = spark.createDataFrame([(f"d{i:04d}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(5)
    for part_bytes in (500, 1 << 25):
        got = sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in fingerprint.sign(df, part_bytes=part_bytes).collect())
        assert [(n, s) for _, n, s, _ in got] == want(texts)
    prints = fingerprint.fingerprints(texts)
    assert [f for *_, f in got] == [fingerprint.encode(p, not t) for p, t in zip(prints, texts, strict=True)]


def test_shared_null_and_repeated_ids_are_spread(spark):
    texts = [prose(20) for _ in range(300)]
    rows = [(None, t) for t in texts] + [(5, "the same text")] * 200 + [(None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("i", "t", "h", "n", "part", "Fingerprint", "last")})
    out = fingerprint.sign(df, part_bytes=400)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    hashed = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "coalesce(text, '') as t").withColumn("h", F.xxhash64("t")).collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    assert sorted((r.n_chars, r.edited_sha256) for r in got) == sorted(want([r.t for r in order]))
    assert {r.near_next for r in got if r.doc_id == 5 and r.near_next != 0.0} == {1.0}


def test_empty_table(spark):
    assert fingerprint.sign(spark.createDataFrame([], "doc_id long, text string")).count() == 0
