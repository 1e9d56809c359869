"""Substring dedup: rows that share an id or repeat, several levels of buckets, and odd inputs, by brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import substring_dedup

RNG = np.random.default_rng(17)


def prose(n):
    return " ".join(RNG.choice([f"w{i}" for i in range(50)], n))


SHARED = [prose(45) for _ in range(5)]


def brute(spark, rows, n=20):
    """Documents in the order of (id, hash of the text); rows that repeat both are one."""
    hashed = [(-(1 << 63) if r.i is None else r.i, r.x, r.t) for r in spark.createDataFrame(rows, "i long, t string").withColumn("x", F.xxhash64("t")).collect()]
    first = {}
    split = [(i, x, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, x, t in hashed]
    for i, x, w in split:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, (i, x, k)), (i, x, k))
    out = []
    for i, x, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (i, x, k):
                gone[k : k + n] = [True] * n
        out.append((i, len(w), sum(gone), " ".join(a for a, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def run(spark, rows, partitions=3, **sizes):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = substring_dedup.remove_repeats(df, ["doc_id"], **sizes).collect()
    return sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got)


def mixed(n):
    return [f"{prose(int(RNG.integers(0, 30)))} {SHARED[k % 5]} {prose(int(RNG.integers(0, 30)))}" if k % 2 else prose(int(RNG.integers(0, 60))) for k in range(n)]


@pytest.mark.parametrize("partitions", [1, 4])
def test_rows_that_share_an_id_are_documents_of_their_own(spark, partitions):
    texts = mixed(60)
    rows = [(None, t) for t in texts[:25]] + [(7, t) for t in texts[25:40]] + list(enumerate(texts[40:], 10))
    rows += [(None, texts[1])] * 6 + [(7, texts[1])] * 3 + [(12, None), (None, None), (None, "")]
    for sizes in ({}, {"chunk_bytes": 400, "bucket_bytes": 600, "cut_bytes": 300}):
        assert run(spark, rows, partitions, **sizes) == brute(spark, rows)


@pytest.mark.parametrize("ids", ["unique", "null"])
def test_buckets_in_several_levels(spark, monkeypatch, ids):
    monkeypatch.setattr(substring_dedup, "LEVEL_BITS", 3)
    monkeypatch.setattr(substring_dedup, "CHUNK_ENTRIES", 150)
    texts = mixed(80)
    rows = [(k if ids == "unique" else None, t) for k, t in enumerate(texts)]
    assert run(spark, rows, 3, chunk_bytes=1500, bucket_bytes=150, cut_bytes=900) == brute(spark, rows)


def test_clashing_columns_and_long_texts(spark):
    rows = [(1, prose(40_000)), (2, SHARED[0] + " x"), (3, "y " + SHARED[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in ("i", "x", "t", "part", "kind", "piece", "first", "k1", "N_words")})
    out = substring_dedup.remove_repeats(df, ["doc_id", "i", "x", "part", "kind", "piece", "first", "k1", "N_words"])
    got = {r.doc_id: r for r in out.collect()}
    assert [got[k].n_removed for k in (1, 2, 3)] == [r[2] for r in brute(spark, rows)]
    assert all(got[k][c] == f"own {c}" for k in got for c in ("i", "x", "part", "kind", "piece", "first", "k1"))
