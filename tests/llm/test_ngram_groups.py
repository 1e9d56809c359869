"""N-gram join: rows that share an id, hubs, groups that chance links join, and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import components, ngram_join
from tests.llm.test_operators import brute_links

RNG = np.random.default_rng(23)


def near_copies(n, words, changes, pool=40):
    base = [f"b{k}" for k in RNG.integers(0, 900, words)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in RNG.choice(words, changes, replace=False):
            w[k] = f"x{RNG.integers(pool)}"
        out.append(" ".join(w))
    return out


def test_five_thousand_near_copies_without_id(spark):
    texts = near_copies(5000, 60, 1, 10**6)
    got = ngram_join.link(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")).collect()
    assert len(got) == 5000 and {r.class_id for r in got} == {None}
    sets = [np.unique([hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)]) for w in map(str.split, texts)]
    for k in RNG.choice(5000, 20, replace=False):  # links of some rows, by brute force; equal counts as multisets
        shared = np.array([len(np.intersect1d(sets[k], s, assume_unique=True)) for s in sets])
        want = int((shared >= 0.8 * (len(sets[k]) + np.array([len(s) for s in sets]) - shared) - 1e-9).sum()) - 1
        assert any(r.n_links == want for r in got)


@pytest.mark.parametrize("most_chunks", [0, 1, 8])
def test_band_buckets_as_groups_count_each_pair_once(spark, monkeypatch, most_chunks):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    monkeypatch.setattr(ngram_join, "MOST_CHUNKS", most_chunks)
    rows = list(enumerate(near_copies(50, 100, 2) + near_copies(30, 40, 1) + near_copies(5, 200, 0))) + [(3, "short one"), (None, "short one"), (90, ""), (91, None)]
    got = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2])
    assert sorted([(r.doc_id, r.class_id, r.n_links) for r in got], key=key) == sorted(brute_links(rows), key=key)


def test_shared_ids_repeated_rows_and_clashing_columns(spark):
    rows = [(7, t) for t in near_copies(40, 80, 1)] + [(None, t) for t in near_copies(40, 80, 1)] + [(8, "a b c d e f g")] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("i", "t", "th", "node", "N_links", "class_id", "key")})
    got = ngram_join.link(df).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2])
    assert sorted([(r.doc_id, r.class_id, r.n_links) for r in got], key=key) == sorted(brute_links(rows), key=key)


def test_components_with_hubs_and_chains(spark):
    edges = [(1, k) for k in range(2, 3000)] + [(k, k + 1) for k in range(10_000, 10_200)] + [(k, 9000) for k in range(5000, 6000)] + [(None, 4), (4, 4)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 1 for k in range(1, 3000)} | {k: 10_000 for k in range(10_000, 10_201)} | {k: 5000 for k in [*range(5000, 6000), 9000]}
    assert got == want


def test_least_value_of_a_key_in_slices(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(300)], "a long, b long")
    assert {(r.a, r.m) for r in components.with_least(df, "a", "b", 7).collect()} == {(0, 0), (1, 1), (2, 2)}
