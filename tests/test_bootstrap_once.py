"""The bootstrap reads its differences once, draws where the replicates are, and lists no pairs of equal labels."""

import hashlib
from statistics import mean

import numpy as np
import pytest

from tallyspark.operators import reindex, retrieval, stats
from tallyspark.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_are_searched_once_and_no_label_pairs_are_joined(spark):
    plan = plan_of(catalog.QUERIES["bootstrap_ci"](spark, FOLDER))
    assert plan.count("MapInArrow") == 1
    assert "Generate explode(sequence" not in plan  # draws, which one task made and the driver then broadcast


def test_replicates_equal_plain_ones_whatever_rows_are_missing(spark):
    values = [(i, float(i * i % 17) if i % 5 else None) for i in range(23)]
    draw = lambda b, k: int(hashlib.md5(f"1234:{b}:{k}".encode()).hexdigest()[:12], 16) % len(values)
    drawn = [[values[draw(b, k)][1] for k in range(len(values))] for b in range(50)]
    means = [mean(x for x in r if x is not None) for r in drawn]
    got = stats.bootstrap_mean(spark.createDataFrame(values[::-1], "q int, v double"), "v", "q", replicates=50).first()
    want = (mean(v for _, v in values if v is not None), *np.quantile(means, [0.025, 0.975]))
    assert tuple(got) == pytest.approx(want, abs=1e-12)
    none = stats.bootstrap_mean(spark.createDataFrame([], "q int, v double"), "v", "q").collect()
    assert [tuple(r) for r in none] == [(None, None, None)]


def test_pooled_delta_judges_only_the_union(spark):
    old = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1)], "qid int, id int, rank int")
    new = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (3, 30, 1)], "qid int, id int, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 12), (1, 99), (2, 20), (2, 20), (3, 31)], "qid int, id int")
    got = {r.qid: r.delta for r in reindex.pooled_delta(old, new, relevant, "qid", "id").collect()}
    ideal = 1 + 1 / np.log2(3)
    assert got == pytest.approx({1: 1 - (1 / np.log2(3)) / ideal, 2: -1.0})


def test_dense_top_k_breaks_ties_by_id_also_over_many_equal_vectors(spark):
    rng = np.random.default_rng(5)
    some = rng.integers(-1, 2, (60, 3)).astype(float)
    items = [(i, some[i % 60].tolist()) for i in rng.permutation(400).tolist()]
    queries = [(q, some[q].tolist()) for q in range(0, 60, 7)]
    got = retrieval.dense_top_k(spark.createDataFrame(queries, "qid int, v array<double>"), spark.createDataFrame(items, "id int, v array<double>"), 9)
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    want = {(q, r + 1): i for q, v in queries for r, (_, i) in enumerate(sorted((-round(float(unit(v) @ unit(w)), 9), i) for i, w in items)[:9])}
    assert {(r.qid, r["rank"]): r.id for r in got.collect()} == want
