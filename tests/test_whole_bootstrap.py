"""The bootstrap query draws as many replicates as the operator does by default."""

import hashlib
from statistics import mean

import numpy as np
import pytest

from tallyspark.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def test_bootstrap_query_equals_2000_plain_replicates(spark):
    v = [r.delta for r in catalog.QUERIES["pooled_ndcg_delta"](spark, FOLDER).orderBy("qid").collect()]
    draw = lambda b, k: int(hashlib.md5(f"1234:{b}:{k}".encode()).hexdigest()[:12], 16) % len(v)
    means = [mean(v[draw(b, k)] for k in range(len(v))) for b in range(2000)]
    got = catalog.QUERIES["bootstrap_ci"](spark, FOLDER).first()
    assert (got.mean, got.ci_low, got.ci_high) == pytest.approx((mean(v), *np.quantile(means, [0.025, 0.975])), abs=1e-8)
