"""Quality classifier: scores are sparse dot products, training is bounded, and odd inputs."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import quality

RNG = np.random.default_rng(5)
SCHEMA = "doc_id long, text string"
LABELS = "doc_id long, quality int"


def prose(n=40):
    return " ".join(RNG.choice([f"w{i}" for i in range(60)], n))


def test_scores_are_dot_products_of_features_and_weights(spark):
    rows = [(i, prose() if i % 3 else prose().upper() + "!!") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    weights, bias = model = quality.train(docs, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], LABELS))
    got = {r.doc_id: r for r in quality.score(docs, model, ["doc_id"]).collect()}
    for i, t in rows:
        index, value, _ = quality.features(pa.array([t]))
        want = 1 / (1 + math.exp(-sum(float(weights[k]) * v for k, v in zip(index, value, strict=True)) - bias))
        assert got[i].score == pytest.approx(want, abs=1e-6) and got[i].predicted == int(want >= 0.3)


def test_features_are_log_counts_of_words_pairs_and_shapes_at_unit_length():
    text = "One two two,  ONE two"
    index, value, n = quality.features(pa.array([text, "", None]))
    w = text.split()
    shape = ["one", "two", "two,", "ONE", "two"]
    # five words (three kinds without case), four pairs (three kinds), and the shapes of 1, 2 and 3 words
    words, pairs = Counter(x.lower() for x in w), Counter(zip([x.lower() for x in w], [x.lower() for x in w[1:]], strict=False))
    assert n.tolist()[1:] == [0, 0] and np.sum(value**2) == pytest.approx(1)
    ratio = sorted(round(float(v / value.min()), 3) for v in value)
    assert ratio.count(1.0) >= sum(c == 1 for c in words.values()) + sum(c == 1 for c in pairs.values()) and len(shape) == 5
    assert max(ratio) == pytest.approx(1 + math.log(max(*words.values(), *pairs.values(), 2)), abs=0.5)


def test_ftrl_follows_its_published_update():
    rows = [(np.array([0, 1]), np.array([0.6, 0.8]), 1), (np.array([1, 2]), np.array([0.6, 0.8]), 0)]
    alpha, beta, l1, l2 = 0.5, 1.0, 1e-3, 1e-3
    z, n = [0.0] * 5, [0.0] * 5

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for index, value, y in rows:
            x = {**dict(zip(index.tolist(), value.tolist(), strict=True)), 4: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y) * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    got, bias = quality.ftrl(rows, bits=2, epochs=3)
    assert got.tolist() == pytest.approx([weight(i) for i in range(4)], abs=1e-6) and bias == pytest.approx(weight(4))


def test_repeated_ids_bounds_textual_ids_and_clashing_columns(spark):
    rows = [(i, prose()) for i in range(30)]
    labels = [(i, i % 2) for i in range(30)]
    model = quality.train(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS))
    more = spark.createDataFrame(rows + rows[:5] * 40 + [(None, "x"), (3, None)], SCHEMA)
    again = quality.train(more, spark.createDataFrame(labels + labels + [(None, 1), (4, None)], LABELS))
    assert np.array_equal(model[0], again[0]) and model[1] == again[1]  # copies neither count nor crowd
    few = quality.train(more, spark.createDataFrame(labels, LABELS), most_features=1)
    assert np.count_nonzero(few[0]) <= 5 * 45  # one document
    textual = quality.train(spark.createDataFrame(rows, SCHEMA).withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), spark.createDataFrame(labels, LABELS).withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert np.count_nonzero(textual[0])
    odd = spark.createDataFrame([(1, "a " * 300_000), (1, "a " * 300_000), (None, None), (2, " \n")], SCHEMA).withColumn("Predicted", F.lit("clash"))
    got = quality.score(odd, model, ["doc_id", "Predicted"]).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id == 1}) == 1
    assert [r.score for r in got if r.doc_id != 1] == pytest.approx([1 / (1 + math.exp(-model[1]))] * 2)
