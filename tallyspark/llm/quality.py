"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal, scored as sparse dots.

Three views of the words (runs of non-space) are hashed into one space: the word itself without case,
pairs of neighbouring words, and the shape of a word (which kinds of characters it has, whether it repeats
the word before) alone, in pairs and in triples. Shapes are what carries over to unseen vocabularies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import LOWER, NONSPACE, cut_lineage, doc_of, list_array, map_texts, mix, ngrams, text_buffers, words

BITS = 18
#: Labelled documents, and features of these in all, that training may hold on the driver (12 bytes a feature).
TRAIN_ROWS = 4000
TRAIN_FEATURES = 8_000_000
THRESHOLD = 0.3


def _kinds(data: np.ndarray) -> np.ndarray:
    kind = np.zeros(256, np.int64)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 1, 2, 4, 2
    for i, c in enumerate("!#$%&*|.,;:=<>@/"):
        kind[ord(c)] = 8 << min(i, 12)
    return kind[data]


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: (indices, values, counts). Values are log counts, scaled to unit length per row."""
    data, offsets = text_buffers(texts)
    n = len(offsets) - 1
    w = words(data, offsets, NONSPACE, LOWER)
    parts = []
    if len(w.hashes):
        kinds = np.bitwise_or.reduceat(_kinds(data), w.starts)  # bytes up to the next word: spaces have no kind
        again = np.zeros(len(w.hashes), bool)
        again[1:] = w.hashes[1:] == w.hashes[:-1]
        again[w.bounds[:-1][w.bounds[:-1] < len(again)]] = False
        shape = w._replace(hashes=mix((kinds * 2 + again).astype(np.uint64) + np.uint64(1 << 40)))
        for tag, (view, k) in enumerate(((w, 1), (w, 2), (shape, 1), (shape, 2), (shape, 3))):
            at, h = ngrams(view, k)
            parts.append((doc_of(at, w.bounds), mix(h + np.uint64(tag * 0x9E3779B9)) >> np.uint64(64 - bits)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(n, np.int64)
    key = np.concatenate([(d.astype(np.int64) << bits) | h.astype(np.int64) for d, h in parts])
    key, count = np.unique(key, return_counts=True)
    doc, value = key >> bits, 1 + np.log(count)
    norm = np.sqrt(np.bincount(doc, value * value, n))
    return key & ((1 << bits) - 1), value / norm[doc], np.bincount(doc, minlength=n)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Follow-the-regularised-leader over the rows in the given order; (weights, bias)."""
    z, g2 = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(g2[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for index, value, y in rows:
            i, v = np.append(index, 1 << bits), np.append(value, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
            sigma = (np.sqrt(g2[i] + g * g) - np.sqrt(g2[i])) / alpha
            z[i] += g - sigma * w
            g2[i] += g * g
    w = weights(slice(None))
    return w[:-1].astype(np.float32), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", most_rows: int = TRAIN_ROWS, most_features: int = TRAIN_FEATURES, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights from at most ``most_rows`` labelled ids, the first in the order of a hash of the id (of any type).

    From these, documents are taken in the same order until they have ``most_features`` features. Rows with a
    null id, label or text teach nothing; of repeated labels of an id the greatest counts and of repeated documents the
    least text, once; with no labelled row every score is 0.5.
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    ids = ids.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(most_rows)  # most_rows small rows
    chosen = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").join(F.broadcast(ids), "i").groupBy("i", "y").agg(F.min("t").alias("t"))

    def make():
        def fn(texts: pa.Array) -> list:
            index, value, counts = features(texts, bits)
            return [list_array(index, counts, pa.int32()), list_array(value, counts, pa.float32())]

        return fn

    found = map_texts(chosen, make, [("index", "array<int>"), ("value", "array<float>")], ["i", "y"], "t")
    found = cut_lineage(found.select(F.xxhash64("i").alias("h"), F.col("i").cast("string").alias("i"), "y", "index", "value"))
    before = F.sum(F.size("index")).over(Window.orderBy("h", "i").rowsBetween(Window.unboundedPreceding, -1))  # most_rows rows without their features
    held = found.select("h", "i", F.coalesce(before, F.lit(0)).alias("before")).where(F.col("before") < most_features).drop("before")
    taken = found.join(F.broadcast(held), ["h", "i"]).orderBy("h", "i").toArrow()
    rows = [(taken["index"][r].values.to_numpy(), taken["value"][r].values.to_numpy().astype(float), int(taken["y"][r].as_py() > 0)) for r in range(taken.num_rows)]
    return ftrl(rows, bits)


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], text_col: str = "text", threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """``keep`` plus score (probability of label 1) and predicted (1 where score >= threshold).

    One row for each input row, repeated ids and rows included; a null, empty or blank text has no features and gets the
    bias alone. Whole texts are scored however long. A score equal to the threshold is predicted 1. Kept columns named
    like an output (in any case) give way to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats: a fixed size

    def make():
        weights, bias = shared.value

        def fn(texts: pa.Array) -> list:
            index, value, counts = features(texts, bits)
            doc = np.repeat(np.arange(len(counts)), counts)
            s = 1 / (1 + np.exp(-np.clip(np.bincount(doc, weights[index] * value, len(counts)) + bias, -35, 35)))
            return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]

        return fn

    return map_texts(docs, make, [("score", "double"), ("predicted", "int")], keep, text_col)
