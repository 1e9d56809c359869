"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed byte n-grams (1 to 4 bytes of lower-cased text whose non-letters are
one space), scaled to unit length. Spherical k-means gives several centroids per language; the language of
the centroid with the highest cosine wins, and a vector further from its language's centroids than all but one in
a thousand of that language's training vectors is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import P_BYTE, _inverse, list_array, map_texts, mix, powers, prefix, text_buffers, EXACT

BITS = 12
SIZES = (1, 2, 3, 4)
#: Distinct training texts of each language (the first by a hash of the text) and of all languages, and centroids of all
#: languages. Every language is learned: with more languages each gets fewer texts and centroids, one at least.
TRAIN_ROWS = 400
ALL_TRAIN_ROWS = 8_000
CENTROIDS = 4
ALL_CENTROIDS = 1024
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def counts(texts: pa.Array, bits: int = BITS, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """Rows of n-gram counts; n-grams don't cross documents."""
    data, offsets = text_buffers(texts)
    n, dim = len(offsets) - 1, 1 << bits
    out = np.zeros(n * dim, np.float32)
    if len(data):
        folded = _FOLD[data]
        keep = np.ones(len(data), bool)  # a run of non-letters counts as one space
        keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
        total = np.concatenate([[0], np.cumsum(keep)])
        folded, offsets = folded[keep], total[offsets]
        c, inv = prefix(EXACT[folded], P_BYTE), powers(_inverse(P_BYTE), len(folded) + 1)
        doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
        for k in sizes:
            at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :]) if len(doc) >= k else np.zeros(0, int)
            h = mix((c[at + k] - c[at]) * inv[at]) >> np.uint64(64 - bits)
            out += np.bincount((doc[at].astype(np.int64) << bits) | h.astype(np.int64), minlength=n * dim)
    return out.reshape(n, dim)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; starts from the rows furthest from those chosen before."""
    centres = [unit(x.mean(0, keepdims=True))[0]]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.argmin((x @ np.array(centres).T).max(1)))])
    c = np.array(centres)
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        new = np.array([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        c = unit(new)
    return c


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows_per_language: int = TRAIN_ROWS, centroids: int = CENTROIDS, bits: int = BITS) -> dict:
    """Idf weights, centroids, their languages and rejection radii from a bounded sample of each language.

    The sample is drawn among distinct texts, so that copies neither crowd others out nor lose a language: every
    language with at least one text with a letter is learned. Rows with a null language or text teach nothing; with no
    such rows the model knows no language. Languages are compared as strings.
    """
    lang, text = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    known = docs.where(lang.isNotNull() & text.rlike(r"\p{L}")).select(lang.alias("l"), text.alias("t")).withColumn("k", F.xxhash64("t", F.lit(11)))
    sizes = known.groupBy("l").agg(F.approx_count_distinct("k").alias("texts")).collect()  # a row for each language
    empty = {"idf": np.ones(1 << bits, np.float32), "centroids": np.zeros((0, 1 << bits), np.float32), "langs": [], "radius": np.zeros(0)}
    if not sizes:
        return empty
    rows_per_language = max(1, min(rows_per_language, ALL_TRAIN_ROWS // len(sizes)))
    centroids = max(1, min(centroids, ALL_CENTROIDS // len(sizes)))
    # A text is in the sample if its hash is below its language's share, so copies are in or out together; the share
    # leaves slack over the bound for the estimate's error.
    share = docs.sparkSession.createDataFrame([(r["l"], min(1.0, (rows_per_language + 7 * rows_per_language**0.5 + 20) / max(1, r["texts"]))) for r in sizes], "l string, share double")
    sampled = known.join(F.broadcast(share), "l").where(F.pmod("k", F.lit(1 << 40)) < F.col("share") * (1 << 40)).drop("share").dropDuplicates(["l", "k"])

    def make():
        def fn(texts: pa.Array) -> list:
            x = counts(texts, bits)
            row, col = np.nonzero(x)
            per = np.bincount(row, minlength=len(x))
            return [list_array(col, per, pa.int16() if bits < 15 else pa.int32()), list_array(x[row, col], per, pa.float32())]

        return fn

    found = map_texts(sampled, make, [("index", "array<smallint>" if bits < 15 else "array<int>"), ("value", "array<float>")], ["l", "k"], "t").toArrow()
    langs, keys = found["l"].to_pylist(), found["k"].to_pylist()
    taken: dict[str, list[int]] = {}
    for r in sorted(range(len(keys)), key=lambda r: (langs[r], keys[r])):
        if len(taken.setdefault(langs[r], [])) < rows_per_language:
            taken[langs[r]].append(r)
    order = [r for rows in taken.values() for r in rows]
    x = np.zeros((len(order), 1 << bits), np.float32)
    for i, r in enumerate(order):
        x[i, found["index"][r].values.to_numpy()] = found["value"][r].values.to_numpy()
    if not len(order):
        return empty
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x = weigh(x, idf)
    of = np.array([langs[r] for r in order])
    found_c, names, radius = [], [], []
    for lang in taken:
        own = x[of == lang]
        c = spherical_kmeans(own, centroids)
        found_c.append(c), names.extend([lang] * len(c))
        radius += [float(np.quantile((own @ c.T).max(1), 0.001))] * len(c)
    return {"idf": idf, "centroids": np.concatenate(found_c).astype(np.float32), "langs": names, "radius": np.array(radius)}


def weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(x) * idf)


def identify(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``keep`` plus lang_pred (nearest language), score (cosine to its centroid, 0 to 1), rejected.

    One row for each input row. A text that is null or has no letter, and any text under a model without
    languages, is ``und`` with score 0 and rejected. ``rejected`` also marks texts beyond the radius of their
    language; callers that want an open set read those as ``und``. Of equally near centroids the first counts, in the
    model's order. Repeated rows and ids are rows like any others, whole texts are read however long, and a kept column
    named like an output (in any case) gives way to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats for each of a bounded number of centroids

    def make():
        m = shared.value
        names = np.array([*m["langs"], UNKNOWN], object)

        def fn(texts: pa.Array) -> list:
            if not m["langs"]:
                return [pa.array([UNKNOWN] * len(texts), pa.string()), pa.array([0.0] * len(texts)), pa.array([True] * len(texts))]
            cos = weigh(counts(texts, bits), m["idf"]) @ m["centroids"].T
            best = cos.argmax(1)
            s = np.clip(cos[np.arange(len(cos)), best], 0, 1).astype(float)
            return [pa.array(names[best], pa.string()), pa.array(s), pa.array(s < m["radius"][best])]

        return fn

    letter = F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))
    taken = [c for c in keep if c.lower() not in ("lang_pred", "score", "rejected")]
    own = "has_letter_" + "_" * max(map(len, docs.columns))  # longer than any other column's name
    out = map_texts(docs.withColumn(own, letter), make, [("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")], [*taken, own], text_col, chunk_rows=256)
    return out.select(*[F.col(f"`{c}`") for c in taken], F.when(F.col(own), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col(own), F.col("score")).otherwise(0.0).alias("score"), (F.col("rejected") | ~F.col(own)).alias("rejected"))
