"""Language ID: no language is lost, nearest centroid by brute force, rejection, and odd inputs."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyspark.llm import langid

SCHEMA = "doc_id long, text string, lang string"
RNG = np.random.default_rng(11)
WORDS = {"aa": "lo mi ra tu", "bb": "sch ung keit ver", "cc": "xiq zuq woj yif"}


def text(lang, n=40):
    return " ".join(RNG.choice(WORDS[lang].split(), n))


def test_a_language_of_copies_and_a_rare_one_are_learned(spark):
    few = [text("aa") for _ in range(3)]
    rows = [(i, few[i % 3], "aa") for i in range(3000)] + [(i, text("bb"), "bb") for i in range(600)] + [(9, text("cc"), "cc")]
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    assert sorted(set(model["langs"])) == ["aa", "bb", "cc"]
    probe = spark.createDataFrame([(1, text("aa"), None), (2, text("bb"), None), (3, text("cc"), None)], SCHEMA)
    assert {r.doc_id: r.lang_pred for r in langid.identify(probe, model, ["doc_id"]).collect()} == {1: "aa", 2: "bb", 3: "cc"}


def test_many_languages_share_the_bounds(spark, monkeypatch):
    monkeypatch.setattr(langid, "ALL_TRAIN_ROWS", 30)
    monkeypatch.setattr(langid, "ALL_CENTROIDS", 30)
    names = [f"l{i:02d}" for i in range(40)]
    rows = [(i, " ".join([chr(97 + i % 26) * 2 + chr(97 + i // 26)] * 9) + f" {j}", n) for i, n in enumerate(names) for j in range(4)]
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    assert sorted(model["langs"]) == names  # one centroid each


def brute_vector(t, model, bits):
    folded = bytes(c + 32 if 65 <= c < 91 else c if 97 <= c < 123 or c >= 128 else 32 for c in t.encode())
    while b"  " in folded:
        folded = folded.replace(b"  ", b" ")
    grams = Counter(folded[i : i + n] for n in langid.SIZES for i in range(len(folded) - n + 1))
    v = np.zeros(1 << bits)
    for g, c in grams.items():  # the slot of a gram, from a text that is only this gram
        slot = np.flatnonzero(langid.counts(pa.array(["x"]), bits)[0] * 0 + slots(g, bits))[0]
        v[slot] += c
    v = np.array([math.log1p(x) for x in v]) * model["idf"]
    return v / math.sqrt((v * v).sum())


def slots(gram, bits):
    """A one-hot row: the n-gram of full length of a text that is ``gram``."""
    from tallyspark.llm.arrowtext import EXACT, P_BYTE, mix

    h = sum(int(EXACT[b]) * pow(P_BYTE, i, 1 << 64) for i, b in enumerate(gram)) % (1 << 64)
    out = np.zeros(1 << bits)
    out[int(mix(np.array([h], np.uint64))[0]) >> (64 - bits)] = 1
    return out


def test_prediction_is_the_nearest_centroid_by_brute_force(spark):
    rows = [(i, text(k) + " Straße, 42!", k) for i, k in enumerate(list(WORDS) * 20)]
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    texts = ["lo mi XIQ", "ung  --  keit 7 ver", "zuq woj lo", "Größe", "a"]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA), model, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        cos = [float(brute_vector(t, model, langid.BITS) @ c) for c in model["centroids"]]
        best = int(np.argmax(cos))
        assert got[i].lang_pred == model["langs"][best] and abs(got[i].score - max(0, cos[best])) < 1e-4
        assert got[i].rejected == (got[i].score < model["radius"][best])


def test_strange_text_is_rejected_and_training_text_is_not(spark):
    rows = [(i, text(k), k) for i, k in enumerate(list(WORDS) * 60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs)
    strange = spark.createDataFrame([(1, "日本語 テスト", None)], SCHEMA)
    assert langid.identify(strange, model, ["doc_id"]).first().rejected
    assert langid.identify(docs, model, ["doc_id"]).where("rejected").count() <= len(WORDS)


def test_repeated_rows_long_texts_ties_and_clashing_columns(spark):
    rows = [(i, text(k), k) for i, k in enumerate(list(WORDS) * 30)]
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    odd = [(1, text("aa"), "zz"), (None, None, None), (None, "", None), (7, text("bb", 60_000), None)]
    df = spark.createDataFrame(odd + odd[:1] * 3, SCHEMA).withColumns({"Score": F.lit("clash"), "__letter": F.lit(1), "rejected": F.lit("x")})
    got = langid.identify(df, model, ["doc_id", "Score", "rejected", "__letter", "lang"]).collect()
    assert len(got) == 7 and all(isinstance(r.score, float) and r["__letter"] == 1 for r in got)
    assert [r.lang_pred for r in got if r.doc_id == 7] == ["bb"] and len({(r.lang_pred, r.score) for r in got if r.doc_id == 1}) == 1
