"""Every pipeline stage on null, empty, repeated and tied rows, empty tables and clashing columns, against plain versions."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import ngram_join

RNG = np.random.default_rng(31)
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join(RNG.choice([f"word{i}" for i in range(80)], n))


PASSAGE = prose(20)
A, B = prose(60), prose(60)
TEXTS = [(1, A), (1, A), (1, B), (2, A), (3, B.replace(B.split()[30], "other", 1)), (None, B), (None, B), (None, None), (None, None), (4, ""), (4, ""), (5, "  "), (6, PASSAGE), (7, prose(900) + " " + PASSAGE), (8, prose(30_000)), (9, "card 4041894974608795"), (9, "card 4041894974608795")]
ROWS = [(i, t, "en", None, len(t or "")) for i, t in TEXTS]
CLASHES = ["score", "Predicted", "n_hit", "spans", "d_text", "new_text", "n_replaced", "t", "i", "th", "key", "class_id", "row", "k0"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("bare")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in CLASHES}).cache()


def bag(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, folder, bare, name):
    empty = spark.createDataFrame([], SCHEMA)
    assert STAGES[name](spark, empty, folder).count() == 0
    assert STAGES[name](spark, empty, bare).count() == 0


@pytest.mark.parametrize("name", [n for n in STAGES if n != "packing"])
def test_other_columns_come_through(spark, docs, folder, name):
    out = STAGES[name](spark, docs, folder)
    assert out.columns == docs.columns
    assert all(r[c] == f"own {c}" for r in out.collect() for c in CLASHES)


def test_quality_without_labels_keeps_all_and_judges_copies_alike(spark, docs, folder, bare):
    assert bag(STAGES["quality_classifier"](spark, docs, bare).collect()) == Counter(TEXTS)
    kept = bag(STAGES["quality_classifier"](spark, docs, folder).collect())
    assert all(kept[k] in (0, n) for k, n in Counter(TEXTS).items())


def test_one_row_of_each_class_by_brute_force(spark, docs, folder):
    got = bag(STAGES["ngram_jaccard_join"](spark, docs, folder).collect())
    grams = lambda t: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").split()) else frozenset()
    sets = [grams(t) for _, t in TEXTS]
    root = list(range(len(TEXTS)))
    for x in range(len(TEXTS)):
        for y in range(x):
            if sets[x] and sets[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                old, new = root[x], root[y]
                root = [new if r == old else r for r in root]
    want = {}
    for k, (i, t) in enumerate(TEXTS):
        if sets[k]:
            want.setdefault(root[k], []).append((i is not None, i or 0))
    assert sum(got.values()) == len(want) + sum(not s for s in sets)
    ids = Counter((i is not None, i or 0) for (i, t), n in got.items() for _ in range(n) if grams(t))
    assert ids == Counter(min(v) for v in want.values())
    assert got[(None, None)] == 2 and got[(4, "")] == 2


def test_decontamination_and_pseudonyms_leave_the_rest_as_it_is(spark, docs, folder, bare):
    assert bag(STAGES["benchmark_decontamination"](spark, docs, bare).collect()) == Counter(TEXTS)
    cut = bag(STAGES["benchmark_decontamination"](spark, docs, folder).collect())
    want = Counter((i, t.replace(PASSAGE, "") if i == 7 else t) for i, t in TEXTS if i != 6)
    assert cut == want
    new = STAGES["pii"](spark, docs, folder).collect()
    assert bag(r for r in new if r["doc_id"] != 9) == Counter((i, t) for i, t in TEXTS if i != 9)
    nine = {r["text"] for r in new if r["doc_id"] == 9}
    assert len(nine) == 1 and nine != {"card 4041894974608795"}


def test_packing_takes_each_row(spark, docs, folder):
    from tallyspark.llm import packing
    from tallyspark.llm.queries import tokenizer_path

    encode = packing.load_encoder(tokenizer_path())
    rows = STAGES["packing"](spark, docs, folder).collect()
    assert sum(r.length for r in rows) == sum(len(encode(t or "")) + 1 for _, t in TEXTS)
    assert Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == Counter((i, len(encode(t or "")) + 1) for i, t in TEXTS)


def test_the_whole_pipeline_on_odd_rows(spark, docs, folder):
    docs.drop(*CLASHES).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    assert ngram_join.one_of_each_class(docs.select("doc_id", "text")).count() > 0
