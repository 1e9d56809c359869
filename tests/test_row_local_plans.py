"""Operators that stay inside a row agree with plain definitions: source offsets, reading order, the best k."""

import math
from collections import Counter

from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.functions import vec
from tallyspark.operators import legibility, retrieval
from tallyspark.sources import files

TEXTS = ["", "  ", "a b", "  Two  words\n\n here ", "ﬁne ﬂow  ﬁﬂ x", "|0 1 5| é\t日本 語", "İstanbul is  near", "a" * 50 + "  b ", "\nline\n"]


def test_source_offset_is_the_element_of_the_map(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", T.canonicalize(F.col("t")).alias("c"), T.canonical_map(F.col("t")).alias("m"))
    each = df.select("t", "c", "m", F.posexplode("m").alias("at", "want")).where(~F.col("t").contains("İ"))
    got = each.select("want", T.source_offset(F.col("t"), F.col("c"), F.col("at")).alias("got")).collect()
    assert len(got) > 80 and [r["got"] for r in got] == [r["want"] for r in got]
    # A letter that grows when it is lowered shifts only the places of its own word.
    grown = df.where(F.col("t").contains("İ")).select(T.source_offset(F.col("t"), F.col("c"), F.expr("instr(c, 'near') - 1")).alias("got")).first()
    assert grown["got"] == "İstanbul is  near".index("near")


def test_reading_order_equals_the_definition(spark):
    docs = ["one two\ntwo three\n\nfour\nfive one two\n...\ntwo", "a\nb\nc", None, "", "!\n?\n.\n-", "x y\nx y\nx y\nx z", "x y\nx y\nx y\nx z"]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, text string").coalesce(1)
    got = {r["id"]: r["margin"] for r in legibility.order_margins(df.select("id", T.lines(F.col("text")).alias("lines")), lambda t: vec.blake_slots(t, "plain", 256)).collect()}

    def vector(line):
        out = Counter()
        for w in "".join(c if c.isalnum() else " " for c in line.lower()).split():
            b, s = vec.token_slot(w, "plain", 256, 0)
            out[b] += s
        return out

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return sum(a[k] * b[k] for k in a) / n if n else 0.0

    for i, text in enumerate(docs):
        vs = [vector(x) for x in (text or "").split("\n") if x.strip()]
        if len(vs) < 4 or not any(any(v.values()) for v in vs):
            assert got[i] is None
        else:
            mean = [sum(cosine(vs[j], vs[j + k]) for j in range(len(vs) - k)) / (len(vs) - k) for k in (1, 2)]
            assert abs(got[i] - (mean[0] - mean[1])) < 1e-12


def test_best_k_takes_slots_as_well_as_vectors(spark):
    words = ["red", "green", "blue", "tree", "stone"]
    rows = [(d, n, " ".join(words[(d * 7 + n * j) % 5] for j in range(1 + (d + n) % 4))) for d in range(12) for n in range(5)] + [(99, 0, ""), (98, 0, None)]
    chunks = spark.createDataFrame(rows, "doc int, no int, text string")
    queries = spark.createDataFrame([(0, "red tree"), (1, "stone"), (2, "nothing alike")], "qid int, text string")
    qv = retrieval.sparse(queries, ["qid"], vec.md5_slots(T.tokens(F.col("text"))))
    vectors = retrieval.sparse(chunks, ["doc", "no"], vec.md5_slots(T.tokens(F.col("text"))))
    slots = chunks.select("doc", "no", vec.md5_slots(T.tokens(F.col("text"))).alias("slots"))
    scored = retrieval.scores(qv, vectors, "qid", ["doc", "no"])
    flat = lambda df: sorted((r["qid"], r["rank"], r["doc"], round(r["sim"], 12)) for r in df.collect())
    want = flat(retrieval.top_k(scored, "qid", ["doc", "no"], 7)), flat(retrieval.top_docs(scored, "qid", "doc", "no", 4))
    for given in (vectors, slots):
        got = flat(retrieval.best_k(qv, given, "qid", ["doc", "no"], 7)), flat(retrieval.best_k(qv, given, "qid", ["doc", "no"], 4, doc="doc"))
        assert got == want


def test_spread_keeps_every_row(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    few = spark.read.parquet(str(tmp_path / "t"))
    assert files.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in files.spread(few).collect()) == list(range(1000))
    many = spark.range(0, 100, 1, 64)
    assert files.spread(many) is many


def test_passages_are_found_whatever_the_number_of_blocks(spark, monkeypatch):
    docs = [(1, "the red tree"), (2, "red"), (3, None), (4, "a stone, a red stone"), (4, "tree")]
    passages = [(10, "red"), (11, "stone, a"), (12, None), (13, ""), (14, "blue"), (10, "tree")]
    d, p = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(passages, "qid int, passage string")
    want = sorted((q, i) for q, s in passages for i, t in docs if s is not None and t is not None and s in t)
    for size in (8_000_000, 40):
        monkeypatch.setattr(retrieval, "PASSAGE_CHARS", size)
        assert sorted(tuple(r) for r in retrieval.containing(p, d).collect()) == want
