"""Generators, recognition noise, separations and accuracies, run fingerprints, the concordance study and the divergence sweep."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.functions import vec
from tallyspark.operators import certificate, conservation, governor, graph, legibility, pii_audit, provenance, reindex, retrieval, studies
from tallyspark.sources import generate


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect())


def test_generators_give_the_same_rows_under_any_partitioning(spark):
    made = lambda: [generate.paraphrase_corpus(spark), generate.probes(spark, 9, 4), generate.legibility_corpus(spark), *generate.entity_graph(spark, True).values(), *generate.citation_bench(spark, 10)]
    first = [rows(d) for d in made()]
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert [rows(d.repartition(2)) for d in made()] == first
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    corpus = generate.paraphrase_corpus(spark).collect()
    assert len(corpus) == 60 and all(len(r.text.split()) == 18 for r in corpus)
    shared = {r.doc_id: {w for w in r.text.split() if w.startswith("sig")} for r in corpus}
    assert all(shared[2 * k] == shared[2 * k + 1] and len(shared[2 * k]) == 4 for k in range(30))
    assert all(3 <= len(r.text.split()) <= 7 for r in generate.probes(spark, 200, 1).collect())


def test_telemetry_rests_before_its_schedule(spark):
    s = spark.createDataFrame([("a", 1, 1000.0, 60.0, 50.0), ("a", 2, 2000.0, 70.0, 60.0)], "run string, hop int, vram_mb double, temp_c double, hop_ms double")
    got = {r.hop: r for r in generate.telemetry(s).collect()}
    assert (got[0].vram_mb, got[0].temp_c, got[0].hop_ms) == (920.0, 56.0, 0.0)
    assert abs(got[1].vram_mb - 1000) <= 8 and abs(got[2].temp_c - 70) <= 0.15 and got[1].vram_mb != 1000
    assert rows(generate.telemetry(s, 0, 0.0, 0.0).where("hop > 0")) == rows(s)


def test_recognition_noise_and_recall_by_class(spark):
    sources, cites = generate.citation_bench(spark, 60)
    x = cites.withColumn("plain", F.expr("quote")).collect()
    assert {r.degradation for r in x} == {"modelled", "unmodelled", "clean"}
    found = provenance.manifest(sources, cites)
    recall = dict(rows(provenance.recall(found, cites.select("cite_id", "degradation", "true_start"))))
    assert recall["modelled"] == recall["clean"] == 1.0 and recall["unmodelled"] < 0.2  # D33
    exact = sources.join(cites, "source_id").select("cite_id", provenance.exact_spans(F.col("source"), F.col("quote")).alias("s")).select("cite_id", "s.*")
    naive = dict(rows(provenance.recall(exact, cites.select("cite_id", "degradation", "true_start"))))
    assert naive["modelled"] == 0.0 and naive["clean"] == 1.0


def test_graph_generator_and_its_lint(spark):
    clean, flawed = generate.entity_graph(spark), generate.entity_graph(spark, True)
    assert clean["nodes"].count() == 12 and clean["edges"].count() == 15 and clean["facts"].count() == 48
    assert graph.label_leaks(clean["facts"]).count() == 0  # E33
    got = graph.report(**flawed).select("kind", "target").collect()
    kinds = {(r["kind"], r["target"]) for r in got}
    assert {("er_collision", "apex"), ("over_merged_community", "topic2_topic3"), ("orphan", "lonely")} <= kinds  # R5, R6, R8
    assert not {k for k, _ in {(r["kind"], r["target"]) for r in graph.report(**clean).collect()}} & {"er_collision", "over_merged_community"}


def test_components_and_baselines(spark):
    nodes = spark.createDataFrame([(i, "c" if i < 4 else "d") for i in range(9)], "id long, community string")
    edges = spark.createDataFrame([(3, 1), (1, 2), (7, 8), (6, 7), (5, 5)], "u long, v long")
    assert rows(graph.components(nodes, edges)) == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 6), (8, 6)]  # R2
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)], "u long, v long")
    assert {c for _, c in rows(graph.components(spark.range(61).withColumn("community", F.lit("x")), chain))} == {0}
    b = graph.baseline_ranks(nodes, edges)
    got = {(r.baseline, r["rank"]): (r.target, r.score) for r in b.collect()}
    assert got["degree_centrality", 1] == ("1", 2.0) and got["degree_centrality", 2] == ("7", 2.0)  # G7, R16
    assert got["thin_density", 1][0] == "d" and got["degree_anomaly", 1][1] == 1.0


def test_split_community_and_poisoning_delta(spark):
    g = generate.entity_graph(spark, True)
    label = g["nodes"].where("community = 'topic2_topic3'").select("id", F.when(F.col("id").startswith("e3"), 1).otherwise(0).alias("label"))
    repaired = graph.split_community(g["nodes"], "topic2_topic3", label)
    assert repaired.where("community = 'topic2_topic3__split1'").count() == 3  # R11, R12
    probe = lambda nodes: graph.probe(nodes, g["node_facts"], g["edges"], g["facts"], "e2_0", "community")
    assert graph.poisoning_delta(probe(g["nodes"]), probe(repaired)).first().asDict() == {"before": 0.5, "after": 0.0, "delta": 0.5}  # R15


def test_halves_equal_a_plain_split(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (2, 3, 40, 300):
        v = rng.normal(size=(n, 16)) + np.where(np.arange(n) % 3 == 0, 2.0, -2.0)[:, None]
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        h = graph._Halves(v)
        cos = [(float(v[i] @ v[j]), i, j) for i in range(n) for j in range(i + 1, n)]
        i, j = h.furthest()
        assert float(v[i] @ v[j]) == pytest.approx(min(cos)[0])
        label, apart = h.split()
        centres = [v[label == k].sum(0) for k in (0, 1)]
        assert ((v @ centres[1] / np.linalg.norm(centres[1]) > v @ centres[0] / np.linalg.norm(centres[0])) == (label == 1)).all()  # a fixed point
        assert apart == pytest.approx(1 - centres[0] @ centres[1] / np.linalg.norm(centres[0]) / np.linalg.norm(centres[1]))
    assert graph._Halves(np.ones((1, 4))).split()[1] == graph._Halves(np.ones((5, 4)) / 2).split()[1] == 0.0


def test_separations_and_accuracy(spark):
    corpus = generate.paraphrase_corpus(spark).withColumnRenamed("doc_id", "id")
    v = retrieval.sparse(corpus, ["id"], vec.blake_slots(T.tokens(F.col("text")), "keyed128", 256, vec.ORACLE_SEED))
    got = studies.oracle_separation(retrieval.scores(v.withColumnRenamed("id", "qid"), v, "qid", ["id"]), corpus.select("id", "pair_id")).first()
    assert got.other_max < reindex.RELEVANCE <= got.partner_min  # D37
    labelled = generate.legibility_corpus(spark).withColumnRenamed("chunk_id", "id")
    scored = legibility.score(labelled.select("id", "text"), lambda t: vec.blake_slots(t, "plain", 256))
    sep = studies.score_separation(scored, labelled.select("id", "label")).first()
    assert sep.margin == sep.clean_min - sep.corrupt_max and sep.margin > 0  # D38
    runs = spark.createDataFrame([("a", "index", "index", "score"), ("b", None, None, None), ("c", "embed", "embed", "embed"), ("d", "score", "embed", "score")], "run string, truth string, first string, last string")
    assert tuple(studies.root_cause_accuracy(runs).first()) == (4, 0.75, 0.75)  # D39


def test_run_fingerprint(spark):
    df = spark.createDataFrame([(i, None if i % 3 else f"t{i}") for i in range(50)], "a long, b string")
    same = {tuple(studies.run_fingerprint(x).first()) for x in (df, df.repartition(7).orderBy(F.desc("a")), df.select("b", "a"))}
    assert len(same) == 1
    others = [df.where("a < 49"), df.union(df.limit(1)), df.withColumn("a", F.col("a") + 1)]
    assert len({studies.run_fingerprint(x).first().fingerprint for x in others} | {f for _, f in same}) == 4  # E32
    assert studies.run_fingerprint(df.where("false")).first().n == 0


def test_concordance_study(spark):
    docs = generate.paraphrase_corpus(spark, 12).withColumnRenamed("doc_id", "id").cache()
    got = studies.concordance_study(docs, [("same", ("whole", 256, 1), ("whole", 256, 1)), ("shrunk", ("whole", 256, 1), ("whole", 4, 1))], k=5, replicates=200).cache()
    by = {r["name"]: r for r in got.collect()}
    assert by["same"].passed and by["same"].gold_delta == 0 and by["same"].mean_rbo == pytest.approx(1.0)
    assert by["shrunk"].gold_delta < -0.01 and not by["shrunk"].passed and by["shrunk"].mean_rbo < 0.9  # B24, X18
    assert {(r.alarm, r.agreement) for r in studies.agreement_of_alarms(got).collect()} == {("gate_regressed", 1.0), ("rbo_regressed", 1.0)}


def test_divergence_sweep(spark):
    swept = studies.divergence_sweep(spark, 4).cache()
    verdicts = {(r.family, r.verdict) for r in swept.collect()}
    assert {("identical", "reproduced"), ("q8", "quant-dtype-drift"), ("wrong-weights", "wrong-weights"), ("lost-norm", "lost-l2-norm"), ("dim-192", "dim-mismatch")} <= verdicts
    rate = {r.family: r for r in studies.sweep_report(swept).collect()}
    assert all(r.caught == r.n == 4 for r in rate.values()) and rate["q8"].caught_by_name == 0 and rate["dim-192"].caught_by_name == 4  # D31, X21
    cosine = swept.where("family in ('q8', 'wrong-weights')").select((F.col("family") == "q8").alias("same"), "mean_cosine")
    assert certificate.margin(cosine).first().margin > 0.5  # D30
    naive = certificate.fingerprint_only(spark.createDataFrame([("m", 256)], "name string, dim int"), spark.createDataFrame([("m", 256), ("m", 192)], "name string, dim int"))
    assert sorted(r.accepted for r in naive.collect()) == [False, True]  # B25


def test_small_operators_without_a_query(spark):
    c = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b")], "cluster int, truth string")
    assert graph.purity(c).first().purity == pytest.approx((2 / 3 + 1) / 2)  # D23
    s = spark.createDataFrame([(True,), (False,), (False,)], "reachable boolean")
    assert pii_audit.over_redaction(s).first().over_redaction == pytest.approx(2 / 3)  # D24
    assert pii_audit.over_redaction(s.where("false")).first().over_redaction == 0.0
    d = spark.createDataFrame([(0.5, 0.9), (0.5, 1.0)], "t double, a double").select(conservation.sensitivity(F.col("t"), F.col("a")).alias("x"))
    assert [round(r.x, 6) for r in d.collect()] == [5.0, float("inf")]  # D36
    o = spark.createDataFrame([("aé日x", 3)], "t string, k int").select(T.byte_offset(F.col("t"), F.col("k")).alias("b"))
    assert o.first().b == 6  # E6
    hop = spark.createDataFrame([("a b c",), ("a b c d e",)], "text string")
    assert governor.tokens_per_hop(hop).first().tokens == (4 + 6) / 2 + governor.GENERATION_TOKENS  # E25: 3.9 and 6.5, halves to even
    q = spark.createDataFrame([("q", 1, 0.5), ("q", 0, 0.5), ("q", 2, 0.1), ("r", 5, 0.2)], "qid string, id int, sim double")
    assert rows(retrieval.argmax(q, "qid", "id")) == [("q", 0, 0.5), ("r", 5, 0.2)]  # G5
    gone = spark.createDataFrame([("q", 0)], "qid string, id int")
    assert rows(retrieval.top_k(q, "qid", ["id"], 2, gone), "qid", "id", "rank") == [("q", 1, 1), ("q", 2, 2), ("r", 5, 1)]  # C4, G4


def test_best_k_equals_the_join_by_bucket(spark, monkeypatch):
    q = generate.probes(spark, 20, 1).select(F.col("pos").alias("qid"), "text")
    d = generate.probes(spark, 150, 2).select((F.col("pos") % 40).alias("doc"), F.floor(F.col("pos") / 40).cast("int").alias("no"), "text")
    qv, dv = retrieval.sparse(q, ["qid"], vec.md5_slots(T.tokens(F.col("text")))), retrieval.sparse(d, ["doc", "no"], vec.md5_slots(T.tokens(F.col("text"))))
    flat = lambda df: sorted((*[v for v in r[:-2]], round(r["sim"], 9), r["rank"]) for r in df.collect())
    fast = [flat(retrieval.best_k(qv, dv, "qid", ["doc", "no"], 5).select("qid", "doc", "no", "sim", "rank")), flat(retrieval.best_k(qv, dv, "qid", ["doc", "no"], 4, doc="doc").select("qid", "doc", "sim", "rank"))]
    monkeypatch.setattr(retrieval, "BROADCAST_ENTRIES", 3)
    assert fast == [flat(retrieval.best_k(qv, dv, "qid", ["doc", "no"], 5).select("qid", "doc", "no", "sim", "rank")), flat(retrieval.best_k(qv, dv, "qid", ["doc", "no"], 4, doc="doc").select("qid", "doc", "sim", "rank"))]
    monkeypatch.setattr(retrieval, "BLOCK_NUMBERS", 40)
    v = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(60)] + [(99, [0.0, 0.0, 0.0])], "id int, v array<double>")
    few = retrieval.dense_top_k(v.select(F.col("id").alias("qid"), "v"), v, 3)
    monkeypatch.setattr(retrieval, "BLOCK_NUMBERS", 10**6)
    assert rows(few) == rows(retrieval.dense_top_k(v.select(F.col("id").alias("qid"), "v"), v, 3))
    assert retrieval.dense_top_k(v.where("false").select(F.col("id").alias("qid"), "v"), v, 3).count() == 0
