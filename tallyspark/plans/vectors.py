"""Queries: sparse and dense retrieval, ranking metrics, statistics, liveness, certificates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.functions import vec
from tallyspark.operators import certificate, liveness, reindex, retrieval, stats

from .registry import Tables, query

# ---------------------------------------------------------------- sparse vectors by the md5 family

_SLOTS = "CAST(('0x' || md5(tok)[1:2]) AS INTEGER) AS bucket, CASE WHEN CAST(('0x' || md5(tok)[3:3]) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END AS sign"


def _tok_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda x: x <> '')"


_DOCVEC = f"SELECT doc_id AS id, bucket, CAST(sum(sign) AS BIGINT) AS w FROM (SELECT doc_id, {_SLOTS} FROM (SELECT doc_id, unnest({_tok_sql('text')}) AS tok FROM documents)) GROUP BY 1, 2 HAVING sum(sign) <> 0"


def _doc_vectors(t: Tables) -> DataFrame:
    return retrieval.sparse(t.documents.select(F.col("doc_id").alias("id"), "text"), ["id"], vec.md5_slots(T.tokens(F.col("text"))))


@query("hash_embed_sparse", _DOCVEC)
def hash_embed_sparse(t: Tables) -> DataFrame:
    return _doc_vectors(t)


_BENCHVEC = f"SELECT item_id AS qid, bucket, CAST(sum(sign) AS BIGINT) AS w FROM (SELECT item_id, {_SLOTS} FROM (SELECT item_id, unnest({_tok_sql('text')}) AS tok FROM benchmark)) GROUP BY 1, 2 HAVING sum(sign) <> 0"
_TOPK = f"""WITH c AS ({_DOCVEC}), q AS ({_BENCHVEC}), cn AS (SELECT id, sum(w*w) AS nn FROM c GROUP BY id), qn AS (SELECT qid, sum(w*w) AS nn FROM q GROUP BY qid),
 d AS (SELECT qid, id, sum(q.w*c.w) AS dot FROM q JOIN c USING (bucket) GROUP BY 1, 2),
 r AS (SELECT qid, id, dot / sqrt(CAST(qn.nn AS DOUBLE) * CAST(cn.nn AS DOUBLE)) AS sim FROM d JOIN qn USING (qid) JOIN cn USING (id)),
 k AS (SELECT qid, id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM r)"""


def _bench_vectors(t: Tables) -> DataFrame:
    return retrieval.sparse(t.benchmark.select(F.col("item_id").alias("qid"), "text"), ["qid"], vec.md5_slots(T.tokens(F.col("text"))))


def _top(t: Tables, k: int) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("id"), vec.md5_slots(T.tokens(F.col("text"))).alias("slots"))
    return retrieval.best_k(_bench_vectors(t), docs, "qid", ["id"], k)


@query("cosine_topk", f"{_TOPK} SELECT qid, id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5")
def cosine_topk(t: Tables) -> DataFrame:
    return _top(t, 5).select("qid", "id", F.round("sim", 6).alias("sim"), "rank")


_CHUNKS = f"SELECT doc_id, i // 4 AS chunk_no, list_reduce(list_transform(toks[i+1:i+4], lambda x: x), lambda a, b: a || ' ' || b) AS chunk FROM (SELECT doc_id, toks, unnest(range(0, len(toks), 4)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS toks FROM documents))"


@query("doc_topk", f"""WITH ch AS ({_CHUNKS}), c AS (SELECT doc_id, chunk_no, bucket, CAST(sum(sign) AS BIGINT) AS w FROM (SELECT doc_id, chunk_no, {_SLOTS} FROM (SELECT doc_id, chunk_no, unnest({_tok_sql('chunk')}) AS tok FROM ch)) GROUP BY 1,2,3 HAVING sum(sign) <> 0),
 q AS ({_BENCHVEC}), cn AS (SELECT doc_id, chunk_no, sum(w*w) AS nn FROM c GROUP BY 1,2), qn AS (SELECT qid, sum(w*w) AS nn FROM q GROUP BY qid),
 d AS (SELECT qid, doc_id, chunk_no, sum(q.w*c.w) AS dot FROM q JOIN c USING (bucket) GROUP BY 1,2,3),
 r AS (SELECT qid, doc_id, chunk_no, dot / sqrt(CAST(qn.nn AS DOUBLE) * CAST(cn.nn AS DOUBLE)) AS sim FROM d JOIN qn USING (qid) JOIN cn USING (doc_id, chunk_no)),
 b AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY sim DESC, chunk_no) AS rn FROM r),
 k AS (SELECT qid, doc_id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, chunk_no, doc_id) AS rank FROM b WHERE rn = 1)
 SELECT qid, doc_id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""")
def doc_topk(t: Tables) -> DataFrame:
    """Passages of four tokens, collapsed to documents."""
    chunks = t.documents.select("doc_id", F.posexplode(T.four_token_chunks(F.col("text"))).alias("chunk_no", "chunk"))
    slots = chunks.select("doc_id", "chunk_no", vec.md5_slots(T.tokens(F.col("chunk"))).alias("slots"))
    ranked = retrieval.best_k(_bench_vectors(t), slots, "qid", ["doc_id", "chunk_no"], 3, doc="doc_id")
    return ranked.select("qid", "doc_id", F.round("sim", 6).alias("sim"), "rank")


_GOLD = "SELECT item_id AS qid, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


def _gold(t: Tables) -> DataFrame:
    passages = t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    return retrieval.containing(passages, t.documents.select(F.col("doc_id").alias("id"), "text"))


@query("recall_at_k", f"{_TOPK}, g AS ({_GOLD}) SELECT round(coalesce(avg(CASE WHEN k.id IS NULL THEN 0 ELSE 1 END), 1.0), 9) AS recall FROM g LEFT JOIN k ON k.qid = g.qid AND k.id = g.id AND k.rank <= 10")
def recall_at_k(t: Tables) -> DataFrame:
    return retrieval.recall_at_k(_top(t, 10), _gold(t), "qid", "id").select(F.round("recall", 9).alias("recall"))


# ---------------------------------------------------------------- dense vectors

_COS = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[]))))"
_DENSE = f"SELECT q.vec_id AS qid, e.vec_id AS id, round({_COS.format('q.embedding', 'e.embedding')}, 9) AS sim FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 20 = 0"


def _dense(t: Tables, k: int, bits: int | None = None) -> DataFrame:
    items = t.embeddings.select(F.col("vec_id").alias("id"), (vec.quantized(F.col("embedding"), bits) if bits else F.col("embedding")).alias("v"))
    queries = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    return retrieval.dense_top_k(queries, items, k)


@query("dense_topk", f"SELECT qid, id, round(sim, 5) AS sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM ({_DENSE})) WHERE rank <= 10")
def dense_topk(t: Tables) -> DataFrame:
    return _dense(t, 10).select("qid", "id", F.round("sim", 5).alias("sim"), "rank")


_RANKED = f"SELECT qid, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM ({_DENSE})) WHERE rank <= 10"
_REL = "SELECT q.vec_id AS qid, e.vec_id AS id FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 20 = 0"


def _relevant(t: Tables) -> DataFrame:
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "label")
    return q.join(t.embeddings.select(F.col("vec_id").alias("id"), "label"), "label").select("qid", "id")


@query("ndcg", f"WITH r AS ({_RANKED}), g AS ({_REL}), n AS (SELECT qid, least(count(*), 10) AS n FROM g GROUP BY qid), d AS (SELECT qid, sum(1/log2(rank+1)) AS dcg FROM r JOIN g USING (qid, id) GROUP BY qid) SELECT n.qid, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, n + 1), lambda x: 1/log2(x + 1))), 9) AS ndcg FROM n LEFT JOIN d USING (qid)")
def ndcg(t: Tables) -> DataFrame:
    return retrieval.ndcg(_dense(t, 10), _relevant(t), "qid", "id", 10).select("qid", F.round("ndcg", 9).alias("ndcg"))


_OTHER = "SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS rank FROM (SELECT q.vec_id AS qid, e.vec_id AS id FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 20 = 0) QUALIFY rank <= 8"


def _by_label(t: Tables, k: int) -> DataFrame:
    """The first k of a query's label by id. A label's first k are found once, so no query meets all of its label."""
    from pyspark.sql import Window

    first = lambda df, of: df.withColumn("rank", F.row_number().over(Window.partitionBy(of).orderBy("id"))).where(F.col("rank") <= k)
    items = first(t.embeddings.select(F.col("vec_id").alias("id"), "label"), "label").select("id", "label")
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "label")
    return first(q.join(items, "label").select("qid", "id"), "qid")


def _pooled_delta(t: Tables) -> DataFrame:
    """Relevance is looked up for the pairs of the pool: all pairs of equal labels are never listed."""
    pool = reindex.pool(_dense(t, 10), _by_label(t, 8), "qid", "id")
    items = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "label")
    judged = pool.join(items, "id").join(q, ["qid", "label"], "left_semi").dropDuplicates(["qid", "id"])
    return reindex.judged_delta(judged, "qid", 10)


@query("rbo", f"""WITH a AS ({_RANKED}), b AS ({_OTHER}), s AS (SELECT a.qid, greatest(a.rank, b.rank) AS seen FROM a JOIN b USING (qid, id)), q AS (SELECT qid, greatest((SELECT max(rank) FROM a WHERE a.qid = x.qid), (SELECT max(rank) FROM b WHERE b.qid = x.qid)) AS depth FROM (SELECT DISTINCT qid FROM a) x),
 e AS (SELECT qid, unnest(range(1, depth + 1)) AS d FROM q)
 SELECT qid, round(sum(pow(0.9, d - 1) * (SELECT count(*) FROM s WHERE s.qid = e.qid AND seen <= d) / d) / sum(pow(0.9, d - 1)), 9) AS rbo FROM e GROUP BY qid""")
def rbo(t: Tables) -> DataFrame:
    return retrieval.rbo(_dense(t, 10), _by_label(t, 8), "qid", "id").select("qid", F.round("rbo", 9).alias("rbo"))


_POOLED = f"""WITH o AS ({_RANKED}), n AS ({_OTHER}), p AS (SELECT qid, id FROM o UNION SELECT qid, id FROM n), g AS (SELECT * FROM ({_REL}) SEMI JOIN p USING (qid, id)),
 c AS (SELECT qid, list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda x: 1/log2(x + 1))) AS ideal FROM g GROUP BY qid),
 a AS (SELECT qid, sum(1/log2(rank+1)) AS v FROM o JOIN g USING (qid, id) GROUP BY qid), b AS (SELECT qid, sum(1/log2(rank+1)) AS v FROM n JOIN g USING (qid, id) GROUP BY qid)
 SELECT c.qid, coalesce(b.v, 0) / ideal - coalesce(a.v, 0) / ideal AS delta FROM c LEFT JOIN a USING (qid) LEFT JOIN b USING (qid)"""


@query("pooled_ndcg_delta", f"SELECT qid, round(delta, 9) AS delta FROM ({_POOLED})")
def pooled_ndcg_delta(t: Tables) -> DataFrame:
    return _pooled_delta(t).select("qid", F.round("delta", 9).alias("delta"))


@query("bootstrap_ci", f"""WITH d AS ({_POOLED}), r AS (SELECT delta AS v, row_number() OVER (ORDER BY qid) - 1 AS i FROM d), n AS (SELECT count(*) AS n FROM r),
 s AS (SELECT b, CAST('0x' || md5('1234:' || b || ':' || k)[1:12] AS BIGINT) % n AS i FROM n, range(0, 2000) x(b), range(0, (SELECT n FROM n)) y(k)), m AS (SELECT b, avg(v) AS m FROM s JOIN r USING (i) GROUP BY b)
 SELECT round((SELECT avg(v) FROM r), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS ci_low, round(quantile_cont(m, 0.975), 9) AS ci_high FROM m""")
def bootstrap_ci(t: Tables) -> DataFrame:
    return stats.bootstrap_mean(_pooled_delta(t), "delta", "qid").select(*[F.round(c, 9).alias(c) for c in ("mean", "ci_low", "ci_high")])


@query("anisotropy", "WITH u AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings) SELECT count(DISTINCT a.vec_id) AS n, round(avg(list_dot_product(a.v, b.v)), 6) AS mean_cosine FROM u a JOIN u b ON a.vec_id <> b.vec_id")
def anisotropy(t: Tables) -> DataFrame:
    return liveness.anisotropy(t.embeddings.select(F.col("vec_id").alias("pos"), F.col("embedding").alias("v"))).select("n", F.round("mean_cosine", 6).alias("mean_cosine"))


@query("embedding_health", """WITH x AS (SELECT CAST(CASE WHEN vec_id % 25 = 0 THEN list_transform(embedding, lambda e: e * 0) ELSE embedding END AS DOUBLE[]) AS v FROM embeddings)
 SELECT count(*) AS n, count(*) FILTER (len(v) <> 64) AS wrong_width, count(*) FILTER (len(list_filter(v, lambda e: e IS NULL OR isnan(e) OR isinf(e))) > 0) AS non_finite, count(*) FILTER (sqrt(list_dot_product(v, v)) < 1e-6) AS zero_norm FROM x""")
def embedding_health(t: Tables) -> DataFrame:
    zeros = F.when(F.expr("vec_id % 25 = 0"), F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return liveness.embedding_health(t.embeddings.select(F.col("vec_id").alias("pos"), zeros.alias("v")), 64)


# ---------------------------------------------------------------- statistics

_PRED = "SELECT l.quality = 1 AS actual, d.n_chars >= 400 AND d.n_chars < 6000 AS predicted, l.doc_id FROM labels l JOIN documents d USING (doc_id)"


def _predictions(t: Tables) -> DataFrame:
    return t.labels.join(t.documents, "doc_id").select("doc_id", (F.col("quality") == 1).alias("actual"), ((F.col("n_chars") >= 400) & (F.col("n_chars") < 6000)).alias("predicted"))


@query("confusion_prf", f"WITH p AS ({_PRED}), c AS (SELECT count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (NOT predicted AND actual) AS fn, count(*) FILTER (NOT predicted AND NOT actual) AS tn FROM p) SELECT tp, fp, fn, tn, round(tp/(tp+fp),9) AS precision, round(tp/(tp+fn),9) AS recall, round(2*(tp/(tp+fp))*(tp/(tp+fn))/((tp/(tp+fp))+(tp/(tp+fn))),9) AS f1 FROM c")
def confusion_prf(t: Tables) -> DataFrame:
    c = stats.precision_recall(_predictions(t), "predicted", "actual")
    return c.select("tp", "fp", "fn", "tn", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])


@query("confusion_matrix", f"WITH p AS ({_PRED}), k AS (SELECT actual AS class FROM p UNION SELECT predicted FROM p) SELECT CAST(class AS VARCHAR) AS class, (SELECT count(*) FROM p WHERE actual = class) AS support, (SELECT count(*) FROM p WHERE predicted = class) AS predicted, round((SELECT count(*) FROM p WHERE predicted = class AND actual = class) / (SELECT count(*) FROM p WHERE predicted = class), 9) AS precision, round((SELECT count(*) FROM p WHERE predicted = class AND actual = class) / (SELECT count(*) FROM p WHERE actual = class), 9) AS recall FROM k")
def confusion_matrix(t: Tables) -> DataFrame:
    return stats.confusion(_predictions(t), "actual", "predicted").select(F.col("class").cast("string").alias("class"), "support", "predicted", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("agreement_kappa", f"WITH p AS ({_PRED}), c AS (SELECT count(*) AS n, avg(CASE WHEN actual = predicted THEN 1 ELSE 0 END) AS po, avg(CASE WHEN actual THEN 1 ELSE 0 END) AS pa, avg(CASE WHEN predicted THEN 1 ELSE 0 END) AS pb FROM p) SELECT n, round(po, 9) AS agreement, round((po - (pa*pb + (1-pa)*(1-pb))) / (1 - (pa*pb + (1-pa)*(1-pb))), 9) AS kappa FROM c")
def agreement_kappa(t: Tables) -> DataFrame:
    return stats.agreement(_predictions(t), "actual", "predicted").select("n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


@query("pearson", "SELECT round(corr(n_chars, quality), 9) AS pearson FROM labels JOIN documents USING (doc_id)")
def pearson(t: Tables) -> DataFrame:
    both = t.labels.join(t.documents, "doc_id").select(F.col("n_chars").cast("double").alias("x"), F.col("quality").cast("double").alias("y"))
    return stats.pearson(both, "x", "y").select(F.round("pearson", 9).alias("pearson"))


@query("kendall", """WITH s AS (SELECT source AS k, avg(n_chars) AS x, CAST(max(n_chars) AS DOUBLE) AS y FROM documents GROUP BY source), p AS (SELECT sign(a.x-b.x) AS dx, sign(a.y-b.y) AS dy FROM s a JOIN s b ON a.k < b.k),
 c AS (SELECT count(*) FILTER (dx*dy>0) AS con, count(*) FILTER (dx*dy<0) AS dis, count(*) FILTER (dx=0) AS tx, count(*) FILTER (dy=0) AS ty FROM p) SELECT round((con-dis)/sqrt(CAST(con+dis+tx AS DOUBLE)*(con+dis+ty)), 9) AS tau FROM c""")
def kendall(t: Tables) -> DataFrame:
    by = t.documents.groupBy("source").agg(F.avg("n_chars").alias("x"), F.max("n_chars").cast("double").alias("y"))
    return stats.kendall(by, "source", "x", "y").select(F.round("tau", 9).alias("tau"))


@query("quantiles", "SELECT round(quantile_cont(n_chars, 0.9), 6) AS q90, round(quantile_cont(n_chars, 0.75), 6) AS q75, round(median(n_chars), 6) AS med FROM documents")
def quantiles(t: Tables) -> DataFrame:
    return t.documents.agg(F.round(F.percentile("n_chars", F.lit(0.9)), 6).alias("q90"), F.round(F.percentile("n_chars", F.lit(0.75)), 6).alias("q75"), F.round(F.median("n_chars"), 6).alias("med"))


# ---------------------------------------------------------------- liveness of a pipeline with a planted fault


def _state(t: Tables) -> DataFrame:
    docs = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("text"))
    index = docs.select(F.col("id").alias("pos"), F.when(F.col("id") == 7, F.lit(10**9)).otherwise(F.col("id")).alias("id"))
    emb = t.embeddings.select(F.col("vec_id").alias("pos"), F.col("embedding").alias("v"))
    hits = _dense(t, 5).select(F.col("qid").alias("qi"), "rank", "id", F.when(F.col("qid") == 40, 0.5).otherwise(F.col("sim")).alias("score"))
    queries = hits.select("qi").distinct().select("qi", F.lit("").alias("text"))
    return liveness.checks(docs, index, emb, queries, hits, 64)


_CHECKS = f"""WITH docs AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS text FROM embeddings), idx AS (SELECT CASE WHEN vec_id = 7 THEN 1000000000 ELSE vec_id END AS id FROM embeddings),
 emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nv FROM embeddings),
 hits AS (SELECT qid AS qi, rank, id, CASE WHEN qid = 40 THEN 0.5 ELSE sim END AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM ({_DENSE})) WHERE rank <= 5),
 pairs AS (SELECT avg(CASE WHEN a.nv = 0 OR b.nv = 0 THEN 0 ELSE list_dot_product(a.v, b.v) / (a.nv * b.nv) END) AS c FROM emb a JOIN emb b ON a.vec_id <> b.vec_id),
 lost AS (SELECT qi, CASE WHEN bool_or(id NOT IN (SELECT id FROM idx)) THEN 'unknown-id' END AS reason FROM hits GROUP BY qi),
 steps AS (SELECT *, lead(score) OVER (PARTITION BY qi ORDER BY rank) AS after FROM hits),
 odd AS (SELECT qi, CASE WHEN bool_or(score IS NULL OR isnan(score) OR isinf(score)) THEN 'non-finite' WHEN coalesce(bool_or(score < after - 1e-12), false) THEN 'not-descending' WHEN count(*) >= 2 AND max(score) - min(score) <= 1e-9 THEN 'tied-scores' END AS reason FROM steps GROUP BY qi),
 c AS (SELECT 0 AS ord, 'ingest' AS stage, CASE WHEN (SELECT count(*) FROM docs) = 0 THEN 'no-docs' WHEN (SELECT count(*) FROM docs WHERE trim(text) <> '') = 0 THEN 'no-text' END AS reason
  UNION ALL SELECT 1, 'index', CASE WHEN (SELECT count(*) FROM idx) <> (SELECT count(*) FROM docs) THEN 'count-mismatch' WHEN (SELECT count(DISTINCT id) FROM idx) <> (SELECT count(*) FROM idx) THEN 'duplicate-ids' WHEN (SELECT count(*) FROM idx WHERE id NOT IN (SELECT id FROM docs)) > 0 THEN 'dangling-ids' END
  UNION ALL SELECT 2, 'embed', CASE WHEN (SELECT count(*) FROM emb) <> (SELECT count(*) FROM idx) THEN 'shape-mismatch' WHEN (SELECT count(*) FROM emb WHERE len(v) <> 64) > 0 THEN 'width-mismatch' WHEN (SELECT count(*) FROM emb WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) > 0 THEN 'non-finite' WHEN (SELECT count(*) FROM emb WHERE nv < 1e-6) > 0 THEN 'zero-norm' WHEN (SELECT c FROM pairs) > 0.98 THEN 'anisotropic' END
  UNION ALL SELECT 3, 'retrieve', (SELECT reason FROM lost WHERE reason IS NOT NULL ORDER BY qi LIMIT 1)
  UNION ALL SELECT 4, 'score', (SELECT reason FROM odd WHERE reason IS NOT NULL ORDER BY qi LIMIT 1))"""


@query("liveness_stages", f"{_CHECKS}, dead AS (SELECT coalesce(min(ord), 99) AS d FROM c WHERE reason IS NOT NULL) SELECT ord, stage, CASE WHEN ord < d THEN 'ok' WHEN ord = d THEN 'dead' ELSE 'skipped' END AS status, CASE WHEN ord = d THEN reason END AS reason FROM c, dead")
def liveness_stages(t: Tables) -> DataFrame:
    return liveness.stage_status(_state(t))


@query("first_dead_stage", f"{_CHECKS} SELECT arg_min(stage, ord) FILTER (reason IS NOT NULL) AS dead_stage, arg_min(reason, ord) FILTER (reason IS NOT NULL) AS reason FROM c")
def first_dead_stage(t: Tables) -> DataFrame:
    return liveness.first_dead(_state(t))


@query("last_dead_stage", f"{_CHECKS} SELECT arg_max(stage, ord) FILTER (reason IS NOT NULL) AS dead_stage FROM c")
def last_dead_stage(t: Tables) -> DataFrame:
    return liveness.last_dead(_state(t))


# ---------------------------------------------------------------- certificates: each label's vectors as a probe set


def _probes(t: Tables, live: bool) -> DataFrame:
    v = F.col("embedding")
    fault = (
        F.when(F.expr("label % 5 = 0"), F.transform(v, lambda x: x.cast("double")))
        .when(F.expr("label % 5 = 1"), F.transform(v, lambda x: x.cast("double") * 3))
        .when(F.expr("label % 5 = 2"), vec.quantized(v, 8))
        .when(F.expr("label % 5 = 3"), F.transform(F.reverse(v), lambda x: x.cast("double")))
        .otherwise(F.transform(F.slice(v, 1, 32), lambda x: x.cast("double")))
    )
    return t.embeddings.select("label", F.col("vec_id").alias("pos"), (fault if live else F.transform(v, lambda x: x.cast("double"))).alias("v"))


@query("vector_certificate", """WITH e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) / 127.0 AS step FROM e),
 p AS (SELECT label, vec_id, CAST(v AS FLOAT[]) AS r, CAST(CASE label % 5 WHEN 0 THEN v WHEN 1 THEN list_transform(v, lambda x: x * 3) WHEN 2 THEN list_transform(v, lambda x: round_even(x / step, 0) * step) WHEN 3 THEN list_reverse(v) ELSE v[1:32] END AS FLOAT[]) AS l FROM s),
 d AS (SELECT *, CAST(r AS DOUBLE[]) AS rd, CAST(l AS DOUBLE[]) AS ld FROM p),
 q AS (SELECT *, CASE WHEN len(l) = len(r) THEN list_dot_product(ld, rd) / (sqrt(list_dot_product(ld, ld)) * sqrt(list_dot_product(rd, rd))) END AS c, sqrt(list_dot_product(ld, ld)) AS nl FROM d)
 SELECT label, CASE WHEN NOT arg_min(len(l) = len(r), vec_id) THEN 'dim-mismatch' WHEN bool_and(l = r) THEN 'reproduced' WHEN avg(c) >= 0.98 AND max(abs(nl - 1)) > 0.05 THEN 'lost-l2-norm' WHEN avg(c) >= 0.98 THEN 'quant-dtype-drift' ELSE 'wrong-weights' END AS verdict, count(*) AS probes FROM q GROUP BY label""")
def vector_certificate(t: Tables) -> DataFrame:
    n = t.embeddings.groupBy("label").agg(F.count("*").alias("probes"))
    return certificate.compare(_probes(t, False), _probes(t, True), ["label"]).join(n, "label").select("label", "verdict", "probes")


@query("quant_drift", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) / 127.0 AS s FROM v), l AS (SELECT vec_id, v, list_transform(v, lambda x: round_even(x / s, 0) * s) AS w FROM q)
 SELECT vec_id, round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 6) AS cosine FROM l""")
def quant_drift(t: Tables) -> DataFrame:
    drift = T.let(vec.quantized(F.col("embedding"), 8), lambda q: vec.cosine(F.col("embedding"), q))
    return t.embeddings.select("vec_id", F.round(drift, 6).alias("cosine"))
