"""Queries: PII reachability, governor, graph, forensics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.functions import vec
from tallyspark.operators import forensics, governor, graph, pii_audit, retrieval

from .registry import Tables, query

# ---------------------------------------------------------------- PII

_EMAIL = "(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}"


def _pii_sql(table: str, key: str) -> str:
    off = "CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))),0) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))),0) AS INTEGER)"
    return f"""WITH m AS (SELECT {key}, regexp_extract_all(text, '{_EMAIL}') AS v, regexp_split_to_array(text, '{_EMAIL}') AS p FROM {table} WHERE text IS NOT NULL), u AS (SELECT {key}, v, p, unnest(range(1, len(v)+1)) AS i FROM m)
 SELECT {key}, 'email' AS kind, v[i] AS value, {off} AS start, CAST({off} + length(v[i]) AS INTEGER) AS stop FROM u"""


@query("pii_spans", _pii_sql("documents", "doc_id"))
def pii_spans(t: Tables) -> DataFrame:
    return pii_audit.detect(t.documents.select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id")


@query("redacted_documents", "SELECT doc_id, md5(regexp_replace(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}', ' redactedtoken redactedtoken redactedtoken redactedtoken ', 'g')) AS redacted_md5 FROM documents WHERE text IS NOT NULL")
def redacted_documents(t: Tables) -> DataFrame:
    docs = t.documents.where("text is not null").select(F.col("doc_id").alias("id"), "text")
    return pii_audit.redact(docs, pii_audit.detect(docs)).select(F.col("id").alias("doc_id"), F.md5("text").alias("redacted_md5"))


@query("pii_reachability")
def pii_reachability(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    return pii_audit.reachability(docs, pii_audit.detect(docs), vec.md5_slots).select("id", "kind", "start", "query", "rank", "reachable")


# ---------------------------------------------------------------- governor: each user's events as hops


def _telemetry(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.select("user_id", "value", (F.row_number().over(w) - 1).cast("bigint").alias("hop"))
    v = F.floor("value").cast("double")
    return e.select(F.col("user_id").alias("run"), "hop", (8000.0 + 60.0 * (v % 100) + 40.0 * F.col("hop")).alias("vram_mb"), (60.0 + (v % 37) * 0.5 + F.col("hop") * 0.25).alias("temp_c"), F.when(F.col("hop") == 0, 0.0).otherwise(v % 50).alias("hop_ms"))


_TELEM = """SELECT user_id AS run, hop, 8000.0 + 60.0 * (fv % 100) + 40.0 * hop AS vram_mb, 60.0 + (fv % 37) * 0.5 + hop * 0.25 AS temp_c, CASE WHEN hop = 0 THEN 0.0 ELSE fv % 50 END AS hop_ms
 FROM (SELECT user_id, CAST(floor(value) AS DOUBLE) AS fv, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS hop FROM events)"""
_GATES = f"""WITH t AS ({_TELEM}), s AS (SELECT *, coalesce(temp_c - lag(temp_c) OVER w, 0) AS dt, coalesce(vram_mb - lag(vram_mb) OVER w, 0) AS dv, coalesce(hop_ms - lag(hop_ms) OVER w, 0) AS dm, sum(hop_ms) OVER (PARTITION BY run ORDER BY hop ROWS UNBOUNDED PRECEDING) AS el FROM t WINDOW w AS (PARTITION BY run ORDER BY hop)),
 g AS (SELECT run, hop, temp_c, vram_mb, CASE WHEN temp_c >= 88 THEN 'thermal-observed' WHEN vram_mb >= 13976 THEN 'vram-observed' WHEN temp_c + dt >= 90 THEN 'thermal-predicted' WHEN vram_mb + dv >= 15000 THEN 'vram-predicted' WHEN temp_c + dt >= 86.5 THEN 'thermal-band' WHEN vram_mb + dv >= 13464 THEN 'vram-band' WHEN el + greatest(hop_ms + dm, hop_ms) > 6000 THEN 'latency' ELSE 'headroom ok' END AS reason FROM s)"""
_DEC = "CASE WHEN reason IN ('thermal-observed','vram-observed','thermal-predicted','vram-predicted') THEN 'DENY' WHEN reason = 'headroom ok' THEN 'ALLOW' ELSE 'DEFER' END"


@query("governor_decisions", f"{_GATES} SELECT run, hop, {_DEC} AS decision, reason FROM g")
def governor_decisions(t: Tables) -> DataFrame:
    return governor.gates(_telemetry(t), governor.profile(t.spark)).select("run", "hop", "decision", "reason")


_RUNS = """, d AS (SELECT run, hop, temp_c, vram_mb, {dec} AS decision, hop >= 1 AND (temp_c >= 90 OR vram_mb >= 15000) AS breach FROM g),
 e AS (SELECT run, max(hop) AS last, min(hop) FILTER (decision <> 'ALLOW') AS stop0, min(hop) FILTER (breach) AS hit FROM d GROUP BY run),
 f AS (SELECT run, hit, last, CASE WHEN stop0 < last THEN stop0 END AS stop FROM e), h AS (SELECT *, least(coalesce(stop, 1073741824), coalesce(hit, 1073741824), last) AS fin FROM f)
 SELECT d.run, max(hop) AS hops_executed, coalesce(any_value(hit) = any_value(fin), false) AS breached, CASE WHEN coalesce(any_value(hit) = any_value(fin), false) THEN 'abort' WHEN any_value(stop) = any_value(fin) THEN 'governor' ELSE 'schedule-end' END AS stopped_by, max(temp_c) AS peak_temp_c, max(vram_mb) AS peak_vram_mb FROM d JOIN h ON d.run = h.run AND d.hop <= h.fin GROUP BY d.run"""


@query("governed_runs", _GATES + _RUNS.format(dec=_DEC))
def governed_runs(t: Tables) -> DataFrame:
    x, p = _telemetry(t), governor.profile(t.spark)
    return governor.runs(x, p, governor.gates(x, p))


@query("ungoverned_runs", _GATES + _RUNS.format(dec="'ALLOW'"))
def ungoverned_runs(t: Tables) -> DataFrame:
    return governor.runs(_telemetry(t), governor.profile(t.spark))


@query("cost_governed_runs", _GATES + _RUNS.format(dec="CASE WHEN (hop + 1) * 412 > 8192 THEN 'DENY' ELSE 'ALLOW' END"))
def cost_governed_runs(t: Tables) -> DataFrame:
    x = _telemetry(t)
    return governor.runs(x, governor.profile(t.spark), governor.cost_gates(x))


@query("breach_rate", _GATES + f", x AS (SELECT 'cost' AS governor, * FROM (SELECT * FROM g)), r AS (SELECT governor, run, min(hop) FILTER ((hop + 1) * 412 > 8192) AS stop, min(hop) FILTER (hop >= 1 AND (temp_c >= 90 OR vram_mb >= 15000)) AS hit, max(hop) AS last FROM x GROUP BY 1, 2) SELECT governor, count(*) AS runs, count(*) FILTER (hit IS NOT NULL AND hit <= coalesce(CASE WHEN stop < last THEN stop END, 1073741824)) AS breaches, round(avg(CASE WHEN hit IS NOT NULL AND hit <= coalesce(CASE WHEN stop < last THEN stop END, 1073741824) THEN 1 ELSE 0 END), 9) AS rate FROM r GROUP BY governor")
def breach_rate(t: Tables) -> DataFrame:
    return governor.breach_rate(cost_governed_runs(t).withColumn("governor", F.lit("cost"))).withColumn("rate", F.round("rate", 9))


# ---------------------------------------------------------------- graph: suppliers of parts, grouped by nation


def _nodes(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("bigint").alias("community"))


def _edges(t: Tables) -> DataFrame:
    """Suppliers of neighbouring lines of an order."""
    a = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("u"))
    b = t.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("l_suppkey").alias("v"))
    return a.join(b, ["l_orderkey", "n"]).select("u", "v").distinct()


_EDGES = "SELECT DISTINCT a.l_suppkey AS u, b.l_suppkey AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"
_ADJ = f"WITH e AS ({_EDGES}), adj AS (SELECT u AS id, v AS nb FROM e UNION SELECT v, u FROM e), deg AS (SELECT s_suppkey AS id, count(nb) AS degree FROM supplier LEFT JOIN adj ON id = s_suppkey GROUP BY 1)"


@query("graph_degree", f"{_ADJ} SELECT id, degree, abs(degree - (SELECT median(degree) FROM deg)) AS anomaly FROM deg")
def graph_degree(t: Tables) -> DataFrame:
    return graph.degree_ranks(_nodes(t), _edges(t))


@query("graph_orphans", f"{_ADJ} SELECT s_suppkey AS id FROM supplier WHERE s_suppkey NOT IN (SELECT id FROM adj WHERE id <> nb)")
def graph_orphans(t: Tables) -> DataFrame:
    return graph.orphans(_nodes(t), _edges(t))


@query("graph_bfs2", f"{_ADJ}, s AS (SELECT min(id) AS id FROM adj), h1 AS (SELECT DISTINCT nb AS id FROM adj WHERE id IN (SELECT id FROM s) AND nb NOT IN (SELECT id FROM s)), h2 AS (SELECT DISTINCT nb AS id FROM adj WHERE id IN (SELECT id FROM h1) AND nb NOT IN (SELECT id FROM s) AND nb NOT IN (SELECT id FROM h1)) SELECT id, 0 AS hop FROM s UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2")
def graph_bfs2(t: Tables) -> DataFrame:
    e = _edges(t)
    return graph.bfs(graph.adjacency(e).agg(F.min("id").alias("id")), e, 2)


@query("community_density", f"{_ADJ}, c AS (SELECT s_nationkey AS community, count(*) AS size FROM supplier GROUP BY 1), i AS (SELECT a.s_nationkey AS community, count(*) AS n FROM e JOIN supplier a ON a.s_suppkey = u JOIN supplier b ON b.s_suppkey = v WHERE a.s_nationkey = b.s_nationkey GROUP BY 1) SELECT CAST(c.community AS BIGINT) AS community, size, round(CASE WHEN size < 2 THEN 1.0 ELSE coalesce(n, 0) / (size * (size - 1) / 2) END, 9) AS density FROM c LEFT JOIN i ON i.community = c.community")
def community_density(t: Tables) -> DataFrame:
    return graph.density(_nodes(t), _edges(t)).withColumn("density", F.round("density", 9))


@query("hub_pollution", f"{_ADJ}, br AS (SELECT adj.id, count(DISTINCT s_nationkey) AS communities FROM adj JOIN supplier ON s_suppkey = nb GROUP BY 1), st AS (SELECT median(degree) AS med, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS nc FROM deg) SELECT deg.id AS target, round(least(1.0, degree / greatest(med, 1.0) / 6.0) * communities / nc, 9) AS score, degree, communities FROM deg JOIN br ON br.id = deg.id, st WHERE med > 0 AND degree >= 3 * med AND degree >= 4")
def hub_pollution(t: Tables) -> DataFrame:
    return graph.hubs(_nodes(t), _edges(t)).withColumn("score", F.round("score", 9))


@query("poison_fraction", f"{_ADJ}, s AS (SELECT min(id) AS id FROM adj), r AS (SELECT id FROM s UNION SELECT nb FROM adj WHERE id IN (SELECT id FROM s)) SELECT round(avg(CASE WHEN s_nationkey <> (SELECT s_nationkey FROM supplier WHERE s_suppkey = (SELECT id FROM s)) THEN 1 ELSE 0 END), 9) AS poison FROM r JOIN supplier ON s_suppkey = id")
def poison_fraction(t: Tables) -> DataFrame:
    e = _edges(t)
    seed = graph.adjacency(e).agg(F.min("id").alias("id"))
    facts = t.supplier.select(F.col("s_suppkey").alias("fact_id"), F.col("s_nationkey").alias("real_community"))
    held = graph.bfs(seed, e, 1).select(F.col("id").alias("fact_id"))
    home = facts.join(seed, F.col("fact_id") == F.col("id")).select(F.col("real_community").alias("home"))
    x = facts.crossJoin(F.broadcast(home))  # one row
    return graph.poison_fraction(held, x, F.col("home")).withColumn("poison", F.round("poison", 9))


@query("graph_components", f"WITH RECURSIVE e AS ({_EDGES}), adj AS (SELECT u AS id, v AS nb FROM e UNION SELECT v, u FROM e), r AS (SELECT s_suppkey AS id, s_suppkey AS c FROM supplier UNION SELECT adj.nb, r.c FROM r JOIN adj ON adj.id = r.id) SELECT id, min(c) AS component FROM r GROUP BY id")
def graph_components(t: Tables) -> DataFrame:
    return graph.components(_nodes(t), _edges(t))


@query("graph_baselines", f"""{_ADJ}, c AS (SELECT s_nationkey AS community, count(*) AS size FROM supplier GROUP BY 1), i AS (SELECT a.s_nationkey AS community, count(*) AS n FROM e JOIN supplier a ON a.s_suppkey = u JOIN supplier b ON b.s_suppkey = v WHERE a.s_nationkey = b.s_nationkey GROUP BY 1),
 x AS (SELECT 'degree_centrality' AS baseline, CAST(id AS VARCHAR) AS target, CAST(degree AS DOUBLE) AS score FROM deg UNION ALL SELECT 'degree_anomaly', CAST(id AS VARCHAR), CAST(abs(degree - (SELECT median(degree) FROM deg)) AS DOUBLE) FROM deg
  UNION ALL SELECT 'thin_density', CAST(c.community AS VARCHAR), 1 - CASE WHEN size < 2 THEN 1.0 ELSE coalesce(n, 0) / (size * (size - 1) / 2) END FROM c LEFT JOIN i ON i.community = c.community)
 SELECT baseline, target, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY baseline ORDER BY score DESC, target) AS INTEGER) AS rank FROM x""")
def graph_baselines(t: Tables) -> DataFrame:
    return graph.baseline_ranks(_nodes(t), _edges(t)).withColumn("score", F.round("score", 9))


@query("incoherent_parts")
def incoherent_parts(t: Tables) -> DataFrame:
    """Two-means separation of benchmark items in ten groups: iterative, so without an SQL twin."""
    v = retrieval.sparse(t.benchmark.select((F.col("item_id") % 10).alias("target"), F.col("item_id").alias("member"), "text"), ["target", "member"], vec.md5_slots(T.tokens(F.col("text"))))
    return graph.separation(v)


# ---------------------------------------------------------------- forensics: assistant turns as answers to the turn before


def _calls(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    x = t.conversations.withColumn("before", F.lag("text").over(w)).where("before is not null and text is not null")
    qid = F.concat_ws(":", "conv_id", "turn")
    whole = lambda c: F.array_join(T.raw_tokens(F.col(c)), " ")
    # Without context a third of the answers stay, a third lose every second word, a third are not known.
    thinned = F.array_join(F.filter(T.raw_tokens(F.col("text")), lambda _, i: i % 2 == 0), " ")
    full = x.select(qid.alias("qid"), F.lit("full").alias("variant"), whole("text").alias("answer"))
    empty = x.select(qid.alias("qid"), F.lit("empty").alias("variant"), F.when(F.expr("turn % 3 = 0"), whole("text")).when(F.expr("turn % 3 = 1"), thinned).otherwise(F.lit("IDK")).alias("answer"))
    again = x.select(qid.alias("qid"), F.lit("resample_0").alias("variant"), whole("before").alias("answer"))
    return full.unionByName(empty).unionByName(again)


_H = "array_to_string(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> ''), ' ')"
_THIN = "array_to_string(list_filter(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> ''), lambda x, i: i % 2 = 1), ' ')"
_CALLS = f"""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations),
 c AS (SELECT concat_ws(':', conv_id, turn) AS qid, {_H.format('text')} AS f, CASE turn % 3 WHEN 0 THEN {_H.format('text')} WHEN 1 THEN {_THIN.format('text')} ELSE 'IDK' END AS e, {_H.format('before')} AS r, before FROM p WHERE before IS NOT NULL AND text IS NOT NULL),
 j AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(f), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(e), '\\s+'), lambda x: x <> '')) AS b FROM c),
 i AS (SELECT *, CASE WHEN NOT (length(f) > 0 AND upper(trim(f)) <> 'IDK') THEN 0.0 WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS inv FROM j),
 k AS (SELECT greatest(0.35, least(0.95, quantile_cont(inv, 0.9) + 0.15)) AS threshold, quantile_cont(inv, 0.9) AS q90, count(*) AS n FROM i)"""


@query("leak_calibration", f"{_CALLS} SELECT round(threshold, 9) AS threshold, round(q90, 9) AS q90, n FROM k")
def leak_calibration(t: Tables) -> DataFrame:
    return forensics.calibrate(_calls(t)).select(F.round("threshold", 9).alias("threshold"), F.round("q90", 9).alias("q90"), "n")


def _context(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    x = t.conversations.withColumn("before", F.lag("text").over(w)).where("before is not null and text is not null")
    return x.select(F.concat_ws(":", "conv_id", "turn").alias("qid"), T.jaccard(F.col("before"), F.col("text")).alias("quality"), T.tokens(F.concat_ws(" ", "before", "text")).alias("tokens"))


_Q = "CASE WHEN len(x1)=0 AND len(x2)=0 THEN 1.0 WHEN len(x1)=0 OR len(x2)=0 THEN 0.0 ELSE len(list_intersect(x1,x2)) / len(list_distinct(list_concat(x1,x2))) END"


@query("forensics_attribution", f"""{_CALLS}, q AS (SELECT concat_ws(':', conv_id, turn) AS qid, {_Q} AS quality FROM (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(before), '\\s+'), lambda x: x <> '')) AS x1, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS x2 FROM p WHERE before IS NOT NULL AND text IS NOT NULL)),
 fl AS (SELECT 0.5 * median(quality) AS floor FROM q)
 SELECT i.qid, f AS answer, round(inv, 4) AS invariance, CAST(CASE WHEN f = r THEN 1.0 ELSE 0.5 END AS DOUBLE) AS consistency, round(quality, 4) AS quality, length(f) > 0 AND upper(trim(f)) <> 'IDK' AS supported, inv >= threshold AND length(f) > 0 AND upper(trim(f)) <> 'IDK' AS leak,
 CASE WHEN quality < floor THEN 'retriever' WHEN NOT (length(f) > 0 AND upper(trim(f)) <> 'IDK') THEN 'generator' ELSE 'ok' END AS attribution FROM i JOIN q USING (qid), k, fl""")
def forensics_attribution(t: Tables) -> DataFrame:
    calls, ctx = _calls(t), _context(t)
    return forensics.verdicts(calls, ctx, forensics.calibrate(calls), forensics.retrieval_floor(ctx))


@query("threshold_ablation", f"""{_CALLS}, z AS (SELECT inv, threshold, length(f) > 0 AND upper(trim(f)) <> 'IDK' AS ans, CAST(split_part(qid, ':', 2) AS BIGINT) % 3 = 0 AS leak FROM i, k),
 y AS (SELECT 'fixed' AS gate, inv >= 0.5 AND ans AS p, leak AS a FROM z UNION ALL SELECT 'calibrated', inv >= threshold AND ans, leak FROM z),
 cc AS (SELECT gate, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM y GROUP BY gate),
 v AS (SELECT *, CASE WHEN tp+fp=0 THEN 1.0 ELSE tp/(tp+fp) END AS pr, CASE WHEN tp+fn=0 THEN 1.0 ELSE tp/(tp+fn) END AS re FROM cc)
 SELECT gate, tp, fp, fn, tn, round(pr, 9) AS precision, round(re, 9) AS recall, round(CASE WHEN pr+re=0 THEN 0.0 ELSE 2*pr*re/(pr+re) END, 9) AS f1 FROM v""")
def threshold_ablation(t: Tables) -> DataFrame:
    calls = _calls(t)
    truth = calls.select("qid").distinct().withColumn("leak", F.split("qid", ":")[1].cast("bigint") % 3 == 0)
    got = forensics.ablation(calls, truth, forensics.calibrate(calls))
    return got.select("gate", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])
