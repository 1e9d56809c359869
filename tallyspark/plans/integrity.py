"""Queries: sync, coverage, drift, provenance, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.operators import coverage, drift, provenance, refs

from .registry import Tables, query


# ---------------------------------------------------------------- references: orders point at customers

LIVE, CACHED = ["BUILDING", "AUTOMOBILE"], ["MACHINERY", "FURNITURE"]


def _sync(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges = t.orders.select(F.col("o_orderkey").alias("from_id"), F.col("o_custkey").alias("to_id"), F.col("o_orderpriority").alias("reason"))
    seg = lambda s: t.customer.where(F.col("c_mktsegment").isin(s)).select(F.col("c_custkey").alias("id"))
    return edges, seg(LIVE), seg(CACHED)


_RESOLVED = """SELECT o_orderkey AS from_id, o_custkey AS to_id, o_orderpriority AS reason,
  CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING','AUTOMOBILE')) THEN 'LIVE'
       WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY','FURNITURE')) THEN 'STALE_CACHED'
       ELSE 'DANGLING' END AS status FROM orders"""


@query("ref_resolution", _RESOLVED)
def ref_resolution(t: Tables) -> DataFrame:
    return refs.resolve(*_sync(t))


@query("ref_closure", "SELECT o_orderkey AS from_id, o_custkey AS to_id, o_orderpriority AS reason FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING','AUTOMOBILE'))")
def ref_closure(t: Tables) -> DataFrame:
    edges, live, _ = _sync(t)
    return refs.closure(edges, live)


@query("sync_gate", f"SELECT count(*) FILTER (status='LIVE') AS live, count(*) FILTER (status='STALE_CACHED') AS stale_cached, count(*) FILTER (status='DANGLING') AS dangling, count(*) FILTER (status='DANGLING') = 0 AS passed FROM ({_RESOLVED})")
def sync_gate(t: Tables) -> DataFrame:
    return refs.gate(refs.resolve(*_sync(t)))


def _states(t: Tables) -> tuple[DataFrame, DataFrame]:
    now = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"))
    before = t.documents.where("doc_id % 11 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.when(F.expr("doc_id % 6 = 0"), F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"))
    return now, before


_STATES = """WITH cur AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS hash FROM documents),
 old AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(CASE WHEN doc_id % 6 = 0 THEN text || 'x' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0)"""


@query("changed_files", f"{_STATES} SELECT c.path, c.hash FROM cur c LEFT JOIN old o USING (path) WHERE c.hash IS DISTINCT FROM o.hash")
def changed_files(t: Tables) -> DataFrame:
    return refs.changed(*_states(t))


@query("unchanged_files", f"{_STATES} SELECT c.path, c.hash FROM cur c LEFT JOIN old o USING (path) WHERE c.hash IS NOT DISTINCT FROM o.hash")
def unchanged_files(t: Tables) -> DataFrame:
    return refs.unchanged(*_states(t))


@query("sync_reduction", f"{_STATES}, x AS (SELECT count(*) AS total, count(*) FILTER (c.hash IS DISTINCT FROM o.hash) AS changed FROM cur c LEFT JOIN old o USING (path)) SELECT total, changed, CASE WHEN changed = 0 THEN CAST('Infinity' AS DOUBLE) ELSE total / changed END AS factor FROM x")
def sync_reduction(t: Tables) -> DataFrame:
    return refs.reduction(*_states(t))


# ---------------------------------------------------------------- coverage: parts mentioned by order lines

OWN = "1-URGENT"
OTHERS = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _mentions(t: Tables, least: int) -> DataFrame:
    """Every line mentions its part: as its order's priority, or, in small quantities, as the part's own type."""
    lines = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("entity"), (F.col("l_quantity") >= least).alias("large"))
    both = lines.join(t.orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("entity", F.when(F.col("large"), F.col("o_orderpriority")).otherwise(OWN).alias("source_type"))


def _registry(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("entity"))


def _mention_sql(least: int) -> str:
    return f"SELECT l_partkey, CASE WHEN l_quantity >= {least} THEN o_orderpriority ELSE '1-URGENT' END AS st FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _audit_sql(least: int) -> str:
    return f"""SELECT p_partkey AS entity, count(DISTINCT st) / 4.0 AS type_coverage, count(st) AS total_other_mentions,
  coalesce(string_agg(DISTINCT st, ',' ORDER BY st), '') AS mentioning_types,
  CASE WHEN count(DISTINCT st) = 0 THEN 'orphan' WHEN count(DISTINCT st) / 4.0 <= 1.0/3 OR count(st) < 3 THEN 'thin' ELSE 'adequate' END AS severity
 FROM part LEFT JOIN (SELECT * FROM ({_mention_sql(least)}) WHERE st <> '1-URGENT') m ON l_partkey = p_partkey GROUP BY p_partkey"""


@query("coverage_audit", f"SELECT entity, CAST(type_coverage AS DOUBLE) AS type_coverage, total_other_mentions, mentioning_types, severity FROM ({_audit_sql(47)})")
def coverage_audit(t: Tables) -> DataFrame:
    return coverage.audit(_registry(t), _mentions(t, 47), OWN, OTHERS).withColumn("mentioning_types", F.array_join("mentioning_types", ","))


@query("coverage_summary", f"SELECT severity, count(*) AS n FROM ({_audit_sql(47)}) GROUP BY severity")
def coverage_summary(t: Tables) -> DataFrame:
    return coverage.audit(_registry(t), _mentions(t, 47), OWN, OTHERS).groupBy("severity").agg(F.count("*").alias("n"))


@query("coverage_drift", f"""WITH r AS (SELECT * FROM (VALUES ('adequate',0),('thin',1),('orphan',2)) v(s, k)), a AS ({_audit_sql(45)}), b AS ({_audit_sql(47)})
 SELECT entity, coalesce(a.severity,'adequate') AS previous, coalesce(b.severity,'adequate') AS current, (SELECT k FROM r WHERE s = coalesce(b.severity,'adequate')) > (SELECT k FROM r WHERE s = coalesce(a.severity,'adequate')) AS worse FROM a FULL JOIN b USING (entity)""")
def coverage_drift(t: Tables) -> DataFrame:
    a, b = (coverage.audit(_registry(t), _mentions(t, q), OWN, OTHERS) for q in (45, 47))
    return drift.severity_drift(a, b)


@query("keyword_count_audit", f"SELECT p_partkey AS entity, count(l_partkey) AS mentions, count(l_partkey) >= 5 AS covered FROM part LEFT JOIN ({_mention_sql(47)}) ON l_partkey = p_partkey GROUP BY p_partkey")
def keyword_count_audit(t: Tables) -> DataFrame:
    return coverage.keyword_count(_registry(t), _mentions(t, 47))


# ---------------------------------------------------------------- text functions on documents

_TOK = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')"


@query("numeric_spans", """WITH m AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*') AS v, regexp_split_to_array(text, '[0-9]+(?:[.,][0-9]+)*') AS p FROM documents WHERE text IS NOT NULL),
 u AS (SELECT doc_id, v, p, unnest(range(1, len(v) + 1)) AS i FROM m)
 SELECT doc_id, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))),0) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))),0) AS INTEGER) AS start, v[i] AS value FROM u""")
def numeric_spans(t: Tables) -> DataFrame:
    spans = T.finditer(F.col("text"), r"[0-9]+(?:[.,][0-9]+)*")
    return t.documents.select("doc_id", F.explode(spans).alias("m")).select("doc_id", "m.start", "m.value")


@query("doc_frequency", f"SELECT tok AS token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOK}) AS tok FROM documents) GROUP BY tok")
def doc_frequency(t: Tables) -> DataFrame:
    from tallyspark.operators import retrieval

    return retrieval.doc_frequency(t.documents.select(F.col("doc_id").alias("id"), "text"))


@query("probe_queries", f"""WITH tk AS (SELECT DISTINCT doc_id, unnest({_TOK}) AS tok FROM documents), d AS (SELECT tok, count(*) AS df FROM tk GROUP BY tok),
 r AS (SELECT doc_id, tok, row_number() OVER (PARTITION BY doc_id ORDER BY df, tok) AS rn FROM tk JOIN d USING (tok))
 SELECT doc_id AS id, string_agg(tok, ' ' ORDER BY rn) AS query FROM r WHERE rn <= 3 GROUP BY doc_id""")
def probe_queries(t: Tables) -> DataFrame:
    from tallyspark.operators import retrieval

    return retrieval.mine_probes(t.documents.select(F.col("doc_id").alias("id"), "text"))


_TURNS = """WITH p AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS reply FROM conversations),
 x AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(reply), '\\s+'), lambda x: x <> '')) AS b, reply FROM p WHERE reply IS NOT NULL AND text IS NOT NULL)"""


def _turns(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return t.conversations.withColumn("reply", F.lead("text").over(w)).where("reply is not null and text is not null")


@query("jaccard_similarity", f"{_TURNS} SELECT conv_id, turn, CAST(CASE WHEN len(a)=0 AND len(b)=0 THEN 1.0 WHEN len(a)=0 OR len(b)=0 THEN 0.0 ELSE len(list_intersect(a,b)) / len(list_distinct(list_concat(a,b))) END AS DOUBLE) AS similarity FROM x")
def jaccard_similarity(t: Tables) -> DataFrame:
    return _turns(t).select("conv_id", "turn", T.jaccard(F.col("text"), F.col("reply")).alias("similarity"))


@query("answer_support", f"{_TURNS} SELECT conv_id, turn, length(reply) > 0 AND upper(trim(reply)) <> 'IDK' AND len(list_filter(b, lambda t: NOT list_contains(a, t))) = 0 AS supported FROM x")
def answer_support(t: Tables) -> DataFrame:
    from tallyspark.operators import forensics

    return _turns(t).select("conv_id", "turn", forensics.supported(F.col("reply"), T.tokens(F.col("text"))).alias("supported"))


_NORM = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query("normalized_text", f"SELECT doc_id, md5({_NORM}) AS normalized_md5, left({_NORM}, 60) AS preview FROM documents WHERE text IS NOT NULL")
def normalized_text(t: Tables) -> DataFrame:
    n = T.normalize(F.col("text"))
    return t.documents.where("text is not null").select("doc_id", F.md5(n).alias("normalized_md5"), F.left(n, F.lit(60)).alias("preview"))


@query("canonicalize", "SELECT doc_id, md5(replace(replace(translate(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '01|5', 'olls'), 'ﬁ', 'fi'), 'ﬂ', 'fl')) AS canonical_md5 FROM documents WHERE text IS NOT NULL")
def canonicalize(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.md5(T.canonicalize(F.col("text"))).alias("canonical_md5"))


# ---------------------------------------------------------------- provenance: a quotation of each document, sought in two versions of it

_CANON = "replace(replace(translate(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), '01|5', 'olls'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
_NEW = "CASE doc_id % 6 WHEN 0 THEN 'Header. ' || text WHEN 1 THEN 'Gone.' ELSE text END"
_COUNT = "CASE WHEN length(q) = 0 THEN 0 ELSE (length({0}) - length(replace({0}, q, ''))) // length(q) END"
_FOUND = f"""WITH d AS (SELECT doc_id, {_CANON.format('replace(substring(text, 11, 40), chr(32), chr(32) || chr(32))')} AS q, {_CANON.format('text')} AS o, {_CANON.format(_NEW)} AS n FROM documents WHERE text IS NOT NULL),
 f AS (SELECT doc_id AS cite_id, {_COUNT.format('o')} AS a, {_COUNT.format('n')} AS b, strpos(o, q) AS pa, strpos(n, q) AS pb FROM d)"""


def _source(t: Tables, text: F.Column) -> DataFrame:
    return t.documents.where("text is not null").select(F.col("doc_id").alias("source_id"), text.alias("source"))


def _versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    cites = t.documents.where("text is not null").select(F.col("doc_id").alias("source_id"), F.col("doc_id").alias("cite_id"), F.replace(F.substring("text", 11, 40), F.lit(" "), F.lit("  ")).alias("quote"))
    new = F.when(F.expr("doc_id % 6 = 0"), F.concat(F.lit("Header. "), "text")).when(F.expr("doc_id % 6 = 1"), F.lit("Gone.")).otherwise(F.col("text"))
    return provenance.manifest(_source(t, F.col("text")), cites), provenance.manifest(_source(t, new), cites)


@query("provenance_manifest", f"{_FOUND} SELECT cite_id, CASE WHEN a = 0 THEN 'UNRESOLVED' WHEN a > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status FROM f")
def provenance_manifest(t: Tables) -> DataFrame:
    return _versions(t)[0].select("cite_id", "status")


@query("coverage_diff", f"""{_FOUND} SELECT cite_id, CASE WHEN a > 1 OR b > 1 THEN 'AMBIGUOUS' WHEN a = 1 AND b = 0 THEN 'LOST' WHEN a = 0 AND b = 1 THEN 'GAINED' WHEN a = 1 AND pa <> pb THEN 'DRIFTED' ELSE 'STABLE' END AS change,
 CAST(CASE WHEN a = 1 AND b = 1 AND pa <> pb THEN pb - pa END AS INTEGER) AS delta FROM f""")
def coverage_diff(t: Tables) -> DataFrame:
    return provenance.diff(*_versions(t)).select("cite_id", "change", "delta")
