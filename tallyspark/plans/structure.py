"""Queries: conservation, legibility, text quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.functions import vec
from tallyspark.operators import conservation, drift, legibility, text_quality

from .registry import Tables, query

# ---------------------------------------------------------------- a markdown page for each nation, from its suppliers

_ROW = "concat('| ', s_suppkey, ' | ', s_name, ' | ', CAST(CAST(floor(s_acctbal) AS BIGINT) AS {str}), ' |')"


def _pages(t: Tables) -> DataFrame:
    rows = t.supplier.groupBy(F.col("s_nationkey").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", F.expr(_ROW.format(str="string")).alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    both = t.nation.join(rows, F.col("n_nationkey") == F.col("n"), "left")
    md = F.concat(
        F.lit("# Nation "), "n_name", F.lit("\n\n| key | name | balance |\n|---|---|---|\n"), F.coalesce("rows", F.lit("| 0 | none | 0 |")), F.lit("\n\n- region number "), F.col("n_regionkey").cast("string"), F.lit("\n- see [the list](http://x.test/"), F.col("n_nationkey").cast("string"), F.lit(")\n\n```\ncode 42\n```\n\nTail 3.14 of "), "n_name"
    )
    return both.select(F.col("n_nationkey").cast("bigint").alias("doc_id"), md.alias("source"))


def _chunks(t: Tables) -> DataFrame:
    return conservation.blocks(_pages(t)).where("(doc_id + pos) % 7 <> 3")


_PAGE = f"""page AS (SELECT CAST(n_nationkey AS BIGINT) AS doc_id, '# Nation ' || n_name || chr(10) || chr(10) || '| key | name | balance |' || chr(10) || '|---|---|---|' || chr(10) || coalesce(r, '| 0 | none | 0 |') || chr(10) || chr(10) || '- region number ' || n_regionkey || chr(10) || '- see [the list](http://x.test/' || n_nationkey || ')' || chr(10) || chr(10) || '```' || chr(10) || 'code 42' || chr(10) || '```' || chr(10) || chr(10) || 'Tail 3.14 of ' || n_name AS source
  FROM nation LEFT JOIN (SELECT s_nationkey, string_agg({_ROW.format(str="VARCHAR")}, chr(10) ORDER BY s_suppkey) AS r FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey)"""
_MD = f"""WITH {_PAGE}, ln AS (SELECT doc_id, unnest(string_split(source, chr(10))) AS t, generate_subscripts(string_split(source, chr(10)), 1) AS i FROM page),
 f AS (SELECT *, regexp_matches(ltrim(t), '^(```|~~~)') AS fence FROM ln), g AS (SELECT *, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS nf, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS total FROM f),
 c AS (SELECT *, (fence OR nf % 2 = 1) AND ceil(nf / 2.0) * 2 <= total AS code, ceil(nf / 2.0) AS block FROM g), p AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM c WHERE NOT code AND contains(t, '|')),
 tab AS (SELECT doc_id, island, string_agg(t, chr(10) ORDER BY i) AS text FROM p GROUP BY 1, 2 HAVING count(*) >= 2 AND bool_or(regexp_matches(t, '^\\s*\\|?[\\s:|-]*-[\\s:|-]*\\|?\\s*$')))"""


@query("markdown_elements", f"""{_MD}, e AS (SELECT 'tables' AS type, count(*) AS n FROM tab UNION ALL SELECT 'code_blocks', count(DISTINCT (doc_id, block)) FROM c WHERE code
  UNION ALL SELECT 'headings', count(*) FROM c WHERE NOT code AND starts_with(ltrim(t), '#') UNION ALL SELECT 'list_items', count(*) FROM c WHERE NOT code AND NOT starts_with(ltrim(t), '#') AND regexp_matches(t, '^\\s*(?:[-*+]|[0-9]+\\.)\\s+\\S')
  UNION ALL SELECT 'links', sum(len(regexp_extract_all(t, '\\[[^\\]]+\\]\\([^)]+\\)'))) FROM c WHERE NOT code UNION ALL SELECT 'numeric_spans', sum(len(regexp_extract_all(t, '[0-9]+(?:[.,][0-9]+)*'))) FROM c WHERE NOT code)
 SELECT type, CAST(n AS BIGINT) AS n FROM e WHERE n > 0""")
def markdown_elements(t: Tables) -> DataFrame:
    return conservation.elements(_pages(t)).groupBy("type").agg(F.count("*").alias("n"))


@query("conservation_manifest")
def conservation_manifest(t: Tables) -> DataFrame:
    return conservation.manifest(_pages(t), _chunks(t))


@query("conservation_per_type")
def conservation_per_type(t: Tables) -> DataFrame:
    return conservation.per_type(conservation.manifest(_pages(t), _chunks(t)), _pages(t))


_TABLES_KEPT = _MD + """, blk AS (SELECT doc_id, b, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS pos FROM (SELECT doc_id, unnest(string_split(source, chr(10) || chr(10))) AS b, generate_subscripts(string_split(source, chr(10) || chr(10)), 1) AS j FROM page) WHERE trim(regexp_replace(b, '\\s+', ' ', 'g')) <> ''),
 kept AS (SELECT doc_id, string_agg(lower(trim(regexp_replace(b, '\\s+', ' ', 'g'))), chr(1) ORDER BY pos) AS h FROM blk WHERE (doc_id + pos) % 7 <> 3 GROUP BY 1),
 n AS (SELECT tab.doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS s, coalesce(h, '') AS h FROM tab LEFT JOIN kept USING (doc_id)),
 sh AS (SELECT doc_id, h, list_distinct(list_transform(range(1, greatest(length(s) - 10, 2)), lambda i: substring(s, i, 12))) AS g FROM n),
 r AS (SELECT page.doc_id, count(sh.doc_id) AS total, CASE WHEN count(sh.doc_id) = 0 THEN 1.0 ELSE round(count(*) FILTER (len(list_filter(g, lambda x: contains(h, x))) / len(g) >= 0.85) / count(sh.doc_id), 6) END AS ratio FROM page LEFT JOIN sh USING (doc_id) GROUP BY 1)"""


@query("conservation_tables", f"{_TABLES_KEPT} SELECT doc_id, total, CAST(ratio AS DOUBLE) AS ratio FROM r")
def conservation_tables(t: Tables) -> DataFrame:
    got = conservation_per_type(t).where("type = 'tables'")
    return got.select("doc_id", "total", "ratio")


@query("conservation_drift", f"{_TABLES_KEPT} SELECT doc_id, CAST(1.0 AS DOUBLE) AS previous, CAST(ratio AS DOUBLE) AS current, ratio < 1 AS regressed FROM r")
def conservation_drift(t: Tables) -> DataFrame:
    pages = _pages(t)
    whole = conservation.per_type(conservation.manifest(pages, conservation.blocks(pages)), pages)
    return drift.ratio_drift(whole, conservation_per_type(t), ["doc_id", "type"]).where("type = 'tables'").drop("type")


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL"
_WORDS = "unnest(regexp_extract_all(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), '[\\p{{L}}\\p{{N}}_]+'))"


def _doc_lines(t: Tables) -> tuple[DataFrame, DataFrame]:
    src = t.documents.where("text is not null").select("doc_id", F.col("text").alias("source"))
    kept = src.select("doc_id", F.posexplode(F.split("source", "\n", -1)).alias("pos", "chunk")).where("pos % 5 <> 2")
    return src, kept


@query("token_recall", f"""WITH a AS (SELECT doc_id, tok, count(*) AS n FROM (SELECT doc_id, {_WORDS.format('text')} AS tok FROM documents) GROUP BY 1,2), b AS (SELECT doc_id, tok, count(*) AS m FROM (SELECT doc_id, {_WORDS.format('l')} AS tok FROM ({_LINES}) WHERE pos % 5 <> 2) GROUP BY 1,2),
 r AS (SELECT doc_id, sum(least(n, coalesce(m, 0))) / sum(n) AS recall FROM a LEFT JOIN b USING (doc_id, tok) GROUP BY doc_id) SELECT d.doc_id, round(coalesce(recall, 1.0), 9) AS recall FROM documents d LEFT JOIN r USING (doc_id) WHERE d.text IS NOT NULL""")
def token_recall(t: Tables) -> DataFrame:
    return conservation.token_recall(*_doc_lines(t)).select("doc_id", F.round("recall", 9).alias("recall"))


_NRM = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"


_ALNUM = "regexp_matches({0}, '[\\p{{L}}\\p{{N}}]')"
_BOUND = f"(NOT {_ALNUM.format('left(a.s, 1)')} OR i = 1 OR NOT {_ALNUM.format('substring(b.s, i - 1, 1)')}) AND (NOT {_ALNUM.format('right(a.s, 1)')} OR NOT {_ALNUM.format('substring(b.s, i + length(a.s), 1)')})"


@query("shingle_coverage", f"""WITH s AS (SELECT doc_id, pos, {_NRM.format('l')} AS s FROM ({_LINES})),
 g AS (SELECT doc_id, pos, unnest(list_distinct(list_transform(range(1, length(s) - 10), lambda i: substring(s, i, 12)))) AS sh FROM s WHERE length(s) >= 12),
 k AS (SELECT doc_id, sh, count(*) AS n FROM g GROUP BY 1, 2),
 short AS (SELECT a.doc_id, a.pos, coalesce(bool_or(len(list_filter(range(1, length(b.s) - length(a.s) + 2), lambda i: substring(b.s, i, length(a.s)) = a.s AND {_BOUND})) > 0), false) AS hit
  FROM s a LEFT JOIN s b ON a.doc_id = b.doc_id AND a.pos <> b.pos AND contains(b.s, a.s) WHERE length(a.s) BETWEEN 1 AND 11 GROUP BY 1, 2)
 SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END), 9) AS coverage FROM g JOIN k USING (doc_id, sh) GROUP BY 1, 2
 UNION ALL SELECT doc_id, CAST(pos AS INTEGER), CASE WHEN hit THEN 1.0 ELSE 0.0 END FROM short UNION ALL SELECT doc_id, CAST(pos AS INTEGER), 1.0 FROM s WHERE s = ''""")
def shingle_coverage(t: Tables) -> DataFrame:
    """(doc_id, pos, coverage): the share of each line's shingles that other lines of its document have."""
    docs = t.documents.where("text is not null").select("doc_id", F.transform(F.split("text", "\n", -1), T.normalize).alias("ls"))
    k = T.GLOBAL_SHINGLE

    def covered(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for doc, ls in zip(batch["doc_id"], batch["ls"].to_pylist(), strict=True):
                grams = {i: {s[j : j + k] for j in range(len(s) - k + 1)} for i, s in enumerate(ls) if len(s) >= k}
                seen, again = set(), set()  # a shingle of full length has no line feed, so it is in the other lines together if it is in one of them
                for g in grams.values():
                    again |= g & seen
                    seen |= g
                out += [(doc.as_py(), i, len(g & again) / len(g)) for i, g in grams.items()]
            ids, pos, share = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch["doc_id"].type), pa.array(pos, pa.int32()), pa.array(share, pa.float64())], ["doc_id", "pos", "coverage"])

    long = docs.mapInArrow(covered, f"doc_id {dict(docs.dtypes)['doc_id']}, pos int, coverage double")
    few = docs.select("doc_id", "ls", F.explode(F.filter(F.transform("ls", lambda s, i: F.struct(i.alias("pos"), s.alias("s"))), lambda x: F.length(x["s"]) < k)).alias("x"))
    rest = F.concat(F.slice("ls", F.lit(1), F.col("x.pos")), F.slice("ls", F.col("x.pos") + 2, F.size("ls")))
    short = few.select("doc_id", F.col("x.pos").alias("pos"), T.coverage(T.shingles(F.col("x.s")), F.array_join(rest, "\n")).alias("coverage"))
    return long.unionByName(short).select("doc_id", "pos", F.round("coverage", 9).alias("coverage"))


# ---------------------------------------------------------------- legibility

_ORDER = """WITH l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS line, l, count(*) OVER (PARTITION BY doc_id) AS n FROM ({lines}) WHERE trim(regexp_replace(l, '\\s+', ' ', 'g')) <> ''),
 v AS (SELECT doc_id, line, n, bucket, sum(sign) AS w FROM (SELECT doc_id, line, n, CAST(('0x' || md5(tok)[1:2]) AS INTEGER) AS bucket, CASE WHEN CAST(('0x' || md5(tok)[3:3]) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM (SELECT doc_id, line, n, unnest(regexp_extract_all(lower(l), '[a-z0-9]+')) AS tok FROM l)) GROUP BY 1,2,3,4 HAVING sum(sign) <> 0),
 m AS (SELECT doc_id, line, sum(w*w) AS nn FROM v GROUP BY 1,2),
 c AS (SELECT k, a.doc_id, a.line, sum(a.w*b.w) / sqrt(CAST(any_value(ma.nn) AS DOUBLE) * CAST(any_value(mb.nn) AS DOUBLE)) AS c FROM (VALUES (1),(2)) t(k), v a JOIN v b ON a.doc_id=b.doc_id AND a.bucket=b.bucket JOIN m ma ON ma.doc_id=a.doc_id AND ma.line=a.line JOIN m mb ON mb.doc_id=b.doc_id AND mb.line=b.line WHERE b.line = a.line + k GROUP BY 1,2,3),
 s AS (SELECT doc_id, sum(c) FILTER (k=1) AS s1, sum(c) FILTER (k=2) AS s2 FROM c GROUP BY 1),
 x AS (SELECT doc_id, max(n) AS n FROM l GROUP BY 1 HAVING max(n) >= 4)
 SELECT doc_id, round(coalesce(s1,0)/(n-1) - coalesce(s2,0)/(n-2), 6) AS margin FROM x LEFT JOIN s USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM v)"""


@query("reading_order", _ORDER.format(lines=_LINES))
def reading_order(t: Tables) -> DataFrame:
    judged = legibility.order_margins(t.documents.select("doc_id", T.lines(F.col("text")).alias("lines")), vec.md5_slots)
    return judged.where("margin is not null").select("doc_id", F.round("margin", 6).alias("margin"))


def _order_tables(t: Tables, collapse: bool) -> DataFrame:
    """A plain-text table of each order's lines, aligned or with its gaps collapsed."""
    pad = lambda c, n: F.rpad(F.col(c).cast("bigint").cast("string"), n, " ")
    row = F.concat(F.rpad(F.concat(F.lit("item"), F.col("l_linenumber").cast("string")), 10, " "), pad("l_partkey", 12), pad("l_quantity", 10), F.col("l_suppkey").cast("string"))
    row = T.collapse_gaps(row) if collapse else row
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r")))), lambda x: x["r"]), "\n").alias("text"), F.count("*").alias("n"))
    return rows.select(F.col("l_orderkey").alias("id"), "text", "n")


_CELL_LINE = "rpad('item' || l_linenumber, 10, ' ') || rpad(CAST(l_partkey AS VARCHAR), 12, ' ') || rpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 10, ' ') || l_suppkey"
# A cell starts at a character that follows two spaces or nothing.
_TABLES = """WITH line AS (SELECT l_orderkey AS id, {0} AS s FROM lineitem),
 t AS (SELECT id, s, list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '') AS w, list_filter(range(1, length(s) + 1), lambda i: substring(s, i, 1) <> ' ' AND (i = 1 OR i > 2 AND substring(s, i - 2, 2) = '  ')) AS st FROM line),
 o AS (SELECT id, count(*) AS n, median(len(w)) AS mid, avg(CASE WHEN length(s) < 60 THEN 1 ELSE 0 END) AS brief, sum(len(list_filter(w, lambda x: regexp_matches(x, '[0-9]')))) / sum(len(w)) AS digits, avg(CASE WHEN len(st) >= 2 THEN 1 ELSE 0 END) AS celled, count(*) FILTER (len(st) >= 2) AS rows, median(len(st)) FILTER (len(st) >= 2) AS cols FROM t GROUP BY id),
 m AS (SELECT id, max(c) AS top FROM (SELECT id, len(w), count(*) AS c FROM t GROUP BY 1, 2) GROUP BY id), mc AS (SELECT id, max(c) AS top_cells FROM (SELECT id, len(st), count(*) AS c FROM t WHERE len(st) >= 2 GROUP BY 1, 2) GROUP BY id),
 al AS (SELECT id, count(*) FILTER (c >= 0.6 * rows) AS hits FROM (SELECT id, x, count(*) AS c FROM (SELECT id, unnest(list_distinct(st)) AS x FROM t WHERE len(st) >= 2) GROUP BY 1, 2) JOIN o USING (id) GROUP BY id),
 a AS (SELECT o.id, o.n, o.n >= 3 AND mid >= 3 AND brief >= 0.6 AND digits >= 0.15 AND top / o.n >= 0.6 AS applicable, 0.5 * celled + 0.3 * coalesce(top_cells / rows, 0) + 0.2 * CASE WHEN rows < 2 THEN 0 ELSE least(1, hits / cols) END AS raw FROM o JOIN m USING (id) LEFT JOIN mc USING (id) LEFT JOIN al USING (id))"""
_SCORES = " SELECT id, applicable, CASE WHEN applicable THEN CAST(round(raw, 9) AS DOUBLE) ELSE 1.0 END AS score FROM a"
_COLLAPSED = _TABLES.format(f"trim(regexp_replace({_CELL_LINE}, ' {{2,}}', ' ', 'g'))")


@query("table_score", _TABLES.format(_CELL_LINE) + _SCORES)
def table_score(t: Tables) -> DataFrame:
    x = _order_tables(t, False).select("id", T.lines(F.col("text")).alias("ls"))
    ok = legibility.looks_tabular(F.col("ls"))
    return x.select("id", ok.alias("applicable"), F.when(ok, F.round(legibility.table_score(F.col("ls")), 9)).otherwise(1.0).alias("score"))


@query("collapsed_tables", _COLLAPSED + _SCORES)
def collapsed_tables(t: Tables) -> DataFrame:
    x = _order_tables(t, True).select("id", T.lines(F.col("text")).alias("ls"))
    ok = legibility.looks_tabular(F.col("ls"))
    return x.select("id", ok.alias("applicable"), F.when(ok, F.round(legibility.table_score(F.col("ls")), 9)).otherwise(1.0).alias("score"))


@query("legibility_gate", _COLLAPSED + " SELECT id, NOT (applicable AND raw < 0.5) AS legible, CASE WHEN applicable AND raw < 0.5 THEN 'collapsed table structure' ELSE '' END AS reasons FROM a")
def legibility_gate(t: Tables) -> DataFrame:
    got = legibility.score(_order_tables(t, True).select("id", "text"), vec.md5_slots)
    return got.select("id", "legible", F.array_join("reasons", ",").alias("reasons"))


# ---------------------------------------------------------------- perplexity and heuristics

_GRAMS = "SELECT doc_id, g[1:2] AS ctx, g[3:3] AS nxt, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3))) AS g FROM (SELECT doc_id, '  ' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) || ' ' AS s FROM documents WHERE text IS NOT NULL)) GROUP BY 1,2,3"


@query("trigram_perplexity", f"WITH g AS ({_GRAMS}), m AS (SELECT ctx, nxt, sum(n) AS c FROM g GROUP BY 1,2), x AS (SELECT ctx, sum(c) AS tot FROM m GROUP BY 1), v AS (SELECT count(DISTINCT nxt) AS v FROM m) SELECT doc_id, round(sum(n * -ln((c + 1) / (tot + v))) / sum(n), 6) AS ppl FROM g JOIN m USING (ctx, nxt) JOIN x USING (ctx) CROSS JOIN v GROUP BY doc_id")
def trigram_perplexity(t: Tables) -> DataFrame:
    grams = text_quality.trigrams(t.documents.select(F.col("doc_id").alias("id"), "text"))
    return text_quality.perplexity(grams, text_quality.train(grams)).select(F.col("id").alias("doc_id"), F.round("ppl", 6).alias("ppl"))


_STOP = "[" + ",".join(f"'{w}'" for w in text_quality.STOPWORDS) + "]"


@query("text_quality", f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w, regexp_extract_all(lower(text), '[A-Za-z'']+') AS s, regexp_replace(text, '\\s', '', 'g') AS solid, len(regexp_extract_all(text, '[#.]')) AS sym FROM documents WHERE text IS NOT NULL)
 SELECT doc_id, round(CASE WHEN len(w)=0 THEN 0.0 ELSE sym/len(w) END, 9) AS symbol_ratio, round(CASE WHEN length(solid)=0 THEN 1.0 ELSE length(regexp_replace(solid, '[A-Za-z0-9]', '', 'g'))/length(solid) END, 9) AS non_alnum,
 round(CASE WHEN len(w)=0 THEN 0.0 ELSE length(array_to_string(w, ''))/len(w) END, 9) AS mean_word, round(CASE WHEN len(s)=0 THEN 0.0 ELSE len(list_filter(s, lambda x: list_contains({_STOP}, x)))/len(s) END, 9) AS stopword_ratio FROM w""")
def text_quality_features(t: Tables) -> DataFrame:
    f = text_quality.features(F.col("text"))
    return t.documents.where("text is not null").select("doc_id", *[F.round(c, 9).alias(n) for n, c in f.items()])
