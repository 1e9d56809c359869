"""DuckDB twins of the operators that SQL can express: plain definitions, without hashes, bands or automata."""

from __future__ import annotations

from .license_scan import CONTAINMENT, SHINGLE, TEMPLATES
from .ngram_join import SIMILARITY
from .ngram_join import WORDS as NGRAM
from .substring_dedup import WINDOW

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every pair of different shingle sets that have a shingle in common is counted; links spread by recursion.
NGRAM_JOIN = f"""
WITH RECURSIVE doc AS (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents
), gram AS (
    SELECT DISTINCT r, array_to_string(w[i : i + {NGRAM - 1}], ' ') AS g
    FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {NGRAM - 1}, 1) + 1)) AS i FROM doc WHERE len(w) > 0)
), text_set AS (
    SELECT r, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS s FROM gram GROUP BY r
), node AS (
    SELECT s, min(r) AS rep, count(*) AS copies, min(n) AS n FROM text_set GROUP BY s
), own AS (
    SELECT node.s, node.n, gram.g FROM node JOIN gram ON gram.r = node.rep
), pair AS (
    SELECT a.s AS a, b.s AS b FROM own a JOIN own b ON a.g = b.g AND a.s <> b.s
    GROUP BY a.s, b.s, a.n, b.n HAVING count(*) >= {SIMILARITY} * (a.n + b.n - count(*)) - 1e-9
), reach AS (
    SELECT s AS a, s AS b FROM node
    UNION
    SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a
), class AS (
    SELECT reach.a AS s, min(doc.doc_id) AS class_id
    FROM reach JOIN text_set ON text_set.s = reach.b JOIN doc ON doc.r = text_set.r GROUP BY reach.a
), linked AS (
    SELECT pair.a AS s, sum(node.copies) AS links FROM pair JOIN node ON node.s = pair.b GROUP BY pair.a
)
SELECT doc.doc_id, CASE WHEN text_set.s IS NULL THEN doc.doc_id ELSE class.class_id END AS class_id,
       CAST(coalesce(node.copies - 1, 0) + coalesce(linked.links, 0) AS BIGINT) AS n_links,
       CAST(coalesce(text_set.n, 0) AS BIGINT) AS n_shingles
FROM doc LEFT JOIN text_set ON text_set.r = doc.r LEFT JOIN node ON node.s = text_set.s
LEFT JOIN class ON class.s = text_set.s LEFT JOIN linked ON linked.s = text_set.s
"""

DECONTAMINATION = f"""
WITH item AS (
    SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark
), win AS (
    SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS words
    FROM (SELECT item, w, least(len(w), 13) AS k, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), doc AS (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents
), place AS (
    SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS words
    FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)
), found AS (
    SELECT place.r, place.k, place.i, win.item FROM place JOIN win ON win.k = place.k AND win.words = place.words
), hit AS (
    SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS pos FROM found) GROUP BY r
), items AS (
    SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc.doc_id, CAST(len(doc.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.names, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AND 20 * coalesce(hit.n_hit, 0) >= len(doc.w) AS contaminated
FROM doc LEFT JOIN hit ON hit.r = doc.r LEFT JOIN items ON items.r = doc.r
"""

SUBSTRING_DEDUP = rf"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
    SELECT doc_id, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM doc WHERE len(w) >= {WINDOW})
), later AS (
    SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1
), word AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM doc WHERE len(w) > 0
), cut AS (
    SELECT word.doc_id, j, word, coalesce(max(later.i) OVER (PARTITION BY word.doc_id ORDER BY j ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), 0) > 0 AS gone
    FROM word LEFT JOIN later ON later.doc_id = word.doc_id AND later.i = word.j
), made AS (
    SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM cut GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(doc.w) AS BIGINT) AS n_words, CAST(coalesce(made.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(made.kept, '')) AS kept_sha256
FROM doc LEFT JOIN made ON made.doc_id = doc.doc_id
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _grams(source: str, key: str) -> str:
    words = "regexp_extract_all(lower(coalesce(t, '')), '[\\p{L}\\p{N}]+')"
    return f"SELECT DISTINCT {key}, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM (SELECT {key}, {words} AS w FROM {source}) WHERE len(w) > 0)"


#: Containment in the whole text; the operator asks for it around a window, which is the same unless a notice lies scattered.
LICENSE_SCAN = f"""
WITH template AS (
    SELECT * FROM (VALUES {', '.join(f'({k}, {_quoted(name)}, {_quoted(text)})' for k, (name, text) in enumerate(TEMPLATES))}) AS v(k, license, t)
), doc AS (
    SELECT row_number() OVER () AS r, doc_id, text AS t FROM documents
), want AS (
    {_grams('template', 'k, license')}
), have AS (
    {_grams('doc', 'r')}
), share AS (
    SELECT have.r, want.k, want.license, count(*) / any_value(total.n) AS containment
    FROM want JOIN have ON have.g = want.g JOIN (SELECT k, count(*) AS n FROM want GROUP BY k) total ON total.k = want.k
    GROUP BY have.r, want.k, want.license HAVING count(*) / any_value(total.n) >= {CONTAINMENT}
), best AS (
    SELECT r, array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses, count(*) AS n, max(containment) AS containment FROM share GROUP BY r
)
SELECT doc.doc_id, coalesce(best.licenses, '') AS licenses, CAST(coalesce(best.n, 0) AS BIGINT) AS n_templates, coalesce(best.containment, 0.0) AS containment
FROM doc LEFT JOIN best ON best.r = doc.r
"""

ORACLES: dict[str, str] = {
    "op2_ngram_join": NGRAM_JOIN,
    "op7_decontamination": DECONTAMINATION,
    "op9_substring_dedup": SUBSTRING_DEDUP,
    "op10_license_scan": LICENSE_SCAN,
}
