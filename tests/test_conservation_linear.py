"""Conservation in one pass over a document: long tables, many short elements, and the rules of the plain definition."""

import random
import re
import time
from collections import Counter

import pytest

from tallyspark.functions import text as T
from tallyspark.operators import conservation
from tallyspark.plans import catalog

SCHEMAS = "doc_id bigint, source string", "doc_id bigint, pos int, chunk string"


def ledger(spark, source, chunks, **more):
    src = spark.createDataFrame([(1, source)], SCHEMAS[0])
    held = spark.createDataFrame([(1, i, c) for i, c in enumerate(chunks)], SCHEMAS[1])
    return [tuple(r)[1:] for r in conservation.manifest(src, held, **more).orderBy("byte_start", "type").collect()]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Nations with 2,000 suppliers each."""
    at = str(tmp_path_factory.mktemp("many"))
    spark.createDataFrame([(n, f"NATION {n}", n % 2) for n in range(4)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{at}/nation.parquet")
    suppliers = spark.range(8000).selectExpr("id as s_suppkey", "concat('Supplier#', lpad(id, 9, '0')) as s_name", "int(id % 4) as s_nationkey", "double(id * 37 % 9999) + 0.5 as s_acctbal")
    suppliers.write.parquet(f"{at}/supplier.parquet")
    return at


def in_time(spark, name, folder, most=60):
    """The rows of a query that took minutes before: each element was searched in its whole document."""
    began = time.time()
    got = catalog.QUERIES[name](spark, folder).collect()
    assert time.time() - began < most
    return got


def test_drift_of_long_pages(spark, folder):
    got = {r.doc_id: (r.previous, r.current, r.regressed) for r in in_time(spark, "conservation_drift", folder)}
    assert got == {n: (1.0, 0.0, True) if n == 2 else (1.0, 1.0, False) for n in range(4)}  # (doc_id + 1) % 7 = 3


def test_manifest_of_long_pages(spark, folder):
    got = in_time(spark, "conservation_manifest", folder)
    count = Counter(r.type for r in got)
    assert count == {"tables": 4, "code_blocks": 4, "headings": 4, "list_items": 8, "links": 4, "numeric_spans": 4 * (3 * 2000 + 5)}
    lost = {(r.doc_id, r.type) for r in got if r.status == "dropped" and r.type != "numeric_spans"}
    assert lost == {(0, "code_blocks"), (1, "list_items"), (1, "links"), (2, "tables"), (3, "headings")}
    assert all(r.status == "conserved" and r.chunk_hits == [1] for r in got if r.type == "tables" and r.doc_id != 2)


def test_ratios_of_long_pages(spark, folder):
    got = {(r.doc_id, r.type): (r.total, r.ratio) for r in in_time(spark, "conservation_per_type", folder)}
    assert len(got) == 4 * len(conservation.TYPES)
    assert {k for k, (_, ratio) in got.items() if ratio == 0} == {(0, "code_blocks"), (1, "list_items"), (1, "links"), (2, "tables"), (3, "headings")}
    assert [got[n, "numeric_spans"][0] for n in range(4)] == [6005] * 4 and got[0, "numeric_spans"][1] == 1.0 > got[2, "numeric_spans"][1]


def test_a_short_element_grows_over_its_own_line_only(spark):
    got = ledger(spark, "Total abc\n42 items, x7y9 and é5\n- a", ["42 items, x7y9 and é5", "- a"])
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [("numeric_spans", 10, 12, "conserved"), ("numeric_spans", 21, 22, "conserved"), ("numeric_spans", 23, 24, "conserved"), ("numeric_spans", 31, 32, "conserved"), ("list_items", 33, 36, "conserved")]


def test_links_equal_their_pattern():
    pattern, rng = re.compile(r"\[[^\]]+\]\([^)]+\)"), random.Random(7)
    for _ in range(20_000):
        s = "".join(rng.choice("[]()a\n") for _ in range(rng.randrange(14)))
        assert list(conservation._links(s)) == [m.span() for m in pattern.finditer(s)], s
    assert list(conservation._links("[" * 300_000)) == []


@pytest.mark.parametrize("k", [5, 12, 15])
def test_verdicts_equal_the_plain_definition(k):
    """Each shingle of each element searched in each chunk, one by one."""
    rng = random.Random(k)
    bits = ["12", "512", "3.14", "x", "é9", "word", "# a", "- b", "|", "|---|", "```", "[l](u)", "1,5", "Long Heading text", "\n", "\n\n", " ", "ß", "日本"]

    def member(s, text):
        if len(s) >= T.GLOBAL_SHINGLE:
            return s in text
        return any(text.startswith(s, i) and not (s[0].isalnum() and text[max(i - 1, 0) : i].isalnum()) and not (s[-1].isalnum() and text[i + len(s) : i + len(s) + 1].isalnum()) for i in range(len(text)))

    seen = 0
    for _ in range(300):
        source = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        chunks = [rng.choice([source[i : i + 25], source[i:], None]) for i in sorted(rng.randrange(len(source) + 1) for _ in range(4))]
        texts = [None if c is None else conservation._normalized(c) for c in chunks]
        for start, stop, _, raw, hits, normal in conservation._judged(source, chunks, k):
            a, b = start, stop
            while len(normal) < k and a > 0 and source[a - 1].isalnum():
                a -= 1
            while len(normal) < k and b < len(source) and source[b].isalnum():
                b += 1
            text = conservation._normalized(source[a:b])
            grams = {text[i : i + k] for i in range(max(1, len(text) - k + 1))}
            shares = [sum(c is not None and member(g, c) for g in grams) / len(grams) for c in texts]
            assert raw == sum(any(c is not None and member(g, c) for c in texts) for g in grams) / len(grams)
            assert hits == [i for i, x in enumerate(shares) if x >= conservation.DUPLICATE_TAU]
            seen += 1
    assert seen > 1000
