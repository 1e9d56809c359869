"""Packing: the encoder equals ``tokenizers`` on every document, ranks split equal rows, and odd inputs."""

from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import packing
from tallyspark.llm.queries import tokenizer_path


@pytest.mark.parametrize("table,column", [("documents", "text"), ("pages", "html"), ("conversations", "text"), ("benchmark", "text")])
def test_encoder_equals_tokenizers_on_whole_tables(table, column):
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(tokenizer_path()), packing.load_encoder(tokenizer_path())
    for text in pq.read_table(f"/root/testdata/sf0.01/{table}.parquet", columns=[column])[column].to_pylist():
        assert fast(text or "").tolist() == slow.encode(text or "", add_special_tokens=False).ids


def test_ranks_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 10)
    df = spark.createDataFrame([(1, "a")] * 500 + [(2, "b")] * 30, "class int, id string").withColumn("row", F.monotonically_increasing_id()).cache()
    got = packing.ranked(df, "class", ["id"], "row", 530)
    assert sorted((r["class"], r["rank"]) for r in got.collect()) == [(1, k) for k in range(500)] + [(2, k) for k in range(30)]
    salts = F.pmod(F.xxhash64("id", "row"), F.lit(53))
    assert df.groupBy(salts).count().agg(F.max("count")).first()[0] < 60  # no salt has all equal rows


def test_repeated_null_long_and_clashing_rows(spark):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(None, "the same text of a row")] * 300 + [(1, long), (1, long), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "class", "row", "rank", "sequence_id", "Start", "ids")})
    got = packing.pack(df, tokenizer_path()).collect()
    encode = packing.load_encoder(tokenizer_path())
    assert sum(r.length for r in got) == sum(len(encode(t or "")) + 1 for _, t in rows)
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == Counter((i, len(encode(t or "")) + 1) for i, t in rows)
    used = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= packing.LENGTH and sorted(used) == list(range(len(used)))
