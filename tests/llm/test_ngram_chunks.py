"""Pairs whose members fall into one chunk are counted once."""

from tallyspark.llm import ngram_join


def test_members_of_one_chunk_count_once(spark, monkeypatch):
    """Every pair of copies is one group of three chunks; some pairs fall into one chunk."""
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 100)
    rows = []
    for g in range(20):
        words = [f"g{g}w{k}" for k in range(120)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[:-1] + ["other"]))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i - i % 2, 1) for i, _ in rows}
