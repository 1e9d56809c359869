"""Sources, sinks and the command line with its exit codes."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark import cli
from tallyspark.functions import vec
from tallyspark.sources import files


@pytest.fixture
def put(tmp_path):
    def write(name, value):
        path = tmp_path / name
        path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
        return str(path)

    return write


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect())


def test_json_and_text_scans(spark, put):
    assert rows(files.json_document(spark, put("d.json", {"a": "x", "n": 3}), "a string, n int, gone string")) == [("x", 3, None)]  # A1
    assert rows(files.json_map(spark, put("m.json", {"p/1": "h1", "p/é": "h2"}))) == [("p/1", "h1"), ("p/é", "h2")]  # A2
    assert rows(files.json_map(spark, put("c.json", {"C1": "a \"quote\""}), "cite_id", "quote"), "cite_id", "quote") == [("C1", 'a "quote"')]  # A8
    assert rows(files.json_list(spark, put("l.json", ["b", "a", "b"]))) == [(0, "b"), (1, "a"), (2, "b")]  # A3
    assert rows(files.json_edges(spark, put("e.json", [{"from": "a", "to": "b", "reason": "r"}, {"from": "c", "to": "d"}])), "from_id", "to_id") == [("a", "b"), ("c", "d")]  # A4
    assert rows(files.json_mentions(spark, put("n.json", [{"entity": "e", "source_type": "s"}]))) == [("e", "s", "")]
    text = "first\r\n\n  second é\n"
    assert files.whole_text(spark, put("t.md", text)).first().value == text  # A7
    with pytest.raises(Exception):
        files.json_document(spark, put("bad.json", "{\"a\": "), "a string").collect()


ARTIFACTS = {
    "docs": [{"id": "d0", "text": "alpha beta"}, {"id": "d1", "text": "gamma delta"}], "index_ids": ["d0", "d1"], "embeddings": [[1.0, 0.0], [0.0, 1.0]],
    "queries": ["alpha", "gamma"], "retrieval": [[["d0", 0.9], ["d1", 0.4]], [["d1", 0.8], ["d0", 0.1]]],
}


def test_pipeline_scans_and_build(spark, put):
    p = files.pipeline_artifacts(spark, put("p.json", ARTIFACTS))  # A5, A6, A10
    assert rows(p["retrieval"]) == [(0, 1, "d0", 0.9), (0, 2, "d1", 0.4), (1, 1, "d1", 0.8), (1, 2, "d0", 0.1)]
    assert tuple(p["params"].first()) == (2, 3) and rows(p["index"]) == [(0, "d0"), (1, "d1")] and p["emb"].count() == 2
    bare = files.pipeline_artifacts(spark, put("q.json", {"docs": []}))
    assert tuple(bare["params"].first()) == (256, 3) and all(bare[k].count() == 0 for k in ("docs", "index", "emb", "queries", "retrieval"))
    built = files.build_pipeline(p["docs"], p["queries"], vec.md5_slots)  # A9
    assert rows(built["retrieval"].where("rank = 1"), "qi", "id") == [(0, "d0"), (1, "d1")] and {len(r.v) for r in built["emb"].collect()} == {256}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(250)], "a long, b string")
    for fmt in ("json", "parquet"):
        files.write_snapshot(df, str(tmp_path / fmt), fmt)  # A11
        assert rows(files.read_snapshot(spark, str(tmp_path / fmt), fmt), "a", "b") == rows(df)
    lines = files.report_lines(df.orderBy("a"))  # A13
    assert lines[0] == "a=0 b=v0" and len(lines) == 201 and lines[-1] == "... 50 more rows"
    assert len(files.report_lines(df, 250)) == 250 and files.report_lines(df.where("false")) == []


def test_exit_codes(spark, put, capsys):
    run = lambda *a: cli.main(list(a), spark)
    now, before = put("now.json", {"a": "1", "b": "2"}), put("before.json", {"a": "1", "b": "0"})
    live, cached = put("live.json", ["x"]), put("cached.json", ["y"])
    good, bad = put("good.json", [{"from": "a", "to": "x", "reason": ""}]), put("bad.json", [{"from": "a", "to": "z", "reason": ""}])
    sync = lambda edges: run("sync", "--current", now, "--previous", before, "--edges", edges, "--live", live, "--cached", cached)
    assert (sync(good), sync(bad)) == (0, 2)
    assert "factor=2.0" in capsys.readouterr().out
    registry = put("r.json", ["E1"])
    mention = lambda n, kinds: put(n, [{"entity": "E1", "source_type": k} for k in kinds])
    full, thin = mention("full.json", ["a", "b", "c", "a"]), mention("thin.json", ["a"])
    audit = lambda m, *prev: run("coverage", "--registry", registry, "--mentions", m, "--own", "own", "--others", "a,b,c", *prev)
    assert (audit(full), audit(thin), audit(thin, "--previous", full), audit(full, "--previous", thin)) == (0, 0, 2, 0)
    source = put("s.md", "# Head\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nThe tail of it is 42 long.")
    chunks = put("c1.json", ["# Head", "| a | b |\n|---|---|\n| 1 | 2 |", "The tail of it is 42 long."])
    lossy = put("c2.json", ["# Head", "The tail of it is 42 long."])
    keep = lambda c, *prev: run("conservation", "--source", source, "--chunks", c, *prev)
    assert (keep(chunks), keep(lossy, "--previous", chunks), keep(chunks, "--previous", lossy)) == (0, 2, 0)
    dead = dict(ARTIFACTS, index_ids=["d0", "dX"])
    assert (run("liveness", "--artifacts", put("ok.json", ARTIFACTS)), run("liveness", "--artifacts", put("dead.json", dead))) == (0, 2)
    cite = lambda q: run("provenance", "--source", source, "--citations", put("q.json", q))
    assert (cite({"C1": "the TAIL of it"}), cite({"C1": "never said"})) == (0, 1)
    with pytest.raises(SystemExit):
        cli.main(["sync"], spark)


def test_reindex_command(spark, put):
    from tallyspark.sources import generate

    docs = put("docs.json", [r.text for r in generate.paraphrase_corpus(spark, 8).orderBy("doc_id").collect()])
    run = lambda new: cli.main(["reindex", "--docs", docs, "--old", "whole:256:1", "--new", new], spark)
    assert (run("whole:256:1"), run("whole:2:1")) == (0, 1)
