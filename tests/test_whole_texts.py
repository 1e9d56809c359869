"""Answers are whole turns, and every line of a document is measured."""

import re

from tallyspark.plans import catalog


def test_forensics_reads_beyond_six_words(spark, tmp_path):
    same = "one two three four five six"
    turns = [same + " asked", same + " first answer", same + " second answer here", same + " third", same + " third"]
    spark.createDataFrame([("c", i, "user", t) for i, t in enumerate(turns)], "conv_id string, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.qid: r for r in catalog.QUERIES["forensics_attribution"](spark, str(tmp_path)).collect()}
    assert {q: r.answer for q, r in got.items()} == {f"c:{i}": t for i, t in enumerate(turns) if i}
    assert [got[f"c:{i}"].consistency for i in (1, 2, 3, 4)] == [0.5, 0.5, 0.5, 1.0]
    # Turns 1 and 4 lose every second word: 4 of 8 and 4 of 7 stay. Turn 2 is not known, turn 3 stays.
    assert [got[f"c:{i}"].invariance for i in (1, 2, 3, 4)] == [0.5, 0.0, 1.0, 0.5714]
    calib = catalog.QUERIES["leak_calibration"](spark, str(tmp_path)).first()
    assert (calib.q90, calib.threshold, calib.n) == (0.871428571, 0.95, 4)
    gates = {r.gate: (r.tp, r.fp, r.fn, r.tn) for r in catalog.QUERIES["threshold_ablation"](spark, str(tmp_path)).collect()}
    assert gates == {"fixed": (1, 2, 0, 1), "calibrated": (1, 0, 0, 3)}


def plain(text):
    lines = [" ".join(x.split()).lower() for x in text.split("\n")]
    for k, s in enumerate(lines):
        rest = "\n".join(lines[:k] + lines[k + 1 :])
        if len(s) < 12:
            found = [bool(re.search(rf"(?<![a-z0-9]){re.escape(s)}(?![a-z0-9])", rest))] if s else [True]
        else:
            found = [g in rest for g in {s[i : i + 12] for i in range(len(s) - 11)}]
        yield k, round(sum(found) / len(found), 9)


def test_shingle_coverage_measures_every_line(spark, tmp_path):
    texts = ["short one\nthe river ran past the old stone mill\nnothing of it comes again\nthe old stone mill was a short one  here\n\nthe river ran past the old stone mill", "a line by itself", "tiny\ntinyish words"]
    spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.pos, r.coverage) for r in catalog.QUERIES["shingle_coverage"](spark, str(tmp_path)).collect())
    assert got == [(d, *x) for d, t in enumerate(texts) for x in plain(t)]
