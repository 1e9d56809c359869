"""License scan: several blocks of templates, rows that share an id, long texts, and clashing columns."""

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import license_scan

RNG = np.random.default_rng(4)


def prose(n):
    return " ".join(RNG.choice([f"w{i}" for i in range(90)], n))


def test_blocks_of_templates_find_what_one_block_finds(spark, monkeypatch):
    rows = [(i, prose(30) + " " + t + " " + prose(30)) for i, (_, t) in enumerate(license_scan.TEMPLATES)] + [(90, prose(50)), (91, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(str, license_scan.scan(df).collect()))
    monkeypatch.setattr(license_scan, "MOST_TEMPLATES", 3)
    assert sorted(map(str, license_scan.scan(df).collect())) == one
    assert license_scan.scan(df, templates=[("none", "!!!")] * 7).where("n_templates > 0").count() == 0
    assert license_scan.matches(df).count() == sum(r.n_templates for r in license_scan.scan(df).collect())


def test_rows_that_share_an_id_are_scanned_each(spark):
    mit, gpl = license_scan.TEMPLATES[2][1], license_scan.TEMPLATES[4][1]
    rows = [(None, mit), (None, "nothing"), (1, gpl), (1, gpl), (1, prose(20)), (2, prose(40_000) + " " + mit), (3, ""), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "t", "th", "Licenses", "template", "x")})
    got = sorted((r.doc_id or 0, ",".join(r.licenses)) for r in license_scan.scan(df).collect())
    assert got == [(0, ""), (0, "MIT"), (1, ""), (1, "GPL-3.0"), (1, "GPL-3.0"), (2, "MIT"), (3, ""), (3, "")]
