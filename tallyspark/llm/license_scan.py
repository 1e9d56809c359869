"""License scans in DataFrame functions only.

Texts become arrays of five-word shingle hashes, cut into overlapping windows of a few sizes. MinHash
has one row a band, so a window and a template of similarity s meet in some of BANDS bands with probability
1 - (1 - s) ** BANDS. A template (or a segment of a long one) is looked for with the windows of which it fills
at least a quarter whatever its place, and BANDS is what takes a quarter to RECALL. Windows that share a band with
a template retrieve it; the exact share of the template's shingles around the window decides.

Band k takes the least of (hash xor mask k). A window can only agree with a template in it if the
window holds the template's own least shingle. Texts and windows without any of these few shingles are therefore
left out before the minima are taken, which changes no result.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
RECALL = 0.999
#: Half windows in shingles; a template of up to half + 1 shingles lies whole in some window of two halves.
HALVES = (2, 8)
BANDS = math.ceil(math.log(1 - RECALL) / math.log(1 - 0.25))
#: Templates that are broadcast at once; more are scanned for in several passes over the texts.
MOST_TEMPLATES = 10_000

# Notices as they are commonly printed, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or"),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or"),
    ("LGPL-2.1", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, wherever the optimiser moves the expression."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(text: Column) -> Column:
    """Hashes of the runs of five words; fewer words are one shingle, none are none."""
    return let(words(text), _of_words)


def _of_words(w: Column) -> Column:
    n = F.size(w)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))).otherwise(F.array().cast("array<bigint>"))


def masks() -> list[int]:
    rng = random.Random(1)
    return [rng.getrandbits(64) - (1 << 63) for _ in range(BANDS)]


def template_table(spark: SparkSession, templates: list[tuple[int, str, str]]) -> list[tuple[int, str, list[int]]]:
    """(number, license, distinct shingles in order) of the (number, license, text) that have words."""
    rows = spark.createDataFrame(templates, "k int, name string, t string")
    rows = rows.select("k", "name", F.array_distinct(shingles(F.col("t"))).alias("s")).where(F.size("s") > 0)
    return [(r["k"], r["name"], list(r["s"])) for r in rows.orderBy("k").collect()]


def segments(s: list[int]) -> list[tuple[int, list[int]]]:
    """(half window, shingles) that retrieve a template: the smallest window that can hold it, or several segments."""
    for half in HALVES:
        if len(s) <= half + 1:
            return [(half, s)]
    n = HALVES[-1] + 1
    return [(HALVES[-1], s[i : i + n]) for i in range(0, len(s) - n // 2, n)]


def band_rows(table: list[tuple[int, str, list[int]]]) -> list[tuple[int, int, int, int]]:
    """(half window, band, least value, template)."""
    return sorted({(half, band, min(x ^ m for x in part), k) for k, _, s in table for half, part in segments(s) for band, m in enumerate(masks())})


def _regions(h: Column, half: int, own: Column, reach: int) -> Column:
    """The windows with any of the shingles ``own``, each with its surroundings."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(h) - half, F.lit(1)), F.lit(half))
    windows = F.filter(starts, lambda s: F.arrays_overlap(F.slice(h, s, 2 * half), own))
    around = lambda s: F.slice(h, F.greatest(s - reach, F.lit(1)), 2 * half + 2 * reach)
    return F.transform(windows, lambda s: F.struct(F.lit(half).alias("half"), s.alias("at"), F.slice(h, s, 2 * half).alias("win"), around(s).alias("region")))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """id, template, license, containment, shingle for each document and template that matches around a window.

    ``shingle`` is the number of the first window's first word. Null texts and texts without words match nothing. Rows
    that repeat an id are one document here.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return _matches(own, ["id"], templates, containment)


def _matches(docs: DataFrame, keys: list[str], templates: list[tuple[str, str]] | None, containment: float) -> DataFrame:
    """Matches of the texts t by the keys."""
    spark = docs.sparkSession
    numbered = [(k, name, text) for k, (name, text) in enumerate(TEMPLATES if templates is None else templates)]
    found = None
    for lo in range(0, len(numbered), MOST_TEMPLATES):
        part = _block_matches(docs, keys, template_table(spark, numbered[lo : lo + MOST_TEMPLATES]), containment)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        schema = ", ".join(f"{k} {dict(docs.dtypes)[k]}" for k in keys)
        return spark.createDataFrame([], f"{schema}, template int, license string, containment double, shingle int")
    return found


def _block_matches(docs: DataFrame, keys: list[str], table: list[tuple[int, str, list[int]]], containment: float) -> DataFrame | None:
    spark = docs.sparkSession
    if not table:
        return None
    rows, mask = band_rows(table), masks()
    reach = max(len(s) for _, _, s in table)
    least = {half: sorted({v ^ mask[b] for h, b, v, _ in rows if h == half}) for half in HALVES}
    literal = lambda xs: F.array(*[F.lit(x) for x in xs])
    anyof = literal(sorted({x for v in least.values() for x in v}))
    regions = lambda h: F.when(F.arrays_overlap(h, anyof), F.concat(*[_regions(h, half, literal(v), reach) for half, v in least.items() if v]))
    near = docs.select(*keys, F.explode(let(shingles(F.col("t")), regions)).alias("x")).select(*keys, "x.*")
    minima = F.transform(F.array(*[F.lit(m) for m in mask]), lambda m: F.array_min(F.transform("win", lambda x: x.bitwiseXOR(m))))
    near = near.select(*keys, "half", "at", "region", F.posexplode(minima).alias("band", "value"))
    bands = spark.createDataFrame(rows, "half int, band int, value bigint, template int")  # a few rows a template
    texts = spark.createDataFrame(table, "template int, license string, s array<bigint>")
    found = near.join(F.broadcast(bands), ["half", "band", "value"]).join(F.broadcast(texts), "template")
    share = F.size(F.array_intersect("s", "region")) / F.size("s")
    found = found.select(*keys, "template", "license", share.alias("containment"), "at").where(F.col("containment") >= containment)
    return found.groupBy(*keys, "template", "license").agg(F.max("containment").alias("containment"), F.min("at").alias("shingle"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """A row for each row: id, licenses (distinct, sorted), n_templates, containment (the best, 0 without a match).

    Rows that repeat an id are scanned each for themselves, null ids too; rows without words match nothing; texts are
    read whole, however long; equal best matches count as several templates. Other columns are not read, whatever
    their names; an empty table gives no rows. Matches come back to rows by id and a hash of the text, so that no id
    gathers its rows in one task.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t")).withColumn("th", F.xxhash64("t"))
    hits = _matches(own, ["id", "th"], templates, containment)
    per = hits.groupBy("id", "th").agg(F.array_sort(F.collect_set("license")).alias("licenses"), F.countDistinct("template").alias("n_templates"), F.max("containment").alias("containment"))
    rows, per = own.select("id", "th").alias("r"), per.alias("m")
    return rows.join(per, F.col("r.id").eqNullSafe(F.col("m.id")) & (F.col("r.th") == F.col("m.th")), "left").select(
        F.col("r.id").alias(id_col), F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("n_templates", F.lit(0)).cast("bigint").alias("n_templates"), F.coalesce("containment", F.lit(0.0)).alias("containment")
    )
