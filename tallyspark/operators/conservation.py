"""Structural conservation: which typed elements of a markdown source survive in its chunks.

Elements and their matches are found by a plain pass over each document (an Arrow-batched function): its work and
memory grow with the document and its chunks, not with elements x characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyspark.functions import text as T

TAU = DUPLICATE_TAU = 0.85
TYPES = ["tables", "code_blocks", "headings", "list_items", "links", "numeric_spans"]

# White space, and what a list item, a number and a word look like. A separator row has only the SEPARATOR's characters.
BLANK = " \t\n\x0b\f\r"
SEPARATOR = BLANK + ":|-"
FENCES = ("```", "~~~")
SPACE = re.compile(f"[{BLANK}]+")
LIST_ITEM = re.compile(r"\s*(?:[-*+]|[0-9]+\.)\s+\S", re.ASCII)
NUMBER = re.compile(r"[0-9]+(?:[.,][0-9]+)*")
WORD = re.compile(r"[^\W_]+")

#: Rows of one Arrow batch, about.
BATCH_ROWS = 10_000


def _links(source: str) -> Iterator[tuple[int, int]]:
    """The matches of ``\\[[^\\]]+\\]\\([^)]+\\)``, without trying each of many open brackets to the end."""
    at = 0
    while (start := source.find("[", at)) >= 0:
        close = source.find("]", start + 1)
        if close < 0:
            return
        at = close + 1
        if close > start + 1 and source.startswith("(", at):
            stop = source.find(")", at + 1)
            if stop < 0:
                return
            if stop > at + 1:
                at = stop + 1
                yield start, at


def _parsed(source: str) -> list[tuple[int, int, str]]:
    """(start, stop, type) of the typed elements, in order. A fence pairs with the next one; an unterminated last fence is prose."""
    lines, at = [], 0
    for line in source.split("\n"):
        lines.append((at, at + len(line), line))
        at += len(line) + 1
    fences = [i for i, (_, _, line) in enumerate(lines) if line.lstrip(BLANK).startswith(FENCES)]
    pairs = list(zip(fences[::2], fences[1::2]))
    code = [(lines[a][0], lines[b][1]) for a, b in pairs]
    out = [(a, b, "code_blocks") for a, b in code]
    in_code = bytearray(len(lines))
    for a, b in pairs:
        in_code[a : b + 1] = b"\1" * (b + 1 - a)
    for piped, group in groupby(range(len(lines)), lambda i: not in_code[i] and "|" in lines[i][2]):
        run = list(group)
        if piped and len(run) >= 2 and any("-" in lines[i][2] and not lines[i][2].strip(SEPARATOR) for i in run):
            out.append((lines[run[0]][0], lines[run[-1]][1], "tables"))
    for i, (start, stop, line) in enumerate(lines):
        if not in_code[i]:
            if line.lstrip(BLANK).startswith("#"):
                out.append((start, stop, "headings"))
            elif LIST_ITEM.match(line):
                out.append((start, stop, "list_items"))
    begins = [a for a, _ in code]
    for spans, kind in ((_links(source), "links"), ((m.span() for m in NUMBER.finditer(source)), "numeric_spans")):
        for start, stop in spans:
            j = bisect_right(begins, start) - 1
            if j < 0 or start >= code[j][1]:
                out.append((start, stop, kind))
    return sorted(out)


def _normalized(text: str) -> str:
    """``T.normalize``."""
    return SPACE.sub(" ", text).strip(" ").lower()


def _shingled(normalized: str, k: int) -> list[str]:
    """``T.shingles``."""
    if len(normalized) <= k:
        return [normalized] if normalized else []
    return list(dict.fromkeys(normalized[i : i + k] for i in range(len(normalized) - k + 1)))


def _held(text: str, wanted: dict[int, set[str]]) -> set[str]:
    """Those of the wanted shingles (by length) that a text holds, as ``T.member`` has it; a pass for each length."""
    out: set[str] = set()
    begins = [m.start() for m in WORD.finditer(text)]
    for n, want in wanted.items():
        last = len(text) - n
        if n >= T.GLOBAL_SHINGLE:
            out.update(g for i in range(last + 1) if (g := text[i : i + n]) in want)
            continue
        # A shingle that begins with a letter or digit stands at a token's begin.
        other = {g for g in want if not g[0].isalnum()}
        for places, some in ((begins, want), (range(last + 1) if other else (), other)):
            for i in places:
                if i <= last and (g := text[i : i + n]) in some and not (g[-1].isalnum() and text[i + n : i + n + 1].isalnum()):
                    out.add(g)
    return out


def _judged(source: str, chunks: list[str | None], k: int) -> Iterator[tuple[int, int, str, float, list[int], str]]:
    """(start, stop, type, coverage, places of the chunks that hold it, normalized text) of each element."""
    words = [m.span() for m in WORD.finditer(source)]
    begins = [a for a, _ in words]
    found, grams = [], {}
    for start, stop, kind in _parsed(source):
        key = normal = _normalized(source[start:stop])
        if len(normal) < k:  # grown over the letters and digits on either side
            a, b = bisect_left(begins, start) - 1, bisect_right(begins, stop) - 1
            left = begins[a] if a >= 0 and words[a][1] >= start else start
            right = words[b][1] if b >= 0 and words[b][1] > stop else stop
            key = _normalized(source[left:right])
        if key not in grams:
            grams[key] = _shingled(key, k)
        found.append((start, stop, kind, key, normal))
    wanted: dict[int, set[str]] = {}
    for gs in grams.values():
        for g in gs:
            wanted.setdefault(len(g), set()).add(g)
    held = [set() if c is None else _held(_normalized(c), wanted) for c in chunks]
    places: dict[str, list[int]] = {}
    for c, gs in enumerate(held):
        for g in gs:
            places.setdefault(g, []).append(c)

    def judge(gs: list[str]) -> tuple[float, list[int]]:
        n = len(gs)
        if not n:
            return 1.0, list(range(len(chunks)))
        # A chunk that holds enough of the shingles holds one of any so many, the rarest for instance.
        rare = sorted(gs, key=lambda g: len(places.get(g, ())))[: n - int(DUPLICATE_TAU * n) + 1]
        near = {c for g in rare for c in places.get(g, ())}
        return sum(g in places for g in gs) / n, sorted(c for c in near if sum(g in held[c] for g in gs) / n >= DUPLICATE_TAU)

    verdicts = {key: judge(gs) for key, gs in grams.items()}
    for start, stop, kind, key, normal in found:
        yield start, stop, kind, *verdicts[key], normal


def _byte_offsets(text: str) -> Callable[[int], int]:
    """The UTF-8 byte offset of a code point offset."""
    import numpy as np

    if text.isascii():
        return lambda i: i
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
    return lambda i: int(ends[i - 1]) if i else 0


def _rows(df: DataFrame, each: Callable[..., Iterator[tuple]], fields: str) -> DataFrame:
    """doc_id and ``fields`` from ``each(values of the other columns)``, for every row whose source isn't null."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([df.schema["doc_id"], *StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        out: list[tuple] = []
        for batch in batches:
            ids = batch.column("doc_id")
            for i in range(batch.num_rows):
                values = [batch.column(j)[i].as_py() for j in range(1, batch.num_columns)]
                if values[0] is None:
                    continue
                doc = ids[i].as_py()
                for row in each(*values):
                    out.append((doc, *row))
                    if len(out) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def elements(sources: DataFrame) -> DataFrame:
    """(doc_id, type, start, stop, text) of the typed elements of (doc_id, source); offsets are code points."""

    def each(source):
        for start, stop, kind in _parsed(source):
            yield kind, start, stop, source[start:stop]

    return _rows(sources.select("doc_id", "source"), each, "type string, start int, stop int, text string")


def manifest(sources: DataFrame, chunks: DataFrame, k: int = T.GLOBAL_SHINGLE, tau: float = TAU) -> DataFrame:
    """A row for each element: type, byte_start, byte_end, coverage (4 places), status, chunk_hits, preview.

    Over (doc_id, source) and (doc_id, pos, chunk). Coverage counts shingles in the document's chunks together;
    an element that two chunks hold whole is duplicated. A document and its chunks meet once, in one task.
    """
    spark = sources.sparkSession
    # Few documents may be much work: they are not merged into one task as small partitions would be.
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    spread = lambda df: df.repartition(parts, "doc_id")
    held = spread(chunks.select("doc_id", "pos", "chunk")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk"))).alias("cs"))
    both = spread(sources.select("doc_id", "source")).join(held, "doc_id", "left")
    both = both.select("doc_id", "source", F.transform("cs", lambda c: c["pos"]).alias("pos"), F.transform("cs", lambda c: c["chunk"]).alias("chunks"))

    def each(source, pos, texts):
        at = _byte_offsets(source)
        for start, stop, kind, raw, hits, normal in _judged(source, texts or [], k):
            yield kind, at(start), at(stop), raw, [pos[c] for c in hits], normal[:60]

    el = _rows(both, each, f"type string, byte_start int, byte_end int, raw double, chunk_hits array<{dict(chunks.dtypes)['pos']}>, preview string")
    status = F.when(F.col("raw") >= tau, F.when(F.size("chunk_hits") >= 2, "duplicated").otherwise("conserved")).otherwise("dropped")
    return el.select("doc_id", "type", "byte_start", "byte_end", F.round("raw", 4).alias("coverage"), status.alias("status"), "chunk_hits", "preview")


def per_type(manifest_: DataFrame, docs: DataFrame) -> DataFrame:
    """A row for each document and each of the six types: total, conserved, dropped, duplicated, ratio (6 places, 1 without elements)."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    g = manifest_.groupBy("doc_id", "type").agg(F.count("*").alias("total"), n("conserved", "duplicated").alias("conserved"), n("dropped").alias("dropped"), n("duplicated").alias("duplicated"))
    every = docs.select("doc_id", F.explode(F.array(*[F.lit(x) for x in TYPES])).alias("type"))
    out = every.join(g, ["doc_id", "type"], "left").na.fill(0, ["total", "conserved", "dropped", "duplicated"])
    return out.withColumn("ratio", F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("conserved") / F.when(F.col("total") > 0, F.col("total")), 6)))


def token_recall(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, recall): the undifferentiated baseline, a multiset recall of word tokens; 1 for a source without any."""
    toks = lambda df, c: df.select("doc_id", F.explode(F.regexp_extract_all(T.normalize(F.col(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("tok")).groupBy("doc_id", "tok").agg(F.count("*").alias("n"))
    a, b = toks(sources, "source"), toks(chunks, "chunk").withColumnRenamed("n", "m")
    got = a.join(b, ["doc_id", "tok"], "left").groupBy("doc_id").agg((F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n")).alias("recall"))
    return sources.select("doc_id").join(got, "doc_id", "left").select("doc_id", F.coalesce("recall", F.lit(1.0)).alias("recall"))


def sensitivity(type_ratio: Column, aggregate: Column) -> Column:
    """How many times more a per-type ratio moved than the aggregate; infinite if the aggregate did not."""
    return F.when(aggregate == 1, F.lit(float("inf"))).otherwise((1 - type_ratio) / F.when(aggregate != 1, 1 - aggregate))


def blocks(sources: DataFrame) -> DataFrame:
    """(doc_id, pos, chunk): blank-line blocks, blank ones left out."""
    parts = F.filter(F.split("source", "\n\n", -1), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    return sources.select("doc_id", F.posexplode(parts).alias("pos", "chunk"))


def recursive_split(sources: DataFrame, size: int = 400) -> DataFrame:
    """(doc_id, pos, chunk): split at blank lines, then lines, then spaces, then characters, and merged greedily; lossless.

    Recursion has no relational form: an Arrow-batched function.
    """
    @pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        def pieces(t: str, seps: list[str]) -> list[str]:
            if len(t) <= size:
                return [t] if t else []
            if not seps:
                return [t[i : i + size] for i in range(0, len(t), size)]
            parts = t.split(seps[0])
            parts = [p + seps[0] for p in parts[:-1]] + parts[-1:]
            return [x for p in parts for x in pieces(p, seps[1:])]

        def merged(t: str) -> list[str]:
            out: list[str] = []
            for p in pieces(t or "", ["\n\n", "\n", " "]):
                if out and len(out[-1]) + len(p) <= size:
                    out[-1] += p
                else:
                    out.append(p)
            return out

        return texts.map(merged)

    return sources.select("doc_id", F.posexplode(cut("source")).alias("pos", "chunk"))
