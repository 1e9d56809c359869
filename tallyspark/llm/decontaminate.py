"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts.

Normalised: A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A pattern is a run of 13 words of an item (or
the whole of a shorter item). Words of the patterns are numbered, and a number is two symbols from two alphabets, so that
patterns have 26 nodes, few of which branch widely; a word of no pattern is a pair of symbols that no pattern has.
Each text is scanned once; the ends of the matches are words, and words map to code points of the original.

A benchmark whose automaton would not fit is cut by a hash of its windows into several automata. Then a first pass marks
the texts that have the 64-bit hash of any window (no hit is without one), and only those are scanned by each automaton.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import cut_lineage, map_texts, ngrams, text_buffers, words

WINDOW_WORDS = 13
#: Memory of one automaton, at NODE_BYTES for each of two nodes a word; a larger one is cut into several.
BLOCK_BYTES = 192 << 20
NODE_BYTES = 50
#: Window hashes that the first pass holds (8 bytes each); beyond, every text is scanned by every automaton.
MOST_HASHES = 8_000_000

_FOLD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def fold(text: str | None) -> list[bytes]:
    """The normalised words of a text."""
    return (text or "").encode().translate(_FOLD).split()


def window_table(benchmark: DataFrame, id_col: str, text_col: str, n: int = WINDOW_WORDS) -> DataFrame:
    """(window, item ids) of the distinct windows: normalised words with one space between; null ids are left out."""
    item = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).where("t is not null")
    low = F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    item = item.select("i", F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    runs = item.select("i", F.explode(F.transform(starts, lambda k: F.array_join(F.slice("w", k, n), " "))).alias("window"))
    return runs.groupBy("window").agg(F.sort_array(F.collect_set("i")).alias("items"))


_BUILT: dict[str, tuple] = {}


def automaton(name: str, patterns: list[tuple[str, list[str]]]) -> tuple:
    """(automaton, symbols of each word), built once in a worker process and kept until another is asked for."""
    if name not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        number: dict[bytes, int] = {}
        split = [window.encode().split() for window, _ in patterns]
        for w in split:
            for x in w:
                number.setdefault(x, len(number))
        base = int(len(number) ** 0.5) + 1
        symbols = {x: chr(1 + k // base) + chr(base + 2 + k % base) for x, k in number.items()}
        made = ahocorasick.Automaton()
        for w, (_, items) in zip(split, patterns, strict=True):
            made.add_word("".join(map(symbols.__getitem__, w)), (len(w), items))
        if patterns:
            made.make_automaton()
        _BUILT[name] = made, symbols
    return _BUILT[name]


_SPAN = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
_OUTPUTS = [("n_words", "bigint"), ("n_hit", "bigint"), ("spans", "array<struct<from:int,to:int>>"), ("item_ids", "array<string>")]


def _scanner(shared) -> Callable[[], Callable[[pa.Array], list]]:
    """shared: a broadcast (name, patterns)."""

    def make() -> Callable[[pa.Array], list]:
        name, patterns = shared.value
        made, symbols = automaton(name, patterns)

        def scan(texts: pa.Array) -> list:
            counts, hits, spans, found = [], [], [], []
            for text in texts.to_pylist():
                w = fold(text)
                matches = list(made.iter("".join(map(symbols.get, w, repeat("\0\0"))))) if w and patterns else []
                counts.append(len(w))
                if not matches:
                    hits.append(0), spans.append([]), found.append([])
                    continue
                hit = np.zeros(len(w) + 1, np.int64)
                for end, (n, _) in matches:
                    hit[end // 2 + 1 - n] += 1
                    hit[end // 2 + 1] -= 1
                covered = np.cumsum(hit)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
                place = [m.span() for m in _WORD.finditer(text)]
                hits.append(int(covered.sum()))
                spans.append([{"from": place[a][0], "to": place[b - 1][1]} for a, b in edge.reshape(-1, 2)])
                found.append(sorted({i for _, (_, items) in matches for i in items}))
            return [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(spans, _SPAN), pa.array(found, pa.list_(pa.string()))]

        return scan

    return make


def _hashes(texts: pa.Array) -> pa.Array:
    """Of texts that are one window each."""
    data, offsets = text_buffers(texts)
    w = words(data, offsets)
    out = np.zeros(len(texts), np.uint64)
    for n in np.unique(np.diff(w.bounds)).tolist():
        own = np.flatnonzero(np.diff(w.bounds) == n)
        at, h = ngrams(w, n)
        out[own] = h[np.searchsorted(at, w.bounds[own])]
    return pa.array(out.view(np.int64))


def _marker(shared) -> Callable[[], Callable[[pa.Array], list]]:
    """shared: a broadcast (sorted window hashes, window lengths)."""

    def make() -> Callable[[pa.Array], list]:
        known, lengths = shared.value

        def mark(texts: pa.Array) -> list:
            data, offsets = text_buffers(texts)
            w = words(data, offsets)
            near = np.zeros(len(texts), bool)
            for n in lengths:
                at, h = ngrams(w, n)
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                near[np.searchsorted(w.bounds, at[known[place] == h], "right") - 1] = True
            return [pa.array(np.diff(w.bounds), pa.int64()), pa.array(near)]

        return mark

    return make


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``keep`` plus n_words, n_hit, spans (code points from/to of the hit runs), item_ids (sorted as strings).

    One row for each input row, repeated ids and rows included; whole texts are read however long. A null or empty text has
    no words and no hit; an item with a null or wordless text has no window; an item with a null id hits words but is
    not listed, and items that repeat an id count as one. An empty benchmark hits nothing. Kept columns named like
    an output give way to it.
    """
    taken = {n for n, _ in _OUTPUTS}
    keep = [c for c in keep if c.lower() not in taken]
    own = docs.select(*[F.col(f"`{c}`").alias(f"k{j}") for j, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("t"))
    kept = [f"k{j}" for j in range(len(keep))]
    table = window_table(benchmark, item_id, item_text)
    out = _scan_all(own, cut_lineage(table), kept, block_bytes)
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], *[n for n, _ in _OUTPUTS])


def _scan_all(own: DataFrame, table: DataFrame, kept: list[str], block_bytes: int) -> DataFrame:
    import uuid

    context, name = own.sparkSession.sparkContext, uuid.uuid4().hex
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(F.split("window", " "))), F.lit(0)).alias("words")).first()
    blocks = min(max(1, size["n"]), -(-2 * NODE_BYTES * size["words"] // block_bytes) or 1)

    def patterns(b: int):
        """Collects and broadcasts one block, whose size is bounded."""
        part = table if blocks == 1 else table.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
        return context.broadcast((f"{name}-{b}", [(r["window"], r["items"]) for r in part.collect()]))

    if blocks == 1:
        return map_texts(own, _scanner(patterns(0)), _OUTPUTS, kept, "t")
    near = own.withColumns({"n_words": F.lit(None).cast("bigint"), "near": F.lit(True)})
    if size["n"] <= MOST_HASHES:
        known = np.unique(map_texts(table, lambda: lambda texts: [_hashes(texts)], [("h", "bigint")], [], "window").toArrow()["h"].to_numpy().view(np.uint64))
        lengths = [r[0] for r in table.select(F.size(F.split("window", " "))).distinct().collect()]  # at most WINDOW_WORDS
        near = map_texts(own.withColumn("t2", F.col("t")), _marker(context.broadcast((known, lengths))), [("n_words", "bigint"), ("near", "boolean")], [*kept, "t2"], "t").withColumnRenamed("t2", "t")
    marked = cut_lineage(near.where("near").select(*kept, "t", F.monotonically_increasing_id().alias("row")))
    found = None
    for b in range(blocks):
        part = map_texts(marked.select("row", "t"), _scanner(patterns(b)), _OUTPUTS, ["row"], "t")
        part = part.select("row", "n_words", "spans", "item_ids")
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    hit = _merged(marked.join(found, "row")).select(*kept, *[n for n, _ in _OUTPUTS])
    rest = near.where("not near").select(*kept, "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.array().cast(_OUTPUTS[2][1]).alias("spans"), F.array().cast(_OUTPUTS[3][1]).alias("item_ids"))
    return hit.unionByName(rest)


def _merged(df: DataFrame) -> DataFrame:
    """The span lists of several scans united, and the words of t inside them counted."""
    united = F.aggregate(
        F.array_sort("spans"),
        F.array().cast(_OUTPUTS[2][1]),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["to"] >= s["from"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["from"].alias("from"), F.greatest(F.element_at(acc, -1)["to"], s["to"]).alias("to"))))).otherwise(F.concat(acc, F.array(s))),
    )
    inside = lambda s: F.size(F.regexp_extract_all(F.substring(F.col("t"), s["from"] + 1, s["to"] - s["from"]), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1))
    return df.withColumn("spans", united).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + inside(s)))


def contaminated(share: int = 20) -> F.Column:
    """At least one hit, and hits are at least 1/share of the words."""
    return (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))


def excise(text: F.Column, spans: F.Column) -> F.Column:
    """The text without the code points of the (ascending, disjoint) spans."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["to"]))
    starts = F.concat(F.transform(spans, lambda s: s["from"]), F.array(F.length(text)))
    return F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(text, a + 1, b - a)), "")
