"""Legibility of chunks: reading order by lagged line similarity, and table structure by cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text as T

ORDER_THRESHOLD, TABLE_THRESHOLD, SQUASH = 0.5, 0.5, 6.0


def _median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return F.when(n % 2 == 1, F.get(s, ((n - 1) / 2).cast("int")).cast("double")).otherwise((F.get(s, (n / 2 - 1).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2.0)


def _modal_share(a: Column) -> Column:
    """Share of the most frequent value (whichever of equals: the share is the same)."""
    share = lambda v: F.size(F.filter(a, lambda x: x == v))
    return F.when(F.size(a) > 0, F.array_max(F.transform(F.array_distinct(a), share)) / F.size(a)).otherwise(0.0)


def _share(a: Column, test) -> Column:
    return F.when(F.size(a) > 0, F.size(F.filter(a, test)) / F.size(a)).otherwise(0.0)


def looks_tabular(lines: Column) -> Column:
    """Judged by content, so that a collapsed table still counts: short, regular lines with numbers."""
    counts = F.transform(lines, lambda x: F.size(T.raw_tokens(x)))
    toks = F.flatten(F.transform(lines, T.raw_tokens))
    return F.coalesce((F.size(lines) >= 3) & (_median(counts) >= 3) & (_share(lines, lambda x: F.length(x) < 60) >= 0.6) & (_share(toks, lambda x: x.rlike(r"\p{Nd}")) >= 0.15) & (_modal_share(counts) >= 0.6), F.lit(False))


def cell_starts(line: Column) -> Column:
    """Where each cell of a line starts: sought left to right from the end of the cell before."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))

    def move(s: Column, c: Column) -> Column:
        rest = F.substring(line, s["at"] + 1, F.length(line))
        k = s["at"] + F.instr(rest, c) - 1
        return F.when(F.instr(rest, c) > 0, F.struct(F.concat(s["out"], F.array(k)).alias("out"), (k + F.length(c)).alias("at"))).otherwise(s)

    return F.aggregate(T.cells(line), start, move, lambda s: s["out"])


def table_score(lines: Column) -> Column:
    """0.5 share of lines with cells + 0.3 consistency of their number + 0.2 alignment of their starts."""
    counts = F.transform(lines, lambda x: F.size(T.cells(x)))
    multi = F.filter(counts, lambda c: c >= 2)
    starts = F.filter(F.transform(lines, cell_starts), lambda s: F.size(s) >= 2)

    def alignment(rows: Column) -> Column:
        every = F.flatten(F.transform(rows, lambda r: F.array_distinct(r)))
        hits = F.filter(F.array_distinct(every), lambda s: F.size(F.filter(every, lambda x: x == s)) >= 0.6 * F.size(rows))
        columns = _median(F.transform(rows, lambda r: F.size(r)))
        return F.when(F.size(rows) < 2, 0.0).otherwise(F.least(F.lit(1.0), F.size(hits) / F.when(columns > 0, columns)))

    return 0.5 * _share(counts, lambda c: c >= 2) + 0.3 * _modal_share(multi) + 0.2 * F.coalesce(T.let(starts, alignment), F.lit(0.0))


def order_margins(chunks: DataFrame, slots) -> DataFrame:
    """The chunks with margin in place of lines: mean cosine of neighbouring lines less that of lines two apart.

    ``chunks`` has lines, an array of strings. margin is null under four lines and for chunks without any word; a line
    without words is like no other. A chunk is judged inside its row, in integer sums: nothing is shuffled or joined.
    """
    import numpy as np
    import pyarrow as pa

    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))
    kept = [c for c in chunks.columns if c != "lines"]
    per = chunks.select(*kept, F.when(F.size("lines") >= 4, F.transform("lines", words)).otherwise(F.array().cast("array<array<string>>")).alias("__words"))
    made = per.select(*kept, F.transform("__words", F.size).alias("__counts"), slots(F.flatten("__words")).alias("__slots"))

    def judge(batches):
        for batch in batches:
            counts, pairs = batch.column("__counts"), batch.column("__slots")
            per_row = np.diff(counts.offsets.to_numpy())
            row = np.repeat(np.arange(len(per_row)), per_row)  # of each line
            flat = pairs.flatten()
            bucket, sign = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("bucket", "sign"))
            width = int(bucket.max()) + 1 if len(bucket) else 1
            line = np.repeat(np.arange(len(row)), counts.flatten().to_numpy())
            key, place = np.unique(line * width + bucket, return_inverse=True)
            w = np.bincount(place, sign, len(key))
            key, w = key[w != 0], w[w != 0]
            line = key // width
            square = np.bincount(line, w * w, len(row))
            margin = np.zeros(len(per_row))
            for step, of in ((1, 1.0), (2, -1.0)):
                at = np.minimum(np.searchsorted(key, key + step * width), max(len(key) - 1, 0))
                same = key[at] == key + step * width
                dots = np.bincount(line[same], w[same] * w[at[same]], len(row))
                first = np.flatnonzero(dots)
                first = first[row[first] == row[np.minimum(first + step, len(row) - 1)]]
                cosine = dots[first] / np.sqrt(square[first] * square[first + step])
                margin += of * np.bincount(row[first], cosine, len(per_row)) / np.maximum(per_row - step, 1)
            some = np.bincount(row, square, len(per_row)) > 0
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(margin, mask=~some)], [*kept, "margin"])

    return made.mapInArrow(judge, T.schema_with(chunks.select(*kept), "margin double"))


def score(chunks: DataFrame, slots) -> DataFrame:
    """(id, order_score, order_margin, order_applicable, table_score, table_applicable, legible, reasons) over (id, text).

    ``slots`` maps an array of tokens to (bucket, sign) structs. Tabular content is judged by its cells only.
    """
    base = chunks.select("id", T.lines(F.col("text")).alias("lines"))
    facts = base.select("id", "lines", F.size("lines").alias("n"), looks_tabular(F.col("lines")).alias("table_applicable"))
    facts = facts.withColumn("table_score", F.when(F.col("table_applicable"), table_score(F.col("lines"))).otherwise(1.0))
    out = order_margins(facts.withColumn("lines", F.when(~F.col("table_applicable"), F.col("lines"))), slots)
    applies = ~F.col("table_applicable") & (F.col("n") >= 4)
    out = out.withColumn("order_applicable", applies).withColumn("order_margin", F.when(F.col("order_applicable"), F.coalesce("margin", F.lit(0.0))).otherwise(0.0))
    out = out.withColumn("order_score", F.when(F.col("order_applicable"), 0.5 + 0.5 * F.tanh(SQUASH * F.col("order_margin"))).otherwise(1.0))
    reasons = F.filter(F.array(F.when(F.col("order_applicable") & (F.col("order_score") < ORDER_THRESHOLD), F.lit("reading-order scramble")), F.when(F.col("table_applicable") & (F.col("table_score") < TABLE_THRESHOLD), F.lit("collapsed table structure"))), lambda r: r.isNotNull())
    out = out.withColumn("reasons", reasons)
    return out.select("id", "order_score", "order_margin", "order_applicable", "table_score", "table_applicable", (F.size("reasons") == 0).alias("legible"), "reasons")


def split(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined)."""
    return scored.where("legible"), scored.where("not legible")
