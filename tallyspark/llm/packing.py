"""Sequence packing as a cutting-stock problem.

A document's ids are cut into full sequences and a remainder shorter than a sequence. The histogram of
remainder lengths, in classes of UNIT tokens, is all that reaches the driver. A linear program over
patterns (how many remainders of each class share a sequence) is solved by column generation: the
revised simplex method prices new patterns with a knapsack dynamic program. Rounded-down pattern
counts, and first-fit patterns for what rounding leaves, are laid out over the ranks of the remainders
within their class: a remainder's sequence follows from its class and rank alone. What the rounding up to
classes leaves open at the end of sequences is filled with cuts from some full sequences' worth of ids.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import cut_lineage

LENGTH = 2048
UNIT = 8
END_ID = 1
#: The linear program stops within this share of its optimum.
GAP = 0.001
#: One full piece in so many keeps its ids, so that it can be cut into fillers.
FILLER_SHARE = 8
#: Rows that one task ranks at once, about, and the least number of slices that a class is ranked in.
RANK_ROWS = 100_000
LEAST_SLICES = 32


# ---------------------------------------------------------------- linear program


def best_pattern(price: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable pattern of the sizes."""
    value, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(size)
    s, p = size[order], price[order]
    for w in range(1, capacity + 1):
        k = int(np.searchsorted(s, w, "right"))
        value[w] = value[w - 1]
        if k:
            v = value[w - s[:k]] + p[:k]
            j = int(v.argmax())
            if v[j] > value[w] + 1e-12:
                value[w], pick[w] = v[j], order[j]
    pattern, w = np.zeros(len(size), np.int64), capacity
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            pattern[pick[w]] += 1
            w -= size[pick[w]]
    return float(value[capacity]), pattern


def invert(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivoting; small matrices, without threads of a linear algebra library."""
    m = len(a)
    w = np.hstack([a.astype(float), np.eye(m)])
    for j in range(m):
        k = j + int(np.abs(w[j:, j]).argmax())
        w[[j, k]] = w[[k, j]]
        w[j] /= w[j, j]
        f = w[:, j].copy()
        f[j] = 0
        w -= f[:, None] * w[j]
    return w[:, m:]


def times(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (a * v).sum(1)


def solve(size: np.ndarray, demand: np.ndarray, capacity: int, most: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns and their (fractional) counts that meet the demand exactly with the fewest sequences."""
    m = len(size)
    exact, demand = demand.astype(float), demand + 1e-5 * np.arange(1, m + 1) / m  # perturbed: no ties, no cycling
    basis = np.diag(capacity // size).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    x = times(inverse, demand)
    for it in range(most):
        if it % 200 == 199:  # rounding errors don't pile up
            inverse = invert(basis)
            x = times(inverse, demand)
        dual = inverse.sum(0)
        worth, column = best_pattern(np.maximum(dual, 0), size, capacity)
        total = x.sum()
        if worth <= 1 + GAP or math.ceil(total / worth - 1e-3) >= math.ceil(total - 1e-3):  # no solution is below total / worth
            break
        step = times(inverse, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x -= ratio[out] * step
        x[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        basis[:, out] = column
    x = times(invert(basis), exact)
    return [(basis[:, j].astype(np.int64), float(x[j])) for j in range(m) if x[j] > 1e-9]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole patterns ({class: items}, count) that hold exactly the items of the histogram."""
    size = np.array(sorted(k for k, v in histogram.items() if v), np.int64)
    if not len(size):
        return []
    left = np.array([histogram[int(k)] for k in size], np.int64)
    out: Counter = Counter()
    for pattern, x in sorted(solve(size, left, capacity), key=lambda p: -p[1]):
        n = int(x + 1e-6)
        n = min([n, *(left[pattern > 0] // pattern[pattern > 0])])
        if n > 0:
            out[tuple(pattern)] += n
            left -= n * pattern
    bins: list[tuple[int, Counter]] = []  # first fit by falling size: at most a few items per basic pattern are left
    room: list[int] = []
    for j in range(len(size) - 1, -1, -1):
        for _ in range(int(left[j])):
            at = next((b for b, r in enumerate(room) if r >= size[j]), None)
            if at is None:
                at = len(room)
                room.append(capacity)
                bins.append((at, Counter()))
            room[at] -= int(size[j])
            bins[at][1][j] += 1
    for _, items in bins:
        out[tuple(items.get(j, 0) for j in range(len(size)))] += 1
    return [({int(size[j]): int(a) for j, a in enumerate(p) if a}, int(n)) for p, n in sorted(out.items(), reverse=True)]


# ---------------------------------------------------------------- tokens


@lru_cache(maxsize=2)
def load_encoder(json_path: str):
    """text -> uint32 ids, as ``tokenizers`` gives them for this file (add_special_tokens=False).

    The same vocabulary as ranks (``.tiktoken`` beside the ``.json``) is several times faster and gives equal ids;
    texts that hold a special token's string, and files without ranks, go to ``tokenizers`` itself.
    """
    import os

    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    slow = Tokenizer.from_file(json_path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    plain = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    ranks_path = json_path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return plain
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    probe = "A prōbe, it's 42\n\n  of <both>."
    if list(fast.encode_ordinary(probe)) != plain(probe).tolist():
        return plain
    return lambda text: plain(text) if any(s in text for s in special) else np.array(fast.encode_ordinary(text), np.uint32)


_PIECE = "id {id}, start bigint, length bigint, crc bigint, doc_tokens bigint, ids binary"


def _piece_maker(json_path: str, length: int, end_id: int, share: int):
    def run(batches):
        encode = load_encoder(json_path)
        for batch in batches:
            kind = batch.schema.field(0).type
            out: list[list] = [[] for _ in range(6)]
            size = 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), length):
                    raw = ids[at : at + length].tobytes()
                    crc = zlib.crc32(raw)
                    full = len(raw) == 4 * length
                    keep = raw if full and crc % share == 0 else None
                    for column, v in zip(out, (i, at, len(raw) // 4, crc, len(ids), keep), strict=True):
                        column.append(v)
                    size += len(keep or b"") + 50
                if size > 1 << 22:
                    yield _batch(out, kind)
                    out, size = [[] for _ in range(6)], 0
            if out[0]:
                yield _batch(out, kind)

    def _batch(out: list[list], kind: pa.DataType) -> pa.RecordBatch:
        types = (kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["id", "start", "length", "crc", "doc_tokens", "ids"])

    return run


# ---------------------------------------------------------------- layout


def ranked(df: DataFrame, key: str, order: list[str], row: str, rows: int) -> DataFrame:
    """Adds rank 0.. within the key, however many rows a key has: salted counts, then ranks within a salt.

    ``row`` is a number of the row, which also deals out rows that are equal in ``order``.
    """
    salts = max(LEAST_SLICES, -(-rows // RANK_ROWS))
    df = df.withColumn("salt", F.pmod(F.xxhash64(*order, row), F.lit(salts)))
    counts = df.groupBy(key, "salt").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy(key).orderBy("salt")) - F.col("c")).drop("c")
    inner = F.row_number().over(Window.partitionBy(key, "salt").orderBy(*order, row)) - 1
    return df.withColumn("inner", inner).join(before, [key, "salt"]).withColumn("rank", F.col("inner") + F.col("before")).drop("inner", "before", "salt")


def pack(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, unit: int = UNIT, share: int = FILLER_SHARE) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every row's document (a null text is empty and has the end id alone) lies in exactly one piece;
    pieces of a sequence follow each other without gap from offset 0. Rows that repeat an id are documents
    of their own. An empty table gives no pieces. ids_crc32 is of the piece's ids as little-endian uint32. Texts are
    encoded whole, however long; documents of equal length are laid out in the order of their ids' hashes; other
    columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    pieces = cut_lineage(source.mapInArrow(_piece_maker(tokenizer_json, length, end_id, share), _PIECE.format(id=kind)))
    # Classes: remainders by length rounded up to units; -1 full pieces that can be cut, -2 other full pieces.
    cls = F.when(F.col("length") < length, F.ceil(F.col("length") / unit)).when(F.col("ids").isNotNull(), -1).otherwise(-2).cast("int")
    pieces = pieces.withColumn("class", cls).withColumn("row", F.monotonically_increasing_id())  # of the checkpoint, so always the same
    histogram = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}  # at most length/unit + 2 rows
    if not histogram:
        return pieces.select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    patterns = plan({k: v for k, v in histogram.items() if k > 0}, length // unit)
    layout, used, sequence = [], Counter(), 0
    for items, n in patterns:
        for c, a in items.items():
            layout.append((c, used[c], used[c] + n * a, a, sequence))
            used[c] += n * a
        sequence += n
    order = ["id", "start", "crc", "doc_tokens"]
    placed = ranked(pieces.drop("ids"), "class", order, "row", sum(histogram.values()))
    placed = cut_lineage(placed.withColumn("cut", F.col("class") == -1))
    rest = placed.where("class > 0")
    grid = spark.createDataFrame(layout or [(0, 0, 0, 1, 0)], "class int, low bigint, high bigint, per bigint, first bigint")
    hit = (F.col("p.class") == F.col("g.class")) & (F.col("p.rank") >= F.col("g.low")) & (F.col("p.rank") < F.col("g.high"))
    rest = rest.alias("p").join(F.broadcast(grid.alias("g")), hit).select("p.id", "p.start", "p.length", "p.crc", "p.doc_tokens", (F.col("g.first") + F.floor((F.col("p.rank") - F.col("g.low")) / F.col("g.per"))).cast("bigint").alias("sequence_id"))
    in_order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "id", "start", "crc")
    rest = cut_lineage(rest.withColumn("offset", F.sum("length").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")))

    # Slack of each sequence as an interval of one long filler stream; a two-level running sum.
    open_ = rest.groupBy("sequence_id").agg(F.sum("length").alias("used")).where(F.col("used") < length).withColumn("slack", length - F.col("used"))
    open_ = open_.withColumn("block", F.floor(F.col("sequence_id") / 65536))
    blocks = open_.groupBy("block").agg(F.sum("slack").alias("s"))
    blocks = blocks.withColumn("base", F.sum("s").over(Window.orderBy("block")) - F.col("s")).drop("s")  # one row for 65,536 sequences
    inside = F.sum("slack").over(Window.partitionBy("block").orderBy("sequence_id")) - F.col("slack")
    open_ = cut_lineage(open_.withColumn("inside", inside).join(F.broadcast(blocks), "block").withColumn("at", F.col("base") + F.col("inside")).select("sequence_id", "used", "slack", "at"))
    need = open_.agg(F.coalesce(F.sum("slack"), F.lit(0))).first()[0]
    cuttable = histogram.get(-1, 0)
    taken = min(cuttable, -(-need // length))
    # An interval overlaps at most two fillers: plain arithmetic instead of a range join.
    first = F.struct((F.col("at") / length).cast("bigint").alias("filler"), (F.col("at") % length).alias("from"), F.least("slack", length - F.col("at") % length).alias("n"), F.col("used").alias("offset"))
    second = F.struct(((F.col("at") / length).cast("bigint") + 1).alias("filler"), F.lit(0).cast("bigint").alias("from"), (F.col("slack") - F.least("slack", length - F.col("at") % length)).alias("n"), (F.col("used") + F.least("slack", length - F.col("at") % length)).alias("offset"))
    cuts = open_.select("sequence_id", F.explode(F.array(first, second)).alias("c")).select("sequence_id", "c.*").where((F.col("n") > 0) & (F.col("filler") < taken))
    spare = (-need) % length if taken == -(-need // length) and need else 0
    tail, at = [], length - spare
    for bit in reversed(range(spare.bit_length())):
        if spare >> bit & 1:  # powers of two need no padding
            tail.append((sequence + len(tail), taken - 1, at, 1 << bit, 0))
            at += 1 << bit
    cuts = cuts.select("sequence_id", "filler", "from", "n", "offset")
    if tail:
        cuts = cuts.unionByName(spark.createDataFrame(tail, "sequence_id bigint, filler bigint, `from` bigint, n bigint, offset bigint"))
    sequence += len(tail)
    fillers = placed.where(F.col("cut") & (F.col("rank") < taken)).select(*order, "row", F.col("rank").alias("filler"))
    fillers = fillers.join(pieces.where("class = -1").select("row", "ids"), "row")
    cut = cuts.join(fillers, "filler").select(
        "id", (F.col("start") + F.col("from")).alias("start"), F.col("n").alias("length"), F.expr("crc32(substring(ids, cast(4 * `from` + 1 as int), cast(4 * n as int)))").alias("crc"), "doc_tokens", "sequence_id", "offset"
    )
    full = placed.where((F.col("class") == -2) | (F.col("cut") & (F.col("rank") >= taken)))
    number = F.when(F.col("cut"), F.col("rank") - taken).otherwise(F.col("rank") + (cuttable - taken)) + sequence
    full = full.select("id", "start", "length", "crc", "doc_tokens", number.cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    out = rest.unionByName(cut).unionByName(full)
    return out.select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
