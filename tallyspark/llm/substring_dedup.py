"""Exact substring dedup over fixed-length word windows.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Every window of 20 words gets a rolling (Rabin-Karp) hash.

1. Map: each chunk of documents finds its own repeats, and sends one entry per distinct hash (its
   earliest place in the chunk) to a bucket of the hash space, packed to about 9 bytes an entry. A
   passage that a third of all documents share is thus one entry per chunk, not one per document.
   A chunk is cut into at most 2**LEVEL_BITS buckets, whatever the input's size; where that leaves buckets too large, each
   is read by as many tasks as it needs and cut again by the next bits of the hash.
2. Count: a bucket of bounded size sorts its hashes; all entries of a hash that start later than its earliest one
   are repeats. Local repeats pass through.
3. Cut: repeated window starts, packed by a hash of the document, are dealt out with the texts and come first in the
   order of a part; then texts stream by, one at a time, and merge their starts into maximal intervals of words to
   remove.

Hashes have 64 bits; two different windows among n share one with a chance of about n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import EXACT, NONSPACE, cut_lineage, doc_of, ngrams, row_chunks, text_buffers, words

WINDOW = 20
#: Text bytes that a map task holds at once, that one bucket of hashes stands for, and that one part of texts has.
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
CUT_BYTES = 8 << 20
#: Bits of the hash by which a chunk is cut at once, and entries that a task of the second cut holds.
LEVEL_BITS = 12
CHUNK_ENTRIES = 1 << 20
#: Packed bytes of one Arrow batch from Python; larger ones are costly for the executor's direct memory.
SENT_BYTES = 1 << 20
LOWEST_ID = -(1 << 63)


def pack(a: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, so that high zero bytes lie together and compress away."""
    a = np.ascontiguousarray(a, "<u8")
    width = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
    return bytes([width]) + a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    width = b[0]
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def deltas(a: np.ndarray) -> bytes:
    """A non-descending sequence from its first value on, without that value."""
    a = a.astype(np.int64).view(np.uint64)
    return pack(a[1:] - a[:-1])


def undeltas(first: int, b: bytes) -> np.ndarray:
    out = np.concatenate([np.array([first], np.int64).view(np.uint64), unpack(b)])
    return np.cumsum(out, dtype=np.uint64).view(np.int64)


def _part_of(ids: np.ndarray, texts: np.ndarray, parts: int) -> np.ndarray:
    x = ids.astype(np.int64) ^ texts
    return (x ^ (x.view(np.uint64) >> np.uint64(17)).view(np.int64)) % parts


_SENT_PA = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("first", pa.int64()), ("base", pa.int64()), ("ids", pa.binary()), ("texts", pa.binary()), ("bases", pa.binary()), ("hashes", pa.binary()), ("places", pa.binary())])
_SENT = "bucket bigint, kind int, first bigint, base bigint, ids binary, texts binary, bases binary, hashes binary, places binary"
_FOUND_PA = pa.schema([("part", pa.int64()), ("first", pa.int64()), ("ids", pa.binary()), ("texts", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])
_FOUND = "part bigint, first bigint, ids binary, texts binary, counts binary, places binary"


def _raw(a: np.ndarray) -> bytes:
    """Hashes of texts; none where they are all 0, as they are where ids are unique."""
    return a.astype("<i8").tobytes() if a.any() else b""


def _unraw(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, "<i8") if b else np.zeros(n, np.int64)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins, in sorted columns."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _by_part(ids: np.ndarray, texts: np.ndarray, places: np.ndarray, parts: int) -> dict[str, list]:
    """Repeated starts (id, text, word), packed for each part of the documents."""
    part = _part_of(ids, texts, parts)
    order = np.lexsort((places, texts, ids, part))
    part, ids, texts, places = part[order], ids[order], texts[order], places[order]
    out: dict[str, list] = {f.name: [] for f in _FOUND_PA}
    edge = np.append(_starts(part), len(part))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        heads = _starts(ids[a:b], texts[a:b])
        out["part"].append(int(part[a]))
        out["first"].append(int(ids[a]))
        out["ids"].append(deltas(ids[a:b][heads]))
        out["texts"].append(_raw(texts[a:b][heads]))
        out["counts"].append(pack(np.diff(np.append(heads, b - a))))
        out["places"].append(pack(places[a:b]))
    return out


def _emit(h: np.ndarray, at: np.ndarray, ids: np.ndarray, texts: np.ndarray, bounds: np.ndarray, used: int, bits: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The earliest entry of each hash by buckets of the ``bits`` after the first ``used`` ones, and local repeats.

    Entries ascend by ``at``, a word's place among all documents, which ascend by (id, text) and begin at ``bounds``.
    """
    if not len(h):
        return
    same = (ids[1:] == ids[:-1]) & (texts[1:] == texts[:-1])
    if same.any():  # rows that repeat id and text are one document: windows at the same place tie
        row = doc_of(at, bounds)
        doc, pos = np.concatenate([[0], np.cumsum(~same)])[row], at - bounds[row]
        order = np.lexsort((pos, doc, h))
        doc, pos = doc[order], pos[order]
    else:
        order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.zeros(len(s), bool)
    first[_starts(s)] = True
    later = ~first
    if same.any():
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        later &= (doc != doc[head]) | (pos != pos[head])
    again = np.sort(at[order[later]])
    order = order[first]
    prefix = int(s[0]) >> (64 - used) if used else 0
    depth = used + bits
    limits = np.array([((prefix << bits) | b) << (64 - depth) for b in range(1 << bits)], np.uint64) if bits else np.zeros(1, np.uint64)
    edge = np.append(np.searchsorted(s[first], limits), len(order)).tolist()
    width = -(-(64 - depth) // 8)  # the bucket stands for the first bits
    out: dict[str, list] = {f.name: [] for f in _SENT_PA}
    size = 0
    for b in range(1 << bits):
        if edge[b] == edge[b + 1]:
            continue
        if size >= SENT_BYTES:
            yield pa.RecordBatch.from_pydict(out, _SENT_PA)
            out, size = {k: [] for k in out}, 0
        own = np.sort(order[edge[b] : edge[b + 1]])
        place = at[own]
        rows = np.arange(len(bounds)) if len(own) > len(bounds) else np.unique(doc_of(place, bounds))
        hashes = h[own].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
        values = ((prefix << bits) | b, 0, int(ids[rows[0]]), int(bounds[rows[0]]), deltas(ids[rows]), _raw(texts[rows]), deltas(bounds[rows]), hashes, pack(np.diff(place, prepend=0)))
        for name, v in zip(out, values, strict=True):
            out[name].append(v)
            size += len(v) if isinstance(v, bytes) else 0
    if len(again):
        row = doc_of(again, bounds)
        local = _by_part(ids[row], texts[row], again - bounds[row], parts)
        for part, head, i, x, c, p in zip(*local.values(), strict=True):
            for name, v in zip(out, ((prefix << bits) | part % (1 << bits), 1, head, part, i, x, c, b"", p), strict=True):
                out[name].append(v)
    yield pa.RecordBatch.from_pydict(out, _SENT_PA)


def _mapper(n: int, bits: int, parts: int, chunk_bytes: int):
    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """held: (ids, hashes of texts, words and windows of each document, hashes in order) of some pieces."""
        ids, texts, n_words, n_windows, h = (np.concatenate([x[j] for x in held]) for j in range(5))
        held.clear()
        by_id = np.lexsort((texts, ids))
        bounds = np.zeros(len(ids), np.int64)
        bounds[by_id[1:]] = np.cumsum(n_words[by_id])[:-1]
        at = np.repeat(bounds - np.cumsum(n_windows) + n_windows, n_windows) + np.arange(len(h))
        if (by_id[1:] < by_id[:-1]).any():  # places must ascend with the document
            order = np.argsort(at, kind="stable")
            h, at = h[order], at[order]
        yield from _emit(h, at, ids[by_id], texts[by_id], bounds[by_id], 0, bits, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for lo, hi in row_chunks(batch.column(2), 1 << 20, 1 << 16):
                data, offsets = text_buffers(batch.column(2).slice(lo, hi - lo))
                w = words(data, offsets, NONSPACE, EXACT)
                n_words = np.diff(w.bounds)
                held.append((batch.column(0).slice(lo, hi - lo).to_numpy(), batch.column(1).slice(lo, hi - lo).to_numpy(), n_words, np.maximum(n_words - n + 1, 0), ngrams(w, n)[1]))
                size += len(data)
                if size >= chunk_bytes:
                    yield from flush(held)
                    size = 0
        if held:
            yield from flush(held)

    return run


def _entries(r: dict, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, id, text, word) of a pack."""
    place = np.cumsum(unpack(r["places"]).astype(np.int64))
    base = undeltas(r["base"], r["bases"])
    row = doc_of(place, base)
    width = -(-(64 - depth) // 8)
    h = np.zeros((len(place), 8), np.uint8)
    h[:, :width] = np.frombuffer(r["hashes"], np.uint8).reshape(width, -1).T
    h = h.reshape(-1).view("<u8")
    if depth:
        h = (h & np.uint64((1 << (64 - depth)) - 1)) | np.uint64(r["bucket"] << (64 - depth))
    return h, undeltas(r["first"], r["ids"])[row], _unraw(r["texts"], len(base))[row], place - base[row]


def _splitter(used: int, bits: int, parts: int):
    """Cuts the packs of buckets of ``used`` bits by the next ``bits``; a bucket's packs lie together."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, i, x, p = (np.concatenate([e[j] for e in held]) for j in range(4))
        held.clear()
        order = np.lexsort((p, x, i))
        h, i, x, p = h[order], i[order], x[order], p[order]
        head = _starts(i, x)
        row = np.zeros(len(i), np.int64)
        row[head[1:]] = 1
        row = np.cumsum(row)
        longest = p[np.append(head[1:], len(p)) - 1] + 1
        bounds = np.concatenate([[0], np.cumsum(longest)[:-1]])
        yield from _emit(h, bounds[row] + p, i[head], x[head], bounds, used, bits, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, bucket = 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 1:
                    yield pa.RecordBatch.from_pylist([r | {"bucket": (r["bucket"] << bits) | r["base"] % (1 << bits)}], _SENT_PA)
                    continue
                if held and (r["bucket"] != bucket or size >= CHUNK_ENTRIES):
                    yield from flush(held)
                    size = 0
                bucket = r["bucket"]
                held.append(_entries(r, used))
                size += len(held[-1][0])
        if held:
            yield from flush(held)

    return run


def _counter(depth: int, parts: int):
    """One bucket: the entries of each hash but its earliest, and the local repeats that came along."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 1:
                    yield pa.RecordBatch.from_pydict({"part": [r["base"]], "first": [r["first"]], "ids": [r["ids"]], "texts": [r["texts"]], "counts": [r["bases"]], "places": [r["places"]]}, _FOUND_PA)
                    continue
                h, i, x, p = _entries(r, depth)
                held.append((h, i, x if x.any() else None, p.astype(np.uint32)))
        if not held:
            return
        h = np.concatenate([e[0] for e in held])
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = np.zeros(len(s), bool)
        same[1:] = s[1:] == s[:-1]
        same[:-1] |= same[1:]
        order = order[same]  # hashes that occur once are done with
        del s, same
        h, i, p = h[order], np.concatenate([e[1] for e in held])[order], np.concatenate([e[3] for e in held])[order].astype(np.int64)
        x = np.concatenate([np.zeros(len(e[0]), np.int64) if e[2] is None else e[2] for e in held])[order] if any(e[2] is not None for e in held) else np.zeros(len(order), np.int64)
        held.clear()
        order = np.lexsort((p, x, i, h))
        h, i, x, p = h[order], i[order], x[order], p[order]
        head = _starts(h)
        of = np.repeat(head, np.diff(np.append(head, len(h))))
        later = (i != i[of]) | (x != x[of]) | (p != p[of])
        if later.any():
            yield pa.RecordBatch.from_pydict(_by_part(i[later], x[later], p[later], parts), _FOUND_PA)

    return run


def _cutter(n: int, n_keep: int):
    """Rows of a part in order: packs of repeated starts, then texts, cut one at a time."""
    span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts: dict[tuple[int, int], np.ndarray] = {}
        part = None
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            kind, parts_ = column["kind"].to_numpy(), list(zip(column["part"].to_pylist(), column["piece"].to_pylist(), strict=True))
            at = 0
            while at < len(kind):
                if parts_[at] != part:
                    part, starts = parts_[at], {}
                if kind[at] == 0:
                    ids, counts = undeltas(column["first"][at].as_py(), column["ids"][at].as_py()), unpack(column["counts"][at].as_py()).astype(np.int64)
                    texts = _unraw(column["texts"][at].as_py(), len(ids))
                    for i, x, p in zip(ids.tolist(), texts.tolist(), np.split(unpack(column["places"][at].as_py()).astype(np.int64), np.cumsum(counts)[:-1]), strict=True):
                        mark = starts.get((i, x))
                        if mark is None or len(mark) <= p[-1]:
                            longer = np.zeros(max(int(p.max()) + 1, 0 if mark is None else 2 * len(mark)), bool)
                            if mark is not None:
                                longer[: len(mark)] = mark
                            mark = starts[i, x] = longer
                        mark[p] = True
                    at += 1
                    continue
                end = at
                while end < len(kind) and kind[end] == 1 and parts_[end] == part:
                    end += 1
                for lo, hi in row_chunks(column["t"].slice(at, end - at), 4 << 20, 4096):
                    rows = batch.slice(at + lo, hi - lo)
                    counts, removed, spans, kept = [], [], [], []
                    for i, x, text in zip(rows.column("i").to_pylist(), rows.column("x").to_pylist(), rows.column("t").to_pylist(), strict=True):
                        w = (text or "").encode().split()  # of bytes: splits at ASCII white space only
                        cover = np.zeros(len(w) + 1, np.int32)
                        mark = starts.get((i, x))
                        if mark is not None:
                            p = np.flatnonzero(mark[: max(0, len(w) - n + 1)])
                            cover[p] += 1
                            cover[p + n] -= 1
                        gone = np.cumsum(cover)[: len(w)] > 0
                        edge = np.flatnonzero(np.diff(gone.view(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
                        counts.append(len(w)), removed.append(sum(b - a for a, b in edge)), spans.append([{"from": a, "to": b} for a, b in edge])
                        begin, rest = 0, []
                        for a, b in [*edge, (len(w), len(w))]:
                            rest += w[begin:a]
                            begin = b
                        kept.append(b" ".join(rest).decode())
                    yield pa.RecordBatch.from_arrays([*(rows.column(f"k{j}") for j in range(n_keep)), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())], names=[*(f"k{j}" for j in range(n_keep)), "n_words", "n_removed", "removed", "kept_text"])
                at = end

    return run


def remove_repeats(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, cut_bytes: int = CUT_BYTES) -> DataFrame:
    """``keep`` plus n_words, n_removed, removed (word intervals from/to), kept_text (kept words, one space between).

    A word goes if a window over it has the same words as a window that starts earlier: at a smaller id,
    or in the same document further left. Null and empty texts have no words and are kept as empty. Rows that share an id,
    null ids too, are documents of their own in the order of a hash of their texts; rows that repeat both id and text
    are one document, whose windows tie, and are cut alike. A null id comes before all others; ids are whole numbers.
    Kept columns named like an output give way to it. Texts are read whole, however long.
    """
    outputs = ("n_words", "n_removed", "removed", "kept_text")
    keep = [c for c in keep if c.lower() not in outputs]
    spark = docs.sparkSession
    base = docs.select(*[F.col(f"`{c}`").alias(f"k{j}") for j, c in enumerate(keep)], F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LOWEST_ID)).alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    per = base.groupBy("i").agg(F.count("*").alias("rows"), F.sum(F.octet_length("t")).alias("bytes"))
    total, most = per.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.max("rows")).first()
    shared = (most or 0) > 1
    base = base.withColumn("x", F.xxhash64("t") if shared else F.lit(0).cast("bigint"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    depth = max(min(8, LEVEL_BITS), (-(-total // bucket_bytes)).bit_length(), min(tasks.bit_length(), LEVEL_BITS))
    parts = max(tasks, -(-total // cut_bytes))
    used = min(depth, LEVEL_BITS)
    sent = base.where("t is not null").select("i", "x", "t").mapInArrow(_mapper(window, used, parts, chunk_bytes), _SENT)
    while used < depth:  # buckets that are too large yet, each in as many pieces as it needs
        bits = min(LEVEL_BITS, depth - used)
        pieces = -(-total // (bucket_bytes << used))
        sent = sent.repartition(max(tasks, -(-total // (8 * bucket_bytes))), "bucket", F.pmod(F.xxhash64("places", "ids"), F.lit(pieces))).sortWithinPartitions("bucket")
        sent = sent.mapInArrow(_splitter(used, bits, parts), _SENT)
        used += bits
    found = cut_lineage(sent.groupBy("bucket").applyInArrow(_counter(depth, parts), _FOUND))
    part = F.expr(f"pmod((i ^ x) ^ shiftrightunsigned(i ^ x, 17), {parts}L)")  # as _part_of
    rows = base.withColumn("part", part)
    found, rows = _in_pieces(found, rows, cut_bytes) if shared else (found.withColumn("piece", F.lit(0)), rows.withColumn("piece", F.lit(0)))
    both = found.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    schema = ", ".join([f"k{j} {base.schema[f'k{j}'].dataType.simpleString()}" for j in range(len(keep))] + ["n_words bigint, n_removed bigint, removed array<struct<from:int,to:int>>, kept_text string"])
    out = both.repartition(parts, "part", "piece").sortWithinPartitions("part", "piece", "kind").mapInArrow(_cutter(window, len(keep)), schema)
    return out.select(*[F.col(f"k{j}").alias(c) for j, c in enumerate(keep)], *outputs)


def _in_pieces(found: DataFrame, rows: DataFrame, cut_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Deals the rows of documents that occur very often over several pieces of their part, each with the part's starts."""
    often = rows.groupBy("part", "i", "x").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("bytes")).where((F.col("n") > 1) & (F.col("bytes") > 2 * cut_bytes))
    often = cut_lineage(often.select("part", "i", "x", F.ceil(F.col("bytes") / cut_bytes).cast("int").alias("pieces")))
    if often.count() <= 100_000:
        often = F.broadcast(often)
    of_part = often.groupBy("part").agg(F.max("pieces").alias("pieces"))
    found = found.join(of_part, "part", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
    rows = rows.join(often, ["part", "i", "x"], "left").withColumn("piece", F.pmod(F.monotonically_increasing_id(), F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces")
    return found, rows
