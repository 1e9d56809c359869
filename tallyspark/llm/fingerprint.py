"""Document fingerprints by improved consistent weighted sampling.

Terms are words (ASCII letters without case, digits, non-ASCII characters) weighted by their counts; a text
without words but not empty is one term. For sample k a term with weight w draws r, c ~ Gamma(2, 1)
and b ~ U(0, 1) from a hash of (term, k), sets t = floor(ln w / r + b) and competes with
ln a = ln c - r (t - b) - r. The winning (term, t) is the sample, so two texts agree in a sample with
probability sum(min) / sum(max) of their weights: the generalised Jaccard similarity.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import EXACT, doc_of, mix, prefix, text_buffers, words, written, P_BYTE

SAMPLES = 128
_CHUNK_CHARS = 3 << 20
_ROWS_AT_ONCE = 1024


def weighted_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, weight) sorted by document and term."""
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    w = words(data, offsets)
    doc, term = doc_of(np.arange(len(w.hashes)), w.bounds), w.hashes
    bare = np.flatnonzero((np.diff(w.bounds) == 0) & (np.diff(offsets) > 0))
    if len(bare):
        whole = [mix(prefix(EXACT[data[offsets[d] : offsets[d + 1]]], P_BYTE)[-1:]) for d in bare]
        doc, term = np.concatenate([doc, bare]), np.concatenate([term, *whole])
    if not len(doc):
        return np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int)
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(first)
    return doc[at], term[at], np.diff(np.append(at, len(doc)))


_LN_UNIT = np.float32(64 * np.log(2))


def _gamma2(h: np.ndarray) -> np.ndarray:
    """-ln(u1 u2), a Gamma(2, 1) variate."""
    a = h.astype(np.uint32).astype(np.float32)  # both 32-bit halves, above 0 in units of 2**-32
    b = (h >> np.uint64(32)).astype(np.uint32).astype(np.float32)
    a += np.float32(0.5)
    b += np.float32(0.5)
    a *= b
    np.log(a, out=a)
    np.subtract(_LN_UNIT, a, out=a)
    return np.maximum(a, np.float32(1e-6), out=a)


def _competition(term: np.ndarray, weight: np.ndarray, samples: int) -> np.ndarray:
    """For each (term, weight) and sample: the order of ln a above 16 bits that stand for (term, t)."""
    k = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    h = term[:, None] * k[None, :]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    r = _gamma2(h)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    ln_a = np.log(_gamma2(h))
    h *= np.uint64(0xD6E8FEB86659FD93)
    b = (h >> np.uint64(40)).astype(np.uint32).astype(np.float32) * np.float32(2**-24)
    code = np.repeat((term >> np.uint64(48)).astype(np.int64)[:, None], samples, 1)
    many = np.flatnonzero(weight > 1)  # a term that occurs once has t = 0
    if len(many):
        t = np.floor(np.log(weight[many].astype(np.float32))[:, None] / r[many] + b[many])
        code[many] = (code[many] ^ (t.astype(np.int64) * 40503)) & 0xFFFF
        b[many] -= t
    b -= 1
    b *= r
    ln_a += b
    bits = ln_a.view(np.int32).astype(np.int64)
    bits ^= (bits >> 31) & 0x7FFFFFFF  # now ordered as the floats are
    bits <<= 16
    bits |= code
    return bits


def fingerprints(texts: list[str], samples: int = SAMPLES) -> np.ndarray:
    """A row of 16-bit samples for each text; rows of texts without terms are all zero."""
    out = np.zeros((len(texts), samples), np.uint16)
    doc, term, weight = weighted_terms(texts)
    if not len(doc):
        return out
    pair = mix(term + weight.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    _, at, row = np.unique(pair, return_index=True, return_inverse=True)
    table = np.concatenate([_competition(term[at[i : i + _ROWS_AT_ONCE]], weight[at[i : i + _ROWS_AT_ONCE]], samples) for i in range(0, len(at), _ROWS_AT_ONCE)])
    best = np.full((len(texts), samples), np.iinfo(np.int64).max)
    for i in range(0, len(row), _ROWS_AT_ONCE):
        d = doc[i : i + _ROWS_AT_ONCE]
        head = np.flatnonzero(np.diff(d, prepend=-1))
        least = np.minimum.reduceat(table[row[i : i + _ROWS_AT_ONCE]], head, axis=0)
        best[d[head]] = np.minimum(best[d[head]], least)
    has = np.unique(doc)
    out[has] = (best[has] & 0xFFFF).astype(np.uint16)
    return out


def encode(signature: np.ndarray, empty: bool) -> str:
    return "" if empty else base64.b64encode(signature.astype("<u2").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, a_empty: bool, b_empty: bool) -> float:
    """Share of equal samples; two empty texts are alike, an empty and another are not."""
    return float(a_empty and b_empty) if a_empty or b_empty else float((a == b).mean())


def edited_text(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Digests travel as bytes and become text at the end.
_FIELDS = [("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _sign_all(texts: list[str], samples: int) -> list[list]:
    """One row for each text but the last, which only serves as the one after."""
    n = len(texts) - 1
    edited = [edited_text(texts[j], texts[j + 1]) for j in range(n)]
    f = fingerprints(texts + edited, samples)
    own, new = f[: n + 1], f[n + 1 :]
    none = [not t for t in texts]
    none_new = [not t for t in edited]
    return [
        [len(t) for t in texts[:n]],
        [hashlib.sha256(t.encode()).digest() for t in edited],
        [b"" if none[j] else own[j].astype("<u2").tobytes() for j in range(n)],
        [b"" if none_new[j] else new[j].astype("<u2").tobytes() for j in range(n)],
        [likeness(own[j], new[j], none[j], none_new[j]) for j in range(n)],
        [likeness(own[j], own[j + 1], none[j], none[j + 1]) for j in range(n)],
    ]


#: Text bytes of a part, and the most parts: Spark draws 100 keys a part to find their bounds.
PART_BYTES = 32 << 20
MOST_PARTS = 50_000


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, part_bytes: int = PART_BYTES) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The next document is the one after in the order of (id, a hash of the text), null ids first, ids of any ordered
    type; after the last comes the first, so a single row is followed by itself. Rows that repeat id and text follow
    each other. A null text counts as empty; the fingerprint of an empty text is the empty string, like (1.0) only
    another empty one. Other columns are not read, whatever their names; an empty table gives no rows.

    Rows are dealt into parts by ranges of that order, and each part is read once in order. Only the last row of a part
    lacks its follower; it meets the first row of the next part in a join of one row a part.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").alias("i"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    total = base.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = min(MOST_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes)))
    # The row's number splits rows that repeat id and text; any order among these is the same.
    order = ["i", "h", "n"]
    dealt = base.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kind = dict(base.dtypes)["i"]
    made = ", ".join(f"{n} {'long' if t == pa.int64() else 'double' if t == pa.float64() else 'binary'}" for n, t in _FIELDS)
    numbered = dealt.select(F.spark_partition_id().alias("part"), "i", "t")
    done = written(numbered.mapInArrow(_in_order(samples), f"part int, i {kind}, {made}, head string, last string"))
    edge = done.where("last is not null").select("part", "i", "head", "last")
    after = edge.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next"))  # two numbers a part
    heads = edge.select(F.col("part").alias("next"), F.col("head").alias("following"))
    pairs = edge.select("part", "i", "last").join(after, "part").join(heads, "next").select("i", "last", "following")
    closed = pairs.mapInArrow(_pairs(samples), f"i {kind}, {made}")
    names = ["i", *[n for n, _ in _FIELDS]]
    out = done.where("last is null").select(*names).unionByName(closed)
    text = {"edited_sha256": F.lower(F.hex("edited_sha256"))} | {c: F.translate(F.base64(c), "\r\n", "") for c in ("fingerprint", "edited_fingerprint")}  # as ``encode``
    return out.select(F.col("i").alias(id_col), *[text.get(n, F.col(n)).alias(n) for n, _ in _FIELDS])


def _in_order(samples: int):
    """Signs the rows of a part but the last; one more row has the part's first and last texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, part, head = 0, None, None

        def batch_of(ids: list, columns: list[list], heads: list, lasts: list) -> pa.RecordBatch:
            values = [pa.array([part] * len(ids), pa.int32()), pa.array(ids, id_type), *(pa.array(v, t) for v, (_, t) in zip(columns, _FIELDS, strict=True)), pa.array(heads, pa.string()), pa.array(lasts, pa.string())]
            return pa.RecordBatch.from_arrays(values, names=["part", "i", *(n for n, _ in _FIELDS), "head", "last"])

        for batch in batches:
            id_type = batch.schema.field("i").type
            if batch.num_rows and part is None:
                part = batch.column("part")[0].as_py()
            for i, t in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist(), strict=True):
                head = t if head is None else head
                if size > _CHUNK_CHARS or len(ids) >= 2048:
                    yield batch_of(ids, _sign_all([*texts, t], samples), [None] * len(ids), [None] * len(ids))
                    ids, texts, size = [], [], 0
                ids.append(i), texts.append(t)
                size += len(t)
        if ids:
            if len(ids) > 1:
                yield batch_of(ids[:-1], _sign_all(texts, samples), [None] * (len(ids) - 1), [None] * (len(ids) - 1))
            yield batch_of(ids[-1:], [[None]] * len(_FIELDS), [head], texts[-1:])

    return run


def _pairs(samples: int):
    """Signs each row's last text by the text that follows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (t, following) in enumerate(zip(batch.column("last").to_pylist(), batch.column("following").to_pylist(), strict=True)):
                columns = _sign_all([t, following], samples)
                yield pa.RecordBatch.from_arrays([batch.column("i").slice(k, 1), *(pa.array(v, f) for v, (_, f) in zip(columns, _FIELDS, strict=True))], names=["i", *(n for n, _ in _FIELDS)])

    return run
