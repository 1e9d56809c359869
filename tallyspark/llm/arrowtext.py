"""Arrow plumbing and vectorised text hashing shared by the operators.

Texts are handled as UTF-8 bytes in numpy. Hashes of words and of word n-grams come from prefix sums
of ``table[byte] * P**position`` modulo 2**64; multiplying by the inverse power makes them independent
of the position, so equal byte strings hash alike on every executor.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
CHUNK_ROWS = 512


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a fresh local one only where none is configured and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, and is computed once however often it is read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage`` by way of compressed columns, for wide rows of which later steps read some columns."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- Arrow in, Arrow out


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(col: pa.Array, most_bytes: int = CHUNK_BYTES, most_rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int]]:
    """Row ranges of bounded bytes; a single longer text is a range of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    lo = 0
    while lo < len(sizes):
        hi = int(np.searchsorted(total, total[lo] + most_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), lo + most_rows, len(sizes))
        yield lo, hi
        lo = hi


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[pa.Array], list]],
    outputs: list[tuple[str, str]],
    keep: list[str],
    text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Rows of ``keep`` plus the columns that ``make()(texts)`` returns, a chunk of rows at a time.

    One narrow stage: only ``keep`` and the text travel to Python. A kept column whose name (in any
    case) is also an output's gives way to the output.
    """
    taken = {n.lower() for n, _ in outputs}
    keep = [c for c in keep if c.lower() not in taken]
    quoted = lambda c: F.col(f"`{c}`")
    sent = df.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], quoted(text_col).cast("string").alias("t"))
    schema = ", ".join([f"k{f.name[1:]} {f.dataType.simpleString()}" for f in sent.schema.fields[:-1]] + [f"o{i} {t}" for i, (_, t) in enumerate(outputs)])
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            texts = batch.column(n_keep)
            for lo, hi in row_chunks(texts, chunk_bytes, chunk_rows):
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in fn(texts.slice(lo, hi - lo))]
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(n_keep)]
                yield pa.RecordBatch.from_arrays(kept + made, names=[f"k{i}" for i in range(n_keep)] + [f"o{i}" for i in range(len(made))])

    out = sent.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"o{i}").alias(n) for i, (n, _) in enumerate(outputs)])


# ---------------------------------------------------------------- hashing


def _inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


P_BYTE, P_WORD = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_powers: dict[int, np.ndarray] = {}


def powers(p: int, n: int) -> np.ndarray:
    """p**0 .. p**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(p)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1024)
        a = np.full(size, p, np.uint64)
        a[0] = 1
        have = _powers[p] = np.multiply.accumulate(a)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (fixed public constants)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _byte_table(lower: bool) -> np.ndarray:
    t = np.random.Generator(np.random.PCG64(20240)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        t[ord("A") : ord("Z") + 1] = t[ord("a") : ord("z") + 1]
    return t


EXACT, LOWER = _byte_table(False), _byte_table(True)

#: Word bytes: ASCII letters and digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALNUM[_a:_b] = True
#: Anything but ASCII white space (space, tab to carriage return).
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False


class Words(NamedTuple):
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # one past its last byte
    bounds: np.ndarray  # words of document d: bounds[d] .. bounds[d+1]-1
    hashes: np.ndarray  # uint64


def prefix(values: np.ndarray, p: int) -> np.ndarray:
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers(p, len(values)), out=out[1:])
    return out


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = ALNUM, table: np.ndarray = LOWER) -> Words:
    """Words of the documents whose bytes lie end to end in ``data``; none spans two documents."""
    n = len(data)
    if not n:
        return Words(*(np.zeros(0, np.int64),) * 2, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    w = is_word[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = w[edges]
    last[edges - 1] = w[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    c = prefix(table[data], P_BYTE)
    h = (c[ends] - c[starts]) * powers(_inverse(P_BYTE), n)[starts]
    return Words(starts, ends, np.searchsorted(starts, offsets), mix(h))


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of n words of one document, in order."""
    m = len(w.hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    if n == 1:
        return at, w.hashes
    c = prefix(w.hashes, P_WORD)
    return at, mix((c[at + n] - c[at]) * powers(_inverse(P_WORD), len(w.hashes) + 1)[at])


def doc_of(at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The document of each word index."""
    return np.searchsorted(bounds, at, "right") - 1


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from concatenated values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
