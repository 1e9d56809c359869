"""Vector expressions over arrays of numbers, and the hashing embedders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

DEFAULT_SEED, ORACLE_SEED = 0xC0FFEE, 0xBADCAFE


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0.0 if either vector is zero."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (na * nb))


def normalized(a: Column) -> Column:
    """Unit length; the zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def quantized(a: Column, bits: int) -> Column:
    """Symmetric per-vector quantisation, back in floating point; halves round to even."""
    top = float(2 ** (bits - 1) - 1)
    largest = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))

    def rounded(m: Column) -> Column:
        return F.when(m > 0, F.transform(a, lambda x: F.rint(x.cast("double") / (m / top)) * (m / top))).otherwise(F.transform(a, lambda x: x.cast("double")))

    return F.transform(F.array(largest), rounded)[0]  # the largest once for each vector, not once for each element


def md5_slots(tokens: Column) -> Column:
    """(bucket 0..255, sign) of each token: the family that plain SQL can repeat anywhere."""
    digit = lambda h, k: F.instr(F.lit("0123456789abcdef"), F.substring(h, k, 1)) - 1
    hashes = F.transform(tokens, lambda t: F.md5(t))  # once for each token
    return F.transform(hashes, lambda h: F.struct((digit(h, 1) * 16 + digit(h, 2)).alias("bucket"), F.when(digit(h, 3) % 2 == 0, 1).otherwise(-1).alias("sign")))


def token_slot(token: str, family: str, dim: int, seed: int) -> tuple[int, int]:
    """(bucket, sign) of a token under one of the BLAKE2b families.

    keyed64: 8-byte digest keyed by the seed, little-endian; bucket n % dim, sign from the top bit.
    keyed128: 16-byte keyed digest; bucket from the first 8 bytes, sign from the lowest bit of the ninth.
    plain: 8-byte digest without key, big-endian; sign from bit 8.
    """
    raw = token.encode()
    if family == "plain":
        n = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big")
        return n % dim, 1 if n >> 8 & 1 else -1
    d = hashlib.blake2b(raw, digest_size=8 if family == "keyed64" else 16, key=seed.to_bytes(8, "little")).digest()
    n = int.from_bytes(d[:8], "little")
    bit = n >> 63 & 1 if family == "keyed64" else d[8] & 1
    return n % dim, 1 if bit else -1


def blake_slots(tokens: Column, family: str = "keyed64", dim: int = 256, seed: int = DEFAULT_SEED) -> Column:
    """(bucket, sign) of each token by BLAKE2b, which has no built-in: an Arrow-batched function with a cache."""

    @pandas_udf("array<struct<bucket:int,sign:int>>")
    def slots(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, dict] = {}

        def one(t: str) -> dict:
            found = known.get(t)
            if found is None:
                if len(known) > 1 << 18:
                    known.clear()
                b, s = token_slot(t, family, dim, seed)
                found = known[t] = {"bucket": b, "sign": s}
            return found

        for batch in batches:
            yield batch.map(lambda ts: [one(t) for t in ts] if ts is not None else [])

    return slots(tokens)


def float32_digest(vectors: Column) -> Column:
    """BLAKE2b-128 of the little-endian float32 bytes of an array of arrays, row after row."""

    @pandas_udf("string")
    def digest(batch: pd.Series) -> pd.Series:
        import numpy as np

        return batch.map(lambda rows: hashlib.blake2b(np.asarray([list(r) for r in rows], "<f4").tobytes(), digest_size=16).hexdigest())

    return digest(vectors)
