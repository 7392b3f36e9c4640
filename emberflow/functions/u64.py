"""Unsigned 64-bit keys kept as BIGINT bit patterns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf


def u64_mod(x: Column, n: Column | int) -> Column:
    """Unsigned ``x % n`` for n below 2**62, in the JVM."""
    n = F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")
    half = F.shiftrightunsigned(x, 1) % n
    return (half * 2 + x.bitwiseAND(F.lit(1))) % n


def key_in_range(x: Column, prefix: Column, bits: int) -> Column:
    """Move a key into its group's range: ``x % (2**(64 - bits) - 1)`` under the prefix.

    The remainder is a fold of the high bits onto the low ones; the prefix is a
    multiple of the range, so the two are joined by OR. A zero prefix leaves x.
    """
    if not 2 <= bits <= 32:
        raise ValueError("prefix bits must be between 2 and 32")
    wide = 64 - bits
    space = (1 << wide) - 1
    fold = x.bitwiseAND(F.lit(space)) + F.shiftrightunsigned(x, wide)
    return F.when(prefix != 0, (fold % space).bitwiseOR(prefix)).otherwise(x)


def group_of(x: Column, bits: int) -> Column:
    """Feature group of a key: its high bits."""
    return F.shiftrightunsigned(x, 64 - bits)


def unsigned(x: Column) -> Column:
    """The value as DECIMAL(20,0), for display."""
    d = x.cast("decimal(20,0)")
    return F.when(x < 0, d + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def unsigned_order(x: Column) -> Column:
    """A BIGINT that sorts as the unsigned value does."""
    return x.bitwiseXOR(F.lit(-(2**63)))


def farmhash64_np(x: np.ndarray) -> np.ndarray:
    """The published FarmHash64 of the eight little-endian bytes of each value."""
    u = np.uint64
    x = x.astype(np.int64, copy=False).view(np.uint64)
    k2 = u(0x9AE16A3B2F90404F)  # fixed value of the published algorithm
    mul = k2 + u(16)
    rot = lambda v, n: (v >> u(n)) | (v << u(64 - n))
    a, b = x + k2, x
    c = rot(b, 37) * mul + a
    d = (rot(a, 25) + b) * mul
    h = (c ^ d) * mul
    h ^= h >> u(47)
    h = (d ^ h) * mul
    h ^= h >> u(47)
    return h * mul


@pandas_udf(T.LongType())
def farmhash64(x: pd.Series) -> pd.Series:
    return pd.Series(farmhash64_np(x.to_numpy(np.int64)).view(np.int64))


def shard_of(x: Column, shards: int) -> Column:
    """Owner of a key among ``shards``."""
    return u64_mod(farmhash64(x), shards).cast("int")


@arrow_udf(T.ArrayType(T.LongType()))
def hash_stack(x: pa.Array, rounds: pa.Array, size: pa.Array) -> pa.Array:
    """Buckets of a key, one a round; the key itself where rounds is 0."""
    keys, n, m = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (x, rounds, size))
    most = int(n.max(initial=0))
    out = np.repeat(keys[:, None], max(most, 1), axis=1)
    h = keys
    for r in range(most):
        h = farmhash64_np(h).view(np.int64)
        has = n > r
        out[has, r] = (h[has].view(np.uint64) % m[has].astype(np.uint64)).astype(np.int64) + r * m[has]
    width = np.maximum(n, 1)
    ends = np.concatenate(([0], np.cumsum(width))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out[np.arange(out.shape[1]) < width[:, None]]))
