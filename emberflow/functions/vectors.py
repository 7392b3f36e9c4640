"""Vectors as ARRAY<FLOAT>: wide sums, scaling, clamping, half precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

#: Largest finite half-precision value.
HALF_MAX = 65504.0


def dealt(df: DataFrame, *keys: str, total: int | None = None, rows: int = 250_000) -> DataFrame:
    """``df`` dealt by ``keys``, about ``rows`` to a task: more rows make more tasks, not larger ones.

    Dealing ids before a lookup lets the grouping by ``keys`` (or more columns)
    that follows do without an exchange of vectors. ``total``: the rows, if known.
    """
    total = df.count() if total is None else total
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-total // rows)), *keys)


def whole(v: Column) -> Column:
    """Missing elements as zero."""
    return F.transform(v, lambda x: F.coalesce(x, F.lit(0.0).cast("float")))


def sum_vectors(df: DataFrame, keys: list[str], vector: str, dim: int, *more: Column, out: str = "emb") -> DataFrame:
    """Group by ``keys`` and sum ``vector`` element by element, in double precision.

    One sum per element keeps partial aggregation in the hash aggregate; no list
    of vectors is ever collected. Missing vectors count as zero.
    """
    sums = [F.sum(F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"__v{i}") for i in range(dim)]
    made = df.groupBy(*keys).agg(*sums, *more)
    whole = F.array(*[F.coalesce(f"__v{i}", F.lit(0.0)) for i in range(dim)]).alias(out)
    rest = [c for c in made.columns if not c.startswith("__v")]
    return made.select(*rest, whole)


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def inverse_sqrt(n: Column) -> Column:
    """1 / sqrt(max(n, 1))."""
    return 1.0 / F.sqrt(F.greatest(n.cast("double"), F.lit(1.0)))


def clamped(v: Column, bound: float) -> Column:
    return F.transform(v, lambda x: F.greatest(F.lit(-bound), F.least(F.lit(bound), x))) if bound > 0 else v


def widen_half(v: Column) -> Column:
    """Infinities of a half-precision vector as its largest values."""
    return clamped(v, HALF_MAX)


@arrow_udf(T.ArrayType(T.FloatType()))
def half_rounded(v: pa.Array) -> pa.Array:
    """Round through half precision; null stays null."""
    flat = v.flatten()
    with np.errstate(over="ignore"):
        half = pa.array(flat.to_numpy(zero_copy_only=False).astype(np.float32).astype(np.float16).astype(np.float32), mask=flat.is_null().to_numpy(zero_copy_only=False))
    size = np.where(v.is_valid().to_numpy(zero_copy_only=False), v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), half, mask=v.is_null())


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def all_finite(v: Column) -> Column:
    """Whether every element is a finite number; a null vector counts as finite."""
    bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(v, bad), F.lit(True))


def any_nan(v: Column) -> Column:
    return F.coalesce(F.exists(v, F.isnan), F.lit(False))
