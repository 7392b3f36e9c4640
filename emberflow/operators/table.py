"""The embedding table: new rows, admission, LRU capacity, upserts, optimizer steps.

Schema: (sign, dim, emb, opt, last_access). A table is an immutable DataFrame;
every change gives a new one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Hyperparameters
from ..functions.optim import Optimizer
from ..functions.u64 import group_of, unsigned_order
from ..functions.vectors import clamped

TABLE = "sign long, dim int, emb array<float>, opt array<float>, last_access long"


def uniform01(*parts: Column) -> Column:
    """Deterministic value in [0, 1) of the given columns."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(2**53)


def initial_vector(sign: Column, dim: int, method: tuple[str, float, float]) -> Column:
    """Start weights seeded by the key: uniform(low, high), normal(mean, sd), gamma(shape, scale), poisson(rate, _)."""
    kind, a, b = method
    places = F.sequence(F.lit(1), F.lit(dim))
    if kind == "uniform":
        v = F.transform(places, lambda i: a + (b - a) * uniform01(sign, i))
    elif kind == "normal":
        v = F.transform(places, lambda i: a + b * F.sqrt(-2 * F.ln(1 - uniform01(sign, i))) * F.cos(2 * np.pi * uniform01(sign, i, F.lit("angle"))))
    elif kind in ("gamma", "poisson"):

        @F.pandas_udf("array<float>")
        def draw(keys: pd.Series) -> pd.Series:
            def one(k: int) -> np.ndarray:
                rng = np.random.default_rng(k & 0xFFFFFFFFFFFFFFFF)
                return (rng.gamma(a, b, dim) if kind == "gamma" else rng.poisson(a, dim)).astype(np.float32)

            return keys.map(one)

        return draw(sign)
    else:
        raise ValueError(f"unknown initialization {kind}")
    return v.cast("array<float>")


def new_rows(signs: DataFrame, dim: int, hyper: Hyperparameters, optimizer: Optimizer, seq: Column | int) -> DataFrame:
    """Rows for distinct unseen signs that pass admission, a hash of the key against the probability."""
    p = hyper.admit_probability
    admitted = signs if p >= 1 else signs.where(uniform01(F.col("sign"), F.lit("admission")) < p)
    last = F.lit(seq) if isinstance(seq, int) else seq
    return admitted.select("sign", F.lit(dim).alias("dim"), initial_vector(F.col("sign"), dim, hyper.initialization).alias("emb"), optimizer.initial_state(dim).alias("opt"), last.cast("long").alias("last_access"))


def touch(table: DataFrame, rows: DataFrame, dim: int, hyper: Hyperparameters, optimizer: Optimizer, seq: int) -> DataFrame:
    """The table after a training lookup of ``rows`` (with sign).

    Keys that are present become the most recent; unseen ones are admitted and
    started; rows of another width are started anew. One full join on sign.
    """
    asked = rows.select("sign").distinct().withColumn("asked", F.lit(True))
    joined = table.join(asked, "sign", "full")
    asked_for = F.coalesce("asked", F.lit(False))
    unseen = F.col("dim").isNull()
    stale = asked_for & (unseen | (F.col("dim") != dim))
    p = hyper.admit_probability
    refused = unseen & (uniform01(F.col("sign"), F.lit("admission")) >= p) if p < 1 else F.lit(False)
    start = initial_vector(F.col("sign"), dim, hyper.initialization)
    return joined.where(~refused).select(
        "sign",
        F.when(stale, F.lit(dim)).otherwise(F.col("dim")).alias("dim"),
        F.when(stale, start).otherwise(F.col("emb")).alias("emb"),
        F.when(stale, optimizer.initial_state(dim)).otherwise(F.col("opt")).alias("opt"),
        F.when(asked_for, F.lit(seq).cast("long")).otherwise(F.col("last_access")).alias("last_access"),
    )


def evict(table: DataFrame, capacity: int, shard: Column) -> DataFrame:
    """The ``capacity`` most recently used rows of every shard; ties keep the larger key.

    Shards are counted first, a row each; only the rows of those above capacity are ranked.
    """
    full = [r["__shard"] for r in table.groupBy(shard.alias("__shard")).count().where(F.col("count") > capacity).collect()]
    if not full:
        return table
    order = Window.partitionBy("__shard").orderBy(F.desc("last_access"), unsigned_order(F.col("sign")).desc())
    placed = table.withColumn("__shard", shard)
    over = F.col("__shard").isin(full)
    ranked = placed.where(over).withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= capacity)
    return placed.where(~over).drop("__shard").unionByName(ranked.drop("__shard", "__rank"))


def upsert(table: DataFrame, rows: DataFrame, seq: str = "last_access") -> DataFrame:
    """Union by key; of equal keys the row with the greatest ``seq`` stays, of ``rows`` at a tie."""
    cols = table.columns
    both = table.withColumn("__new", F.lit(0)).unionByName(rows.select(*cols).withColumn("__new", F.lit(1)))
    best = both.groupBy("sign").agg(F.max_by(F.struct(*[c for c in cols if c != "sign"]), F.struct(seq, "__new")).alias("r"))
    return best.select(*[F.col("sign") if c == "sign" else F.col(f"r.{c}").alias(c) for c in cols])


def apply_gradients(table: DataFrame, grads: DataFrame, optimizer: Optimizer, hyper: Hyperparameters, steps: Column | int = 1) -> DataFrame:
    """One optimizer step on the keys of ``grads`` (sign, grad), then the clamp; recency is unchanged.

    Keys that left the table are ignored (see missing_gradients).
    """
    joined = table.join(grads.select("sign", "grad"), "sign", "left")
    n = F.lit(steps) if isinstance(steps, int) else steps
    emb, opt = optimizer.step(F.col("emb"), F.col("opt"), F.col("grad"), n)
    emb = clamped(emb, hyper.weight_bound)
    some = F.col("grad").isNotNull()
    return joined.select("sign", "dim", F.when(some, emb).otherwise(F.col("emb")).cast("array<float>").alias("emb"), F.when(some, opt).otherwise(F.col("opt")).alias("opt"), "last_access")


def apply_per_feature(table: DataFrame, grads: DataFrame, features: list[str], optimizer: Optimizer, hyper: Hyperparameters, steps: Column | int = 1) -> DataFrame:
    """Features that share a key step one after another, in the given order."""
    for f in features:
        table = apply_gradients(table, grads.where(F.col("feature") == f), optimizer, hyper, steps)
    return table


def missing_gradients(table: DataFrame, grads: DataFrame) -> DataFrame:
    """Gradients whose key is not in the table."""
    return grads.join(table.select("sign"), "sign", "left_anti")


def group_steps(rows: DataFrame, bits: int) -> DataFrame:
    """(group, batch_id, step): running number of the batches in which a feature group occurs."""
    seen = rows.select(group_of(F.col("sign"), bits).alias("group"), "batch_id").distinct()
    return seen.withColumn("step", F.row_number().over(Window.partitionBy("group").orderBy("batch_id")))


def shard_sizes(table: DataFrame, shard: Column) -> DataFrame:
    """Rows per shard."""
    return table.groupBy(shard.alias("shard")).agg(F.count("*").alias("signs"))


def cleared(table: DataFrame) -> DataFrame:
    return table.where("false")


def vector_part(entry: Column, dim: int) -> Column:
    """Weights of an entry stored as weights followed by state."""
    return F.slice(entry, 1, dim)


def state_part(entry: Column, dim: int) -> Column:
    return F.slice(entry, F.lit(dim + 1), F.greatest(F.size(entry) - dim, F.lit(0)))
