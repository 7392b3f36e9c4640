"""From nested id features to keyed rows: explode, deduplicate, count, hash, prefix, shard.

Long form: (batch_id, feature, sample, col, id); ``col`` is the position of the
id within its sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EmbeddingConfig, with_slots
from ..functions.u64 import hash_stack, key_in_range, shard_of, unsigned_order

SAMPLE = ["batch_id", "feature", "sample"]


def explode_ids(samples: DataFrame, features: list[str], keep_empty: bool = False) -> DataFrame:
    """Rows of all id features. Array columns are multi-id, long columns single-id.

    All features go through one projection, so one exchange serves them later.
    """
    kinds = dict(samples.dtypes)
    for f in features:
        if kinds[f] not in ("array<bigint>", "bigint"):
            raise TypeError(f"feature {f} must be bigint or array<bigint>, not {kinds[f]}")
    listed = [F.struct(F.lit(f).alias("feature"), (F.col(f) if kinds[f].startswith("array") else F.array(F.col(f))).alias("ids")) for f in features]
    wide = samples.select("batch_id", "sample", F.explode(F.array(*listed)).alias("f"))
    burst = F.posexplode_outer if keep_empty else F.posexplode
    return wide.select("batch_id", F.col("f.feature").alias("feature"), "sample", burst("f.ids").alias("col", "id"))


def id_counts(samples: DataFrame, features: list[str], rounds: dict[str, int] | None = None) -> DataFrame:
    """(batch_id, feature, sample, n): ids of each sample, empty ones too, times the hash rounds."""
    kinds = dict(samples.dtypes)
    size = lambda f: F.size(f) if kinds[f].startswith("array") else F.lit(1)
    times = lambda f: max((rounds or {}).get(f, 0), 1)
    listed = [F.struct(F.lit(f).alias("feature"), (size(f) * times(f)).cast("long").alias("n")) for f in features]
    return samples.select("batch_id", "sample", F.explode(F.array(*listed)).alias("f")).select("batch_id", F.col("f.feature").alias("feature"), "sample", F.col("f.n").alias("n"))


def dedup(ids: DataFrame, keys: tuple[str, ...] = ("batch_id", "feature")) -> DataFrame:
    """A row per distinct id of a batch and feature, with its positions (bounded by the batch)."""
    return ids.groupBy(*keys, "id").agg(F.collect_list(F.struct("sample", "col")).alias("positions"))


def dense_index(ids: DataFrame, keys: tuple[str, ...] = ("batch_id", "feature"), start: int = 0) -> DataFrame:
    """``ids`` with distinct_idx: ordinal of the id among the distinct ones, in unsigned order."""
    order = Window.partitionBy(*keys).orderBy(unsigned_order(F.col("id")))
    return ids.withColumn("distinct_idx", (F.dense_rank().over(order) + (start - 1)).cast("long"))


def truncated(ids: DataFrame, fixed: Column | int) -> DataFrame:
    """The first ``fixed`` ids of each sample."""
    return ids.where(F.col("col") < fixed)


def stacked(ids: DataFrame, config: EmbeddingConfig) -> DataFrame:
    """Ids replaced by their hash buckets, one row a round, where the slot says so."""
    rows = with_slots(ids, config)
    some = any(s.hash_stack_rounds for s in config.slots.values())
    if not some:
        return rows
    return rows.withColumn("id", F.explode(hash_stack("id", "rounds", "emb_size")))


def prefixed(rows: DataFrame, config: EmbeddingConfig) -> DataFrame:
    """``sign`` from ``id``: moved to the key range of the feature's group."""
    return rows.withColumn("sign", key_in_range(F.col("id"), F.col("prefix"), config.feature_index_prefix_bit))


def to_signs(ids: DataFrame, config: EmbeddingConfig) -> DataFrame:
    """Hash-stack, then prefix; keeps the slot columns."""
    return prefixed(stacked(ids, config), config)


def sharded(rows: DataFrame, shards: int, key: str = "sign") -> DataFrame:
    """``rows`` with their shard, co-located by it and grouped within each partition."""
    return rows.withColumn("shard", shard_of(F.col(key), shards)).repartition(shards, "shard").sortWithinPartitions("shard")


def unique_rate(ids: DataFrame, keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """Distinct ids over ids, per feature."""
    each = ids.groupBy(*keys, "id").agg(F.count("*").alias("n"))  # two plain aggregations, no expand
    return each.groupBy(*keys).agg((F.count("*") / F.sum("n")).alias("unique_rate"))


def distinct_estimate(ids: DataFrame, keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """Mergeable sketch estimate of the distinct ids (2**16 registers)."""
    return ids.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_sketch_agg("id", 16)).alias("distinct_ids"))
