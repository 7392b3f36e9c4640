"""Slot and engine configuration: parsing, defaults, derived key ranges.

Unknown slots and groups that do not fit the prefix bits are errors here, before
any job runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most slots whose table is broadcast; a configuration has tens to hundreds.
MAX_SLOTS = 10_000


@dataclass(frozen=True)
class SlotConfig:
    """One feature: vector width, pooling and key range."""

    name: str
    dim: int
    sample_fixed_size: int = 10
    embedding_summation: bool = True
    sqrt_scaling: bool = False
    hash_stack_rounds: int = 0
    embedding_size: int = 0
    index_prefix: int = 0

    def __post_init__(self) -> None:
        if self.dim <= 0:
            raise ValueError(f"slot {self.name}: dim must be positive")
        if self.hash_stack_rounds and self.embedding_size <= 0:
            raise ValueError(f"slot {self.name}: hash stacking needs an embedding_size")


@dataclass(frozen=True)
class EmbeddingConfig:
    """All slots with derived prefixes."""

    slots: dict[str, SlotConfig]
    feature_index_prefix_bit: int = 8
    feature_groups: dict[str, list[str]] = field(default_factory=dict)

    def slot(self, name: str) -> SlotConfig:
        try:
            return self.slots[name]
        except KeyError:
            raise KeyError(f"feature {name!r} has no slot configuration") from None

    @property
    def key_bits(self) -> int:
        return 64 - self.feature_index_prefix_bit

    def frame(self, spark: SparkSession) -> DataFrame:
        """The slots as a small DataFrame to join on ``feature``."""
        if len(self.slots) > MAX_SLOTS:
            raise ValueError(f"more than {MAX_SLOTS} slots")
        rows = [(s.name, s.dim, s.embedding_summation, s.sqrt_scaling, s.hash_stack_rounds, s.embedding_size, signed(s.index_prefix), s.sample_fixed_size) for s in self.slots.values()]
        return spark.createDataFrame(rows, "feature string, dim int, pool_sum boolean, sqrt_scaling boolean, rounds int, emb_size long, prefix long, fixed int")


def signed(x: int) -> int:
    """Bit pattern of an unsigned 64-bit value as Spark's BIGINT."""
    return x - 2**64 if x >= 2**63 else x


def with_slots(df: DataFrame, config: EmbeddingConfig) -> DataFrame:
    """Join slot settings on ``feature``; a feature without a slot is an error."""
    slots = F.broadcast(config.frame(df.sparkSession))  # at most MAX_SLOTS rows
    joined = df.join(slots, "feature", "left")
    known = F.assert_true(F.col("dim").isNotNull(), F.concat(F.lit("no slot for feature "), F.col("feature")))
    return joined.withColumn("dim", F.when(known.isNull(), F.col("dim")))


def parse_embedding_config(raw: dict[str, Any]) -> EmbeddingConfig:
    """Slots from a mapping; ungrouped slots become groups of their own, after the explicit ones."""
    bits = int(raw.get("feature_index_prefix_bit", 8))
    if bits == 0:
        raise ValueError("feature_index_prefix_bit must not be 0")
    slots: dict[str, SlotConfig] = {}
    for name, s in raw["slots_config"].items():
        if s.get("index_prefix", 0):
            raise ValueError(f"slot {name}: index_prefix is derived")
        stack = s.get("hash_stack_config", {})
        plain = {k: v for k, v in s.items() if k in ("dim", "sample_fixed_size", "embedding_summation", "sqrt_scaling")}
        slots[name] = SlotConfig(name, hash_stack_rounds=stack.get("hash_stack_rounds", 0), embedding_size=stack.get("embedding_size", 0), **plain)
    groups = {k: list(v) for k, v in raw.get("feature_groups", {}).items()}
    grouped = [n for names in groups.values() for n in names]
    if len(grouped) != len(set(grouped)):
        raise ValueError("a slot stands in two feature groups")
    for name in grouped:
        if name not in slots:
            raise ValueError(f"feature group names unknown slot {name}")
    for name in slots:
        if name not in grouped:
            if name in groups:
                raise ValueError(f"slot {name} bears the name of a feature group")
            groups[name] = [name]
    if len(groups) >= 2**bits:
        raise ValueError(f"{len(groups)} feature groups need more than {bits} prefix bits")
    for at, names in enumerate(groups.values()):
        for name in names:
            slots[name] = replace(slots[name], index_prefix=(at + 1) << (64 - bits))
    return EmbeddingConfig(slots, bits, groups)


def load_yaml(path: str) -> dict[str, Any]:
    import yaml

    return yaml.safe_load(Path(path).read_text())


@dataclass(frozen=True)
class Hyperparameters:
    """How new rows start and how far weights may go."""

    initialization: tuple[str, float, float] = ("uniform", -0.01, 0.01)
    admit_probability: float = 1.0
    weight_bound: float = 10.0

    def __post_init__(self) -> None:
        if not 0 <= self.admit_probability <= 1:
            raise ValueError("admit_probability must be between 0 and 1")


@dataclass(frozen=True)
class EngineConfig:
    """Runtime settings with the documented defaults."""

    job_type: str = "train"
    forward_buffer_size: int = 1000
    buffered_data_expired_sec: int = 1000
    capacity: int = 1_000_000_000
    shards: int = 100
    incremental: bool = False
    staleness: int = 1
    max_batch_size: int = 65535

    def __post_init__(self) -> None:
        if self.job_type not in ("train", "eval", "infer"):
            raise ValueError(f"unknown job type {self.job_type}")


def parse_engine_config(raw: dict[str, Any]) -> EngineConfig:
    """Engine settings of a global configuration mapping; keys that are absent keep their defaults."""
    common, worker, server = (raw.get(k, {}) for k in ("common_config", "embedding_worker_config", "embedding_parameter_server_config"))
    found = {
        "job_type": str(common.get("job_type", "train")).lower(),
        "forward_buffer_size": worker.get("forward_buffer_size"),
        "buffered_data_expired_sec": worker.get("buffered_data_expired_sec"),
        "capacity": server.get("capacity"),
        "shards": server.get("num_hashmap_internal_shards"),
        "incremental": server.get("enable_incremental_update"),
    }
    return EngineConfig(**{k: v for k, v in found.items() if v is not None})
