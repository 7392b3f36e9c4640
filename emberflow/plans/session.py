"""The engine session: ingest, lookup, train, infer, save and load around one table."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import EmbeddingConfig, EngineConfig, Hyperparameters
from ..functions import optim
from ..functions.optim import Adagrad, Optimizer
from ..functions.u64 import shard_of
from ..functions.vectors import all_finite
from ..model import Logistic, LossScale
from ..operators import features, grads, lookup, table
from ..sources import batches as sources
from ..sources.checkpoint import Generations, Store, load_table, save_table
from ..sources.scratch import scratch
from ..streaming import flows

_CURRENT: list[EmberSession] = []
KEPT = 8


@dataclass
class EmberSession:
    """Context manager; the innermost is ``current()``. ``table`` holds rows of one vector width.

    Every change of the table is written as a generation below ``spark.checkpoint.dir``,
    so its plan is one scan after any number of steps. ``KEPT`` generations stay: what a
    lookup returned can be used during the next three steps.
    """

    spark: SparkSession
    slots: EmbeddingConfig
    table: DataFrame
    engine: EngineConfig = field(default_factory=EngineConfig)
    hyper: Hyperparameters = field(default_factory=Hyperparameters)
    optimizer: Optimizer = field(default_factory=Adagrad)
    model: Logistic | None = None
    seq: int = 0
    loss_scale: LossScale | None = None
    generations: Generations | None = None

    def __enter__(self) -> EmberSession:
        _CURRENT.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        _CURRENT.remove(self)

    def configure(self, hyper: Hyperparameters | None = None, optimizer: Optimizer | None = None) -> None:
        self.hyper, self.optimizer = hyper or self.hyper, optimizer or self.optimizer

    def _dim(self, names: Sequence[str]) -> int:
        dims = {self.slots.slot(n).dim for n in names}
        if len(dims) != 1:
            raise ValueError(f"features {list(names)} differ in width; look them up apart")
        return dims.pop()

    def ingest(self, df: DataFrame, ids: Sequence[str], dense: Sequence[str] = (), labels: Sequence[str] = (), meta: str | None = None) -> DataFrame:
        for n in ids:
            self.slots.slot(n)
        train = self.engine.job_type == "train"
        return sources.make_batches(df, ids, dense, labels, meta, requires_grad=train)

    def signs(self, batches: DataFrame, names: Sequence[str]) -> DataFrame:
        return features.to_signs(features.explode_ids(batches, list(names)), self.slots)

    def lookup(self, batches: DataFrame, names: Sequence[str], half: bool = True, train: bool | None = None) -> DataFrame:
        """Sum-pooled vectors of the features; in training unseen keys are started and recency moves on."""
        dim = self._dim(names)
        rows = self.signs(batches, names)
        if train if train is not None else self.engine.job_type == "train":
            self.seq += 1
            self._publish(table.touch(self.table, rows, dim, self.hyper, self.optimizer, self.seq))
            kept = self._evicted(self.table)
            if kept is not self.table:
                self._publish(kept)
        return self._pooled(batches, names, rows, self.table, half)

    def _publish(self, changed: DataFrame) -> None:
        if self.generations is None:
            self.generations = Generations(self.spark, scratch(self.spark, "session-table"), KEPT)
        self.generations.publish(changed)
        self.table = self.generations.read()

    def _evicted(self, rows: DataFrame) -> DataFrame:
        """Within capacity; ``rows`` itself if no shard is above it."""
        per_shard = max(1, self.engine.capacity // self.engine.shards)
        return table.evict(rows, per_shard, shard_of(F.col("sign"), self.engine.shards))

    def _pooled(self, batches: DataFrame, names: Sequence[str], rows: DataFrame, of: DataFrame, half: bool = True) -> DataFrame:
        dim = self._dim(names)
        rounds = {n: self.slots.slot(n).hash_stack_rounds for n in names}
        counts = features.id_counts(batches, list(names), rounds)
        found = lookup.lookup(rows, of, dim)
        scaled = [n for n in names if self.slots.slot(n).sqrt_scaling]
        plain = [n for n in names if n not in scaled]
        parts = [lookup.sum_pooled(found.where(F.col("feature").isin(own)), dim, counts.where(F.col("feature").isin(own)), bool(own is scaled), half) for own in (scaled, plain) if own]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def raw_lookup(self, batches: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Distinct rows and padded index of a feature that is not summed."""
        slot = self.slots.slot(name)
        rows = self.signs(batches, [name])
        return lookup.raw_pooled(rows, self.table, slot.dim, slot.sample_fixed_size, slot.hash_stack_rounds)

    def prepare_features(self, batches: DataFrame, names: Sequence[str], dense: Sequence[str], label: str | None, mode: str = "train") -> DataFrame:
        """Model rows: embeddings side by side after the dense columns; labels unless inferring."""
        return self._model_rows(batches, names, dense, label if mode != "infer" else None, self.lookup(batches, names, train=mode == "train"))

    def _model_rows(self, batches: DataFrame, names: Sequence[str], dense: Sequence[str], label: str | None, pooled: DataFrame) -> DataFrame:
        wide = lookup.concat_features(pooled, list(names))
        keep = [label] if label else []
        base = batches.select("batch_id", "sample", F.array(*[F.col(c).cast("float") for c in dense]).alias("dense"), *keep)
        return base.join(wide, ["batch_id", "sample"]).withColumn("x", F.concat("dense", "emb"))

    def apply_gradients(self, batches: DataFrame, names: Sequence[str], sample_grads: DataFrame, per_feature: bool = False) -> DataFrame:
        """Back to the keys and one optimizer step; returns the touched signs."""
        changed, signs = self._stepped(self.table, batches, names, sample_grads, self.seq, per_feature)
        if changed is not self.table:
            self._publish(changed)
        return signs

    def sample_gradients(self, rows: DataFrame, names: Sequence[str], dense: Sequence[str], label: str) -> DataFrame:
        """(batch_id, feature, sample, grad, scale): the model's gradient by the embeddings of ``prepare_features``, times the loss scale."""
        if self.model is None:
            raise ValueError("the session has no model")
        dim, scale = self._dim(names), self.loss_scale.scale if self.loss_scale else 1.0
        whole = rows.select("batch_id", "sample", self.model.input_gradient(F.col("x"), F.col(label), scale).alias("g"))
        parts = F.array(*[F.struct(F.lit(n).alias("feature"), F.slice("g", len(dense) + 1 + i * dim, dim).alias("grad")) for i, n in enumerate(names)])
        return whole.select("batch_id", "sample", F.explode(parts).alias("r")).select("batch_id", "r.feature", "sample", "r.grad", F.lit(scale).alias("scale"))

    def train_step(self, batches: DataFrame, names: Sequence[str], dense: Sequence[str], label: str) -> DataFrame:
        """Lookup, the model's gradients, optimizer step; returns the touched signs."""
        rows = self.prepare_features(batches, names, dense, label)
        return self.apply_gradients(batches, names, self.sample_gradients(rows, names, dense, label))

    def train_stream(self, batches: DataFrame, names: Sequence[str], dense: Sequence[str], label: str, generations: Generations, checkpoint: str, **how) -> StreamingQuery:
        """``train_step`` on every micro-batch of a stream, on the table of ``generations``; ``how`` as in ``flows.train_stream``.

        The staleness is that of the engine's settings unless given.
        """

        def step(batch: DataFrame, seen: DataFrame, current: DataFrame, epoch: int) -> tuple[DataFrame, DataFrame]:
            rows, dim = self.signs(batch, names), self._dim(names)
            touched = self._evicted(table.touch(current, rows, dim, self.hyper, self.optimizer, epoch + 1))
            view = touched if seen is current else table.touch(seen, rows, dim, self.hyper, self.optimizer, epoch + 1)
            x = self._model_rows(batch, names, dense, label, self._pooled(batch, names, rows, view))
            return self._stepped(touched, batch, names, self.sample_gradients(x, names, dense, label), epoch + 1)

        return flows.train_stream(batches, step, generations, checkpoint, **({"staleness": self.engine.staleness} | how))

    def _stepped(self, before: DataFrame, batches: DataFrame, names: Sequence[str], sample_grads: DataFrame, seq: int, per_feature: bool = False) -> tuple[DataFrame, DataFrame]:
        """The table after one step, and the touched signs. With a loss scale, a step with a gradient that is not finite is left out."""
        if self.loss_scale:
            finite = sample_grads.agg(F.bool_and(all_finite(F.col("grad"))).alias("finite")).first()["finite"] is not False
            self.loss_scale.update(finite)
            if not finite:
                return before, self.signs(batches, names).select("sign").where("false")
        dim = self._dim(names)
        rows = self.signs(batches, names)
        good = grads.usable(sample_grads)
        if "scale" in good.columns:
            good = grads.unscaled(good)
        rounds = {n: self.slots.slot(n).hash_stack_rounds for n in names}
        scaled = [n for n in names if self.slots.slot(n).sqrt_scaling]
        if scaled:
            counts = features.id_counts(batches, list(names), rounds)
            good = grads.sqrt_scaled(good.where(F.col("feature").isin(scaled)), counts).unionByName(good.where(~F.col("feature").isin(scaled)))
        summed = grads.grads_per_sign(rows, good.select(*features.SAMPLE, "grad"), dim, per_feature)
        if per_feature:
            after = table.apply_per_feature(before, summed, list(names), self.optimizer, self.hyper, max(seq, 1))
        else:
            after = table.apply_gradients(before, summed, self.optimizer, self.hyper, max(seq, 1))
        return after, summed.select("sign")

    def infer(self, batches: DataFrame, names: Sequence[str], dense: Sequence[str]) -> DataFrame:
        """(batch_id, sample, score); misses are zeros and nothing changes."""
        if self.model is None:
            raise ValueError("the session has no model")
        rows = self.prepare_features(batches, names, dense, None, "infer")
        return rows.select("batch_id", "sample", self.model.score(F.col("x")).alias("score"))

    def infer_payloads(self, payloads: DataFrame, schema: str, names: Sequence[str], dense: Sequence[str]) -> DataFrame:
        """Serving: (batch_id, response), scores of a serialized batch one a line."""
        scored = self.infer(sources.from_payload(payloads, schema), names, dense)
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("sample", "score"))), lambda x: x["score"].cast("string"))
        return scored.groupBy("batch_id").agg(F.array_join(ordered, "\n").alias("response"))

    def save(self, path: str) -> None:
        """Table, dense model, optimizer with its settings, hyper-parameters, steps so far and loss scale."""
        save_table(self.table, f"{path}/embedding", self.engine.shards)
        if self.model:
            Store(self.spark, path).write("model.json", self.model.to_json())
        state = {"optimizer": optim.to_dict(self.optimizer), "hyper": asdict(self.hyper), "seq": self.seq, "loss_scale": asdict(self.loss_scale) if self.loss_scale else None}
        Store(self.spark, path).write("session.json", json.dumps(state))

    def load(self, path: str, merge: bool = False) -> None:
        store = Store(self.spark, path)
        if store.exists("model.json"):
            self.model = Logistic.from_json(store.read("model.json"))
        if store.exists("session.json"):
            state = json.loads(store.read("session.json"))
            if state["optimizer"] != optim.to_dict(self.optimizer):
                self.optimizer = optim.from_dict(state["optimizer"])
            self.hyper = Hyperparameters(**(state["hyper"] | {"initialization": tuple(state["hyper"]["initialization"])}))
            self.seq = state["seq"]
            self.loss_scale = LossScale(**state["loss_scale"]) if state["loss_scale"] else None
        self.table = load_table(self.spark, f"{path}/embedding", self.engine.shards, self.table if merge else None)

    def sizes(self) -> DataFrame:
        return table.shard_sizes(self.table, shard_of(F.col("sign"), self.engine.shards))

    def clear(self) -> None:
        self.table = table.cleared(self.table)


def current() -> EmberSession:
    if not _CURRENT:
        raise RuntimeError("no session is active")
    return _CURRENT[-1]
