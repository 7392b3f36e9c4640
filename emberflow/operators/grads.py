"""Gradients back to keys: skip, widen, unscale, sum per sign."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import any_nan, inverse_sqrt, scaled, sum_vectors, widen_half
from .features import SAMPLE

FLOAT_EPS = 1.1920929e-07


def nan_features(grads: DataFrame) -> DataFrame:
    """(batch_id, feature) whose gradient holds a NaN: the whole feature is skipped for the batch."""
    return grads.groupBy("batch_id", "feature").agg(F.bool_or(any_nan(F.col("grad"))).alias("bad")).where("bad").select("batch_id", "feature")


def usable(grads: DataFrame) -> DataFrame:
    """Gradients of features that are neither skipped by the sender nor hold a NaN."""
    sent = grads.where(~F.coalesce("skipped", F.lit(False))) if "skipped" in grads.columns else grads
    return sent.join(nan_features(sent), ["batch_id", "feature"], "left_anti")


def skip_counts(grads: DataFrame) -> DataFrame:
    """Per feature: batches skipped for NaN and batches skipped by the sender."""
    per = grads.groupBy("batch_id", "feature").agg(F.bool_or(any_nan(F.col("grad"))).alias("nan"), F.bool_and(F.coalesce("skipped", F.lit(False))).alias("skip"))
    return per.groupBy("feature").agg(F.count_if("nan").alias("nan_batches"), F.count_if("skip").alias("skipped_batches"))


def unscaled(grads: DataFrame, scale: str = "scale") -> DataFrame:
    """Infinities of half precision to its largest values, then the loss scale taken off."""
    s = F.col(scale).cast("double")
    ok = F.assert_true((s > 0) & (1 / s < float("inf")), "the loss scale has no finite reciprocal")
    by = F.when(F.abs(s - 1) > FLOAT_EPS, 1 / s).otherwise(1.0)
    return grads.withColumn("grad", F.when(ok.isNull(), scaled(widen_half(F.col("grad")), by)))


def sqrt_scaled(grads: DataFrame, counts: DataFrame) -> DataFrame:
    """Sum-pooled gradients over sqrt(max(n, 1)), as the forward pass scaled them."""
    joined = grads.join(counts.select(*SAMPLE, "n"), SAMPLE)
    return joined.withColumn("grad", scaled(F.col("grad"), inverse_sqrt(F.col("n")))).drop("n")


def raw_scaled(grads: DataFrame, rounds: int) -> DataFrame:
    return grads.withColumn("grad", scaled(F.col("grad"), F.lit(rounds**-0.5))) if rounds > 0 else grads


def grads_per_sign(rows: DataFrame, grads: DataFrame, dim: int, per_feature: bool = False, table: DataFrame | None = None) -> DataFrame:
    """Sum of the sample gradients over all occurrences of a key: the transpose of sum pooling.

    One row per sign, or per (feature, sign) where features of a group shall
    step one after another. All batches given are one step. With ``table`` only
    its keys are summed: a step on it ignores all others (see missing_gradients).
    """
    if table is not None:
        rows = rows.join(table.select("sign"), "sign", "left_semi")
    joined = rows.select(*SAMPLE, "sign").join(grads.select(*SAMPLE, "grad"), SAMPLE)
    keys = ["feature", "sign"] if per_feature else ["sign"]
    return sum_vectors(joined, keys, "grad", dim, out="grad")


def raw_index_add(index_grads: DataFrame, dim: int) -> DataFrame:
    """(batch_id, feature, distinct_idx, grad): sums over positions, the padding row dropped."""
    return sum_vectors(index_grads.where("distinct_idx <> 0"), ["batch_id", "feature", "distinct_idx"], "grad", dim, out="grad")


def dense_mean(parts: DataFrame, dim: int) -> DataFrame:
    """Element-wise mean of per-worker dense gradients (all-reduce)."""
    sums = sum_vectors(parts.withColumn("__one", F.lit(1)), ["__one"], "grad", dim, F.count("*").alias("n"), out="grad")
    return sums.select(scaled(F.col("grad"), 1 / F.col("n")).alias("grad"))
