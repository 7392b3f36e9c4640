"""Model and dataflow metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import below, ranged


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve, ties at half, as one row ``auc``.

    Rows are counted by score, the scores dealt into ranges of nearly equal
    numbers, accumulated within these and shifted by the totals of the ranges
    before, so scores that gather in one place make no large task.
    """
    s, y = F.col(score).cast("double"), F.col(label).cast("int")
    per = ranged(scored.groupBy(s.alias("s")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n")), "s")
    totals = {r["__range"]: r["n"] for r in per.groupBy("__range").agg(F.sum("n").alias("n")).collect()}  # a row per range
    inner = Window.partitionBy("__range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    under = below(totals) + F.coalesce(F.sum("n").over(inner), F.lit(0))
    wins = F.sum(F.col("p") * (F.col("under") + F.col("n") / 2))
    return per.withColumn("under", under).agg((wins / (F.sum("p").cast("double") * F.sum("n"))).alias("auc"))


def batch_accuracy(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Mean over batches of the share of rounded scores that equal the label (half to even)."""
    hit = (F.bround(F.col(score), 0) == F.col(label)).cast("double")
    return scored.groupBy("batch_id").agg(F.avg(hit).alias("a")).agg(F.avg("a").alias("accuracy"))


def log_loss(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Mean over batches of the mean binary cross-entropy; logarithms end at -100."""
    p, y = F.col(score).cast("double"), F.col(label).cast("double")
    ln = lambda x: F.when(x > 0, F.greatest(F.ln(x), F.lit(-100.0))).otherwise(-100.0)
    each = -(y * ln(p) + (1 - y) * ln(1 - p))
    return scored.groupBy("batch_id").agg(F.avg(each).alias("l")).agg(F.avg("l").alias("log_loss"))


def delay_seconds(emitted_at: Column) -> Column:
    """Age of an incremental packet."""
    return F.unix_timestamp() - F.unix_timestamp(emitted_at)


def observed_lookup(found: DataFrame, name: str) -> DataFrame:
    """``found`` reporting requests, misses and distinct signs while it runs, without another job."""
    return found.observe(name, F.count("*").alias("requests"), F.count_if("miss").alias("misses"), F.approx_count_distinct("sign").alias("distinct_signs"))


def pending(half_a: DataFrame, half_b: DataFrame, keys: list[str]) -> DataFrame:
    """Batches of which only the first half has come."""
    return half_a.select(*keys).distinct().join(half_b.select(*keys), keys, "left_anti")
