"""Order-dependent operators: global numbering, batches, routing, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch


def ranged(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt into ranges of ``keys``, in order, with ``__range`` and ``__at``, the place in the range.

    One exchange into as many ranges of nearly equal rows as the session shuffles
    into, by Spark's own sample of the keys; the result is written, as a second
    evaluation might draw other ranges.
    """
    row = F.monotonically_increasing_id()
    made = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__row", row)
    made = made.withColumns({"__range": F.shiftright("__row", 33).cast("int"), "__at": F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__row")
    path = scratch(df.sparkSession, "ranges")
    made.write.parquet(path)
    return df.sparkSession.read.schema(made.schema).parquet(path)


def below(sizes: dict[int, int]) -> Column:
    """What stands before each range, by ``__range``; ``sizes`` has one entry a range."""
    out, total = [], 0
    for i in range(max(sizes, default=-1) + 1):
        out.append(total)
        total += sizes.get(i, 0)
    return F.get(F.array(*[F.lit(x).cast("long") for x in out or [0]]), F.col("__range"))


def numbered(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    """``df`` with the 0-based position of each row in the order of ``key`` (unique).

    Rows are numbered within ranges in parallel and shifted by the counts of the
    ranges before; no task sorts the whole table.
    """
    rows = ranged(df, key)
    sizes = {r["__range"]: r["n"] for r in rows.groupBy("__range").agg(F.count("*").alias("n")).collect()}  # a row per range
    return rows.withColumn(out, below(sizes) + F.col("__at")).drop("__range", "__at")


def sliced(df: DataFrame, key: str, batch_size: int, drop_last: bool = False) -> DataFrame:
    """``df`` cut into mini-batches in the order of ``key``: batch_id and sample."""
    rows = numbered(df, key, "__n")
    if drop_last:
        rows = rows.where(F.col("__n") < rows.count() // batch_size * batch_size)  # of what is written
    return rows.withColumns({"batch_id": F.expr(f"__n DIV {int(batch_size)}"), "sample": (F.col("__n") % batch_size).cast("int")}).drop("__n")


def global_batch_id(seq: Column, replica: Column | int, replicas: int) -> Column:
    """Ids that do not meet: local sequence times replicas plus replica."""
    return seq * replicas + replica


def routed(df: DataFrame, world: int) -> DataFrame:
    """Co-locate batches with the rank that takes them."""
    return df.withColumn("rank", F.pmod("batch_id", F.lit(world)).cast("int")).repartition(world, "rank")


def round_robin(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def in_batch_order(df: DataFrame) -> DataFrame:
    """By batch id, a missing one first as 0."""
    return df.orderBy(F.coalesce("batch_id", F.lit(0)))


def chunked(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` with one of ``n`` chunks of nearly equal rows, in the order of ``key``."""
    rows = numbered(df, key, "__n")
    total = max(rows.count(), 1)
    return rows.withColumn("chunk", F.expr(f"__n * {int(n)} DIV {int(total)}").cast("int")).drop("__n")


def every_nth(step: Column, n: int) -> Column:
    return step % n == 0
