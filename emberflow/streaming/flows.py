"""Streams over the embedding table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.checkpoint import Generations, apply_packet, write_packet


def file_source(spark, path: str, schema: str, files_per_batch: int = 10) -> DataFrame:
    """Unbounded source of Parquet batches; the rate limit stands for a bounded queue."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def join_halves(ids: DataFrame, dense: DataFrame, expire_seconds: int = 1000) -> DataFrame:
    """Inner join of the two halves of batches on (batcher_idx, ref_id), each used once.

    Both carry ``sent_at``; a half whose other does not come within
    ``expire_seconds`` leaves the state.
    """
    delay = f"{expire_seconds} seconds"
    a = ids.withWatermark("sent_at", delay).dropDuplicatesWithinWatermark(["batcher_idx", "ref_id"]).alias("a")
    b = dense.withWatermark("sent_at", delay).dropDuplicatesWithinWatermark(["batcher_idx", "ref_id"]).alias("b")
    near = F.expr(f"b.sent_at BETWEEN a.sent_at - INTERVAL {expire_seconds} SECONDS AND a.sent_at + INTERVAL {expire_seconds} SECONDS")
    both = a.join(b, (F.col("a.batcher_idx") == F.col("b.batcher_idx")) & (F.col("a.ref_id") == F.col("b.ref_id")) & near)
    return both.select("a.*", *[F.col(f"b.{c}").alias(c) for c in dense.columns if c not in ids.columns])


def reorder(batches: DataFrame, world: int, stall_ms: int = 1000) -> DataFrame:
    """(rank, batch_id, payload) of each rank in order of batch_id.

    A batch waits until its predecessor (batch_id - world) was released; after a
    stall all that wait are released in order.
    """

    def release(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, ids, payloads = state.get if state.exists else (int(key[0]), [], [])
        waiting = sorted(zip(ids, payloads, strict=True))
        for pdf in pdfs:
            waiting += list(zip(pdf["batch_id"].tolist(), pdf["payload"].tolist(), strict=True))
        waiting.sort()
        out = []
        while waiting and (state.hasTimedOut or waiting[0][0] <= expected):
            out.append(waiting.pop(0))
            expected = out[-1][0] + world
        state.update((expected, [w[0] for w in waiting], [w[1] for w in waiting]))
        if waiting:
            state.setTimeoutDuration(stall_ms)
        yield pd.DataFrame({"rank": int(key[0]), "batch_id": [o[0] for o in out], "payload": [o[1] for o in out]})

    keyed = batches.withColumn("rank", F.pmod("batch_id", F.lit(world)))
    return keyed.groupBy("rank").applyInPandasWithState(release, "rank long, batch_id long, payload string", "expected long, ids array<long>, payloads array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def train_stream(batches: DataFrame, step: Callable[[DataFrame, DataFrame, DataFrame, int], tuple[DataFrame, DataFrame]], generations: Generations, checkpoint: str, staleness: int = 1, packets: str | None = None, gauge: Callable[[str, float], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """Run ``step(batch, seen, current, epoch) -> (new table, touched signs)`` on every micro-batch.

    The new table is published under the epoch's number before the epoch
    commits, so a repeated epoch writes the same generation again: exactly once.
    With staleness K a lookup sees the table ``seen`` of K - 1 generations before,
    so K are kept, and one more for a repeated epoch; gradients are applied to
    ``current`` (the same object if K is 1), so no step is lost. ``gauge`` gets the
    generations between the two. With ``packets`` the touched rows are published
    for servers.
    """
    if generations.keep <= staleness:
        raise ValueError(f"staleness {staleness} needs more than {staleness} generations kept, not {generations.keep}")

    def run(batch: DataFrame, epoch: int) -> None:
        held = batch.persist()
        try:
            current = generations.read(upto=epoch)  # the same at a repetition
            seen = generations.read(staleness - 1, epoch) if staleness > 1 else current
            if gauge:
                gauge("staleness", float((generations.number(0, epoch) or 0) - (generations.number(staleness - 1, epoch) or 0)))
            table, signs = step(held, seen, current, epoch)
            if epoch + 1 not in generations.numbers():
                generations.publish(table, epoch + 1)
            if packets:
                write_packet(generations.read(upto=epoch + 1), signs, packets, epoch)
        finally:
            held.unpersist()

    writer = batches.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def follow_packets(packets: DataFrame, generations: Generations, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """A server's table: every new packet is upserted into the next generation."""

    def run(packet: DataFrame, epoch: int) -> None:
        if epoch + 1 not in generations.numbers():  # a repeated epoch was published whole
            generations.publish(apply_packet(generations.read(), packet), epoch + 1)

    writer = packets.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def distinct_changes(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Touched keys, each once within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["sign"])


def wait(query: StreamingQuery, timeout_seconds: float) -> bool:
    """Whether the stream ended within the time; it is stopped if not."""
    ended = query.awaitTermination(timeout_seconds)
    if not ended:
        query.stop()
    return bool(ended)
