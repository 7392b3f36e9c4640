"""Table checkpoints, generations and incremental packets, on any Hadoop file system."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.u64 import shard_of
from ..operators.table import TABLE, upsert

MARKER = "_embedding_done.json"
PACKET = f"{TABLE}, emitted_at timestamp"


class Store:
    """The few file operations that Spark's readers and writers do not cover, over Hadoop's FileSystem."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = root.rstrip("/")

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def is_file(self, name: str) -> bool:
        return self.exists(name) and self._fs.getFileStatus(self._at(name)).isFile()

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def write(self, name: str, text: str, overwrite: bool = False) -> None:
        """Through a temporary name, so that the file is there whole or not at all."""
        if self.exists(name) and not overwrite:
            raise FileExistsError(f"{self.root}/{name} already exists")
        temporary = self._at(f"{name}.tmp")
        out = self._fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        if overwrite:
            self._fs.delete(self._at(name), False)
        if not self._fs.rename(temporary, self._at(name)):
            raise OSError(f"cannot write {self.root}/{name}")

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def append(self, name: str, text: str) -> None:
        self.write(name, (self.read(name) if self.exists(name) else "") + text, overwrite=True)

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def save_table(table: DataFrame, path: str, shards: int) -> None:
    """Write ``table`` below ``path`` by shard; refuses a path that exists. The marker comes last."""
    store = Store(table.sparkSession, path)
    if store.exists():
        raise FileExistsError(f"{path} already exists")
    placed = table.withColumn("shard", shard_of(F.col("sign"), shards))
    placed.repartition(shards, "shard").write.partitionBy("shard").mode("errorifexists").parquet(path)
    store.write(MARKER, json.dumps({"num_shards": shards, "datetime": datetime.now(timezone.utc).isoformat()}))


def checkpoint_info(spark: SparkSession, path: str) -> dict:
    """What the marker says; an error if the checkpoint was not completed."""
    store = Store(spark, path)
    if not store.exists(MARKER):
        raise FileNotFoundError(f"{path} holds no completed checkpoint")
    return json.loads(store.read(MARKER))


def load_table(spark: SparkSession, path: str, shards: int | None = None, into: DataFrame | None = None) -> DataFrame:
    """The table of a checkpoint. With the saved shard count partitions are read as they are,
    with another they are dealt anew; ``into`` merges it over a live table."""
    info = checkpoint_info(spark, path)
    rows = spark.read.schema(f"{TABLE}, shard int").parquet(path)
    if shards is not None and shards != info["num_shards"]:
        rows = rows.drop("shard").repartition(shards, shard_of(F.col("sign"), shards))
    rows = rows.select(*[c.split(" ")[0] for c in TABLE.split(", ")])
    return rows if into is None else upsert(into.withColumn("last_access", F.col("last_access")), rows.withColumn("last_access", F.col("last_access")))


def load_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """One shard; Spark prunes the other directories."""
    checkpoint_info(spark, path)
    return spark.read.schema(f"{TABLE}, shard int").parquet(path).where(F.col("shard") == shard).drop("shard")


class Generations:
    """A table as numbered immutable generations; the newest complete one is current.

    A generation counts once Spark's commit marker is there, so readers never see
    half of one, and a writer that died leaves the current one in place.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.store, self.keep = spark, Store(spark, root), keep

    def numbers(self) -> list[int]:
        found = [n for n in self.store.names() if n.startswith("gen=")]
        return sorted(int(n[4:]) for n in found if self.store.exists(f"{n}/_SUCCESS"))

    def number(self, lag: int = 0, upto: int | None = None) -> int | None:
        """Number of the newest generation (up to ``upto``), or of that ``lag`` before it, the first if there are fewer."""
        there = [n for n in self.numbers() if upto is None or n <= upto]
        return there[max(0, len(there) - 1 - lag)] if there else None

    def read(self, lag: int = 0, upto: int | None = None) -> DataFrame:
        """The current table, or that of ``lag`` generations before (bounded staleness)."""
        n = self.number(lag, upto)
        if n is None:
            return self.spark.createDataFrame([], TABLE)
        return self.spark.read.schema(TABLE).parquet(f"{self.store.root}/gen={n}")

    def publish(self, table: DataFrame, number: int | None = None) -> int:
        """Write the next generation and drop those beyond ``keep``. Writing a number again replaces it."""
        n = number if number is not None else (self.numbers() or [-1])[-1] + 1
        table.write.mode("overwrite").parquet(f"{self.store.root}/gen={n}")
        for old in self.numbers()[: -self.keep]:
            if old < n:
                self.store.remove(f"gen={old}")
        return n


def changed_rows(table: DataFrame, signs: DataFrame) -> DataFrame:
    """Packet rows of the distinct touched keys that are still in the table."""
    return table.join(signs.select("sign").distinct(), "sign", "left_semi").withColumn("emitted_at", F.current_timestamp())


def write_packet(table: DataFrame, signs: DataFrame, path: str, batch: int) -> None:
    """Publish changed rows as packet directory ``inc_<batch>``; rewriting one is harmless."""
    changed_rows(table, signs).write.mode("overwrite").parquet(f"{path}/inc_{batch:012d}")


def packet_stream(spark: SparkSession, path: str) -> DataFrame:
    """New packets as a stream; Spark's log keeps which files were taken."""
    return spark.readStream.schema(PACKET).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)


def apply_packet(table: DataFrame, packet: DataFrame) -> DataFrame:
    """Upsert of a packet: for each key the row emitted last."""
    cols = [c.split(" ")[0] for c in TABLE.split(", ")]
    newest = packet.groupBy("sign").agg(F.max_by(F.struct(*cols[1:]), "emitted_at").alias("r")).select("sign", *[F.col(f"r.{c}").alias(c) for c in cols[1:]])
    return upsert(table, newest)
