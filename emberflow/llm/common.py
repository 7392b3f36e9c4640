"""Helpers shared by the operators: stage tables, digests and Arrow mapping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.checkpoint import Store

#: The word separators of every operator: space and U+0009 to U+000D.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: rows whose results ``map_texts`` holds at once
BATCH_ROWS = 1_000
#: Spark's setting by which a command that ends deletes the files of its shuffles
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: paths that ``materialize`` wrote inside the innermost ``settled``
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, the folder all executors share.

    Only where a local session names none (tests) a temporary folder takes its
    place; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = spark.conf.get("spark.emberflow.scratch", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="emberflow-")
            spark.conf.set("spark.emberflow.scratch", base)
    return f"{base.rstrip('/')}/emberflow-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, never a recomputation of
    what stands before. Shuffle files, which nothing can read again, go at once
    and not when the driver happens to collect its garbage.
    """
    path = shared_folder(df.sparkSession, tag)
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` writes last and returns; those that it wrote on the way are deleted.

    They must not be read later, so ``make`` returns what ``materialize`` gave it.
    """
    outer, inner = _WRITTEN.get(), []
    token = _WRITTEN.set(inner)
    try:
        out = make()
    finally:
        _WRITTEN.reset(token)
    for path in inner[:-1]:
        Store(out.sparkSession, path).remove("")
    if outer is not None:
        outer += inner[-1:]
    return out


def bounded_sample(rows: DataFrame, total: int, most: int, *key: str) -> DataFrame:
    """At most ``most`` of ``total`` rows, those with the smallest hashes of ``key``.

    A filter on the hash comes first, so tasks return few rows besides those
    wanted, however many tasks there are.
    """
    h = F.xxhash64(*key)
    if total > most:
        share = min(1.0, 1.2 * most / total + 1000 / total)
        rows = rows.where(h < int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True))
    return rows.orderBy(h).limit(most)


def utf8_bytes(text: Column) -> Column:
    """Bytes of the text in UTF-8, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the text in UTF-8; a null text counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def map_texts(df: DataFrame, column: str, fields: list[T.StructField], rows: Callable[[Iterator[bytes | None]], Iterator[tuple]]) -> DataFrame:
    """Add ``fields`` to ``df``, computed by ``rows`` from the UTF-8 bytes of ``column``.

    Column names are matched exactly. A column of ``df`` that already bears the
    name of a new field is replaced. Texts go through one at a time, whole, in
    Arrow batches that Spark bounds by rows and bytes; results are returned for
    ``BATCH_ROWS`` rows at once, as they can be larger than the texts.
    """
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new]
    source = "__text_bytes__"
    slim = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{column}`").cast("binary").alias(source))
    schema = T.StructType([*kept, *fields])
    kinds = [_arrow_type(f.dataType) for f in fields]
    step = BATCH_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                made = list(rows(x.as_py() for x in part.column(part.num_columns - 1)))
                arrays = part.columns[:-1] + [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return slim.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    return simple[kind.simpleString()]
