"""Training and inference batches as DataFrames: assembly, checks, payloads, tabular preparation."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.order import numbered

#: The types that dense features and labels may have.
DENSE_TYPES = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
MAX_BATCH = 65535


def check_columns(df: DataFrame, ids: Sequence[str] = (), dense: Sequence[str] = (), labels: Sequence[str] = ()) -> None:
    """Types of all features, before any job: ids bigint or array<bigint>, dense and labels numeric or arrays of it."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for c in ids:
        inner = kinds[c].elementType if isinstance(kinds[c], T.ArrayType) else kinds[c]
        if not isinstance(inner, T.LongType):
            raise TypeError(f"id feature {c} must hold bigint, not {kinds[c].simpleString()}")
    for c in (*dense, *labels):
        inner = kinds[c]
        while isinstance(inner, T.ArrayType):
            inner = inner.elementType
        if not isinstance(inner, DENSE_TYPES):
            raise TypeError(f"column {c} has unsupported type {kinds[c].simpleString()}")


def make_batches(df: DataFrame, ids: Sequence[str], dense: Sequence[str] = (), labels: Sequence[str] = (), meta: str | None = None, requires_grad: bool = True) -> DataFrame:
    """(batch_id, sample, ids.., dense.., labels.., meta): checked columns; gradients need labels."""
    if not ids:
        raise ValueError("a batch needs at least one id feature")
    if requires_grad and not labels:
        raise ValueError("a batch that requires gradients needs labels")
    check_columns(df, ids, dense, labels)
    extra = [F.col(meta).cast("binary").alias("meta")] if meta else []
    return df.select("batch_id", "sample", *ids, *dense, *labels, *extra)


def check_batch_sizes(batches: DataFrame, most: int = MAX_BATCH) -> DataFrame:
    """(batch_id, size), failing where a batch is too large or a sample number is used twice."""
    sizes = batches.groupBy("batch_id", "sample").agg(F.count("*").alias("n")).groupBy("batch_id").agg(F.count("*").alias("size"), F.max("n").alias("n"))
    ok = F.assert_true((F.col("size") <= most) & (F.col("n") == 1), "batch too large or sample repeated")
    return sizes.select("batch_id", F.when(ok.isNull(), F.col("size")).alias("size"))


def single_id(column: str) -> Column:
    """One id per sample as a list."""
    return F.array(F.col(column))


def id_half(batches: DataFrame, ids: Sequence[str]) -> DataFrame:
    """What goes to the lookup side; joined again on (batch_id, sample)."""
    return batches.select("batch_id", "sample", *ids)


def dense_half(batches: DataFrame, ids: Sequence[str]) -> DataFrame:
    return batches.drop(*ids)


def to_payload(batches: DataFrame) -> DataFrame:
    """(batch_id, payload): a whole batch as JSON bytes, samples in order."""
    row = F.struct(*[c for c in batches.columns if c != "batch_id"])
    lines = F.transform(F.sort_array(F.collect_list(F.struct("sample", F.to_json(row).alias("j")))), lambda x: x["j"])
    return batches.groupBy("batch_id").agg(F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]")).cast("binary").alias("payload"))


def from_payload(payloads: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Rows of serialized batches; ``schema`` without batch_id."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    rows = F.from_json(F.col("payload").cast("string"), T.ArrayType(kind), {"mode": "FAILFAST"})
    return payloads.select("batch_id", F.inline(rows))


def read_table(spark: SparkSession, path: str, schema: str, skip_first: bool = False) -> DataFrame:
    """Headerless CSV with given columns and trimmed leading spaces; ``skip_first`` drops each file's first line."""
    return spark.read.schema(schema).option("ignoreLeadingWhiteSpace", True).option("header", skip_first).option("enforceSchema", True).csv(path)


def ordinal_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): sorted distinct values numbered from 0. Fit once, on the training data.

    Numbered in ranges of the values themselves, so a common prefix does no harm.
    """
    values = df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    return numbered(values, "value", "code")


def encode_ordinal(df: DataFrame, column: str, codes: DataFrame, out: str | None = None) -> DataFrame:
    """``df`` with the code of ``column``; unknown values get the number of known ones."""
    name = out or column
    unknown = F.lit(codes.count()).cast("long")
    joined = df.join(codes.withColumnsRenamed({"value": "__value", "code": "__code"}), F.col(column) == F.col("__value"), "left")
    return joined.withColumn(name, F.coalesce("__code", unknown)).drop("__value", "__code")


def prepare_tabular(df: DataFrame, categorical: Sequence[str], continuous: Sequence[str], label: str, positive: str, codes: dict[str, DataFrame] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(target, continuous_data, categorical_data) and the codes it was made with."""
    codes = codes or {c: ordinal_codes(df, c) for c in categorical}
    df = df.withColumn("target", F.col(label).contains(positive).cast("float"))
    for c in categorical:
        df = encode_ordinal(df, c, codes[c])
    return df.select("target", F.array(*[F.col(c).cast("float") for c in continuous]).alias("continuous_data"), F.array(*[F.col(c).cast("long") for c in categorical]).alias("categorical_data")), codes


def strides(shape: Sequence[int]) -> list[int]:
    """Row-major strides of a shape, in elements."""
    out = [1]
    for n in reversed(shape[1:]):
        out.insert(0, out[0] * n)
    return out if shape else []


def dumps_meta(**values: object) -> bytes:
    return json.dumps(values, sort_keys=True).encode()
