"""Operator 1, sharding by histogram sort.

Rows are put in the order of (hash of the text, hash of the id), so equal texts
lie side by side, and cut into shards of nearly equal bytes. The last bits of the
key differ between rows that are equal in both, so any number of those, also
without ids, can be cut. The cuts are found without
sorting: each round counts the exact bytes and rows between candidate key
boundaries in every partition, sums the counts, and places new candidates
inside the bins that hold an unmet cut, until each cut is within tolerance or
falls on a single key. Then the rows are exchanged once, by bin.

A group of equal texts is only cut when it is larger than the tolerance, as a
hot group must be. All boundaries ever counted stay in the plan with the exact
rows below them, so slots are numbered bin by bin and no shard is sorted by one
task.

What reaches the driver is one row per bin: ``MOST_PROBES`` at most in the first
round, (shards - 1) * probes in the others, whatever the input.

Defined cases: null texts have size 8, checksum 0 and sort as empty ones; null
ids are one id; rows that are equal in text and id take neighbouring slots in
any order; a text longer than a shard fills one alone and makes it larger; fewer rows than shards leave shards empty; an empty table gives an
empty table; columns named like results are replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_crc32, utf8_bytes

_LOW = -(2**63)
#: Candidate boundaries of the first round.
MOST_PROBES = 65_536
#: Bits of the key that tell rows of equal text and id apart.
_SALT = 20
Key = tuple[int, int]


@dataclass
class ShardPlan:
    """Sorted boundaries with the shard and the rows of that shard below each."""

    first: np.ndarray
    second: np.ndarray
    shard: np.ndarray  # one more than boundaries: of the bin above each
    base: np.ndarray
    rounds: int


def bins(first: np.ndarray, second: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Number of boundaries at or below each key (k1, k2)."""
    lo = np.searchsorted(first, k1, "left")
    hi = np.searchsorted(first, k1, "right")
    out = lo.copy()
    tied = np.flatnonzero(hi > lo)
    for a in np.unique(lo[tied]):
        own = tied[lo[tied] == a]
        out[own] = a + np.searchsorted(second[a : hi[own[0]]], k2[own], "right")
    return out


def _between(lo: Key, hi: Key, probes: int) -> set[Key]:
    """Candidate boundaries from lo to just above hi: between hashes where they differ, else between ids."""
    level = 0 if lo[0] != hi[0] else 1
    a, b = lo[level], hi[level]
    at = {a + -(-(b - a) * n // probes) for n in range(probes + 1)} | {b + 1}
    return {(x, _LOW) if level == 0 else (lo[0], x) for x in at if x < 2**63}


def _count(rows: DataFrame, bounds: list[Key]) -> dict[int, tuple]:
    """(bytes, rows, least key, greatest key) of every bin that has rows."""
    first, second = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pdf = pdf.assign(bin=bins(first, second, pdf["k1"].to_numpy(), pdf["k2"].to_numpy())).sort_values(["bin", "k1", "k2"])
                g = pdf.groupby("bin")
                yield pd.DataFrame({"bin": g["size"].sum().index, "bytes": g["size"].sum().to_numpy(), "n": g.size().to_numpy(), "a1": g["k1"].first().to_numpy(), "a2": g["k2"].first().to_numpy(), "b1": g["k1"].last().to_numpy(), "b2": g["k2"].last().to_numpy()})

    parts = rows.select("k1", "k2", "size").mapInPandas(partial, "bin long, bytes long, n long, a1 long, a2 long, b1 long, b2 long")
    found = parts.groupBy("bin").agg(F.sum("bytes"), F.sum("n"), F.min(F.struct("a1", "a2")), F.max(F.struct("b1", "b2"))).collect()
    return {r[0]: (r[1], r[2], tuple(r[3]), tuple(r[4])) for r in found}


def plan_shards(rows: DataFrame, shards: int, tolerance: float = 0.005, probes: int = 64) -> ShardPlan:
    """Find the cuts for ``rows`` with long columns k1, k2 (the key, no nulls) and size.

    ``tolerance``: most bytes a cut may be off, as a share of a mean shard.
    """
    known: dict[Key, tuple[int, int]] = {}  # boundary -> bytes and rows below it
    wanted: dict[int, Key] = {}
    found = _count(rows, [])
    if not found:
        return ShardPlan(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), 0)
    total, n_rows, least, greatest = found[0]
    off = total / shards * tolerance
    spans = {i: (0, 0, total, n_rows, least, greatest) for i in range(1, shards)}  # bytes, rows below; of the bin; its ends
    rounds = 0
    while spans:
        rounds += 1
        bounds = sorted(set().union(*(_between(s[4], s[5], max(probes, min(probes * (shards - 1), MOST_PROBES)) if rounds == 1 else probes) for s in set(spans.values()))))
        # rows outside the open spans are counted too; their totals are known and serve as a check
        found = _count(rows, bounds)
        below, under, edges = 0, 0, [(0, 0, 0)]
        for b in range(len(bounds) + 1):
            size, n = found[b][:2] if b in found else (0, 0)
            below, under = below + size, under + n
            if b < len(bounds):
                known[bounds[b]] = (below, under)
            edges.append((below, under, 0))
        if below != total:
            raise RuntimeError(f"the counts of a round do not add up: {below} of {total} bytes")
        sums = [e[0] for e in edges]
        for i in list(spans):
            goal = total * i / shards
            at = min(bisect_right(sums, goal) - 1, len(bounds))  # edges[at] <= goal
            while at > 0 and at not in found:
                at -= 1
            size, n, a, b = found[at]
            lo_key = bounds[at - 1] if at else None
            hi_key = bounds[at] if at < len(bounds) else None
            options = [(abs(known[k][0] - goal), k) for k in (lo_key, hi_key) if k is not None]
            best = min(options, default=None)
            if a == b or (best and best[0] <= off):
                if best is None:  # all rows share one key
                    best = (0, b if goal * 2 < total else (b[0], b[1] + 1))
                    known.setdefault(best[1], (0, 0) if best[1] == b else (total, n_rows))
                wanted[i] = best[1]
                del spans[i]
            else:
                spans[i] = (edges[at][0], edges[at][1], size, n, a, b)
    cuts = [wanted[i] for i in range(1, shards)]
    bounds = sorted(known)
    shard = np.array([0, *(bisect_right(cuts, k) for k in bounds)], np.int64)
    start = {0: 0} | {s: known[cuts[s - 1]][1] for s in set(shard.tolist()) if s}
    base = np.array([0, *(known[k][1] - start[int(s)] for k, s in zip(bounds, shard[1:], strict=True))], np.int64)
    return ShardPlan(*(np.array([k[i] for k in bounds], np.int64) for i in (0, 1)), shard, base, rounds)


def assign_shards(rows: DataFrame, plan: ShardPlan, key: tuple[str, str] = ("k1", "k2")) -> DataFrame:
    """``rows``, with the columns ``key``, and their shard and slot; the one exchange."""
    kept = [f for f in rows.schema.fields if f.name not in ("shard", "slot")]
    schema = T.StructType([*kept, T.StructField("__bin", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("__base", T.LongType())])
    first, second, shard, base = plan.first, plan.second, plan.shard, plan.base

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            b = bins(first, second, *(batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in key))
            new = [pa.array(b, pa.int64()), pa.array(shard[b], pa.int32()), pa.array(base[b], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[f.name for f in schema.fields])

    placed = rows.select(*[f"`{f.name}`" for f in kept]).mapInArrow(place, schema)
    order = Window.partitionBy("__bin").orderBy(*key)
    return placed.withColumn("slot", F.col("__base") + F.row_number().over(order) - 1).drop("__bin", "__base")


def salted(key: Column, salt: Column) -> Column:
    """``key`` with its last bits replaced by those of ``salt``, both hashes."""
    mask = (1 << _SALT) - 1
    return key.bitwiseAND(F.lit(~mask)).bitwiseOR(salt.bitwiseAND(F.lit(mask)))


def shard_key(text: Column, id: Column) -> list[Column]:
    """Key columns k1 (hash of the text) and k2 (hash of the id, its end the row's own) of a row."""
    own = F.xxhash64(F.monotonically_increasing_id(), F.lit(1))
    return [F.xxhash64(F.coalesce(text, F.lit(""))).alias("k1"), salted(F.xxhash64(id, F.lit(2)), own).alias("k2")]


def shard_documents(docs: DataFrame, shards: int, id: str = "doc_id", text: str = "text", keep_text: bool = True, tolerance: float = 0.005) -> DataFrame:
    """``docs`` with size, text_crc32, shard and slot; only with the id and without the text if not wanted.

    The keys, and with them the rows that are wanted, are written to the shared
    folder once, as every round reads them and the keys of equal rows are drawn.
    """
    t, i = F.col(f"`{text}`"), F.col(f"`{id}`")
    made = [(utf8_bytes(t) + 8).alias("size"), text_crc32(t).alias("text_crc32"), F.struct(*shard_key(t, i)).alias("__key")]
    named = [F.col(f"`{c}`") for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot", "__key")] if keep_text else [i.alias(id)]
    rows = materialize(docs.select(*named, *made), "shard-keys")
    plan = plan_shards(rows.select("__key.k1", "__key.k2", "size"), shards, tolerance)
    placed = assign_shards(rows.select(F.col("__key.k1").alias("__k1"), F.col("__key.k2").alias("__k2"), *[F.col(f"`{c}`") for c in rows.columns if c != "__key"]), plan, ("__k1", "__k2"))
    return placed.drop("__k1", "__k2")
