"""Operator 9, mixing sources to target weights by subset-sum budget fitting.

Sources get shares of the whole by weight, capped at a multiple of their size
with the excess shared again. A source's target is met by whole repeats of all
its documents and, for what remains, by a subset: its documents are counted by
exact length, an equal share of every length is taken, what is left of each
length carried on to the next, and a bounded-knapsack dynamic programme over the
documents not yet taken fits the rest to the word, or to the nearest sum there
is, below or above. Which documents of a length go in is decided by a seeded
hash of the id.

Only counts by (source, length) are gathered per source, never documents; the
choice within one length runs over hash buckets of about ``BUCKET`` documents,
so a hot source, or a group of copies of one length, has no large task.

Defined cases: null and empty texts have size 0 and take 0; a null source is a
source of its own, last in order; documents with equal ids and lengths are
interchangeable; repeated rows are drawn one by one; a document longer than what
is left of its source's target is taken if that comes nearer than leaving it; if
no source can grow further, targets stay at their caps; columns besides the
three are ignored, whatever their names; an empty table gives an empty table.

Sources are weighed on the driver, one short row each; what tasks need of them
is joined as a table. The programme's array has as many cells as the rest has
words: at most six of the source's longest documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

#: Documents of one length that are ranked in one piece.
BUCKET = 4096

def fit_targets(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float = 3.0) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size."""
    targets = [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        for i in open_:
            targets[i] = left * weights[i] / weight
        above = [i for i in open_ if targets[i] > cap * sizes[i]]
        if not above:
            break
        for i in above:
            targets[i] = cap * sizes[i]
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(above)]
    return targets


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of the ``counts`` documents of each (distinct, positive) length to take for ``budget`` words.

    An equal share of every length, what rounding leaves carried on to the next
    longer one; then the subset of the documents left whose sum is nearest to
    the rest, the smaller of two.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    order = np.argsort(lengths, kind="stable")
    taken = np.zeros(len(counts), np.int64)
    carry = 0  # in words * total
    for i in order.tolist():
        w, c = int(lengths[i]), int(counts[i])
        carry += c * w * budget
        taken[i] = min(c, carry // (w * total))
        carry -= int(taken[i]) * w * total
    rest = budget - int((taken * lengths).sum())
    # short documents, twice the words of the longest that is left, go back, so that it can be weighed against them
    room = 2 * int(lengths[counts > taken].max(initial=0))
    for i in order.tolist():
        n = min(int(taken[i]), -(-room // int(lengths[i])))
        taken[i] -= n
        rest += n * int(lengths[i])
        room -= n * int(lengths[i])
        if room <= 0:
            break
    spare = counts - taken
    cells = rest + int(lengths[spare > 0].max(initial=0)) + 1
    reach = np.zeros(cells, bool)
    reach[0] = True
    first = np.full(cells, -1, np.int64)  # the item that first reached a sum
    items = []  # (length index, documents): powers of two make up every count
    for i in order.tolist():
        n, k = int(min(spare[i], (cells - 1) // lengths[i])), 1
        while n > 0 and not reach[rest]:
            k = min(k, n)
            w = int(lengths[i]) * k
            new = reach[:-w] & ~reach[w:]
            first[w:][new] = len(items)
            reach[w:] |= new
            items.append((i, k))
            n, k = n - k, 2 * k
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at:
        i, k = items[first[at]]
        taken[i] += k
        at -= int(lengths[i]) * k
    return taken


def mix_sources(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (1, 2, 3), cap: int = 3, seed: int = 42) -> DataFrame:
    """A row per document: id, size, source_size, target, copies and taken."""
    d, s = F.col(f"`{id}`"), F.col(f"`{source}`")
    slim = docs.select(d.alias("id"), s.alias("source"), word_count(F.col(f"`{text}`")).alias("size"), F.xxhash64(d, F.lit(seed)).alias("h"))
    slim = materialize(slim, "mix-sizes")
    lengths = materialize(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()  # a row per source
    order = sorted(sizes, key=lambda r: (r.source is None, r.source or ""))
    own = [int(r.words) for r in order]
    targets = fit_targets(own, [weights[i % len(weights)] for i in range(len(order))], sum(own), cap)
    plan = docs.sparkSession.createDataFrame([(r.source, n, float(t)) for r, n, t in zip(order, own, targets, strict=True)], "p_source string, source_size long, target double")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        words, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole = min(cap, int(target // words)) if words else 0
        budget = 0 if whole >= cap else round(target - whole * words)
        some = pdf["size"].to_numpy() > 0
        part = np.zeros(len(pdf), np.int64)
        if words and budget > 0:
            part[some] = fit_counts(pdf["size"].to_numpy()[some], pdf["n"].to_numpy()[some], budget)
        return pdf.assign(part=part, whole=whole)[["source", "size", "n", "part", "whole", "source_size", "target"]]

    known = lengths.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    quotas = materialize(known.groupBy("source").applyInPandas(fit, "source string, size long, n long, part long, whole long, source_size long, target double"), "mix-quotas")
    q = quotas.withColumnsRenamed({"source": "q_source", "size": "q_size"})
    wide = slim.join(q, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("size") == F.col("q_size"))).drop("q_source", "q_size")
    settled = (F.col("part") == 0) | (F.col("part") == F.col("n"))
    bucket = F.pmod(F.xxhash64("h", F.lit(1)), F.ceil(F.col("n") / BUCKET)).alias("bucket")
    wide = materialize(wide.withColumn("bucket", F.when(~settled, bucket)), "mix-wide")
    sure = wide.where(settled).withColumn("extra", (F.col("part") > 0).cast("long"))
    open_ = wide.where(~settled)
    keys = ["source", "size", "bucket"]
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = open_.groupBy(*keys).agg(F.count("*").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    counted = counted.withColumnsRenamed({k: f"c_{k}" for k in keys})
    same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("bucket") == F.col("c_bucket"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "id"))
    drawn = open_.join(counted, same).withColumn("extra", (rank + F.col("before") <= F.col("part")).cast("long"))
    cols = ["id", "source", "size", "source_size", "target", "whole", "extra"]
    both = sure.select(*cols).unionByName(drawn.select(*cols))
    copies = (F.col("whole") + F.col("extra")).alias("copies")
    return both.select(F.col("id").alias(id), "size", "source_size", "target", copies, (F.col("size") * (F.col("whole") + F.col("extra"))).alias("taken"))
