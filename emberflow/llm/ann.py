"""Operator 10, nearest neighbours over learned partitions.

On a bounded sample a neighbour graph is built and cut into partitions of equal
size that keep most edges inside. A small classifier learns which partition a
vector lies in. It files every row of the table under its most probable
partition and routes a query to the several most probable ones, whose rows are
reranked by exact distance. How many is calibrated: the fewest that find
``recall`` of the true neighbours of held-out sample vectors. Partitions grow in
number with the rows, as far as the bounded sample supports them; beyond, they
grow in size.

Partitions are dealt to tasks in blocks of ``block`` rows, so a partition that
holds a third of all rows is many tasks. A block returns the k best for each
query; ranks are taken over those with Spark's partial rank limit.

Defined cases: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part; ties go to the smaller id;
rows with the query's id are not candidates, nor are rows without an id; repeated query rows count once;
fewer than k candidates are all returned; components whose squares overflow
double precision have distance infinity and are not returned; columns other than
id and vector are ignored, whatever their names; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_sample, materialize


@dataclass(frozen=True)
class AnnParams:
    k: int = 10
    #: vectors in the sample for graph, partitions and classifier, at most, and for each partition at least
    sample: int = 24_000
    per_part: int = 96
    #: rows of a partition that are wanted, and partitions at least
    rows: int = 1_024
    partitions: int = 16
    neighbours: int = 10
    hidden: int = 64
    recall: float = 0.92
    #: rows and queries of one task
    block: int = 16_384
    seed: int = 42


def valid(vector) -> object:
    """Condition: a vector with finite components, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Indexes of the k nearest rows to each query, unordered; ``own``: row to leave out."""
    norms = np.einsum("ij,ij->i", rows, rows)
    out = []
    step = max(1, 2**19 // len(rows))  # 4 MB of distances at once
    for at in range(0, len(queries), step):
        d = queries[at : at + step] @ rows.T
        d *= -2
        d += norms
        if own is not None:
            d[np.arange(len(d)), own[at : at + step]] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k].astype(np.int32))  # copied: a view would keep all places
    return np.concatenate(out)


def partition_graph(graph: np.ndarray, start: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.05) -> np.ndarray:
    """Balanced label propagation: nodes move to the label of most neighbours while it has room."""
    n = len(graph)
    heads, tails = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    heads, tails = np.concatenate((heads, tails)), np.concatenate((tails, heads))
    room = int(np.ceil(slack * n / parts))
    label = start.copy()
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (heads, label[tails]), 1)  # 4 bytes for each node and part: 24 MB at most
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        sizes = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < room:
                sizes[label[i]] -= 1
                sizes[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


def balanced_start(x: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Equal halves along the widest direction of each part, again and again."""
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        own, first, n = todo.pop()
        if n == 1 or not len(own):
            label[own] = first
            continue
        c = x[own] - x[own].mean(axis=0)
        v = rng.normal(size=x.shape[1])
        for _ in range(8):
            v = c.T @ (c @ v)
            v /= np.linalg.norm(v) or 1.0
        order = own[np.argsort(c @ v, kind="stable")]
        cut = len(order) * (n // 2) // n
        todo += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    return label


@dataclass(frozen=True)
class Router:
    """Scaling, one hidden layer and a softmax over partitions; ``probes`` partitions a query."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def filed(self, x: np.ndarray, step: int = 2_048) -> np.ndarray:
        """The most probable partition of each vector."""
        return np.concatenate([self.logits(x[at : at + step]).argmax(axis=1) for at in range(0, max(len(x), 1), step)]).astype(np.int32)


def train_router(x: np.ndarray, label: np.ndarray, parts: int, hidden: int, rng: np.random.Generator, epochs: int = 30) -> Router:
    """Adam on the cross entropy."""
    mean, scale = x.mean(axis=0), float(x.std()) or 1.0
    z = (x - mean) / scale
    shapes = [(x.shape[1], hidden), (hidden,), (hidden, parts), (parts,)]
    w = [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for s in shapes]
    m, v, t = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
    for _ in range(epochs):
        for own in np.array_split(rng.permutation(len(z)), max(1, len(z) // 256)):
            h = np.maximum(z[own] @ w[0] + w[1], 0)
            o = h @ w[2] + w[3]
            p = np.exp(o - o.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), label[own]] -= 1
            p /= len(own)
            back = (p @ w[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((z[own].T @ back, back.sum(axis=0), h.T @ p, p.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= 3e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(mean, scale, *w, 1)


def wanted_parts(total: int, params: AnnParams) -> int:
    return min(max(total // params.rows, params.partitions), params.sample // params.per_part)


def fit_router(sample: np.ndarray, total: int, params: AnnParams) -> Router:
    """Graph, partitions, classifier and the calibrated number of probes."""
    rng = np.random.default_rng(params.seed)
    x = np.unique(sample, axis=0)
    x = x[rng.permutation(len(x))]
    parts = wanted_parts(total, params)
    parts = int(max(1, min(parts, len(x) // 24)))
    if parts == 1:
        return Router(x.mean(axis=0), 1.0, np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    held, base = x[: len(x) // 8], x[len(x) // 8 :]
    graph = nearest(base, base, params.neighbours, np.arange(len(base)))
    label = partition_graph(graph, balanced_start(base, parts, rng), parts)
    router = train_router(base, label, parts, params.hidden, rng)
    filed = router.filed(base)
    true = filed[nearest(held, base, params.k)]
    rank = np.argsort(np.argsort(-router.logits(held), axis=1, kind="stable"), axis=1)
    need = np.sort(rank[np.arange(len(held))[:, None], true].ravel())
    probes = 1 + int(need[min(len(need) - 1, int(np.ceil(params.recall * len(need))) - 1)])
    return Router(router.mean, router.scale, router.w1, router.b1, router.w2, router.b2, probes)


def block_top(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of a block to each query by exact distance, ties to the smaller id."""
    c = c.sort_values("vec_id", kind="stable", na_position="first")
    ids = c["vec_id"].to_numpy()
    x = np.stack(c["vec"].to_list()).astype(np.float64)
    norms = np.einsum("ij,ij->i", x, x)
    out = []
    for at in range(0, len(q), 128):
        part = q.iloc[at : at + 128]
        y = np.stack(part["vec"].to_list()).astype(np.float64)
        y2 = np.einsum("ij,ij->i", y, y)
        d = norms + y2[:, None] - 2 * y @ x.T
        d[part["query_id"].to_numpy()[:, None] == ids[None]] = np.inf
        n = min(k, len(ids))
        worst = np.partition(d, n - 1, axis=1)[:, n - 1]
        for i, (name, key) in enumerate(zip(part["query_id"], part["query_key"], strict=True)):
            slack = 1e-9 * (1 + y2[i] + norms.max())
            near = np.flatnonzero((d[i] <= worst[i] + slack) & np.isfinite(d[i]))
            exact = np.sqrt(((x[near] - y[i]) ** 2).sum(axis=1))
            best = np.argsort(exact, kind="stable")[:k]  # near is in order of id
            out.append(pd.DataFrame({"query_id": name, "query_key": key, "vec_id": ids[near[best]], "score": exact[best]}))
    return pd.concat(out)


def search(rows: DataFrame, queries: DataFrame, id: str = "vec_id", vector: str = "embedding", params: AnnParams = AnnParams()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest ``rows`` found for each of ``queries``."""
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = lambda df: df.select(F.col(f"`{id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vec")).where(valid(F.col("vec")))
    points, asked = own(rows).where("vec_id IS NOT NULL"), own(queries).where("vec_id IS NOT NULL")
    widths = points.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not widths:
        return empty
    same = F.size("vec") == widths[0]["n"]
    total = widths[0]["count"]
    points, asked = points.where(same), asked.where(same)
    wanted = min(params.sample, max(4_000, params.per_part * wanted_parts(total, params)))
    # as Arrow: 12 MB at most; rows of Python numbers took four times that, besides Java's own in the driver
    sample = bounded_sample(points, total, wanted, "vec_id", "vec").select("vec").toArrow()["vec"]
    router = fit_router(np.concatenate([c.flatten().to_numpy() for c in sample.chunks]).reshape(len(sample), -1), total, params)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(part=router.filed(np.stack(pdf["vec"].to_list())))

    filed = materialize(points.mapInPandas(file, "vec_id long, vec array<double>, part int"), "ann-index")
    counts = {r["part"]: r["count"] for r in filed.groupBy("part").count().collect()}  # a row per partition
    blocks = {p: -(-n // params.block) for p, n in counts.items()}
    held = np.array([counts.get(p, 0) for p in range(router.parts)])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            order = np.argsort(-router.logits(np.stack(pdf["vec"].to_list())), axis=1, kind="stable")
            # further partitions for a query whose own hold too few rows
            enough = (np.cumsum(held[order], axis=1) < params.k + 1).sum(axis=1) + 1
            n = np.minimum(np.maximum(enough, router.probes), router.parts)
            parts = [o[:m].astype(np.int32) for o, m in zip(order, n, strict=True)]
            yield pd.DataFrame({"query_id": pdf["vec_id"], "query_key": pdf["key"], "vec": pdf["vec"], "parts": parts})

    keyed = asked.select("vec_id", "vec", F.xxhash64("vec").alias("key")).dropDuplicates(["vec_id", "key"])
    routed = keyed.mapInPandas(route, "query_id long, query_key long, vec array<double>, parts array<int>")
    routed = materialize(routed.select("query_id", "query_key", "vec", F.explode("parts").alias("part")), "ann-routes")
    asked_in = {r["part"]: -(-r["count"] // params.block) for r in routed.groupBy("part").count().collect()}

    def of(table: dict[int, int]):
        out = [table.get(p, 0) for p in range(router.parts)]
        return F.get(F.array(*map(F.lit, out)), F.col("part"))

    each = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    block = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.greatest(n, F.lit(1))).cast("int")
    left = routed.select("*", block(of(asked_in), "query_id", "query_key").alias("qblock")).select("*", each(of(blocks)).alias("block"))
    right = filed.select("*", block(of(blocks), "vec_id", "vec").alias("block")).select("*", each(of(asked_in)).alias("qblock"))
    keys = ["part", "block", "qblock"]

    def rerank(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []})
        return block_top(q, c, params.k)

    tops = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rerank, "query_id long, query_key long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id"))
    return tops.withColumn("rank", rank).where(F.col("rank") <= params.k).select("query_id", "rank", "vec_id", "score")
