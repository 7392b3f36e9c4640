"""Operator 7, SimHash near-duplicates over a vantage-point tree.

1. ``simhash`` gives every text a fingerprint (64 bits per block; each further
   block mixes the same shingle hashes with another constant).
2. ``fingerprint_components`` joins the distinct fingerprints into classes.
   A vantage-point tree, fitted on a bounded sample, splits Hamming space:
   at a node with vantage v and radius mu, a fingerprint goes inward if
   d <= mu + r and outward if d > mu. By the triangle bound two fingerprints
   within r of each other always share a branch, so only those in the band
   (mu, mu + r] are sent to both shards, and a shard finds all its pairs alone.
3. Each shard links its members exactly, splitting on with local vantage points,
   and returns a star per class instead of the pairs; stars are joined by
   alternating large-star and small-star rounds on Spark.

Exact copies share a fingerprint and are merged before any comparison, so a
group of copies of any size is one node. A shard above ``block`` fingerprints
is compared in pairs of blocks, each in a task of its own.

``similar_classes`` links texts by the exact similarity of their shingle sets.
Several trees, each on another part of a longer fingerprint, propose pairs: in a
shard each member's nearest, and the nearest pair between the classes these
make, never all pairs of a group, and each node's nearest is held against the
texts. Then an exact join looks for links between the classes this left apart:
two sets of similarity t or more share one of the first n - ceil(t n) + 1
shingles of each in any common order. Rare shingles come first, by counts in a
bounded sample, which decides the work but not the result. Texts whose sizes and
counts of shared shingles allow no partner go before pairs are made. A shingle of
few texts joins them in pairs; pairs that share too few, or whose parity sketches
differ in too many bits, cannot be similar and go before any text is moved; then
one pair of each two classes is held against the texts, and last those pairs
whose classes this did not join. Texts that share a shingle with many meet in
blocks, a row for each text, and a block returns links between classes, not pairs.

Defined cases: null and empty texts have fingerprint zero and link like any
other; fewer words than a shingle give one shingle of all words; the component
of rows whose ids are all null is null; repeated rows share their component;
an empty table gives an empty table; columns named like results are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bounded_sample, map_texts, materialize, settled


@dataclass(frozen=True)
class SimHashParams:
    shingle: int = 5
    #: 64-bit blocks of a fingerprint
    blocks: int = 8
    #: probes (first bit, width): the parts of the fingerprint that a tree is built on, here halves of blocks, and their middles
    probes: tuple[tuple[int, int], ...] = (*((32 * k, 32) for k in range(16)), *((64 * k + 16, 32) for k in range(8)))
    #: most differing bits inside a probe
    radius: int = 2
    #: most differing bits for a link, or for a proposal: of the whole fingerprint, or of its last two blocks
    limit: int = 32
    #: the similarity that proposed pairs must have
    similarity: float = 0.8
    #: partners of each text that a shard proposes, besides one for each two classes
    nearest: int = 2
    #: whether repeated shingles count once
    distinct: bool = True
    #: fingerprints sampled for the tree at least and at most (sixteen for each shard), and wanted in a shard
    sample: int = 20_000
    most: int = 262_144
    shard: int = 8_192
    #: a larger shard is compared block by block
    block: int = 32_768


#: The contract of the query: one 64-bit fingerprint of 3-word shingles, links at 2 bits.
CONTRACT = SimHashParams(shingle=3, blocks=1, probes=((0, 64),), radius=2, limit=2, distinct=False)
#: Five words and a similarity of 0.8: angles of 0.151 pi, 19 of 128 bits on average.
#: 24 trees give tasks enough, so shards are larger (40 bytes a row, 5 MB): each level of a tree sends a quarter of its rows to both sides.
#: Eight of them: what the trees do not propose is found by shared shingles.
NEAR_DUPLICATES = SimHashParams(probes=tuple((64 * k, 32) for k in range(8)), shard=131_072, block=262_144)


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; none for a text without words."""
    words = (text or b"").lower().split()  # bytes.lower() touches A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    k = min(shingle, len(words))
    last = ends[k - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[: len(last)].tolist(), last.tolist(), strict=True)), np.uint64, len(last))


def fingerprint(text: bytes | None, shingle: int, blocks: int, distinct: bool = False) -> bytes:
    """SimHash of a text, ``8 * blocks`` bytes, first block first, big-endian each."""
    h = shingle_hashes(text, shingle)
    return print_of(np.unique(h) if distinct else h, blocks)


def print_of(h: np.ndarray, blocks: int) -> bytes:
    """SimHash of shingle hashes."""
    if not len(h):
        return bytes(8 * blocks)
    out = []
    for n in range(blocks):
        if n:
            with np.errstate(over="ignore"):
                g = h * np.uint64(2 * (0x9E3779B97F4A7C15 * n % 2**63) + 1)
                g ^= g >> np.uint64(32)
                g *= np.uint64(0xD6E8FEB86659FD93)
                g ^= g >> np.uint64(32)
        else:
            g = h
        ones = np.zeros(64, np.int64)
        for at in range(0, len(g), 65_536):
            part = g[at : at + 65_536].byteswap().view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(g)).tobytes())
    return b"".join(out)


def simhash(docs: DataFrame, text: str = "text", params: SimHashParams = CONTRACT, column: str = "fingerprint") -> DataFrame:
    """``docs`` with the binary fingerprint of ``text``. A map, no shuffle."""

    def rows(texts: Iterator[bytes | None]) -> Iterator[tuple]:
        return ((fingerprint(t, params.shingle, params.blocks, params.distinct),) for t in texts)

    return map_texts(docs, text, [T.StructField(column, T.BinaryType())], rows)


# --- vantage-point trees -------------------------------------------------------------


def _words(prints: np.ndarray | list) -> np.ndarray:
    """Binary fingerprints as an array of uint64, one row each."""
    data = b"".join(prints)
    return np.frombuffer(data, ">u8").astype(np.uint64).reshape(len(prints), -1)


def _probe(words: np.ndarray, first: int, width: int) -> np.ndarray:
    """Bits ``first`` to ``first + width`` (inside one block) as uint64."""
    shift = np.uint64(64 - first % 64 - width)
    mask = np.uint64(2**width - 1)
    return (words[:, first // 64] >> shift) & mask


def _split(keys: np.ndarray, radius: int) -> tuple[int, int] | None:
    """Vantage and mu that leave the smallest larger half; None if none helps."""
    best = None
    for k in range(0, len(keys), max(1, len(keys) // 5)):
        d = np.bitwise_count(keys ^ keys[k])
        count = np.cumsum(np.bincount(d, minlength=65 + radius))
        inside, outside = count[radius : 65 + radius], len(keys) - count[:65]
        mu = int(np.argmin(np.maximum(inside, outside)))
        worse = int(max(inside[mu], outside[mu]))
        if best is None or worse < best[0]:
            best = (worse, int(keys[k]), mu)
    return best[1:] if best and best[0] < 0.9 * len(keys) else None


def build_tree(keys: np.ndarray, radius: int, leaves: int) -> list:
    """Nodes [vantage, mu, inner, outer]; a child below zero is leaf -1-child.

    The most populous leaf is split next until there are ``leaves`` of them.
    """
    nodes: list[list] = []
    counter = 0
    heap = [(-len(keys), 0, keys, -1, 0)]
    done: list[tuple] = []
    while heap and len(heap) + len(done) < leaves:
        _, _, own, parent, side = heapq.heappop(heap)
        cut = _split(own, radius) if len(own) > 8 else None
        if cut is None:
            done.append((own, parent, side))
            continue
        d = np.bitwise_count(own ^ np.uint64(cut[0]))
        nodes.append([cut[0], cut[1], 0, 0])
        if parent >= 0:
            nodes[parent][side] = len(nodes) - 1
        for s, part in ((2, own[d <= cut[1] + radius]), (3, own[d > cut[1]])):
            counter += 1
            heapq.heappush(heap, (-len(part), counter, part, len(nodes) - 1, s))
    for leaf, (parent, side) in enumerate([*[x[3:] for x in heap], *[x[1:] for x in done]]):
        if parent >= 0:
            nodes[parent][side] = -1 - leaf
    return nodes


def place(nodes: list, keys: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, indexes of the keys whose ball of the radius needs it)."""
    stack = [(0 if nodes else -1, np.arange(len(keys)))]
    while stack:
        at, own = stack.pop()
        if not len(own):
            continue
        if at < 0:
            yield -1 - at, own
            continue
        vantage, mu, inner, outer = nodes[at]
        d = np.bitwise_count(keys[own] ^ np.uint64(vantage))
        stack += [(inner, own[d <= mu + radius]), (outer, own[d > mu])]


def _linked(keys: np.ndarray, words: np.ndarray, of: np.ndarray, to: np.ndarray, radius: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i from ``of`` and j from ``to``, that are within radius and limit."""
    near = np.bitwise_count(keys[of][:, None] ^ keys[to][None]) <= radius
    i, j = np.nonzero(near)
    i, j = of[i], to[j]
    if len(i) and words.shape[1] > 1 or limit < radius:
        ok = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64) <= limit
        i, j = i[ok], j[ok]
    return i, j


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            jump = root[root]
            if (jump == root).all():
                break
            root = jump
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def link_shard(keys: np.ndarray, words: np.ndarray, radius: int, limit: int, small: int = 512) -> np.ndarray:
    """Root of each member of a shard: exact single linkage within it."""
    heads: list[np.ndarray] = []
    tails: list[np.ndarray] = []
    stack = [np.arange(len(keys))]
    while stack:
        own = stack.pop()
        cut = _split(keys[own], radius) if len(own) > small else None
        if cut is not None:
            d = np.bitwise_count(keys[own] ^ np.uint64(cut[0]))
            stack += [own[d <= cut[1] + radius], own[d > cut[1]]]
        elif len(own) <= small:
            i, j = _linked(keys, words, own, own, radius, limit)
            off = i < j
            heads.append(i[off])
            tails.append(j[off])
        else:  # a dense region: grow one class after another over what is left
            rest = own
            while len(rest):
                front, rest = rest[:1], rest[1:]
                while len(front) and len(rest):
                    i, j = _linked(keys, words, front[:64], rest, radius, limit)
                    new, first = np.unique(j, return_index=True)
                    heads.append(i[first])
                    tails.append(new)
                    rest = rest[~np.isin(rest, new)]
                    front = np.concatenate((front[64:], new))
    if not heads:
        return np.arange(len(keys))
    return _roots(len(keys), np.concatenate(heads), np.concatenate(tails))


def _chosen(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, nearest: int) -> np.ndarray:
    """Which pairs to propose: the nearest of each member, then the nearest between the classes these make."""
    member, pair = np.concatenate((i, j)), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((pair, d[pair], member))
    m = member[order]
    first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
    rank = np.arange(len(m)) - np.repeat(first, np.diff(np.concatenate((first, [len(m)]))))
    keep = np.unique(pair[order][rank < nearest])
    root = _roots(n, i[keep], j[keep])
    apart = np.flatnonzero(root[i] != root[j])
    apart = apart[np.argsort(d[apart], kind="stable")]
    a, b = root[i[apart]], root[j[apart]]
    _, least = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_index=True)
    return np.concatenate((keep, apart[least]))


def propose_pairs(keys: np.ndarray, checks: np.ndarray, radius: int, limit: int, nearest: int, small: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, distance of the checks) of a shard whose keys are within radius and checks within limit."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    narrow = keys.astype(np.uint32) if len(keys) and keys.max() < 2**32 else keys
    apart = lambda i, j: np.bitwise_count(checks[i] ^ checks[j]).sum(axis=1, dtype=np.int64)
    stack = [np.arange(len(keys))]
    while stack:
        own = stack.pop()
        cut = _split(keys[own], radius) if len(own) > small else None
        if cut is not None:
            d = np.bitwise_count(keys[own] ^ np.uint64(cut[0]))
            stack += [own[d <= cut[1] + radius], own[d > cut[1]]]
        elif len(own) <= small:
            part = narrow[own]
            flat = np.flatnonzero(np.bitwise_count(part[:, None] ^ part[None]) <= radius)
            i, j = np.divmod(flat, len(own))
            i, j = i[i < j], j[i < j]
            d = apart(own[i], own[j])
            ok = d <= limit
            i, j, d = i[ok], j[ok], d[ok]
            if len(i):
                c = _chosen(len(own), i, j, d, nearest)
                out.append((own[i[c]], own[j[c]], d[c]))
        else:  # a dense region: grow one class after another over what is left, each by its nearest of the front
            rest = own
            while len(rest):
                front, rest = rest[:1], rest[1:]
                while len(front) and len(rest):
                    i, j = np.nonzero(np.bitwise_count(keys[front[:64]][:, None] ^ keys[rest][None]) <= radius)
                    d = apart(front[i], rest[j])
                    ok = d <= limit
                    i, j, d = i[ok], j[ok], d[ok]
                    order = np.argsort(d, kind="stable")
                    new, first = np.unique(j[order], return_index=True)
                    c = order[first]
                    out.append((front[i[c]], rest[new], d[c]))
                    front = np.concatenate((front[64:], rest[new]))
                    left = np.ones(len(rest), bool)
                    left[new] = False
                    rest = rest[left]
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# --- components on Spark -----------------------------------------------------------


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is its smallest node.

    Alternates large-star and small-star; both are a minimum per node with
    partial aggregation and one join, so no neighbourhood is gathered. Each
    round is written to the shared folder, which also counts and sums up its
    pairs; rounds grow with the logarithm of the nodes and end when none changes.
    """

    def written(pairs: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
        seen = Observation()
        sums = F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")
        pairs = materialize(pairs.observe(seen, *sums), tag)
        return pairs, (seen.get["n"], seen.get["x"])

    pairs, before = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while before[0]:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(down, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        pairs, now = written(small)
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _sharded(prints: DataFrame, params: SimHashParams, fields: str, columns, name: str) -> DataFrame:
    """Rows (probe, leaf, x, y, ``fields``) of every shard that the balls of the fingerprints in ``fp`` meet.

    ``columns(words, pdf, own, probe)`` makes the fields; blocks of a large
    shard are dealt by the hash of field ``name``, each pair of blocks (x, y).
    """
    total = prints.count()
    wanted = min(max(params.sample, 16 * -(-total // params.shard)), params.most)
    sample = _words([bytes(r.fp) for r in bounded_sample(prints, total, wanted, "fp").select("fp").collect()])
    leaves = max(1, min(-(-total // params.shard), max(1, len(sample) // 16)))
    trees = [build_tree(_probe(sample, first, width), params.radius, leaves) for first, width in params.probes]
    probes, radius = params.probes, params.radius

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            words = _words(pdf["fp"].tolist())
            for t, (first, width) in enumerate(probes):
                for leaf, own in place(trees[t], _probe(words, first, width), radius):
                    yield pd.DataFrame({"probe": np.int32(t), "leaf": np.int32(leaf), **columns(words, pdf, own, t)})

    placed = materialize(prints.mapInPandas(assign, f"probe int, leaf int, {fields}"), "vp-shards")
    sizes = placed.groupBy("probe", "leaf").agg(F.ceil(F.count("*") / params.block).cast("int").alias("n"))
    own = F.pmod(F.xxhash64(name, F.lit(7)), F.col("n")).cast("int")
    parts = min(leaves * len(trees), 20_000)  # the work grows with the square of a shard's rows, so small shards aren't put together
    return (
        placed.join(F.broadcast(sizes), ["probe", "leaf"])  # a row per shard: at most ``most`` / 16 for each probe
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("probe", "leaf", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), *[c for c in placed.columns if c not in ("probe", "leaf")])
        .repartition(parts, "probe", "leaf", "x", "y")
    )


def fingerprint_components(prints: DataFrame, params: SimHashParams) -> DataFrame:
    """(node, root) for the fingerprints in column ``fp`` (distinct, binary) that have a link."""
    spark = prints.sparkSession
    if prints.isEmpty():
        return spark.createDataFrame([], "node binary, root binary")
    probes, radius, limit = params.probes, params.radius, params.limit
    tasks = _sharded(prints.select("fp"), params, "fp binary", lambda words, pdf, own, t: {"fp": pdf["fp"].to_numpy()[own]}, "fp")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        words = _words(pdf["fp"].tolist())
        first, width = probes[int(pdf["probe"].iloc[0])]
        root = link_shard(_probe(words, first, width), words, radius, limit)
        led = np.flatnonzero(root != np.arange(len(root)))
        fp = pdf["fp"].to_numpy()
        return pd.DataFrame({"a": fp[led], "b": fp[root[led]]})

    edges = tasks.groupBy("probe", "leaf", "x", "y").applyInPandas(link, "a binary, b binary")
    return connected_components(edges, "vp-links")


def near_duplicate_components(docs: DataFrame, id: str = "doc_id", text: str = "text", params: SimHashParams = CONTRACT) -> DataFrame:
    """A row per document: ``id``, ``fingerprint`` (lowercase hex) and ``component_id``."""
    slim = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = materialize(simhash(slim, "text", params, "fp").select("id", "fp"), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    links = fingerprint_components(prints, params)
    rooted = prints.join(links, prints.fp == links.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "roots")
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(classes, "root").select("fp", "component_id")
    return rows.join(named, "fp", "left").select(F.col("id").alias(id), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def proposed_pairs(prints: DataFrame, params: SimHashParams) -> DataFrame:
    """Distinct (a, b, d), a < b: pairs of ``node`` proposed by any of the trees over ``fp``, with the distance of their checks."""
    if prints.isEmpty():
        return prints.sparkSession.createDataFrame([], "a long, b long, d int")

    def columns(words: np.ndarray, pdf: pd.DataFrame, own: np.ndarray, t: int) -> dict:
        first, width = params.probes[t]
        checks = words[own, -2:].view(np.int64)
        return {"node": pdf["node"].to_numpy()[own], "key": _probe(words[own], first, width).view(np.int64), "c1": checks[:, 0], "c2": checks[:, 1]}

    tasks = _sharded(prints.select("fp", "node"), params, "node long, key long, c1 long, c2 long", columns, "node")

    def propose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")  # so that all trees choose alike
        checks = np.ascontiguousarray(pdf[["c1", "c2"]].to_numpy(np.int64)).view(np.uint64)
        i, j, d = propose_pairs(pdf["key"].to_numpy(np.int64).view(np.uint64), checks, params.radius, params.limit, params.nearest)
        node = pdf["node"].to_numpy()
        return pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j]), "d": d.astype(np.int32)})

    return tasks.groupBy("probe", "leaf", "x", "y").applyInPandas(propose, "a long, b long, d int").distinct()


def similar_pairs(pairs: DataFrame, texts: DataFrame, params: SimHashParams) -> DataFrame:
    """Those of ``pairs`` (a, b and more) whose ``texts`` (node, body) have shingle sets of the wanted Jaccard similarity."""
    import pyarrow as pa

    one = lambda n: texts.select(F.col("node").alias(n), F.col("body").alias(f"body_{n}"))
    both = pairs.join(one("b"), "b").join(one("a"), "a").select(*pairs.columns, "body_a", "body_b")
    names = pairs.columns
    n, at = len(names), names.index("a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, np.ndarray] = (None, np.zeros(0))
        for batch in batches:
            keep = []
            for a, x, y in zip(*(batch.column(k) for k in (at, n, n + 1)), strict=True):
                if a.as_py() != held[0]:
                    held = a.as_py(), np.unique(shingle_hashes(x.as_py(), params.shingle))
                other = np.unique(shingle_hashes(y.as_py(), params.shingle))
                common = len(np.intersect1d(held[1], other, assume_unique=True))
                keep.append(common >= params.similarity * (len(held[1]) + len(other) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[:n], names=names).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, pairs.schema)


def similar_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", params: SimHashParams = NEAR_DUPLICATES) -> DataFrame:
    """A row per document: ``id`` and ``component_id``, the smallest id of its class.

    Classes are linked by pairs whose sets of ``shingle``-word shingles have a
    Jaccard similarity of ``similarity`` or more, held exactly against the whole
    texts; texts of one fingerprint are one class. Null and empty texts are one
    class; fewer words than a shingle make one shingle; ids may repeat or be null.
    """
    named = settled(lambda: materialize(_similar_classes(docs, id, text, params), "similar-classes"))
    return named.select(F.col("id").alias(id), "component_id")


def _similar_classes(docs: DataFrame, id: str, text: str, params: SimHashParams) -> DataFrame:
    """(id, component_id). Each step deletes the tables that it wrote on its way."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    slim = docs.select(F.col(f"`{id}`").alias("id"), t.alias("text"), F.xxhash64(t).alias("h"))
    rows = materialize(_with_sketch(slim, params), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("id").alias("least"), F.min("h").alias("node")), "distinct-fingerprints")
    texts = docs.select(F.xxhash64(t).alias("node"), t.cast("binary").alias("body"))
    sure = settled(lambda: materialize(_checked(_nearest(prints, params), texts, params), "similar-nearest"))
    first = settled(lambda: materialize(prints.join(connected_components(sure, "near-classes"), "node", "left").select("fp", "least", F.coalesce("root", "node").alias("first")), "first-classes"))
    prefixes = _with_prefix(slim.select("h", "text"), frequent_shingles(slim, params), params)
    shared = settled(lambda: _shared(prefixes, rows, first, params))
    blocks = settled(lambda: materialize(_linked_in_blocks(shared.where(F.col("g") > FEW), slim, params), "similar-in-blocks"))
    apart = settled(lambda: materialize(_possible(_apart(shared.where(F.col("g") <= FEW), params), rows, params), "pairs-apart"))
    lead = materialize(apart.groupBy("root_a", "root_b").agg(F.min(F.struct("gap", "a", "b")).alias("x")).select("x.a", "x.b", "root_a", "root_b"), "leading-pairs")
    joined = settled(lambda: materialize(_checked(lead, texts, params).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).union(blocks), "similar-leading"))
    over = connected_components(joined, "near-classes")
    final = lambda e: over.select(F.col("node").alias(f"root_{e}"), F.col("root").alias(f"final_{e}"))
    left = apart.join(lead, ["a", "b"], "left_anti").join(final("a"), "root_a", "left").join(final("b"), "root_b", "left")
    left = left.where(F.coalesce("final_a", "root_a") != F.coalesce("final_b", "root_b")).select("a", "b", "root_a", "root_b")
    rest = _checked(materialize(left, "pairs-left"), texts, params).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    over = connected_components(over.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest), "near-classes").select(F.col("node").alias("first"), F.col("root").alias("final"))
    rooted = materialize(first.join(over, "first", "left").select("fp", "least", F.coalesce("final", "first").alias("root")), "roots")
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(classes, "root").select("fp", "component_id")
    return rows.select("id", "fp").join(named, "fp", "left").select("id", "component_id")


def _nearest(prints: DataFrame, params: SimHashParams) -> DataFrame:
    """(a, b): of each node of ``prints`` the pair proposed with the nearest."""
    pairs = materialize(proposed_pairs(prints, params), "proposed-pairs")
    each = pairs.select("a", "b", "d").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    near = each.groupBy("a").agg(F.min(F.struct("d", "b")).alias("x")).select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b")).distinct()
    return materialize(near, "nearest-pairs")


#: ids of texts that are broadcast rather than joined by an exchange of all texts
BROADCAST_IDS = 1_048_576
#: texts of a shingle that are joined in pairs; where there are more, they meet in blocks
FEW = 16
#: shingles wanted in a block; two blocks are held at once
BLOCK_SHINGLES = 1_048_576


def _checked(pairs: DataFrame, texts: DataFrame, params: SimHashParams) -> DataFrame:
    """``pairs`` (a, b and more) that have the wanted similarity, by the ``texts`` (node, body) of their ends, written once."""
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends-of-pairs")
    return similar_pairs(pairs, materialize(_once(texts, ends, "node", "body"), "texts-of-pairs"), params)


def _once(texts: DataFrame, ids: DataFrame, id: str, text: str) -> DataFrame:
    """(id, text): a row for each of ``ids``, distinct and written."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return texts.join(ids, id, "left_semi").groupBy(id).agg(F.first(text).alias(text))


def frequent_shingles(rows: DataFrame, params: SimHashParams) -> dict[int, int]:
    """Counts of the most frequent shingles of a sample of ``rows`` (text, h): 16,384 rows or so, 65,536 shingles at most."""
    share = min(1.0, 16_384 / max(rows.count(), 1))
    sample = rows.where(F.abs(F.col("h") % 1_000_000) < int(share * 1_000_000) + 1) if share < 1 else rows

    def shingles(texts: Iterator[bytes | None]) -> Iterator[tuple]:
        return ((np.unique(shingle_hashes(x, params.shingle)).view(np.int64),) for x in texts)

    each = map_texts(sample.select("text"), "text", [T.StructField("s", T.ArrayType(T.LongType()))], shingles).select(F.explode("s").alias("s"))
    top = each.groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(65_536)
    return {r["s"]: r["count"] for r in settled(lambda: materialize(top, "frequent-shingles")).collect()}


def prefix_of(h: np.ndarray, similarity: float, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set ``h``, rare ones first, of which similar sets must share one; ``hot``, sorted, with ``counts``."""
    if not len(h):
        return h
    n = len(h) - int(np.ceil(similarity * len(h) - 1e-6)) + 1
    if not len(hot):
        return h[:n]
    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
    return h[np.lexsort((h, np.where(hot[at] == h, counts[at], 0)))[:n]]


def parities(h: np.ndarray) -> bytes:
    """A bit for each value of the last bits of a set of shingle hashes: whether an odd number of them has it; two bits or more a shingle."""
    size = 64
    while size < 2 * len(h):
        size *= 2
    count = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def parity_gap(x: bytes, y: bytes) -> int:
    """A number of shingles by which two sets differ at least: each bit in which their parities differ needs one. The longer is folded."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _with_sketch(rows: DataFrame, params: SimHashParams) -> DataFrame:
    """(id, h, fp, odd): fingerprint and parities."""

    def made(texts: Iterator[bytes | None]) -> Iterator[tuple]:
        for x in texts:
            h = np.unique(shingle_hashes(x, params.shingle))
            yield print_of(h, params.blocks), parities(h)

    fields = [T.StructField("fp", T.BinaryType()), T.StructField("odd", T.BinaryType())]
    return map_texts(rows, "text", fields, made).select("id", "h", "fp", "odd")


def _with_prefix(rows: DataFrame, frequent: dict[int, int], params: SimHashParams) -> DataFrame:
    """(h, n, prefix): number of shingles, and those by which the exact join finds partners. Not written, it is large."""
    hot = np.array(list(frequent), np.int64).view(np.uint64)
    order = np.argsort(hot)
    hot, counts = hot[order], np.array(list(frequent.values()), np.int64)[order]

    def made(texts: Iterator[bytes | None]) -> Iterator[tuple]:
        for x in texts:
            h = np.unique(shingle_hashes(x, params.shingle))
            yield len(h), prefix_of(h, params.similarity, hot, counts).view(np.int64)

    fields = [T.StructField("n", T.IntegerType()), T.StructField("prefix", T.ArrayType(T.LongType()))]
    return map_texts(rows, "text", fields, made).select("h", "n", "prefix")


def _shared(prefixes: DataFrame, rows: DataFrame, first: DataFrame, params: SimHashParams) -> DataFrame:
    """(s, h, n, root, g, k, d): shingles of prefixes that texts of different classes share and by which they could be similar.

    ``g`` texts have the shingle; the text has ``k`` such shingles, ``d`` of them with more than ``FEW`` texts.
    """
    root = rows.select("h", "fp").distinct().join(first.select("fp", F.col("first").alias("root")), "fp").select("h", "root")
    each = prefixes.groupBy("h").agg(F.first(F.struct("n", "prefix")).alias("x")).join(root, "h")
    placed = each.select("h", "x.n", "root", F.explode("x.prefix").alias("s"))
    several = materialize(_several(placed), "shared-shingles")
    for _ in range(2):  # a second time as the first leaves fewer shingles to a text; more would leave hardly fewer
        several = materialize(_feasible(several, params), "shared-shingles")
    several = several.withColumn("g", F.count(F.lit(1)).over(Window.partitionBy("s")))
    counts = several.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("g") > FEW).alias("d"))
    return materialize(several.join(counts, "h").select("s", "h", "n", "root", "g", "k", "d"), "shared-shingles")


def _several(placed: DataFrame) -> DataFrame:
    """Those rows (s, h, n, root) whose shingle has texts of different classes."""
    by = Window.partitionBy("s")
    return placed.withColumns({"low": F.min("root").over(by), "high": F.max("root").over(by)}).where("low < high").select("s", "h", "n", "root")


def _feasible(several: DataFrame, params: SimHashParams) -> DataFrame:
    """``several`` without rows whose text has no partner of a possible size at the shingle.

    Sets of n and m <= n shingles that are similar have m >= t n, and share more than t / (1 + t) (m - t n) shingles
    of their prefixes (see ``_apart``), so m - t n is bounded for a text by the shingles it shares at all. In the order of
    m and t n the next m after each t n, and the last t n before each m, tell whether any is in reach.
    """
    t = params.similarity
    counts = several.groupBy("h").agg(F.count(F.lit(1)).alias("k"))
    each = several.join(counts, "h").withColumn("whole", F.explode(F.array(F.lit(0), F.lit(1))))
    each = each.withColumn("v", F.when(F.col("whole") == 1, F.col("n").cast("double")).otherwise(t * F.col("n") - 1e-6))
    until = lambda *order: Window.partitionBy("s").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.last(F.when(F.col("whole") == 0, F.col("v")), True).over(until("v", "whole"))
    size = F.last(F.when(F.col("whole") == 1, F.col("v")), True).over(until(F.desc("v"), F.desc("whole")))
    gap = F.when(F.col("whole") == 1, F.col("v") - least).otherwise(size - F.col("v"))
    near = each.withColumn("gap", gap).where(F.col("gap") <= F.col("k") * ((1 + t) / t) + 1e-3)
    return _several(near.select("s", "h", "n", "root").dropDuplicates(["s", "h"]))


def _apart(shared: DataFrame, params: SimHashParams) -> DataFrame:
    """(a, b, root_a, root_b, n_a, n_b): texts of different classes that share so many shingles of their prefixes that they could be similar.

    Similar sets of n and m shingles share t / (1 + t) (n + m). Of two prefixes one ends first in the common order;
    a shingle that is in both sets but not in both prefixes is behind that one's end in its set, where ceil(t n) - 1 are.
    Shingles of more texts, which are not in ``shared``, count as if both had the same.
    """
    of = lambda e: shared.select("s", *[F.col(c).alias(f"{c}_{e}") for c in ("h", "n", "root", "k", "d")])
    n, m = F.col("n_a"), F.col("n_b")
    size = F.least(n, m) >= params.similarity * F.greatest(n, m) - 1e-6
    enough = lambda count: count + F.ceil(params.similarity * F.greatest(n, m) - 1e-6) - 1 >= params.similarity / (1 + params.similarity) * (n + m) - 1e-6
    both = of("a").join(of("b"), "s").where((F.col("root_a") < F.col("root_b")) & size & enough(F.least("k_a", "k_b")))
    pairs = both.groupBy("h_a", "h_b", "root_a", "root_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("count"), F.first(F.least("d_a", "d_b")).alias("more"))
    return pairs.where(enough(F.col("count") + F.col("more"))).select(F.col("h_a").alias("a"), F.col("h_b").alias("b"), "root_a", "root_b", "n_a", "n_b")


def link_sets(sets: list[np.ndarray], root: np.ndarray, of: np.ndarray, to: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that join the classes ``root`` as all similar pairs of the members ``of`` with the members ``to`` would, one for each join."""
    n = np.array([len(x) for x in sets], np.int64)
    ends = np.concatenate(([0], np.cumsum(n)))
    value, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(value, kind="stable")
    value, member = value[order], member[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(value)), bool), value[1:] != value[:-1])))
    size = np.diff(np.concatenate((starts, [len(value)])))
    number = np.empty(len(value), np.int64)  # of each member's shingles
    number[order] = np.repeat(np.arange(len(starts)), size)
    root, heads, tails = root.copy(), [], []
    for i in np.flatnonzero(of):
        fit = to & (root != root[i]) & (np.minimum(n, n[i]) >= similarity * np.maximum(n, n[i]) - 1e-6)
        if not fit.any():
            continue
        at = number[ends[i] : ends[i + 1]]
        at = at[size[at] > 1]
        many = size[at]
        place = np.repeat(starts[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        common = np.bincount(member[place], minlength=len(sets))
        near = np.flatnonzero(fit & (common >= similarity * (n + n[i] - common) - 1e-9))
        classes, one = np.unique(root[near], return_index=True)
        heads += [i] * len(one)
        tails += near[one].tolist()
        root[np.isin(root, classes)] = root[i]
    return np.array(heads, np.int64), np.array(tails, np.int64)


def _linked_in_blocks(shared: DataFrame, texts: DataFrame, params: SimHashParams) -> DataFrame:
    """(a, b): classes with similar ``texts`` (h, text) among those that have a shingle of ``shared`` in common.

    A text is at home in the block of its most frequent shingle, and visits the blocks of more frequent ones that are home
    to a text with which it shares any; so of two texts one visits the other's. Blocks are few, as each takes most of what
    shares a shingle. Large ones are compared in parts, each two in a task of their own.
    """
    home = shared.groupBy("h").agg(F.max(F.struct("g", "s")).alias("home"))
    placed = materialize(shared.join(home, "h").select("s", "h", "n", "root", "home"), "homes")
    blocks = placed.select("s", F.col("home").alias("block")).distinct()
    visits = placed.join(blocks, "s").where("block >= home").select(F.col("block.s").alias("block"), "h", "n", "root").distinct()
    visits = materialize(visits, "visits")
    parts = visits.groupBy("block").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts"), F.min("root").alias("low"), F.max("root").alias("high"))
    visits = visits.join(parts.where("low < high").select("block", "parts"), "block")
    sets = map_texts(_once(texts, materialize(visits.select("h").distinct(), "texts-of-blocks"), "h", "text"), "text", [T.StructField("set", T.ArrayType(T.LongType()))], lambda each: ((np.unique(shingle_hashes(x, params.shingle)).view(np.int64),) for x in each))
    tasks = (
        visits.withColumn("own", F.pmod(F.xxhash64("h", F.lit(7)), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("block", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "h", "root")
        .join(materialize(sets.select("h", "set"), "sets-of-blocks"), "h")
    )

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        own, root = pdf["own"].to_numpy(), pdf["root"].to_numpy()
        i, j = link_sets(pdf["set"].tolist(), root, own == pdf["x"].iloc[0], own == pdf["y"].iloc[0], params.similarity)
        return pd.DataFrame({"a": root[i], "b": root[j]})

    return tasks.groupBy("block", "x", "y").applyInPandas(link, "a long, b long")


def _possible(pairs: DataFrame, rows: DataFrame, params: SimHashParams) -> DataFrame:
    """(a, b, root_a, root_b, gap): those of ``pairs`` whose parities differ in no more bits than similar sets can; gap is their share."""
    import pyarrow as pa

    pairs = materialize(pairs, "pairs-by-count")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    odd = materialize(rows.select("h", "odd").join(ends, "h", "left_semi").groupBy("h").agg(F.first("odd").alias("odd")), "parities")
    one = lambda e: odd.select(F.col("h").alias(e), F.col("odd").alias(f"odd_{e}"))
    both = pairs.join(one("b"), "b").join(one("a"), "a").select("a", "b", "root_a", "root_b", (F.col("n_a") + F.col("n_b")).cast("long").alias("n"), "odd_a", "odd_b")
    most = (1 - params.similarity) / (1 + params.similarity)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(4).to_numpy()
            gap = np.array([parity_gap(x.as_py(), y.as_py()) for x, y in zip(batch.column(5), batch.column(6), strict=True)], np.int64)
            out = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(gap / n)], names=["a", "b", "root_a", "root_b", "gap"])
            yield out.filter(pa.array(gap <= most * n + 1e-6))

    return both.mapInArrow(check, "a long, b long, root_a long, root_b long, gap double")
