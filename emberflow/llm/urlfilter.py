"""Operator 8, URL filters by a Bloom filter cascade, DataFrame functions only.

A cascade answers membership of a key in a list exactly, for every key of a
known universe. Level 0 is a Bloom filter of the listed keys; level 1 one of
the unlisted keys of the corpus that pass level 0; level 2 one of the listed
keys that pass level 1, and so on until nothing passes wrongly. The first level
that rejects a key decides by its parity. Building scans the distinct keys of
the corpus once a level; judging is one projection without a join.

A rule is a host and a path prefix, written ``host/path``. It fits its host and
all subdomains if the path begins with the rule's; the longest rule wins. The
keys of a url are its host suffixes, up to as many labels as any rule has, each
with its path prefixes of the lengths that rules have. A first cascade tells
which keys are rules, a second, over the rules as its universe, which of those
block. A url without a rule is on no list, so the method allows it.

The bits of all levels are literals in the plan. Their number depends on the
list (about 1.44 * log2(keys in corpus / rules) bits a rule, then 3 a rule) and
is checked against ``MAX_BITS``.

Defined cases: a null url, or one without ``://``, has empty host and path and
no rule; empty rule lists allow everything; repeated rows are judged one by
one; columns named like results are replaced; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Most bits of one level, 8 MB.
MAX_BITS = 1 << 26


def host_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path of a url; empty for null or without ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.char_length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


@dataclass(frozen=True)
class Level:
    """A Bloom filter: bits, hash functions and the words that have bits set."""

    bits: int
    hashes: int
    words: tuple[int, ...]
    seed: int

    def passes(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        ok = F.lit(True)
        for p in positions(key, self.seed, self.bits, self.hashes):
            word = F.get(words, F.shiftright(p, 6).cast("int"))
            ok = ok & (F.getbit(word, (p % 64).cast("int")) == 1)
        return ok


def positions(key: Column, seed: int, bits: int, hashes: int) -> list[Column]:
    """Double hashing of the two halves of one 64-bit hash; no sum overflows."""
    h = F.xxhash64(key, F.lit(seed))
    a, b = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 33)
    return [(a + n * b) % bits for n in range(hashes)]


def bloom_level(keys: DataFrame, rate: float, seed: int) -> Level:
    """Bloom filter of ``keys`` (column key, distinct) with the false positive rate."""
    n = keys.count()
    bits = max(64, 64 * math.ceil(n * math.log(1 / rate) / math.log(2) ** 2 / 64))
    if bits > MAX_BITS:
        raise ValueError(f"a level of {n} keys needs {bits} bits, more than MAX_BITS; judge the list in slices")
    hashes = max(1, round(bits / max(n, 1) * math.log(2)) if n else 1)
    hashes = min(hashes, 40)
    at = keys.select(F.explode(F.array(*positions(F.col("key"), seed, bits, hashes))).alias("p"))
    one = F.expr("shiftleft(1L, CAST(p % 64 AS INT))")
    rows = at.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(one).alias("v")).collect()
    words = [0] * (bits // 64)
    for r in rows:
        words[r.w] = r.v
    return Level(bits, hashes, tuple(words), seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Exact membership for keys of the universe: parity of the first level that rejects."""
        if not self.levels:
            return F.lit(False)
        out = F.lit(len(self.levels) % 2 == 1)
        for n in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[n].passes(key), out).otherwise(F.lit(n % 2 == 1))
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, most: int = 64) -> Cascade:
    """Cascade of ``listed`` over ``universe``: DataFrames with a column key, no nulls.

    The first level is tight enough that about as many keys pass it wrongly as
    are listed; later levels halve what is left.
    """
    inside = materialize(listed.select("key").distinct(), "listed-keys")
    outside = materialize(universe.select("key").distinct().join(inside, "key", "left_anti"), "unlisted-keys")
    n_in, n_out = inside.count(), outside.count()
    if n_in == 0:
        return Cascade(())
    levels: list[Level] = []
    coded, other = inside, outside
    rate = min(0.5, max(1e-9, n_in / max(n_out, 1)))
    while len(levels) < most:
        levels.append(bloom_level(coded, rate, len(levels)))
        wrong = materialize(other.where(levels[-1].passes(F.col("key"))), "wrong-keys")
        if wrong.isEmpty():
            return Cascade(tuple(levels))
        coded, other, rate = wrong, coded, 0.5
    raise RuntimeError(f"the cascade did not end within {most} levels")


@dataclass(frozen=True)
class Rule:
    verdict: str
    key: str  # host/path

    @property
    def labels(self) -> int:
        return self.key.partition("/")[0].count(".") + 1

    @property
    def path_chars(self) -> int:
        return len(self.key) - len(self.key.partition("/")[0])


#: The rules of the query.
RULES = (Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"), Rule("block", "net/fr/"))


def rule_keys(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Array of the keys under which a rule for this host and path could be listed."""
    keys = []
    for labels in range(1, max([r.labels for r in rules], default=0) + 1):
        for chars in sorted({r.path_chars for r in rules}):
            keys.append(F.when((host != "") & (F.char_length(path) >= chars), F.concat(F.substring_index(host, ".", -labels), F.left(path, F.lit(chars)))))
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def judge_urls(pages: DataFrame, url: str = "url", rules: Sequence[Rule] = RULES, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict."""
    own = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_path(F.col(f"`{url}`"))
    spark = pages.sparkSession
    listed = spark.createDataFrame([(r.key, r.verdict) for r in rules], "key string, verdict string")
    parsed = pages.select(host.alias("host"), path.alias("path"))
    universe = parsed.select(F.explode(rule_keys(F.col("host"), F.col("path"), rules)).alias("key"))
    known = build_cascade(listed, universe)
    blocking = build_cascade(listed.where("verdict = 'block'"), listed)
    rows = pages.select(*own, host.alias("host"), path.alias("path"))
    fits = F.filter(rule_keys(F.col("host"), F.col("path"), rules), known.holds)
    best = F.array_max(F.transform(fits, lambda k: F.struct(F.char_length(k).alias("size"), k.alias("key"))))
    rows = rows.select("*", best["key"].alias("rule"))
    verdict = F.when(F.col("rule").isNull(), default).when(blocking.holds(F.col("rule")), "block").otherwise("allow")
    return rows.select("*", verdict.alias("verdict"))
