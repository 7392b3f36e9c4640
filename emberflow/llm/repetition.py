"""Operator 6, quality rules by repetition coverage.

Every text is cut into words; rolling polynomial hashes of several n-gram
lengths, all in numpy, tell which n-grams occur more than once, and the
characters inside them (each counted once) are measured against all characters
in words. Duplicated lines are measured likewise.

Per text: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
``n_repeat_words`` (words in 3-word windows found twice or more, by exact
window identity), ``dup_line_chars`` (share of the characters that stand in
lines equal to an earlier one), ``dup_<n>gram_chars`` for each n, and the
verdicts ``base_failed`` and ``kept``.

Defined cases: null and empty texts have no words, count 0 throughout and fail
the base rule; columns of the input that bear a result's name are replaced;
repeated rows are judged one by one; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ASCII_SPACE, map_texts

_SPACE = np.zeros(256, bool)
_SPACE[list(ASCII_SPACE)] = True
#: The symbols that the rule counts.
SYMBOLS = b"#*$%&|<>"
#: Multiplier of the rolling hash, any large odd number.
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class RepetitionRules:
    """Thresholds. A text fails where a measure is above its share."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_dup_line_chars: float = 0.3
    #: n-gram length -> most characters inside n-grams that occur twice or more
    max_dup_ngram_chars: tuple[tuple[int, float], ...] = ((5, 0.35), (8, 0.30), (10, 0.25))
    #: most symbols per word; None: the rule is off
    max_symbols_per_word: float | None = 0.3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(1)) * _BASE
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _repeated(keys: np.ndarray) -> np.ndarray | None:
    """Mask of the entries that occur more than once, None if there are none."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return None
    twice = np.zeros(len(keys), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.zeros(len(keys), bool)
    out[order] = twice
    return out


def _covered(starts: np.ndarray | None, n: int, words: int) -> np.ndarray:
    """Mask of the words inside the windows of n words that begin at ``starts``."""
    if starts is None:
        return np.zeros(words, bool)
    edge = np.zeros(words + 1, np.int64)
    edge[: len(starts)] += starts
    edge[n : n + len(starts)] -= starts
    return np.cumsum(edge[:words]) > 0


def rolling_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all windows of n word ids."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    words = _mix(ids.astype(np.uint64))
    out = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _BASE + words[k : len(words) - n + 1 + k]
    return out


def _windows3(ids: np.ndarray, distinct: int) -> np.ndarray:
    """Exact keys of the 3-word windows."""
    if len(ids) < 3:
        return np.zeros(0, np.int64)
    pair = ids[:-1] * distinct + ids[1:]  # below 2**63 for up to 3e9 distinct words
    if distinct < 1 << 20:
        return pair[:-1] * distinct + ids[2:]
    _, rank = np.unique(pair, return_inverse=True)
    return rank[:-1].astype(np.int64) * distinct + ids[2:]


def measure(text: bytes | None, rules: RepetitionRules) -> tuple:
    """All measures and the verdict for one text."""
    body = text or b""
    words = body.split()  # bytes.split() separates at ASCII_SPACE exactly
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    raw = np.frombuffer(body, np.uint8)
    space = _SPACE[raw]
    points = np.concatenate(([0], np.cumsum(((raw & 0xC0) != 0x80) & ~space)))
    edges = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    lengths = points[np.flatnonzero(edges == 1)] - points[np.flatnonzero(edges == -1)]
    chars = int(points[-1])
    symbols = len(body) - len(body.translate(None, SYMBOLS))

    lines: set[bytes] = set()
    dup_lines = dup_line_chars = 0
    for line in body.split(b"\n"):
        if line in lines:
            dup_lines += 1
            dup_line_chars += len(line.decode("utf-8", "replace")) - sum(map(line.count, (b" ", b"\t", b"\x0b", b"\x0c", b"\r")))
        elif line.strip():
            lines.add(line)
    repeat = int(_covered(_repeated(_windows3(ids, len(seen))), 3, n).sum())

    shares = []
    for k, _ in rules.max_dup_ngram_chars:
        twice = _repeated(rolling_hashes(ids, k))
        shares.append(float(lengths[_covered(twice, k, n)].sum() / chars) if twice is not None else 0.0)
    line_share = dup_line_chars / chars if chars else 0.0
    base_failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
    kept = not (
        base_failed
        or line_share > rules.max_dup_line_chars
        or any(s > most for s, (_, most) in zip(shares, rules.max_dup_ngram_chars, strict=True))
        or (rules.max_symbols_per_word is not None and symbols > rules.max_symbols_per_word * n)
    )
    return (n, chars, symbols, dup_lines, repeat, line_share, *shares, base_failed, kept)


def repetition_quality(docs: DataFrame, text: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """``docs`` with all measures of its texts and the columns base_failed and kept.

    A map over the rows: no shuffle, memory bounded by one Arrow batch and one text.
    """
    fields = [T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [T.StructField(x, T.DoubleType()) for x in ("dup_line_chars", *(f"dup_{k}gram_chars" for k, _ in rules.max_dup_ngram_chars))]
    fields += [T.StructField(x, T.BooleanType()) for x in ("base_failed", "kept")]

    def rows(texts: Iterator[bytes | None]) -> Iterator[tuple]:
        return (measure(t, rules) for t in texts)

    return map_texts(docs, text, fields, rows)
