"""Operator 4, substring dedup by hashing lines and paragraphs.

A text is cut into units: its lines, these at sentence marks before white space,
and what is longer than sixteen words after the word with the least hash of each
sixteen. All cuts depend on the words around them only, so a passage put into the
middle of other text has the same units inside, whatever stands around it.
Units are normalised (lower case, words only) and their digests grouped
globally. The earliest occurrence, by id, text hash, then offset, is kept; every
other one is a repeat. ``repeated_passages`` gives runs of whole units. The ends
of a passage lie within units that also hold other text: ``whole_passages`` takes
the runs of ``seed_words`` or more, extends each word by word while the text
that keeps it has the same words, joins what overlaps, and reports what then
has ``min_words`` or more; shorter ones are common phrases and stay.
Offsets are code points of the original text, ends exclusive.

A passage of n words shares all cuts but those within sixteen words of its ends,
so its whole units hold n - 32 words at least: a passage of 44 words has a seed
wherever it stands. Shorter ones have one if their units lie well. A passage has
two units or more (``min_words`` is above sixteen), so a chance collision of one
64-bit digest makes none.

Grouping keeps one row per digest and task before the exchange. The repeated
digests are written before the units are joined with them, so both sides of the
join stand right above their exchange and Spark splits the partition of a hot
digest. Passages are formed within one text. Extension asks for bounded pieces
around those ends that have more words beside them, by one join with the texts.

Defined cases: null and empty texts have no units; a null id ranks last;
repeated rows, equal in id and text, count as one document and are treated
alike; texts that share an id, or have none, are different documents, ranked by
(id, 64-bit hash of the text); texts are cut whole, however long; an empty table
gives an empty table; columns named like results are replaced, others are kept
by ``remove_passages``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Where units end: sentence marks before white space, and line ends.
_END = re.compile(r"[.!?…。]+(?=\s)|\n")
_WORD = re.compile(r"\w+")
UNITS = "id long, doc long, digest long, word int, words int, start int, chars int, again boolean, last boolean"
#: Units have at most so many words, or are cut after the least of each so many.
_LONG = 16
#: Characters looked at around an end; units have at most sixteen words.
_AROUND = 400
_LAST = 2**63 - 1
#: Texts that a task remembers, so that rows repeated in it are cut once.
_REMEMBERED = 65_536


def _lower(text: str) -> str:
    """Lower case with the same offsets: letters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


_RANKS: dict[str, int] = {}


def _rank(word: str) -> int:
    if len(_RANKS) > 500_000:
        _RANKS.clear()
    return _RANKS.setdefault(word, zlib.crc32(word.encode("utf-8", "replace")))


def _pieces(words: list[str]) -> list[int]:
    """Ends of the pieces of a long unit: after the least (and last of these) of each ``_LONG`` words."""
    h = [_RANKS.get(w) or _rank(w) for w in words]
    ends, at = [], -1
    for i in range(_LONG - 1, len(h)):
        if at <= i - _LONG:
            first = i - _LONG + 1
            least = min(h[first : i + 1])
            at = next(k for k in range(i, first - 1, -1) if h[k] == least)
        elif h[i] <= h[at]:
            at = i
        else:
            continue
        ends.append(at + 1)
    if ends[-1] != len(words):
        ends.append(len(words))
    return ends


def cut(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, normalised words) of the units that have words."""
    text = _lower(text)
    size, start = len(text), 0
    for m in chain(_END.finditer(text), (None,)):
        if m is None:
            end = after = size
        else:
            after = m.end()
            end = m.start() if text[after - 1] == "\n" else after
        words = _WORD.findall(text[start:end])
        if words:
            while text[start].isspace():
                start += 1
            if len(words) <= _LONG:
                yield start, end, words
            else:
                spans = [w.span() for w in _WORD.finditer(text, start, end)]
                first = 0
                for last in _pieces(words):
                    yield start if first == 0 else spans[first][0], end if last == len(words) else spans[last - 1][1], words[first:last]
                    first = last
        start = after


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def digest(words: list[str]) -> int:
    return _signed(xxhash.xxh3_64_intdigest(" ".join(words)))


def units(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per unit of every text; ``again``: the text had it before; ``last``: no unit follows."""
    kinds = pa.schema([*[(n, pa.int64()) for n in ("id", "doc", "digest")], *[(n, pa.int32()) for n in ("word", "words", "start", "chars")], ("again", pa.bool_()), ("last", pa.bool_())])

    def batch_of(made: list[list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(made, kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[list[int]] = [[] for _ in kinds]
        known: dict[tuple[int, int], None] = {}
        for batch in batches:
            for name, body_hash, data in zip(*batch.columns, strict=True):
                key = name.as_py(), body_hash.as_py()
                body = None if key in known else data.as_py()
                if not body:
                    continue
                known[key] = None
                if len(known) > _REMEMBERED:
                    del known[next(iter(known))]
                seen: set[int] = set()
                at = 0
                for start, end, words in cut(body.decode("utf-8", "replace")):
                    code = digest(words)
                    for column, value in zip(made, (*key, code, at, len(words), start, end - start, code in seen, False), strict=True):
                        column.append(value)
                    seen.add(code)
                    at += len(words)
                if at:
                    made[-1][-1] = True
                if len(made[0]) >= 50_000:
                    yield batch_of(made)
                    made = [[] for _ in kinds]
        yield batch_of(made)

    return docs.select(*_keys(id, text, "id", "doc"), F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(run, UNITS)


def _keys(id: str, text: str, *names: str) -> list[Column]:
    """Id, the greatest number if null, and hash of the text."""
    return [F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(_LAST)).alias(names[0]), F.xxhash64(F.col(f"`{text}`")).alias(names[1])]


def _runs(docs: DataFrame, id: str, text: str) -> DataFrame:
    """A row per run of consecutive repeated units.

    ``first`` keeps its first unit; ``left`` and ``right``, ``left2`` and
    ``right2`` are units near its ends with the place that keeps them; ``last``:
    its last unit ends the text.
    """
    cutting = materialize(units(docs, id, text), "units")
    firsts = cutting.groupBy("digest").agg(F.min(F.struct("id", "doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = materialize(firsts, "repeated-units")
    again = cutting.join(firsts, "digest").where("again OR id <> first.id OR doc <> first.doc").select("id", "doc", "word", "words", "start", "chars", "last", "first")
    # one exchange by text serves the removal of repeated rows, the window and the grouping
    again = again.repartition("id", "doc").dropDuplicates(["id", "doc", "word"])
    # units of a run follow each other: the words that stand between repeated units are as many before each of them
    repeated = F.sum("words").over(Window.partitionBy("id", "doc").orderBy("word").rowsBetween(Window.unboundedPreceding, -1))
    runs = again.withColumn("run", F.col("word") - F.coalesce(repeated, F.lit(0)).cast("int")).groupBy("id", "doc", "run")
    # short units may be kept by texts that share nothing else, so the ends go by the outermost unit of five words, or the longest
    at = F.struct("first", "start", "word")
    unit = F.when(F.col("words") >= 5, F.col("word"))
    ends = [F.coalesce(by(at, unit), F.max_by(at, "words")).alias(n) for n, by in (("left", F.min_by), ("right", F.max_by))]
    # and, as those may be kept by a shorter copy, by the outermost of the earliest text
    far = lambda u: F.when(F.col("words") >= 5, F.struct("first.id", "first.doc", u.alias("u")))
    ends += [F.coalesce(F.min_by(at, far(u)), F.max_by(at, "words")).alias(n) for n, u in (("left2", F.col("word")), ("right2", -F.col("word")))]
    return runs.agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("chars")).alias("end"), F.min("word").alias("word"), F.sum("words").cast("long").alias("n_words"), F.count("*").alias("n_units"), F.bool_or("last").alias("last"), F.min_by("first", "word").alias("first"), *ends)


def _named(found: DataFrame, id: str) -> DataFrame:
    real = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return found.select(real("id").alias(id), "doc", "start", "end", "n_words", "n_units", real("first.id").alias("kept_id"))


def repeated_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = 25) -> DataFrame:
    """Whole repeated units: (id, doc, start, end, n_words, n_units, kept_id): what is removed, and the text that keeps it (its first unit)."""
    return _named(_runs(docs, id, text).where(F.col("n_words") >= min_words), id)


def extension(own: str, kept: str, back: bool) -> tuple[int, int]:
    """(words, characters of ``own``) that are equal from the start of both, or from their ends if ``back``."""
    a, b = ([m.span() + (m[0],) for m in _WORD.finditer(_lower(t))] for t in (own, kept))
    for spans, piece in ((a, own), (b, kept)):
        if len(piece) >= _AROUND and spans:  # its far word may be cut
            spans.pop(0 if back else -1)
    if back:
        a.reverse()
        b.reverse()
    n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x[2] != y[2]), min(len(a), len(b)))
    return n, 0 if n == 0 else len(own) - a[n - 1][0] if back else a[n - 1][1]


def whole_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = 25, seed_words: int = 12) -> DataFrame:
    """As ``repeated_passages``, each extended to the words around it that its kept text has too."""
    if min(seed_words, min_words) < 1 or min_words <= _LONG:
        raise ValueError(f"min_words must be above {_LONG}, the words of a unit")
    seeds = materialize(_runs(docs, id, text).where(F.col("n_words") >= min(seed_words, min_words)), "seeds")
    c = F.col
    asks = []
    for back, near, far in ((True, "left", "left2"), (False, "right", "right2")):
        beside = c("word") > 0 if back else ~c("last")  # the text has more words on this side
        for way, end in enumerate((near, far)):
            wanted = beside if way == 0 else beside & (c(f"{far}.start") != c(f"{near}.start"))
            for own, i, d, at in ((True, c("id"), c("doc"), c(f"{end}.start")), (False, c(f"{end}.first.id"), c(f"{end}.first.doc"), c(f"{end}.first.start"))):
                asks.append(F.when(wanted, F.struct(F.lit(way).alias("way"), F.lit(back).alias("back"), F.lit(own).alias("own"), i.alias("__id"), d.alias("__doc"), at.alias("at"), c(f"{end}.word").alias("word"))))
    asked = seeds.select("id", "doc", "run", F.explode(F.array_compact(F.array(*asks))).alias("x")).select("id", "doc", "run", "x.*")
    bodies = docs.select(*_keys(id, text, "__id", "__doc"), F.col(f"`{text}`").alias("__text"))
    # repeated rows: one of each task and key is sent on
    bodies = bodies.groupBy("__id", "__doc").agg(F.first("__text").alias("__text"))
    low = F.greatest(c("at") - _AROUND, F.lit(0))
    piece = F.when(c("back"), F.substring("__text", low + 1, c("at") - low)).otherwise(F.substring("__text", c("at") + 1, F.lit(_AROUND)))
    pieces = asked.join(bodies, ["__id", "__doc"]).select("id", "doc", "run", "way", "back", "own", "at", "word", piece.alias("piece"))
    of = lambda own, x: F.max(F.when(c("own") == own, c(x)))
    pairs = pieces.groupBy("id", "doc", "run", "way", "back").agg(of(True, "piece").alias("own"), of(False, "piece").alias("kept"), of(True, "at").alias("at"), F.max("word").alias("word"))
    pairs = pairs.select("id", "doc", "run", "back", "own", "kept", "at", "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = []
            for back, own, kept, at, word in zip(*(batch.column(k).to_pylist() for k in range(3, 8)), strict=True):
                n, chars = extension(own, kept, back)
                more.append((word - n, at - chars) if back else (word + n, at + chars))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([m[0] for m in more], pa.int32()), pa.array([m[1] for m in more], pa.int32())], names=["id", "doc", "run", "back", "word", "char"])

    more = pairs.mapInArrow(run, "id long, doc long, run int, back boolean, word int, char int")
    ends = more.groupBy("id", "doc", "run").agg(*[f(F.when(c("back") == b, c(x))).alias(f"{x}_{n}") for b, n, f in ((True, "l", F.min), (False, "r", F.max)) for x in ("word", "char")])
    long = seeds.join(ends, ["id", "doc", "run"], "left")  # least and greatest pass over nulls
    long = long.select(
        "id", "doc", "n_units", "first",
        F.least(c("start"), c("char_l")).alias("start"), F.greatest(c("end"), c("char_r")).alias("end"),
        F.least(c("word"), c("word_l")).alias("word"), F.greatest(c("word") + c("n_words"), c("word_r")).alias("stop"),
    )
    by = Window.partitionBy("id", "doc").orderBy("word", "stop")
    before = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    parted = long.withColumn("new", F.when(c("word") <= before, 0).otherwise(1)).withColumn("part", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    found = parted.groupBy("id", "doc", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("stop") - F.min("word")).cast("long").alias("n_words"), F.sum("n_units").alias("n_units"), F.min_by("first", "word").alias("first"))
    return _named(found.where(c("n_words") >= min_words), id)


def _without(text: Column, spans: Column) -> Column:
    """The text outside sorted disjoint spans."""
    parts = F.transform(spans, lambda s, i: F.substring(text, F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"]) + 1, s["start"] - F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])))
    return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(spans, -1)["end"] + 1, F.char_length(text)))


def remove_passages(docs: DataFrame, passages: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the passages, and ``removed``: their spans in the original text (empty if none)."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "removed"])
    spans = passages.groupBy(F.coalesce(F.col(f"`{id}`"), F.lit(_LAST)).alias("__id"), F.col("doc").alias("__doc")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    keyed = docs.select("*", *_keys(id, text, "__id", "__doc"))
    joined = keyed.join(spans, ["__id", "__doc"], "left").drop("__id", "__doc")
    kept = F.when(F.col("removed").isNotNull(), _without(F.col(f"`{text}`"), F.col("removed"))).otherwise(F.col(f"`{text}`"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return joined.withColumns({text: kept, "removed": F.coalesce("removed", none)})
