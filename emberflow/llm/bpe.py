"""Operator 2, exact byte-level BPE by dynamic programming over prefixes.

For every prefix of a pre-token exactly one vocabulary entry can be the last
token of its encoding. A suffix automaton of the vocabulary (its trie with
suffix links) lists the entries that end at each position; the one that is
compatible with the last token of the shorter prefix before it is stored, and
the ids are read off by following these back-pointers. Two tokens are compatible
if no merge across their border comes before the merges inside them. Costs are
linear in the text; no merge loop runs over it.

Ids equal those of the published tokenizer files as the ``tokenizers`` library
applies them without added special tokens; strings of special tokens that stand
in a text become their ids, as there. ``decode`` maps ids back, byte for byte.

Defined cases: null and empty texts have no ids and decode to the empty text;
texts of any length are encoded whole; repeated rows are encoded one by one;
columns named like the result are replaced; an empty table stays empty.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the published pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of each half of a store of results in a worker; a full half replaces the other.
CACHE = 180_000
#: Pairs of tokens whose test is kept, and prefixes whose last token is.
PAIRS = 250_000
PREFIXES = 150_000
#: Texts of one Arrow batch of results.
SLICE = 256
#: Longer words are not kept.
CACHE_CHARS = 48


def byte_letters() -> dict[str, int]:
    """The published letter -> byte table: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Token bytes by id, merge ranks by id pair and special tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    ids = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
    tokens: list[bytes | None] = [None] * (1 + max([*ids.values(), *special.values()]))
    for word, n in ids.items():
        tokens[n] = bytes(letters[c] for c in word)
    for word, n in special.items():
        tokens[n] = word.encode()
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges.setdefault(ids[left] << 32 | ids[right], (rank, ids[left + right]))
    return {"tokens": tokens, "merges": merges, "special": special, "bytes": [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]}


class Recent:
    """Results by key, the recent ones: two halves, the older dropped when the newer is full."""

    def __init__(self, size: int):
        self.new: dict = {}
        self.old: dict = {}
        self.size = size

    def get(self, key):
        """The result, or None; for what the newer half lacks."""
        found = self.old.get(key)
        if found is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old = dict(self.new)
            self.new.clear()
        self.new[key] = value


class SuffixAutomaton:
    """Trie of byte strings with suffix links; ``ends[node]``: (value, size) of all that end there, longest first."""

    def __init__(self, entries: list[tuple[bytes, int]]):
        self.steps: dict[int, int] = {}  # node << 8 | byte -> node; links followed once are added
        self.ends: list[tuple] = [()]
        for data, value in entries:
            node = 0
            for byte in data:
                key = node << 8 | byte
                node = self.steps.get(key, 0)
                if not node:
                    node = self.steps[key] = len(self.ends)
                    self.ends.append(())
            self.ends[node] = ((value, len(data)),)
        self.links = [0] * len(self.ends)
        below: dict[int, list[tuple[int, int]]] = {}
        for key, child in self.steps.items():
            below.setdefault(key >> 8, []).append((key & 255, child))
        level = [0]
        while level:
            following = []
            for node in level:
                for byte, child in below.get(node, ()):
                    if node:
                        self.links[child] = link = self.step(self.links[node], byte, keep=False)
                        self.ends[child] += self.ends[link]
                    following.append(child)
            level = following

    def step(self, node: int, byte: int, keep: bool = True) -> int:
        at = node
        while (found := self.steps.get(at << 8 | byte)) is None and at:
            at = self.links[at]
        found = found or 0
        if keep and at != node and len(self.steps) < 4 * len(self.ends):
            self.steps[node << 8 | byte] = found
        return found


class PrefixEncoder:
    """The per-prefix encoder of one vocabulary, with its stores."""

    def __init__(self, vocabulary: dict):
        self.tokens = vocabulary["tokens"]
        self.merges = vocabulary["merges"]
        self.single = vocabulary["bytes"]
        self.special = vocabulary["special"]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = regex.compile(PATTERN).findall
        special = set(self.special.values())
        self.automaton = SuffixAutomaton([(t, n) for n, t in enumerate(self.tokens) if t and n not in special and self._merge(t) == [n]])
        self.prefixes: dict[int, int] = {}  # prefix << 8 | byte -> longer prefix, for prefixes met before
        self.prefix_node, self.prefix_token = array("i", [0]), array("i", [-1])  # automaton node and last token of each
        self.inner_space = regex.compile(r"\s").search
        self.parts = {}  # token -> rank and ids of the merge that makes it
        for key, (rank, new) in self.merges.items():
            self.parts.setdefault(new, (rank, key >> 32, key & 0xFFFFFFFF))
        self.edges: dict[int, list[tuple[int, int, int]]] = {}
        self.fits: dict[int, bool] = {}
        self.words = Recent(CACHE)  # a space and letters, by the letters
        self.others = Recent(CACHE // 8)
        self.tails = {c: self.bytes_of([self.single[ord(c)]]) for c in ",.!?;:"}  # each a pre-token after letters and before a space

    def _merge(self, data: bytes) -> list[int]:
        """Encoding of a vocabulary entry's bytes from the merge list, to leave out unreachable entries."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            keys = [a << 32 | b for a, b in pairwise(ids)]
            _, new, key = min(((*self.merges[k], k) for k in keys if k in self.merges), default=(0, -1, -1))
            if key < 0:
                break
            out, at = [], 0
            while at < len(ids):
                if at < len(keys) and keys[at] == key:
                    out.append(new)
                    at += 2
                else:
                    out.append(ids[at])
                    at += 1
            ids = out
        return ids

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """What stands at the left (0) or right (1) end of a token as it is merged together.

        (part, rank of the merge that made it, rank of the merge that takes it up), outermost first.
        """
        out, until = [], 1 << 62
        while True:
            made = self.parts.get(token)
            out.append((token, made[0] if made else -1, until))
            if made is None:
                return out
            until, token = made[0], made[1 + side]

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge across the border of two tokens comes before those inside them.

        A merge of two end parts happens if both exist at its rank. Equal merges
        go from left to right, so at equal rank the left token's own comes first.
        """
        key = left << 32 | right
        fit = self.fits.get(key)
        if fit is None:
            a, b = self.edges.get(left), self.edges.get(~right)
            if a is None:
                a = self.edges[left] = self._edge(left, 1)
            if b is None:
                b = self.edges[~right] = self._edge(right, 0)
            fit = True
            for x, x_made, x_until in a:
                for y, y_made, y_until in b:
                    merge = self.merges.get(x << 32 | y)
                    if merge is not None and x_made < merge[0] < x_until and y_made < merge[0] <= y_until:
                        fit = False
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            self.fits[key] = fit
        return fit

    def pretoken(self, data: bytes) -> list[int]:
        """Ids of one pre-token: last token of every prefix, then the way back.

        Results for prefixes that other pre-tokens shared are looked up.
        """
        last = [-1]
        prefix = node = 0
        steps, ends, prefixes, nodes, tokens = self.automaton.steps, self.automaton.ends, self.prefixes, self.prefix_node, self.prefix_token
        for byte in data:
            key = prefix << 8 | byte
            known = prefixes.get(key, -1) if prefix >= 0 else -1
            if known > 0:
                prefix = known
                node = nodes[known]
                last.append(tokens[known])
                continue
            step = node << 8 | byte
            node = steps[step] if step in steps else self.automaton.step(node, byte)
            end = len(last)
            for token, size in ends[node]:
                if end == size:
                    break
                before = last[end - size]
                if before >= 0 and self.compatible(before, token):
                    break
            else:
                token = -1
            last.append(token)
            if prefix >= 0 and len(nodes) < PREFIXES:
                prefixes[key] = prefix = len(nodes)
                nodes.append(node)
                tokens.append(token)
            else:
                prefix = -1
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at -= len(self.tokens[last[at]])
        return ids[::-1]

    @staticmethod
    def bytes_of(ids: list[int]) -> bytes:
        return array("i", ids).tobytes()

    def word(self, letters: str) -> bytes:
        """Ids of a space and letters, one pre-token."""
        ids = self.words.new.get(letters) or self.words.get(letters)
        if ids is None:
            ids = self.bytes_of(self.pretoken(b" " + letters.encode()))
            if len(letters) <= CACHE_CHARS:
                self.words.put(letters, ids)
        return ids

    def pretokens(self, text: str) -> bytes:
        """Ids of a text without special tokens, as bytes of 32-bit integers."""
        out = []
        for part in self.find(text):
            if part[0] == " " and part[1:].isalpha():
                out.append(self.word(part[1:]))
                continue
            ids = self.others.new.get(part) or self.others.get(part)
            if ids is None:
                ids = self.bytes_of(self.pretoken(part.encode()))
                if len(part) <= CACHE_CHARS:
                    self.others.put(part, ids)
            out.append(ids)
        return b"".join(out)

    def plain(self, text: str) -> bytes:
        """The same, cut where one space stands between two other characters.

        No pre-token reaches over such a cut and the space belongs to what
        follows, so words between cuts that are letters, or letters and one
        mark, need no pattern.
        """
        words = text.split(" ")
        if any(not w or w[0].isspace() or w[-1].isspace() for w in words):
            return self.pretokens(text)
        out = [self.pretokens(words[0])]
        fresh, tails = self.words.new, self.tails
        for word in words[1:]:
            ids = fresh.get(word)
            if ids is None:
                if word.isalpha():
                    ids = self.word(word)
                elif word[-1] in tails and (head := word[:-1]).isalpha():
                    ids = (fresh.get(head) or self.word(head)) + tails[word[-1]]
                else:
                    ids = self.pretokens(" " + word)
            out.append(ids)
        return b"".join(out)

    def encode_bytes(self, text: str) -> bytes:
        if not self.split:
            return self.plain(text) if text else b""
        return b"".join(np.int32(self.special[part]).tobytes() if part in self.special else self.plain(part) for part in self.split.split(text) if part)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()


_ENCODERS: dict[str, PrefixEncoder] = {}


def _encoder(key: str, vocabulary) -> PrefixEncoder:
    """One encoder per worker and vocabulary."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PrefixEncoder(vocabulary.value)
    return _ENCODERS[key]


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few results are held at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def encode(docs: DataFrame, path: str, text: str = "text", column: str = "ids") -> DataFrame:
    """``docs`` with the array of token ids of ``text``.

    ``path``: a tokenizer file on the driver; its tables (a few MB whatever the
    corpus) are broadcast. A map over the rows, no shuffle.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    kept = [f for f in docs.schema.fields if f.name != column]
    schema = T.StructType([*kept, T.StructField(column, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, vocabulary)
        for batch in sliced(batches):
            ids = [encoder.encode_bytes((t.as_py() or b"").decode("utf-8", "replace")) for t in batch.column(batch.num_columns - 1)]
            ends = np.cumsum([0, *map(len, ids)]) // 4
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[f.name for f in schema.fields])

    return docs.select(*[f"`{f.name}`" for f in kept], F.col(f"`{text}`").cast("binary").alias("__text_bytes__")).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids``; null for null ids. Special tokens are written out."""
    tokens = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path)["tokens"])
    kept = [f for f in docs.schema.fields if f.name != column]
    schema = T.StructType([*kept, T.StructField(column, T.StringType())])
    at = [f.name for f in kept].index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens.value
        for batch in sliced(batches):
            texts = []
            for row in batch.column(at):
                own = row.values
                texts.append(None if own is None else b"".join(map(table.__getitem__, own.to_numpy(zero_copy_only=False).tolist())).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, schema)
