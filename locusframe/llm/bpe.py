"""Encoding whole corpora with a public byte-level BPE vocabulary.

Per piece of text the ids come from a dynamic programme over prefixes: for every prefix the last token of its
encoding is unique; it is the longest vocabulary match ending there whose predecessor (the last token of the prefix
before it) may stand next to it. Matches come from an Aho-Corasick automaton over the vocabulary, whose suffix links give all tokens that end at a byte,
the neighbour test from the merge tree. Following the stored last tokens backwards gives the exact ids.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
DEFAULT_FILE = f"{TOKENIZERS}/byte_bpe_50k.json"
LARGEST = 1 << 24  # bytes of all tokens of a vocabulary that is sent to the tasks
CHUNK = 1 << 21  # characters handled in one pass of the vectorised splitter

# The code points with the Unicode property White_Space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


class Vocabulary:
    """Tokens, merge tree and neighbour test of a byte-level BPE vocabulary."""

    def __init__(self, tokens: list[bytes], left: np.ndarray, right: np.ndarray):
        """tokens by id; left and right: the two ids a token was merged from, or its own id for single bytes."""
        import ahocorasick

        self.tokens, self.left, self.right = tokens, left.tolist(), right.tolist()
        self.merged = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if a != i}
        self.size = [len(t) for t in tokens]
        self.matches = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            if t:
                self.matches.add_word(t.decode("latin-1"), i)
        self.matches.make_automaton()
        self.whole = {t: i for i, t in enumerate(tokens) if t}

    def neighbours(self, a: int, b: int, limit: int | None = None) -> bool:
        """Whether BPE of the joined bytes gives exactly the tokens a, b: no merge across the border may come before both are built, or before merge ``limit``."""
        limit = len(self.tokens) if limit is None else limit
        left, right, merged = self.left, self.right, self.merged
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            # take apart the token built last; its inner part at the border stands there until that merge
            if a > b:
                limit, inner = a, right[a]
                if inner == a:
                    return True
                a = inner
            else:
                limit, inner = b + 1, left[b]
                if inner == b:
                    return True
                b = inner

    def encode(self, piece: bytes) -> list[int]:
        """Exact ids of one piece, in time linear in its length."""
        if not piece:
            return []
        if (one := self.whole.get(piece)) is not None:
            return [one]
        last = [-1] * len(piece)
        at, found = -1, []
        for end, token in self.matches.iter(piece.decode("latin-1")):
            if end != at:
                if at >= 0:
                    self._settle(last, at, found)
                at, found = end, []
            found.append(token)
        self._settle(last, at, found)
        out, end = [], len(piece) - 1
        while end >= 0:
            out.append(last[end])
            end -= self.size[last[end]]
        return out[::-1]

    def _settle(self, last: list[int], end: int, found: list[int]) -> None:
        found.sort(key=self.size.__getitem__, reverse=True)
        for token in found:
            before = end - self.size[token]
            if before < 0 or self.neighbours(last[before], token):
                last[end] = token
                return
        raise AssertionError("a vocabulary with all single bytes always has a last token")


@cache
def read_vocabulary(path: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Tokens and merge tree of a tokenizer file with ``vocab`` and ordered ``merges`` (special tokens left out)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab: dict[str, int] = model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes written as the character of the same number
    moved = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}
    n = max(vocab.values()) + 1
    tokens, left, right = [b""] * n, np.arange(n), np.arange(n)
    for c in byte_of:
        tokens[vocab[c]] = bytes([byte_of[c]])
    for a, b in merges:
        i = vocab[a + b]
        tokens[i] = tokens[vocab[a]] + tokens[vocab[b]]
        left[i], right[i] = vocab[a], vocab[b]
    order = [vocab[a + b] for a, b in merges]
    if order != sorted(order):
        raise ValueError("ids must follow the order of the merges")
    if sum(map(len, tokens)) > LARGEST:
        raise ValueError(f"a vocabulary of more than {LARGEST} bytes: too large to send to every task")
    check = Vocabulary(tokens, left, right)
    if not all(check.neighbours(int(a), int(b), i) for i, (a, b) in enumerate(zip(left, right)) if a != i):
        raise ValueError("every token must be the encoding of its own text")  # what whole pieces and first tokens rest on
    return tokens, left, right


def _class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[_WHITE] = SPACE
    return table


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well spread values for code points."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Encoder:
    """Vectorised splitting into pieces plus the exact encoder with a bounded cache of pieces."""

    BASE, CACHED = 0x9E3779B97F4A7C15 | 1, 1_000_000

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.classes = vocabulary, _class_table()
        self.cache: dict[str, np.ndarray] = {}
        self.power = self.inverse = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            base = np.full(n, self.BASE, np.uint64)
            base[0] = 1
            back = np.full(n, pow(self.BASE, -1, 1 << 64), np.uint64)
            back[0] = 1
            self.power, self.inverse = np.cumprod(base), np.cumprod(back)

    def starts(self, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Positions where a piece starts. first: True at the first character of each text.

        Pieces: an English contraction; letters, numbers or other characters, each with one blank before them if there is
        one; white space, which leaves its last character to what follows.
        """
        n, kind = len(chars), self.classes[chars]
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        after = np.flatnonzero(start & ~first & (kind != SPACE))
        after = after[kind[after - 1] == SPACE]
        start[after - 1] = True
        start[after] = chars[after - 1] != 0x20
        quote = np.flatnonzero(start & (chars == 0x27))
        quote = quote[quote + 1 < n]
        quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
        one = quote[np.isin(chars[quote + 1], [ord(c) for c in "stmd"])]
        two = quote[quote + 2 < n]
        two = two[~first[two + 2]]
        pair = chars[two + 1].astype(np.int64) << 32 | chars[two + 2]
        two = two[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]
        for at, size in ((one, 2), (two, 3)):
            start[at + 1] = False
            past = at + size
            start[past[past < n]] = True
        return np.flatnonzero(start)

    def _ids(self, piece: str) -> np.ndarray:
        ids = self.cache.get(piece)
        if ids is None:
            if len(self.cache) >= self.CACHED:
                self.cache.clear()
            ids = np.array(self.vocabulary.encode(piece.encode()), np.int32)
            if len(piece) <= 64:
                self.cache[piece] = ids
        return ids

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(code of each piece, ids by code, number of pieces of each text) for non-empty texts."""
        whole = "".join(texts)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        n = len(chars)
        first = np.zeros(n, bool)
        begin = np.cumsum([0, *map(len, texts)])
        first[begin[:-1]] = True
        at = self.starts(chars, first)
        ends = np.r_[at[1:], n]
        self._powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(chars) * self.power[:n], out=sums[1:])
        name = (sums[ends] - sums[at]) * self.inverse[at]
        code, distinct = pd.factorize(name)
        where = np.full(len(distinct), -1, np.int64)
        where[code[::-1]] = np.arange(len(code))[::-1]  # first place of each
        size = ends - at
        if not self._same(chars, at, size, where[code]):  # two pieces with one name: never seen, but settled exactly
            names = [whole[a:b] for a, b in zip(at, ends)]
            code, distinct = pd.factorize(np.array(names, object))
            ids = [self._ids(p) for p in distinct]
        else:
            ids = [self._ids(whole[at[w] : ends[w]]) for w in where]
        return code, ids, np.diff(np.searchsorted(at, begin))

    @staticmethod
    def _same(chars: np.ndarray, at: np.ndarray, size: np.ndarray, model: np.ndarray) -> bool:
        """Whether every piece equals the first piece of its name, character by character."""
        if not (size == size[model]).all():
            return False
        shift = np.repeat(at[model] - at, size)
        return bool((chars == chars[np.arange(len(chars)) + shift]).all())

    def chunks(self, texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
        """Lists of text parts and their text's number, about CHUNK characters each; very long texts are cut before white space, where a piece always ends."""
        parts, owners, held = [], [], 0
        for number, text in enumerate(texts):
            done = 0
            while done < len(text):
                end = len(text)
                if end - done > CHUNK:
                    cut = _BEFORE_WHITE.search(text, done + CHUNK)
                    end = cut.start() + 1 if cut else end
                part = text[done:end]
                done = end
                if held and held + len(part) > CHUNK:
                    yield parts, owners
                    parts, owners, held = [], [], 0
                parts.append(part)
                owners.append(number)
                held += len(part)
        if parts:
            yield parts, owners

    def encode_batch(self, texts: list[str | None]) -> pa.ListArray:
        """Ids of every text; an empty list for null and empty ones."""
        counts, flat = np.zeros(len(texts), np.int64), []
        for parts, owners in self.chunks([t or "" for t in texts]):
            code, ids, per_part = self.pieces(parts)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            pool, begin = np.concatenate(ids), np.r_[0, np.cumsum(size)[:-1]]
            each = size[code]
            into = np.cumsum(each) - each
            flat.append(pool[np.arange(each.sum()) + np.repeat(begin[code] - into, each)])
            np.add.at(counts, owners, self._per_part(each, per_part))
        offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))

    def count_batch(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of every text; 0 for null and empty ones."""
        counts = np.zeros(len(texts), np.int64)
        for parts, owners in self.chunks([t or "" for t in texts]):
            code, ids, per_part = self.pieces(parts)
            np.add.at(counts, owners, self._per_part(np.fromiter(map(len, ids), np.int64, len(ids))[code], per_part))
        return counts

    @staticmethod
    def _per_part(each: np.ndarray, per_part: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(each)]
        end = np.cumsum(per_part)
        return total[end] - total[end - per_part]


_BEFORE_WHITE = re.compile("[^" + "".join(map(re.escape, map(chr, _WHITE))) + "](?=[" + "".join(map(re.escape, map(chr, _WHITE))) + "])")
_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str, data: object) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(Vocabulary(*data.value))
    return _ENCODERS[name]


def _vocabulary(spark: SparkSession, path: str) -> object:
    """The vocabulary as a broadcast: read on the driver once, its size checked by ``read_vocabulary``."""
    return spark.sparkContext.broadcast(read_vocabulary(path))


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_FILE) -> DataFrame:
    """(key, ids): the ids of every text by the vocabulary at ``path``, without special tokens.

    One row per row; a null or empty text gives an empty list; blank texts give their blanks. Texts that spell a special
    token are ordinary text. Runs where the rows lie, without a shuffle; texts of any length are handled in
    parts. Extra columns are not read; a null key is passed through; an empty table gives no rows.
    """
    key_type = docs.schema[key].dataType.simpleString()
    data = _vocabulary(docs.sparkSession, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, data)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.encode_batch(part.column(1).to_pylist())], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(encode, f"`{key}` {key_type}, ids array<int>")


def token_counts(docs: DataFrame, text: str = "text", path: str = DEFAULT_FILE) -> DataFrame:
    """``docs`` without its text and with ``n_tokens`` (bigint), counted as ``encode_documents`` would; null and empty texts count 0. A column ``n_tokens`` of the input is replaced."""
    rest = [c for c in docs.columns if c not in (text, "n_tokens")]
    narrow = docs.select(text, *rest)
    fields = docs.select(*rest, F.lit(0).cast("bigint").alias("n_tokens")).schema
    data = _vocabulary(docs.sparkSession, path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, data)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts = encoder.count_batch(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(counts)], names=[*rest, "n_tokens"])

    return narrow.mapInArrow(count, fields)
