"""Abusive, hateful or sexual content: a linear-chain conditional random field over the words of cues.

Two tags: part of an offending span, or not. Raters judge whole documents, so the labelled tokens are made from
their verdicts: in a document judged clean no token offends; in one judged bad the tokens of its most suspect cues do,
first by the log-odds of word n-grams, then twice by the marginals of a field fitted to the other half of the documents. The fit takes a bounded sample
of the judged documents; scoring covers every word of every document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .field import Field
from .words import BITS, GRAMS, Reader, features

SIZE = 1 << BITS
TURNS = 2  # relabelling turns before the last fit
Model = tuple[Field, set[str]]


def judged_documents(documents: DataFrame, labels: DataFrame, most: int = 8000, seed: int = 42, longest: int = 60_000) -> DataFrame:
    """(doc_id, text, bad, weight) of at most ``most`` documents of at most ``longest`` characters with a clear verdict, drawn by a seeded hash of their id.

    Of several verdicts of a rater on a document the last counts; nulls do not; a document on which the raters are split evenly has no verdict. The length
    is looked at before the draw: more verdicts than asked for are drawn first, and more again should too few of their documents be short enough.
    The draw is written, since the fit reads it twice.
    """
    last = W.partitionBy("doc_id", "rater").orderBy(F.col("rated_at").desc_nulls_last(), F.col("flagged").desc())
    votes = (
        labels.filter("flagged is not null and doc_id is not null").withColumn("__r", F.row_number().over(last)).filter("__r = 1")
        .groupBy("doc_id").agg(F.avg("flagged").alias("share"), F.count("*").alias("n")).filter("share <> 0.5")
    )
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    bad = (F.col("share") > 0.5).cast("double").alias("bad")
    trust = F.least(F.lit(1.0), 0.4 + 0.2 * F.col("n") * F.abs(2 * F.col("share") - 1)).alias("weight")
    wide = 2 * most
    while True:
        drawn = votes.orderBy(*order).limit(wide)
        usable = documents.select("doc_id", "text").filter(F.length("text") <= longest).join(F.broadcast(drawn), "doc_id")  # at most ``wide`` rows of three numbers
        found = written(usable.select("doc_id", "text", bad, trust), "judged")
        if found.count() >= most or drawn.count() < wide:
            return found.orderBy(*order).limit(most)
        wide *= 4


def _spellings(judged: DataFrame, least: int) -> set[str]:
    """Lower-case words that stand in at least ``least`` of the judged documents."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            found: list[str] = []
            for t in batch.column(0).to_pylist():
                found += filter(str.isalpha, {raw.lower() for raw in reader.raw(t or "")})
            counted = pa.array(found, pa.string()).value_counts()
            yield pa.RecordBatch.from_arrays([counted.field(0), counted.field(1)], names=["word", "n"])

    counts = judged.select("text").mapInArrow(words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word for r in counts.filter(F.col("n") >= least).select("word").collect()}


_SHARD = "shard int, code binary, kind binary, begin binary, owner binary, bad binary, weight binary, half binary"
_TYPES = {"code": np.int32, "kind": np.int8, "begin": np.int64, "owner": np.int64, "bad": np.float64, "weight": np.float64, "half": np.int8}


def _encoded(judged: DataFrame, known: set[str], shards: int, seed: int) -> DataFrame:
    """One row of arrays for each of ``shards`` hash shards of the judged documents: their words as codes, in an order that the ids alone settle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one shard
        if sum(b.num_rows for b in held):
            group = pa.Table.from_batches(held).sort_by([("h", "ascending"), ("doc_id", "ascending")])
            code, kind, begin, owner = Reader(known).read(group["text"].to_pylist())
            arrays = {"code": code, "kind": kind, "begin": begin, "owner": owner, "bad": group["bad"].to_numpy(), "weight": group["weight"].to_numpy(), "half": group["half"].to_numpy()}
            blobs = [pa.array([np.ascontiguousarray(arrays[c], t).tobytes()], pa.binary()) for c, t in _TYPES.items()]
            yield pa.RecordBatch.from_arrays([pa.array([group["shard"][0].as_py()], pa.int32()), *blobs], names=["shard", *_TYPES])

    h = F.xxhash64("doc_id", F.lit(seed))
    rows = judged.select("doc_id", "text", "bad", "weight", h.alias("h"), F.pmod(h, F.lit(shards)).cast("int").alias("shard"), (F.xxhash64("doc_id", F.lit(seed + 1)) % 2 == 0).cast("int").alias("half"))
    return written(rows.repartitionById(shards, "shard").mapInArrow(encode, _SHARD), "shards")


class _Shard:
    """The arrays of one shard, with their features and what is said of its cues."""

    def __init__(self, row: dict):
        for c, kind in _TYPES.items():
            setattr(self, c, np.frombuffer(row[c], kind))
        self.feature = features(self.code, self.kind, self.begin)
        self.size = np.diff(self.begin)
        self.is_bad = self.bad[self.owner] > 0

    def per_cue(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.begin[:-1]) / self.size

    def grams(self) -> np.ndarray:
        """[3, 2, features]: clean and bad documents that hold each word n-gram."""
        out = np.zeros((len(GRAMS), 2, SIZE))
        of_word = np.repeat(self.owner, self.size)
        for i, column in enumerate(GRAMS):
            held = np.unique(of_word << BITS | self.feature[:, column])
            for b in (0, 1):
                out[i, b] = np.bincount((held & (SIZE - 1))[self.bad[held >> BITS] == b], minlength=SIZE)
        return out

    def first_guess(self, counts: np.ndarray, share: float) -> np.ndarray:
        """How likely each cue offends, by the mean log-odds of its word n-grams in the other judged documents (never its own).

        A seed word adds to it as far as the n-grams are unknown to the clean ones among them.
        """
        own = np.repeat(self.bad[self.owner], self.size)
        total, unknown = np.zeros(len(own)), np.zeros(len(own))
        for (clean, bad), column in zip(counts, GRAMS):
            gram = self.feature[:, column]
            odds = np.log((bad[gram] - own + 2 * share) / (clean[gram] - (1 - own) + 2 * (1 - share)) * (1 - share) / share)
            total += np.clip(odds, -2.0, 3.0) / len(GRAMS)
            unknown += (clean[gram] - (1 - own) <= 0) / len(GRAMS)
        listed = np.maximum.reduceat(np.where(self.kind < 4, self.kind, 0), self.begin[:-1]) > 0
        guess = self.per_cue(total) + 0.7 * listed * self.per_cue(unknown)
        return 1 / (1 + np.exp(-3 * (guess - 0.6)))

    def cross_tagged(self, fields: list[Field]) -> np.ndarray:
        """How likely each cue offends by the field that has not seen its half."""
        by = [np.maximum.reduceat(f.tag(f.weight[self.feature].sum(1), self.begin), self.begin[:-1]) for f in fields]
        return np.where(self.half[self.owner] > 0, by[1], by[0])

    def labels(self, likely: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cue offends, trust, cue is used): of a bad document its suspect cues, at least the top one; cues in doubt are left out."""
        top = np.zeros(len(self.bad))
        np.maximum.at(top, self.owner, likely)
        chosen = self.is_bad & ((likely > 0.5) | (likely >= top[self.owner]) & (likely > 0.4))
        unsure = self.is_bad & ~chosen & (likely > 0.2) | ~self.is_bad & (likely > 0.9)  # a rater may have overlooked it
        return chosen.astype(float), np.where(chosen, 1.0, self.weight[self.owner]), ~unsure


def _mean_of_holders(parts: np.ndarray) -> np.ndarray:
    """Mixed (weights, squared gradients) of [shards, 2, features]: the mean over the shards whose documents hold the feature.

    So a feature that a single shard has seen keeps that shard's weight.
    """
    weight, gained = parts[:, 0], parts[:, 1]
    held = gained > 0
    n = np.maximum(held.sum(0), 1)
    return np.stack([np.where(held.any(0), (weight * held).sum(0) / n, weight[0]), gained.sum(0) / n])


SLICES = 8  # stretches of the feature numbers that are summed in tasks of their own


def fit_judged(judged: DataFrame, seed: int = 42, shard: int = 1000) -> Model:
    """Field and known spellings from (doc_id, text, bad, weight): bad 1 or 0, weight the trust in the verdict.

    Which cues of a bad document offend is settled without looking at that document's own labels: first by n-gram counts in the other
    documents, then ``TURNS`` times by a field fitted to the other half of them. The documents lie in hash shards of about ``shard``; each task fits
    the field to its shard, and the shards' weights are mixed, several times over. Rows may come in any order and
    partitions: shards, order and halves follow from the ids.
    """
    sums = judged.agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")).first()
    n, share = sums.n, sums.bad / max(1, sums.n)
    known = _spellings(judged, max(3, n // 400))
    if not 0 < share < 1:
        field = Field()
        field.start[1] = field.step[0, 1] = -30.0  # nothing to learn from: no word offends
        return field, known
    encoded = _encoded(judged, known, max(1, round(n / shard)), seed)
    context = judged.sparkSession.sparkContext

    def reduced(make: Callable, reduce: Callable) -> dict[int, np.ndarray]:
        """What ``reduce`` makes of the arrays [rows, features] that ``make`` gives for each shard, by key; slice by slice, in tasks, so the driver gets one array a key however many shards there are."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    s = _Shard(row)
                    for key, rows in make(row["shard"], s) if len(s.owner) else ():
                        cuts = [np.ascontiguousarray(x, np.float32).tobytes() for x in np.array_split(rows, SLICES, axis=1)]
                        yield pa.RecordBatch.from_arrays([pa.array([x] * SLICES, pa.int32()) for x in (key, row["shard"], len(rows))] + [pa.array(range(SLICES), pa.int32()), pa.array(cuts, pa.binary())], names=["key", "shard", "n", "at", "data"])

        def add(keys: tuple, group: pa.Table) -> pa.Table:
            group = group.sort_by("shard")
            n = group["n"][0].as_py()
            total = reduce(keys[0].as_py(), np.stack([np.frombuffer(d, np.float32).astype(float).reshape(n, -1) for d in group["data"].to_pylist()]))
            return pa.table({"key": pa.array([keys[0].as_py()], pa.int32()), "at": pa.array([keys[1].as_py()], pa.int32()), "n": pa.array([len(total)], pa.int32()), "data": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        got = encoded.mapInArrow(run, "key int, shard int, n int, at int, data binary").groupBy("key", "at").applyInArrow(add, "key int, at int, n int, data binary").collect()
        out: dict[int, list] = {}
        for r in sorted(got, key=lambda r: (r.key, r.at)):
            out.setdefault(r.key, []).append(np.frombuffer(r.data, np.float32).reshape(r.n, -1))
        return {k: np.concatenate(x, axis=1) for k, x in out.items()}

    counts = reduced(lambda _, s: [(0, s.grams().reshape(-1, SIZE))], lambda _, parts: parts.sum(0))[0].reshape(len(GRAMS), 2, SIZE)

    def fitted(guide: object, bases: list[tuple[Field, np.ndarray]], turn: int, rounds: int) -> list[tuple[Field, np.ndarray]]:
        """Fields fitted on from ``bases``: two, each to a half of the documents, or one to all."""
        sent = context.broadcast((guide, [(f.weight.astype(np.float32), f.step, f.start, past.astype(np.float32)) for f, past in bases]))

        def fit(number: int, s: _Shard) -> Iterator[tuple[int, np.ndarray]]:
            told, starts = sent.value
            likely = s.first_guess(told, share) if isinstance(told, np.ndarray) else s.cross_tagged(told)
            chosen, trust, use = s.labels(likely)
            for side, (weight, step, start, past) in enumerate(starts):
                mine = use if len(starts) == 1 else use & (s.half[s.owner] == side)
                field, total = Field(), past.astype(float)
                field.weight, field.step, field.start = weight.astype(float), step.copy(), start.copy()
                field.fit(s.feature, s.begin, np.flatnonzero(mine), chosen, trust, total, rounds, [seed, turn, number, side])
                yield 2 * side, np.stack([field.weight, total - past])
                n = float(mine.sum())
                yield 2 * side + 1, n * np.concatenate([field.step.ravel(), field.start, [1.0, 0.0]])[None, :]  # a value for each slice

        got = reduced(fit, lambda key, parts: parts.sum(0) if key % 2 else _mean_of_holders(parts))
        out = []
        for side, (field, past) in enumerate(bases):
            mixed = Field()
            weight, gained = got[2 * side].astype(float)
            ends = got[2 * side + 1][0].astype(float)
            if ends[6]:
                mixed.step, mixed.start = (ends[:4] / ends[6]).reshape(2, 2), ends[4:6] / ends[6]
            mixed.weight = weight
            out.append((mixed, past + gained))
        sent.unpersist()
        return out

    new = lambda: (Field(), np.full(SIZE, 0.1))
    guide: object = counts
    for turn in range(TURNS):
        guide = [f for f, _ in fitted(guide, [new(), new()], turn, 3)]
        guide = guide[::-1]  # a half is tagged by the field of the other: cross_tagged takes the second for half 1
    last = [new()]
    for part in range(2):
        last = fitted(guide, last, TURNS + part, 3)
    return last[0][0], known


def fit_content(documents: DataFrame, labels: DataFrame, most: int = 8000, seed: int = 42, longest: int = 60_000) -> Model:
    """Fit on a bounded sample: ``most`` judged documents of ``longest`` characters, the documented bound. Only the fit is bounded; scoring is not."""
    return fit_judged(written(judged_documents(documents, labels, most, seed, longest), "sample"), seed)


SCORES = "score double, n_cues int, spans array<struct<start:int,end:int>>"


def score_documents(documents: DataFrame, model: Model, threshold: float = 0.5, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, score, n_cues, spans) for every row: the highest marginal of any word, the number of offending cues and the character ranges of offending words.

    Every word of every text is tagged, where the rows lie, without a shuffle. Null, empty and wordless texts score 0. The model (a
    table of 2^18 weights and the known spellings of a bounded sample) is broadcast. A range is a run of offending words of one cue, in
    characters of the text as it stands.
    """
    field, known = model
    data = documents.sparkSession.sparkContext.broadcast((field.weight.astype(np.float32), field.step, field.start, known))
    rest = [key, *keep]
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in rest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field()
        own.weight, own.step, own.start, words = data.value
        reader = Reader(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n = part.num_rows
                texts = part.column(0).to_pylist()
                code, kind, begin, owner = reader.read(texts)
                top, hits, spans = np.zeros(n), np.zeros(n, np.int32), [[] for _ in range(n)]
                if len(owner):
                    p = own.tag(own.emission(code, kind, begin), begin)
                    cue = np.maximum.reduceat(p, begin[:-1])
                    np.maximum.at(top, owner, cue)
                    first_word = begin[np.searchsorted(owner, np.arange(n))]
                    places: dict[int, np.ndarray] = {}
                    for i in np.flatnonzero(cue >= threshold):
                        o = int(owner[i])
                        if o not in places:
                            places[o] = reader.places(texts[o])
                        words_at = np.flatnonzero(p[begin[i] : begin[i + 1]] >= threshold) + begin[i] - first_word[o]
                        hits[o] += 1
                        for run in np.split(words_at, np.flatnonzero(np.diff(words_at) > 1) + 1):
                            spans[o].append({"start": int(places[o][run[0], 0]), "end": int(places[o][run[-1], 1])})
                kind_of = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(top), pa.array(hits), pa.array(spans, kind_of)], names=[*rest, "score", "n_cues", "spans"])

    return documents.select(text, *rest).mapInArrow(score, f"{kinds}, {SCORES}")


def source_rates(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(source, n_docs, n_flagged, rate) per source of ``score_documents`` with its source kept; documents without a source make a row of their own (source null)."""
    flagged = F.count_if(F.col("score") >= threshold)
    return scores.groupBy("source").agg(F.count("*").alias("n_docs"), flagged.alias("n_flagged"), (flagged / F.count("*")).alias("rate"))
