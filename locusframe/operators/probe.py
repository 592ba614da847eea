"""Model provider and probe: our own design behind the published shapes (a window in, vectors per position out; a score per variant)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import FLOAT_EPS
from ..session import fresh_path

#: (sequence) -> (activations [length, d], loss [length - 1])
Model = Callable[[str], tuple[np.ndarray, np.ndarray]]


def hashed_model(d: int = 16, context: int = 4) -> Model:
    """A deterministic stand-in for a genome model: a vector per position from a hash of the bases before it."""

    odd = np.uint64(0x9E3779B97F4A7C15)
    steps = np.arange(1, d + 1, dtype=np.uint64)[:, None] * odd

    def run(sequence: str) -> tuple[np.ndarray, np.ndarray]:
        n = len(sequence)
        codes = np.zeros(n + context, np.uint64)
        codes[context:] = np.frombuffer(sequence.encode(), np.uint8)
        h = np.zeros(n, np.uint64)
        for back in range(context):
            h = h * np.uint64(131) + codes[context - back : context - back + n]
        mixed = h * odd + steps
        mixed >>= np.uint64(40)
        acts = mixed.astype(np.int32).astype(np.float32)  # 24 bits: exact
        acts *= np.float32(2**-23)
        acts -= np.float32(1)
        return acts.T, np.abs(acts[:, 1:]).mean(0)

    return run


def both_directions(model: Model, sequence: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward and reverse-complement pass, both in sense order."""
    turned = sequence[::-1].translate(str.maketrans("ATGCatgcNn", "TACGtacgNn"))
    (fwd, fwd_loss), (bwd, bwd_loss) = model(sequence), model(turned)
    return fwd, bwd[::-1], fwd_loss, bwd_loss[::-1]


def run_model(windows: DataFrame, model: Model) -> DataFrame:
    """(variant_id, dir, pos, var_same, ref_same, ref_cross, var_loss, ref_loss) for every position both windows share.

    windows: (variant_id, ref_window, var_window); one window pair is in memory at a time, positions leave as Arrow batches.
    """

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                rf, rb, rfl, rbl = both_directions(model, row.ref_window)
                vf, vb, vfl, vbl = both_directions(model, row.var_window)
                n = min(len(rf), len(vf))
                for direction, var, same, cross, vl, rl in ((0, vf, rf, rb, vfl, rfl), (1, vb, rb, rf, vbl, rbl)):
                    loss = [[float(x[i]) if i < len(x) else None for i in range(n)] for x in (vl, rl)]
                    yield pd.DataFrame(
                        {"variant_id": row.variant_id, "dir": direction, "pos": np.arange(n), "var_same": list(var[:n]), "ref_same": list(same[:n]), "ref_cross": list(cross[:n]), "var_loss": loss[0], "ref_loss": loss[1]}
                    )

    schema = "variant_id string, dir int, pos bigint, var_same array<float>, ref_same array<float>, ref_cross array<float>, var_loss float, ref_loss float"
    return windows.filter("var_window is not null").select("variant_id", "ref_window", "var_window").mapInPandas(infer, schema)


def _cosines(a: np.ndarray, b: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    """``functions.vectors.cosine`` by row, summed in the same order, so that ties are the same; in blocks of rows that a cache holds."""
    out, step = np.empty(len(a)), max(1, (1 << 17) // max(1, a.shape[1]))
    for at in range(0, len(a), step):
        x, y = (np.ascontiguousarray(v[at : at + step].T, np.float64) for v in (a, b))
        xy, xx, yy = ((p * q).sum(0) for p, q in ((x, y), (x, x), (y, y)))  # over the outer axis: one component after the other
        out[at : at + step] = xy / (np.maximum(np.sqrt(xx), eps) * np.maximum(np.sqrt(yy), eps))
    return out


def _pick(var: np.ndarray, ref: np.ndarray, start: int, end: int, k: int, sure: int) -> np.ndarray:
    """``k`` positions of start..end: the first ``sure``, then those of least similarity, in ascending order; -1 beyond them."""
    first = min(start + sure, end, start + k)
    out, given = np.full(k, -1, np.int64), max(first - start, 0)
    if end - start <= k:  # all of them, whatever their similarity
        out[: max(end - start, 0)] = np.arange(start, end)
        return out
    order = np.argsort(_cosines(var[first:end], ref[first:end]), kind="stable")[: k - given]
    out[:given] = np.arange(start, start + given)
    out[given : given + len(order)] = np.sort(order) + first
    return out


def _mean_normalised(x: np.ndarray, eps: float = FLOAT_EPS) -> list[float]:
    """Mean over positions of RMS-normalised vectors."""
    x = x.astype(np.float64)
    return (x / np.sqrt((x * x).mean(1, keepdims=True) + eps)).mean(0).tolist() if len(x) else [0.0] * x.shape[1]


HARVEST = (
    "variant_id string, dir int, slot int, pos bigint, var_same array<float>, ref_same array<float>, ref_cross array<float>, loss float, "
    "mean array<array<double>>, error string"
)
COLUMNS = tuple(f.split()[0] for f in HARVEST.split(", "))
VIEWS = ("var_same", "ref_same", "ref_cross")

#: Slots and bytes of vectors that a task gathers before it hands them on as one Arrow batch.
BATCH_SLOTS, BATCH_BYTES = 1 << 15, 1 << 26


class _Harvest:
    """What a task has selected so far, in columns; one Arrow batch of slots and one of means are made of it."""

    types = dict(zip(COLUMNS, [pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.float32())] * 3, pa.float32(), pa.list_(pa.list_(pa.float64())), pa.string()]))

    def __init__(self, k: int, keep: tuple[str, ...]):
        self.k, self.names, self.kept, self.means, self.bytes = k, [c for c in COLUMNS if c in keep], [], [], 0

    def add(self, key: str, turn: int, pos: np.ndarray, loss: np.ndarray, vectors: list[np.ndarray] | None) -> None:
        self.kept.append((key, turn, pos, loss, vectors))
        self.bytes += sum(x.nbytes for x in vectors or ())

    def full(self) -> bool:
        return len(self.kept) * self.k + len(self.means) >= BATCH_SLOTS or self.bytes >= BATCH_BYTES

    def batch(self, n: int, **columns: object) -> pa.RecordBatch:
        def column(name: str, kind: pa.DataType) -> pa.Array:
            x = columns.get(name)
            return pa.nulls(n, kind) if x is None else x if isinstance(x, pa.Array) else pa.array(x, kind)

        return pa.RecordBatch.from_arrays([column(c, self.types[c]) for c in self.names], names=self.names)

    def lists(self, view: int) -> pa.Array:
        """Vectors of one view; the slots beyond a row's vectors, which stand last, are null."""
        parts = [vectors[view] for *_, vectors in self.kept]
        real = np.arange(self.k) < np.array([len(x) for x in parts])[:, None]
        upto = np.cumsum(real.ravel() * parts[0].shape[1])
        offsets = pa.array(np.r_[0, upto].astype(np.int32), mask=np.r_[~real.ravel(), False])
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.ascontiguousarray(x, np.float32).ravel() for x in parts])))

    def drained(self) -> Iterator[pa.RecordBatch]:
        if self.kept:
            keys, turns, pos, loss, vectors = zip(*self.kept)
            m = len(keys)
            views = {} if vectors[0] is None else {name: self.lists(i) for i, name in enumerate(VIEWS)}
            yield self.batch(
                m * self.k, variant_id=pa.array(keys, pa.string()).take(pa.array(np.repeat(np.arange(m), self.k))), dir=np.repeat(np.array(turns, np.int32), self.k),
                slot=np.tile(np.arange(self.k, dtype=np.int32), m), pos=np.concatenate(pos), loss=np.concatenate(loss), **views,
            )
        if self.means:
            keys, turns, means, errors = zip(*self.means)
            yield self.batch(len(keys), variant_id=keys, dir=turns, slot=[None if t is None else -1 for t in turns], mean=means, error=errors)
        self.kept, self.means, self.bytes = [], [], 0


def harvested(windows: DataFrame, model: Model, k: int = 256, window: int = 64, keep: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Everything kept of a model's passes, made in the task that runs the model: nothing is shuffled and no position leaves it but the selected ones.

    windows: (variant_id, pos, ref, alt, offset, ref_window, var_window); rows without a var_window are left out. For each row and direction there are ``k``
    slots: forward behind the variant, its first ``window`` positions guaranteed; backward before it, none guaranteed; the rest of least similarity. A slot has its
    position on the chromosome, the vectors of three views there (variant, reference, reference of the other strand) and the loss of the variant less that of the
    reference (0 where one has none); beyond the positions it is a pad (pos -1, null vectors). Slot -1 holds the mean: for each view the mean of the RMS-normalised
    vectors over the shared length, in the backward direction with the roles of the strands swapped. Only the columns to ``keep`` are made, and rows
    of means or errors only with the columns of that name. A row whose model fails gives one row with the ``error`` and nothing else; lack of memory and interrupts end the task. One window pair is in memory at a time, beside
    what is selected, which leaves in batches of bounded size.
    """

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _Harvest(k, keep)
        for whole in batches:
            for at in range(whole.num_rows):
                if got.full():
                    yield from got.drained()
                r = whole.slice(at, 1).to_pylist()[0]
                try:
                    rf, rb, rfl, rbl = both_directions(model, r["ref_window"])
                    vf, vb, vfl, vbl = both_directions(model, r["var_window"])
                except (MemoryError, KeyboardInterrupt):
                    raise
                except Exception as error:  # noqa: BLE001 - whatever a model may raise is reported, and the others go on
                    if "error" in keep:
                        got.means.append((r["variant_id"], None, None, f"{type(error).__name__}: {error}"))
                    continue
                shared, o = min(len(rf), len(vf)), r["offset"]
                behind = o + max(len(r["ref"]), len(r["alt"]))
                for turn, var, same, cross, vl, rl, start, end, sure in ((0, vf, rf, rb, vfl, rfl, behind, shared, window), (1, vb[:shared], rb[:shared], rf, vbl, rbl, 0, o, 0)):
                    pos = _pick(var, same, start, end, k, sure)
                    real = pos[: int((pos >= 0).sum())]  # pads stand last
                    loss = np.zeros(k, np.float32)
                    if "loss" in keep:
                        both = np.flatnonzero(real < min(len(vl), len(rl)))
                        loss[both] = vl[real[both]] - rl[real[both]]
                    got.add(r["variant_id"], turn, np.where(pos >= 0, pos + r["pos"] - o, -1), loss, [x[real] for x in (var, same, cross)] if vectors else None)
                    if "mean" in keep:
                        got.means.append((r["variant_id"], turn, [_mean_normalised(x[:shared]) for x in (var, same, cross)], None))
        yield from got.drained()

    vectors = bool({*VIEWS} & {*keep})
    usable = windows.filter("var_window is not null").select("variant_id", "pos", "ref", "alt", "offset", "ref_window", "var_window")
    return usable.mapInArrow(infer, ", ".join(f for f in HARVEST.split(", ") if f.split()[0] in keep))


def selected_positions(windows: DataFrame, model: Model, k: int = 256, window: int = 64) -> DataFrame:
    """(variant_id, dir, slot, pos): ``activations.select_positions`` over ``run_model``, made where the model runs; positions count within the window.

    windows: (variant_id, ref, alt, offset, ref_window, var_window). Variants without var_window give no rows.
    """
    placed = windows.withColumn("pos", F.col("offset").cast("bigint"))  # so that the window starts at 0
    return harvested(placed, model, k, window, keep=("variant_id", "dir", "slot", "pos"))


def projection(d_in: int, d_hidden: int, seed: int = 42) -> np.ndarray:
    return (np.random.default_rng(seed).standard_normal((d_in, d_hidden)) / np.sqrt(d_in)).astype(np.float32)


def moment_embeddings(diffs: DataFrame, weights: np.ndarray, key: str = "variant_id") -> DataFrame:
    """(key, embedding): second moments of projected difference vectors, summed over a variant's slots and divided by their number.

    Projection and outer product run per Arrow batch, with one partial sum per key and batch, so a key with very many slots moves as partial sums.
    """
    d_hidden = weights.shape[1]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                z = np.stack(batch["diff"].to_list()).astype(np.float32) @ weights
                codes, keys = pd.factorize(batch[key])
                total = np.zeros((len(keys), d_hidden, d_hidden))
                np.add.at(total, codes, z[:, :, None] * z[:, None, :])
                yield pd.DataFrame({key: keys, "n": np.bincount(codes, minlength=len(keys)), "m": list(total.reshape(len(keys), -1))})

    parts = diffs.select(key, "diff").filter(f"{key} is not null and diff is not null").mapInPandas(partial, f"`{key}` {diffs.schema[key].dataType.simpleString()}, n bigint, m array<double>")
    sums = parts.select(key, "n", F.posexplode("m").alias("i", "x")).groupBy(key, "i").agg((F.sum("x") / F.sum("n")).cast("float").alias("x"))
    return sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding"))


def fit_probe(embeddings: DataFrame, label: str = "label", iterations: int = 50) -> object:
    """Logistic regression over embeddings (array<float>), fitted by Spark.

    The model is saved and read back: what is read holds no training summary, and with it no session, that would travel to the tasks.
    """
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.functions import array_to_vector

    rows = embeddings.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    path = fresh_path(embeddings.sparkSession, "probe")
    LogisticRegression(maxIter=iterations, regParam=0.01).fit(rows).save(path)
    return LogisticRegressionModel.load(path)


def score_probe(embeddings: DataFrame, model: object, key: str = "variant_id") -> DataFrame:
    """(key, score): probability of the second class."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = embeddings.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    return model.transform(rows).select(key, vector_to_array("probability")[1].alias("score"))
