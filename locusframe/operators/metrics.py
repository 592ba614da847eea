"""Ranking metrics of scored variants: AUROC, average precision, rank correlation, bootstrap intervals."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.annotate import strata
from ..session import written
from .ordering import join_null_safe, running_totals

DRAWS = 1 << 14  # draws of one generated block
OFFSETS = 1 << 15  # ranks of a block within which a draw is an offset of two bytes
PACK = 1 << 20  # draws of a replicate that are sorted together


@dataclass(frozen=True)
class Metric:
    """A ranking metric as a sum over ranked rows.

    gain: (label 1 or 0, positives up to and with the row, rank from 1) -> what the row adds, in plain arithmetic, since it serves columns and arrays.
    value: (sum, positives, rows) -> the metric, as columns; NaN where it is not defined.
    """

    gain: Callable
    value: Callable[[Column, Column, Column], Column]


def _area(positives: Column, negatives: Column, above: Column) -> Column:
    return F.when(positives * negatives > 0, F.try_divide(above, (positives * negatives).cast("double"))).otherwise(F.lit(float("nan")))


AUROC = Metric(lambda y, tp, rank: (1 - y) * tp, lambda total, p, n: _area(p, n - p, total))
AVERAGE_PRECISION = Metric(lambda y, tp, rank: y * tp / rank, lambda total, p, n: F.when(p > 0, F.try_divide(total, p)).otherwise(0.0))
METRICS = {"auroc": AUROC, "auprc": AVERAGE_PRECISION}


def by_stratum(scored: DataFrame, consequence: str = "consequence", names: Column | None = None) -> DataFrame:
    """One row per row and stratum it belongs to. names: an array of stratum names per row, by default those of its consequence."""
    return scored.withColumn("stratum", F.explode(strata(F.col(consequence)) if names is None else names))


def _clean(rows: DataFrame, group: list[str], score: str, label: str, tie: str) -> DataFrame:
    return rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*group, score, tie, F.col(label).cast("bigint").alias("__y"))


def ranked_metrics(
    rows: DataFrame, group: list[str], score: str, label: str, tie: str, least_positive: int = 0, least_negative: int = 0, metrics: dict[str, Metric] = METRICS
) -> DataFrame:
    """(group, n_variants, n_pathogenic, n_benign, each of ``metrics``) with ties broken by ``tie``.

    label: 1 or 0. Ranks and running positives come from range partitions, so a group may hold all rows. AUROC is NaN without both classes, average
    precision 0 without positives; groups below the least counts are left out. Rows with a null score or label count nowhere.
    """
    run = running_totals(_clean(rows, group, score, label, tie), group, [F.col(score).desc(), F.col(tie).asc()], {"__rank": F.lit(1), "__tp": F.col("__y")})
    gains = [F.sum(m.gain(F.col("__y"), F.col("__tp"), F.col("__rank")).cast("double")).alias(f"__g_{name}") for name, m in metrics.items()]
    totals = run.groupBy(*group).agg(F.count("*").alias("n_variants"), F.sum("__y").alias("n_pathogenic"), *gains)
    n, p = F.col("n_variants"), F.col("n_pathogenic")
    kept = totals.filter((p >= least_positive) & (n - p >= least_negative))
    return kept.select(*group, n, p, (n - p).alias("n_benign"), *[m.value(F.col(f"__g_{name}"), p, n).alias(name) for name, m in metrics.items()])


def stratified_metrics(
    scored: DataFrame, score: str = "score", label: str = "pathogenic", tie: str = "variant_id", least: int = 5, names: Column | None = None, metrics: dict[str, Metric] = METRICS
) -> DataFrame:
    return ranked_metrics(by_stratum(scored, names=names), ["stratum"], score, label, tie, least, least, metrics)


def average_ranks(rows: DataFrame, group: list[str], value: str, name: str, weight: Column | None = None) -> DataFrame:
    """(group, value, name): the mean rank of each distinct value, ascending; counts per value are summed first, so ties cost nothing. weight: rows a row stands for."""
    counts = rows.groupBy(*group, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("__n"))
    run = running_totals(counts, group, [F.col(value).asc()], {"__upto": F.col("__n")})
    return run.select(*group, value, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(name))


def tied_auroc(rows: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """(group, n, n_pathogenic, auroc): ties count half. Exact from counts per distinct score."""
    clean = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = clean.groupBy(*group, score).agg(F.count("*").alias("__n"), F.sum(F.col(label).cast("bigint")).alias("__p"))
    run = running_totals(counts, group, [F.col(score).desc()], {"__tp": F.col("__p")})
    gained = (F.col("__n") - F.col("__p")) * (F.col("__tp") - F.col("__p") / 2)
    totals = run.groupBy(*group).agg(F.sum("__n").alias("n"), F.sum("__p").alias("n_pathogenic"), F.sum(gained).alias("__above"))
    return totals.select(*group, "n", "n_pathogenic", _area(F.col("n_pathogenic"), F.col("n") - F.col("n_pathogenic"), F.col("__above")).alias("auroc"))


def spearman(rows: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """(group, spearman): correlation of average ranks over rows that have both values."""
    clean = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*group, a, b)
    pairs = written(clean.groupBy(*group, a, b).agg(F.count("*").alias("__w")), "pairs")  # equal pairs once, weighted; read three times
    ranked = join_null_safe(pairs, average_ranks(pairs, group, a, "__ra", F.col("__w")), [*group, a])
    ranked = join_null_safe(ranked, average_ranks(pairs, group, b, "__rb", F.col("__w")), [*group, b])
    w, x, y = F.col("__w"), F.col("__ra"), F.col("__rb")
    s = ranked.groupBy(*group).agg(
        F.sum(w).alias("n"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"), F.sum(w * x * y).alias("xy")
    )
    spread = F.sqrt((F.col("xx") - F.col("x") * F.col("x") / F.col("n")) * (F.col("yy") - F.col("y") * F.col("y") / F.col("n")))
    rho = F.try_divide(F.col("xy") - F.col("x") * F.col("y") / F.col("n"), spread)
    return s.select(*group, rho.alias("spearman"))


def bootstrap_draws(spark: SparkSession, sizes: list[int], replicates: int, seed: int = 42, size: int = OFFSETS, pack: int = PACK) -> DataFrame:
    """(__g, __block, b, drawn): the rows drawn in ``replicates`` samples with replacement, as two-byte offsets in blocks of ``size`` positions.

    sizes: rows of each group; __g is the place in the list. Draw d of replicate b takes row md5(seed:b:d) mod n. The hash knows no group, so it is made once for
    all of them, and up to ``pack`` draws are sorted and leave their task as one row a block.
    """
    assert size <= 1 << 16, "offsets have two bytes"
    most = max(sizes, default=0)
    falling = sorted(range(len(sizes)), key=lambda g: -sizes[g])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-replicates * most // (4 * pack)))
    b, d = F.expr(f"id div {max(most, 1)}"), F.col("id") % max(most, 1)
    key = F.concat_ws(":", F.lit(str(seed)), b.cast("string"), d.cast("string"))
    hashes = spark.range(0, replicates * most, 1, parts).select(b.cast("int").alias("b"), d.alias("d"), F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint").alias("h"))

    def cells(b: int, first: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(held)
        for g in falling:
            n = sizes[g]
            if n <= first:
                return
            at = np.sort(h[: n - first] % n)
            block = at // size
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            ends = np.append(starts, len(at)).astype(np.int32) * 2
            drawn = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer((at - block * size).astype("<u2"))])
            number, replicate = (pa.array(np.full(len(starts), x, np.int32)) for x in (g, b))
            yield pa.RecordBatch.from_arrays([number, pa.array(block[starts]), replicate, drawn], names=["__g", "__block", "b", "drawn"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, of = [], 0, -1  # hashes of consecutive draws of one replicate
        for batch in batches:
            bs, ds, hs = (batch.column(c).to_numpy() for c in ("b", "d", "h"))
            cuts = [*np.flatnonzero(np.diff(bs, prepend=-1)), len(bs)]
            for i, j in pairwise(cuts):
                if held and (bs[i] != of or sum(map(len, held)) >= pack):
                    yield from cells(of, first, held)
                    held = []
                if not held:
                    first, of = int(ds[i]), int(bs[i])
                held.append(hs[i:j])
        if held:
            yield from cells(of, first, held)

    return hashes.mapInArrow(packed, "__g int, __block bigint, b int, drawn binary")


def bootstrap_intervals(
    rows: DataFrame, group: list[str], score: str, label: str, tie: str, replicates: int = 1000, alpha: float = 0.05, seed: int = 42, least: int = 5, size: int = OFFSETS, pack: int = PACK
) -> DataFrame:
    """(group, auroc_ci_lo, auroc_ci_hi, auprc_ci_lo, auprc_ci_hi): percentile intervals.

    Rows are ranked once; a replicate is what is drawn of each block of ranks, then one bit a draw: the labels in the order of the ranks, in which the copies of a
    row stand together. Replicates without both classes give no AUROC; without any the bounds are NaN. Groups with fewer than ``least`` of a class are left out.
    The driver reads one row a group.
    """
    spark = rows.sparkSession
    ranked = running_totals(_clean(rows, group, score, label, tie), group, [F.col(score).desc(), F.col(tie).asc()], {"__rank": F.lit(1)})
    ranked = written(ranked.select(*group, "__y", (F.col("__rank") - 1).alias("position")), "ranked")
    n, p = F.count("*").alias("__n"), F.sum("__y").alias("__p")
    found = ranked.groupBy(*group).agg(n, p).filter((F.col("__p") >= least) & (F.col("__n") - F.col("__p") >= least)).collect()
    schema = T.StructType([*(T.StructField(g, ranked.schema[g].dataType) for g in group), T.StructField("__g", T.IntegerType())])
    numbers = spark.createDataFrame([(*r[: len(group)], i) for i, r in enumerate(found)], schema)
    labels = join_null_safe(ranked, F.broadcast(numbers), group).select("__g", F.expr(f"position div {size}").alias("__block"), (F.col("position") % size).cast("int").alias("__at"), "__y")
    draws = bootstrap_draws(spark, [r["__n"] for r in found], replicates, seed, size, pack)

    def copied(key: tuple, labels: pa.Table, draws: pa.Table) -> pa.Table:
        y = np.zeros(labels.num_rows, np.uint8)
        y[labels["__at"].to_numpy()] = labels["__y"].to_numpy()
        of: dict[int, list[bytes]] = {}
        for b, drawn in zip(draws["b"].to_pylist(), draws["drawn"].to_pylist()):
            of.setdefault(b, []).append(drawn)
        out = []
        for b, drawn in of.items():
            copies = np.repeat(y, np.bincount(np.frombuffer(b"".join(drawn), "<u2"), minlength=len(y)))
            out.append((b, len(copies), int(copies.sum()), np.packbits(copies).tobytes()))
        bs, ns, ps, bits = zip(*out) if out else ((),) * 4
        keys = [pa.array([k.as_py()] * len(out), k.type) for k in key]
        return pa.table([*keys, pa.array(bs, pa.int32()), pa.array(ns, pa.int64()), pa.array(ps, pa.int64()), pa.array(bits, pa.binary())], names=["__g", "__block", "b", "__n", "__p", "bits"])

    at = ["__g", "__block"]
    parts = labels.groupBy(*at).cogroup(draws.groupBy(*at)).applyInArrow(copied, "__g int, __block bigint, b int, __n bigint, __p bigint, bits binary")
    earlier = W.partitionBy("__g", "b").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("*", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__b{c}") for c in ("__n", "__p")])
    sums = ["__n", "__p", *[f"__g_{name}" for name in METRICS]]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gains = np.zeros((len(METRICS), batch.num_rows))
            for i, (bits, n, n0, p0) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bits", "__n", "__b__n", "__b__p")))):
                y = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(np.int64)
                tp, rank = p0 + np.cumsum(y), n0 + np.arange(1, n + 1)
                gains[:, i] = [m.gain(y, tp, rank).sum() for m in METRICS.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("__g", "b", "__n", "__p")), *map(pa.array, gains)], names=["__g", "b", *sums])

    each = parts.mapInArrow(measured, ", ".join(["__g int, b int, __n bigint, __p bigint", *(f"`{c}` double" for c in sums[2:])]))
    bounds = _percentiles(each.groupBy("__g", "b").agg(*[F.sum(c).alias(c) for c in sums]), ["__g"], alpha, METRICS)
    return bounds.join(F.broadcast(numbers), "__g").select(*group, *bounds.columns[1:])


def _percentiles(each: DataFrame, group: list[str], alpha: float, metrics: dict[str, Metric]) -> DataFrame:
    """Bounds from the sums of each replicate: (group, b, __n, __p, a sum per metric); replicates in which a metric is NaN do not count for it."""
    values = each.select(*group, *[F.nanvl(m.value(F.col(f"__g_{name}"), F.col("__p"), F.col("__n")), F.lit(None).cast("double")).alias(name) for name, m in metrics.items()])
    bounds = [(m, side, q) for m in metrics for side, q in (("lo", alpha / 2), ("hi", 1 - alpha / 2))]
    return values.groupBy(*group).agg(*[F.coalesce(F.percentile(m, F.lit(q)), F.lit(float("nan"))).alias(f"{m}_ci_{side}") for m, side, q in bounds])


def _share(totals: np.ndarray, rows: np.ndarray, block: int, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(draws before ``block``, draws of it) of each replicate when ``totals`` draws fall evenly on all rows; rows: rows before each block, and at the end.

    The draws are halved down a tree over the blocks, each node with its own seed: every block finds the same tree on its own.
    """
    lo, hi, before, inside = 0, len(rows) - 1, np.zeros_like(totals), totals
    while hi - lo > 1:
        mid = (lo + hi) // 2
        every = rows[hi] - rows[lo]
        left = np.random.default_rng([*seed, lo, hi]).binomial(inside, (rows[mid] - rows[lo]) / every) if every else np.zeros_like(inside)
        if block < mid:
            inside, hi = left, mid
        else:
            before, inside, lo = before + left, inside - left, mid
    return before, inside


def block_weights(key: tuple, positives: np.ndarray, negatives: np.ndarray, block: int, replicates: int, seed: int = 42) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By replicate: positives and negatives drawn before ``block``, and how often each positive and each negative of it is drawn.

    positives, negatives: rows of the class before each block of the group, and at the end. Over all blocks the weights of a replicate are those of n draws
    with replacement from the group's n rows.
    """
    base = [seed, zlib.crc32(repr(key).encode())]
    n, p = int(positives[-1] + negatives[-1]), int(positives[-1])
    drawn = np.random.default_rng([*base, 0]).binomial(n, p / n, replicates)
    before_p, in_p = _share(drawn, positives, block, [*base, 1])
    before_n, in_n = _share(n - drawn, negatives, block, [*base, 2])
    here_p, here_n = int(positives[block + 1] - positives[block]), int(negatives[block + 1] - negatives[block])
    rng = np.random.default_rng([*base, 3, block])
    for b in range(replicates):
        wp = np.bincount(rng.integers(0, here_p, in_p[b]), minlength=here_p) if here_p else np.zeros(0, np.int64)
        wn = np.bincount(rng.integers(0, here_n, in_n[b]), minlength=here_n) if here_n else np.zeros(0, np.int64)
        yield int(before_p[b]), int(before_n[b]), wp, wn


def blocked_bootstrap_intervals(
    rows: DataFrame, group: list[str], score: str, label: str, tie: str, replicates: int = 1000, alpha: float = 0.05, seed: int = 42, least: int = 5, size: int = DRAWS,
    metrics: dict[str, Metric] = METRICS,
) -> DataFrame:
    """``bootstrap_intervals`` whose draws are weights per block of ``size`` ranked rows, made inside the task that holds the block: no draw is shuffled.

    How many draws fall on a block and before it follows from the seed and the class counts of the blocks, of which the driver reads one row a block. A block
    gives two counts and a sum per metric for each replicate.
    """
    ranked = running_totals(_clean(rows, group, score, label, tie), group, [F.col(score).desc(), F.col(tie).asc()], {"__rank": F.lit(1)})
    ranked = written(ranked.select(*group, "__y", (F.col("__rank") - 1).alias("__at")).withColumn("__block", F.floor(F.col("__at") / size)), "ranked")
    found: dict[tuple, list] = {}
    counts = ranked.groupBy(*group, "__block").agg(F.sum("__y").alias("p"), F.count("*").alias("n"))
    for r in counts.collect():  # one row a block
        found.setdefault(tuple(r[: len(group)]), []).append((r["__block"], r["p"], r["n"] - r["p"]))
    before = {}
    for key, blocks in found.items():
        _, p, n = zip(*sorted(blocks))
        if sum(p) >= least and sum(n) >= least:
            before[key] = np.cumsum((0, *p)), np.cumsum((0, *n))
    sums = ["__n", "__p", *[f"__g_{name}" for name in metrics]]
    schema = ", ".join([*(f"`{g}` {ranked.schema[g].dataType.simpleString()}" for g in group), "b int, __n bigint, __p bigint", *(f"`{c}` double" for c in sums[2:])])

    def measure(keys: tuple, block: pa.Table) -> pa.Table:
        *key, at = (k.as_py() for k in keys)
        out = np.zeros((len(sums), replicates))
        if tuple(key) in before:
            y = block.sort_by("__at")["__y"].to_numpy()
            is_p, w = y == 1, np.zeros(len(y), np.int64)
            for b, (p0, n0, wp, wn) in enumerate(block_weights(tuple(key), *before[tuple(key)], at, replicates, seed)):
                w[is_p], w[~is_p] = wp, wn
                copies = np.repeat(y, w)  # of a row stand together
                tp, rank = p0 + np.cumsum(copies), p0 + n0 + np.arange(1, len(copies) + 1)
                out[:, b] = len(copies), copies.sum(), *[m.gain(copies, tp, rank).sum() for m in metrics.values()]
        filled = {g: pa.array([k] * replicates, block.schema.field(g).type) for g, k in zip(group, key)}
        values = [np.arange(replicates, dtype=np.int32), out[0].astype(np.int64), out[1].astype(np.int64), *out[2:]]
        return pa.table(filled | dict(zip(["b", *sums], map(pa.array, values)))).slice(0, replicates if tuple(key) in before else 0)

    parts = ranked.groupBy(*group, "__block").applyInArrow(measure, schema)
    each = parts.groupBy(*group, "b").agg(*[F.sum(c).alias(c) for c in sums])
    return _percentiles(each, group, alpha, metrics)


def measured_variants(scores: DataFrame, manifest: DataFrame, label: str, continuous: str | None = None) -> DataFrame:
    """(n, n_pathogenic, auroc[, spearman]) of scores against measured labels, 6 decimals. The manifest may have its own ``score``."""
    joined = scores.withColumnRenamed("score", "probe_score").join(manifest, "variant_id")
    measured = continuous if continuous and continuous in manifest.columns else None
    used = list(dict.fromkeys(["probe_score", label, *([measured] if measured else [])]))
    joined = written(joined.select(*used), "measured")  # read for both metrics
    out = tied_auroc(joined, [], "probe_score", label).withColumn("auroc", F.round("auroc", 6))
    return out.withColumn("spearman", F.round(spearman(joined, [], "probe_score", measured).scalar(), 6)) if measured else out
