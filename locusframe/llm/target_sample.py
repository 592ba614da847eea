"""Sample matching target category proportions: swap repair over counts of category signatures."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import consequence_key, term_key
from ..operators.latest import latest_variants
from ..session import written
from .capping import first_by_position

REPORT = (
    "signature string, available bigint, required bigint, taken bigint, target_share double, actual_share double, met boolean"
)


def random_start(available: np.ndarray, floors: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Counts of a random sample without replacement of size ``n`` that holds every floor as far as rows exist."""
    least = np.minimum(floors, available)
    rest = min(n - least.sum(), (available - least).sum())
    if rest <= 0:
        return least
    return least + np.random.default_rng(seed).multivariate_hypergeometric(available - least, int(rest), method="marginals")


def swap_repair(start: np.ndarray, available: np.ndarray, floors: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Exchange counts between signatures while an exchange lowers the summed absolute deviation from ``target``.

    A step moves as many rows as help at once from the signature furthest above its target to the one furthest
    below that still has rows; floors are never undercut, the sample keeps its size. It ends when no exchange improves.
    """
    take, least = start.copy(), np.minimum(floors, available)
    gap = take - target
    above = [(-gap[i], i) for i in np.flatnonzero(take > least)]
    below = [(gap[i], i) for i in np.flatnonzero(take < available)]
    heapq.heapify(above)
    heapq.heapify(below)

    def furthest(heap: list, sign: int) -> int | None:
        while heap:
            g, i = heap[0]
            if g == sign * (take[i] - target[i]) and (take[i] > least[i] if sign < 0 else take[i] < available[i]):
                return i
            heapq.heappop(heap)  # has changed since, or cannot give or take any more
        return None

    while True:
        give, get = furthest(above, -1), furthest(below, 1)
        if give is None or get is None or give == get:
            return take
        a, b = take[give] - target[give], target[get] - take[get]
        # moving m rows changes the deviation by |a - m| - a + |b - m| - b
        m = int(min(np.floor(a), np.floor(b), take[give] - least[give], available[get] - take[get]))
        if m < 1:
            if a - abs(a - 1) + b - abs(b - 1) <= 1e-9:
                return take
            m = 1
        take[give] -= m
        take[get] += m
        for i in (give, get):
            heapq.heappush(above, (-(take[i] - target[i]), i))
            heapq.heappush(below, (take[i] - target[i], i))


def plan_sample(counts: DataFrame, targets: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """How many rows of each signature to take, and where the target cannot be met.

    counts: (signature, available); targets: (signature, target_share, min_n). Only the cells of ``targets`` reach the driver, four numbers each, and the
    repair takes the logarithm of their number for each exchange; signatures without a target are not drawn and not looked at.
    required = max(min_n, floor(share × n)); met says that the sample holds as many, or could. A sample holds fewer than required also where
    enough exist, if the least numbers of other cells leave no room.
    """
    cells = targets.join(counts, "signature", "left").select(
        "signature", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("min_n", F.lit(0)).alias("min_n")
    )
    rows = cells.orderBy("signature").collect()
    available = np.array([r.available for r in rows], np.int64)
    share = np.array([r.share for r in rows], float)
    floors = np.array([r.min_n for r in rows], np.int64)
    required = np.maximum(floors, np.floor(share * n).astype(np.int64))
    take = np.zeros(0, np.int64)
    if rows:
        take = swap_repair(random_start(available, floors, n, seed), available, floors, np.maximum(share * n, floors))
    size = max(1, int(take.sum()))
    report = [
        (r.signature, int(a), int(q), int(k), float(s), float(k / size), bool(k >= q or a >= q))
        for r, a, q, k, s in zip(rows, available, required, take, share)
    ]
    return targets.sparkSession.createDataFrame(report, REPORT)


def draw_sample(rows: DataFrame, plan: DataFrame, identifier: str, seed: int = 42) -> DataFrame:
    """``taken`` rows of each signature of ``plan``, in seeded random order by exact positions, however large a signature is."""
    wanted = rows.join(plan.filter("taken > 0").select("signature", "taken"), "signature").withColumn("__h", F.xxhash64(F.col(identifier), F.lit(seed)))
    return first_by_position(wanted, "signature", [F.col("__h").asc(), F.col(identifier).asc()], "taken").select(*rows.columns)


def signature(consequence: Column, label: Column) -> Column:
    """Comparison form of a (consequence, label) cell; null when either is missing."""
    return F.concat(consequence_key(consequence), F.lit("|"), term_key(label))


def target_cells(targets: DataFrame) -> DataFrame:
    """(signature, consequence, label, target_share, min_n); a cell given twice counts with its least min_n and share."""
    cells = targets.withColumn("signature", signature(F.col("consequence"), F.col("label"))).filter("signature is not null")
    return cells.groupBy("signature").agg(
        F.min("consequence").alias("consequence"), F.min("label").alias("label"), F.min("target_share").alias("target_share"), F.min("min_n").alias("min_n")
    )


def _latest_cells(variants: DataFrame) -> DataFrame:
    narrow = variants.select("variant_id", "consequence", "label", "loaded_at", "row_id")
    return latest_variants(narrow).select("row_id", "variant_id", signature(F.col("consequence"), F.col("label")).alias("signature"))


def variant_plan(variants: DataFrame, targets: DataFrame, fraction: int = 10, seed: int = 42) -> DataFrame:
    """Report of the sample of a ``fraction``-th of all distinct variants: (consequence, label, available, required, taken, target_share, actual_share, met)."""
    by_cell = written(_latest_cells(variants).groupBy("signature").agg(F.count("*").alias("available")), "cells")  # read twice
    n = int(by_cell.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("n")).first().n) // fraction
    cells = target_cells(targets)
    plan = plan_sample(by_cell, cells.select("signature", "target_share", "min_n"), n, seed)
    return plan.drop("target_share").join(cells.select("signature", "consequence", "label", "target_share"), "signature")


def short_cells(plan: DataFrame) -> DataFrame:
    """Cells of which the sample holds fewer rows than required, and could not hold more: the least numbers of the others are not what stands in their way."""
    return plan.filter("taken < required").filter("available < required")


def variant_sample(variants: DataFrame, targets: DataFrame, fraction: int = 10, seed: int = 42) -> DataFrame:
    """(row_id, variant_id, consequence, label): the sample itself, spelled as in ``targets``."""
    return draw_variants(variants, variant_plan(variants, targets, fraction, seed), seed)


def draw_variants(variants: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of a plan."""
    drawn = draw_sample(_latest_cells(variants), plan, "row_id", seed)
    return drawn.join(plan.select("signature", "consequence", "label"), "signature").select("row_id", "variant_id", "consequence", "label")
