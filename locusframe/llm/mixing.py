"""Mixing sources to target weights by subset-sum budget fitting over token lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .bpe import DEFAULT_FILE, token_counts
from .capping import first_by_position

#: Tokens of remaining budget that the dynamic programme fits exactly.
EXACT_BUDGET = 1 << 17


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int, exact: int = EXACT_BUDGET) -> np.ndarray:
    """How many documents of each token length to take (at most ``counts``) so that their sum comes as near to ``budget`` from below as can be.

    A proportional share of every length comes first, by systematic sampling over the documents in order of length, at every size of the budget; what is kept
    back is twice the longest length, ``exact`` tokens at most. Whole long documents then bring the rest below ``exact``, and that remainder is fitted by
    bounded-knapsack dynamic programming: a length with c documents enters as 1, 2, 4, ... of it, and of every sum the first entry is kept that
    reached it, so memory is one number a sum whatever the lengths are. It stops as soon as the remainder itself is reached. Where it is not, and the
    whole budget is at most ``exact``, the whole budget is fitted that way, and the nearer of both is taken.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    take = np.zeros(len(lengths), np.int64)
    usable = np.flatnonzero((lengths > 0) & (counts > 0))
    total = int((lengths * counts)[usable].sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        take[usable] = counts[usable]
        return take
    rng = np.random.default_rng(seed)
    usable = usable[np.argsort(lengths[usable], kind="stable")]
    keep = min(exact, 2 * int(lengths[usable].max()))
    if budget > keep:
        upto = np.floor(np.cumsum(counts[usable]) * ((budget - keep) / total) + rng.random()).astype(np.int64)
        take[usable] = np.minimum(np.diff(np.r_[0, upto]), counts[usable])
    left = budget - int((lengths * take).sum())
    for i in usable[::-1]:  # the draw may lie above the budget by a document or two of the longest
        if left >= 0:
            break
        back = min(int(take[i]), -(left // int(lengths[i])))
        take[i] -= back
        left += back * int(lengths[i])
    for i in usable[::-1]:
        if left <= exact:
            break
        more = min(int(counts[i] - take[i]), max(0, left - exact // 2) // int(lengths[i]))
        take[i] += more
        left -= more * int(lengths[i])
    if left > exact:  # whatever is not taken yet is longer than half of ``exact`` and no two of it fit
        fits = usable[(take[usable] < counts[usable]) & (lengths[usable] <= left)]
        if len(fits):
            take[fits[-1]] += 1
            left -= int(lengths[fits[-1]])
    if left > exact:
        return take
    short = _filled(lengths, counts, take, left, rng.permutation(usable))
    if short and budget <= exact:  # other documents than the share's may come nearer
        other = np.zeros(len(lengths), np.int64)
        if _filled(lengths, counts, other, budget, rng.permutation(usable)) < short:
            return other
    return take


def _filled(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, left: int, order: np.ndarray) -> int:
    """Add to ``take`` documents of ``left`` tokens, or as near below as can be; what is left then."""
    by = np.full(left + 1, -1, np.int64)  # the entry that reached a sum first
    reached = np.zeros(left + 1, bool)
    reached[0], entries = True, []
    for i in order:
        size, spare, lot = int(lengths[i]), int(counts[i] - take[i]), 1
        while spare > 0 and size * min(lot, spare) <= left:
            lot = min(lot, spare)
            step = size * lot
            new = reached[:-step] & ~reached[step:]
            by[step:][new] = len(entries)
            reached[step:] |= new
            entries.append((i, lot))
            spare -= lot
            lot *= 2
        if reached[left]:
            break
    best = at = int(np.flatnonzero(reached)[-1])
    while at:
        i, lot = entries[by[at]]
        take[i] += lot
        at -= int(lengths[i]) * lot
    return left - best


def length_plan(sized: DataFrame, weights: DataFrame, seed: int = 42) -> DataFrame:
    """(source, n_tokens, n_docs, copies, extra): whole copies of every document of a source, and of how many of each length one more.

    sized: (source, n_tokens) per document. The corpus is reduced to a count per source and exact length before anything is planned; one
    group of the planning step holds the distinct lengths of one source. Target of a source: weight × T, with T the tokens of all
    weighted sources. Copies and extra together never repeat a document more than max_repeat times.
    """
    lengths = written(sized.groupBy("source", "n_tokens").agg(F.count("*").alias("n_docs")), "lengths")  # texts are counted once
    known = weights.filter("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeat").alias("max_repeat"))
    mine = lengths.join(known, "source").withColumn("__tokens", F.col("n_tokens") * F.col("n_docs"))
    whole = mine.agg(F.sum("__tokens")).scalar()

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n_tokens", ignore_index=True)
        size, target = int(group["__tokens"].sum()), float(group["weight"][0]) * int(group["__all"][0])
        most = int(group["max_repeat"][0])
        copies, extra = most, np.zeros(len(group), np.int64)
        if most * size > target:
            copies = int(target // size)
            extra = fit_budget(group["n_tokens"].to_numpy(), group["n_docs"].to_numpy(), int(target) - copies * size, seed)
        return group[["source", "n_tokens", "n_docs"]].assign(copies=copies, extra=extra)

    planned = mine.withColumn("__all", whole).groupBy("source").applyInPandas(plan, "source string, n_tokens bigint, n_docs bigint, copies int, extra bigint")
    return written(planned, "plan")


def mix_report(plan: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, weight, max_repeat, size, target, used, share, short) for every weighted source, also those without documents.

    short: its plan repeats every document max_repeat times and yet stays below its target. share: used tokens of all used tokens.
    """
    known = weights.filter("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeat").alias("max_repeat"))
    used = plan.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("n_docs")).alias("size"), F.sum(F.col("n_tokens") * (F.col("n_docs") * F.col("copies") + F.col("extra"))).alias("used"), F.min("copies").alias("__least")
    )
    rows = known.join(used, "source", "left").fillna(0, ["size", "used"])
    target = F.col("weight") * F.col("__size")
    return rows.withColumns({"__size": rows.agg(F.sum("size")).scalar(), "__used": rows.agg(F.sum("used")).scalar()}).select(
        "source", "weight", "max_repeat", "size", target.alias("target"), "used",
        F.when(F.col("__used") > 0, F.col("used") / F.col("__used")).otherwise(F.lit(0.0)).alias("share"),
        ((F.coalesce("__least", "max_repeat") >= F.col("max_repeat")) & (F.col("used") < target)).alias("short"),
    )


def mixed_documents(sized: DataFrame, plan: DataFrame, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """(key, source, n_tokens, copies): how often each document stands in the mixture; those that do not are left out.

    The extra copies of a length go to its documents in seeded order, by exact positions, so a length that very many documents share is no single task.
    """
    joined = sized.join(plan.select("source", "n_tokens", "copies", "extra"), ["source", "n_tokens"])
    drawn = joined.filter("extra > 0").withColumn("__cell", F.concat_ws(":", "source", "n_tokens")).withColumn("__h", F.xxhash64(F.col(key), F.lit(seed)))
    chosen = first_by_position(drawn, "__cell", [F.col("__h").asc(), F.col(key).asc()], "extra")
    whole = joined.filter("copies > 0").select(key, "source", "n_tokens", "copies")
    once = chosen.select(key, "source", "n_tokens", F.lit(1).alias("copies"))
    return whole.unionByName(once).groupBy(key, "source", "n_tokens").agg(F.sum("copies").cast("int").alias("copies"))


def sized_documents(documents: DataFrame, path: str = DEFAULT_FILE) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that name a source."""
    return token_counts(documents.filter("source is not null").select("text", "doc_id", "source"), path=path)
