"""Position-level activation vectors in long form: one row per variant, direction and position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import FLOAT_EPS, cosine, rms_normalised, unified_difference

VIEWS = ("var_same", "ref_same", "ref_cross")


def lowest_cosine(rows: DataFrame, keys: list[str], k: int, a: str = "var_same", b: str = "ref_same") -> DataFrame:
    """The ``k`` positions of least similarity per key, in ascending order of position with ``slot`` from 0; ties to the smaller position."""
    picked = rows.withColumn("__c", cosine(F.col(a), F.col(b))).withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy("__c", "pos"))).filter(F.col("__r") <= k)
    return picked.withColumn("slot", F.row_number().over(W.partitionBy(*keys).orderBy("pos")) - 1).drop("__r")


def select_positions(rows: DataFrame, ranges: DataFrame, keys: list[str], k: int, window: int = 0, zeros: int | None = None) -> DataFrame:
    """``k`` slots per key: the first ``window`` positions of its range, then those of least similarity; slots beyond them are pads (pos -1).

    rows: (keys, pos, vectors); ranges: (keys, range_start, range_end). Order by (guaranteed first, cosine, pos) makes both parts one rank.
    The result has a row for every slot 0..k-1 of every key of ``ranges``; pads have null vectors, or ``zeros`` zeros. Without a window these are the ``k`` positions of
    least similarity of the range, padded.
    """
    inside = rows.join(ranges, keys).filter((F.col("pos") >= F.col("range_start")) & (F.col("pos") < F.col("range_end")))
    kept_first = F.when(F.col("pos") < F.col("range_start") + window, F.struct(F.lit(0).alias("g"), F.lit(0.0).alias("c"), "pos")).otherwise(
        F.struct(F.lit(1).alias("g"), cosine(F.col("var_same"), F.col("ref_same")).alias("c"), "pos")
    )
    picked = inside.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(kept_first))).filter(F.col("__r") <= k)
    slotted = picked.withColumn("slot", F.row_number().over(W.partitionBy(*keys).orderBy("pos")) - 1).drop("__r", "range_start", "range_end")
    slots = ranges.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    padded = slots.join(slotted, [*keys, "slot"], "left")
    if zeros is not None:
        empty = F.array_repeat(F.lit(0.0).cast("float"), zeros)
        padded = padded.withColumns({v: F.when(F.col("pos").isNull(), empty).otherwise(F.col(v)) for v in VIEWS if v in rows.columns})
    return padded.withColumn("pos", F.coalesce("pos", F.lit(-1)))


def selection_ranges(variants: DataFrame, length: str, offset: str) -> DataFrame:
    """(variant_id, dir, range_start, range_end): forward behind the longer allele up to the shared length, backward before the variant."""
    shared = F.least(F.col(length), F.col(length) - F.length("ref") + F.length("alt"))
    behind = F.col(offset) + F.greatest(F.length("ref"), F.length("alt"))
    pair = F.array(F.struct(F.lit(0).alias("dir"), behind.alias("range_start"), shared.alias("range_end")), F.struct(F.lit(1).alias("dir"), F.lit(0).cast("bigint").alias("range_start"), F.col(offset).alias("range_end")))
    return variants.select("variant_id", F.explode(pair).alias("r")).select("variant_id", "r.*")


def loss_difference(selected: DataFrame, losses: DataFrame, keys: list[str]) -> DataFrame:
    """Loss of the variant less loss of the reference at each selected position; 0 for pads and positions without both losses."""
    joined = selected.join(losses, [*keys, "pos"], "left")
    return joined.withColumn("loss", F.coalesce(F.col("var_loss") - F.col("ref_loss"), F.lit(0.0))).drop("var_loss", "ref_loss")


def genomic_positions(selected: DataFrame, variants: DataFrame, pos: str = "variant_pos", offset: str = "offset") -> DataFrame:
    """Window positions to genome positions; pads stay -1."""
    joined = selected.join(variants.select("variant_id", pos, offset), "variant_id")
    return joined.withColumn("pos", F.when(F.col("pos") >= 0, F.col("pos") + F.col(pos) - F.col(offset)).otherwise(-1)).drop(pos, offset)


def mean_pooled(rows: DataFrame, keys: list[str], view: str, eps: float = FLOAT_EPS) -> DataFrame:
    """(keys, dim, mean): mean over positions of RMS-normalised vectors, one row per dimension (combined before the shuffle)."""
    spread = rows.select(*keys, F.posexplode(rms_normalised(F.col(view), eps)).alias("dim", "__x"))
    return spread.groupBy(*keys, "dim").agg(F.avg("__x").alias("mean"))


def unified_diff(selected: DataFrame) -> DataFrame:
    """(variant_id, slot, diff): variant less reference of the forward, then of the backward direction; pads count as zeros."""
    def part(direction: int, name: str) -> DataFrame:
        return selected.filter(F.col("dir") == direction).select("variant_id", "slot", F.col("var_same").alias(f"{name}_var"), F.col("ref_same").alias(f"{name}_ref"))

    both = part(0, "f").join(part(1, "b"), ["variant_id", "slot"], "full")
    vectors = ["f_var", "f_ref", "b_var", "b_ref"]
    zeros: Column = F.array_repeat(F.lit(0.0).cast("float"), F.coalesce(*[F.size(v) for v in vectors], F.lit(0)))
    return both.select("variant_id", "slot", unified_difference(*[F.coalesce(v, zeros) for v in vectors]).alias("diff"))
