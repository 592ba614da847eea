"""Sharding, resuming and checks; a check returns the violations, an empty table passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .ordering import with_position


def contiguous_shards(df: DataFrame, order: list[Column], shards: int) -> DataFrame:
    """Rows with their ``shard``: contiguous stretches of ``order``, as even as can be; never more shards than rows."""
    placed = with_position(df, order, "__row").withColumn("__n", df.agg(F.count("*")).scalar())
    n = F.least(F.lit(shards).cast("bigint"), F.col("__n"))
    return placed.withColumn("shard", F.floor(((F.col("__row") + 1) * n - 1) / F.col("__n")).cast("int")).drop("__row", "__n")


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def stale(done: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Done keys that the manifest does not hold."""
    return done.select(key).distinct().join(df.select(key), key, "left_anti")


def missing_shards(df: DataFrame, shard: str = "shard", expected: int | None = None) -> DataFrame:
    """Shard numbers from 0 to the greatest (or ``expected`` - 1) that have no rows."""
    last = F.lit(expected - 1) if expected is not None else F.max(shard)
    full = df.agg(last.cast("int").alias("__last")).filter("__last >= 0").select(F.explode(F.sequence(F.lit(0), "__last")).alias(shard))
    return full.join(df.select(shard).distinct(), shard, "left_anti")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that stand in several rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def unequal_counts(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(dataset, n_items) for all datasets when their distinct item counts differ; empty when equal."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count_distinct(key).alias("n_items")).select(F.lit(name).alias("dataset"), "n_items")
        counts = one if counts is None else counts.unionByName(one)
    differ = counts.agg(F.max("n_items") != F.min("n_items"), F.collect_list(F.struct("dataset", "n_items")))
    return differ.toDF("__differ", "__c").filter("__differ").select(F.explode("__c").alias("c")).select("c.*")  # one row a dataset


def dropped_counts(steps: dict[str, Observation]) -> dict[str, tuple[int, int]]:
    """(rows in, rows dropped) of each step, in order, from the counts of ``counted`` rows; known once a result has been written or read.

    A step's rows out are the next step's rows in, so the last entry is the count of what came out.
    """
    n = {name: o.get["n"] for name, o in steps.items()}
    names = list(n)
    return {a: (n[a], n[a] - n[b]) for a, b in zip(names, names[1:])} | {names[-1]: (n[names[-1]], 0)}


def counted(df: DataFrame, name: str, steps: dict[str, Observation]) -> DataFrame:
    """``df`` as it is; its rows are counted as they pass, without a job of their own, into ``steps[name]``."""
    steps[name] = Observation(name)
    return df.observe(steps[name], F.count("*").alias("n"))


def id_mismatch(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): ids that only the left or only the right table holds."""
    left = a.select(key).distinct().withColumn("__a", F.lit(True))
    right = b.select(key).distinct().withColumn("__b", F.lit(True))
    both = left.join(right, key, "full").filter("__a is null or __b is null")
    return both.select(key, F.when(F.col("__a").isNull(), "right_only").otherwise("left_only").alias("side"))
