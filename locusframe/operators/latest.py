"""Latest delivery of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, key: str | Column, order: list[Column]) -> DataFrame:
    """Keep, per ``key``, the first row of ``order``.

    The literal rank limit lets Spark drop all but one row per key before the shuffle
    (WindowGroupLimit), so a key delivered very often costs no more than any other.
    Rows with a null key belong to no key and are left out. An empty table gives an empty table.
    """
    k = F.col(key) if isinstance(key, str) else key
    return (
        df.filter(k.isNotNull())
        .withColumn("__rank", F.row_number().over(W.partitionBy(k).orderBy(*order)))
        .filter(F.col("__rank") == 1)
        .drop("__rank")
    )


def latest_variants(variants: DataFrame) -> DataFrame:
    """Latest row of each variant id: greatest loaded_at, then greatest row_id."""
    return latest_rows(
        variants, "variant_id", [F.col("loaded_at").desc_nulls_last(), F.col("row_id").desc_nulls_last()]
    )
