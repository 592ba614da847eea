"""Top N items within every group by secondary sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import gene_key
from ..operators.curation import valid_scores
from ..operators.latest import latest_variants
from .runs import RunRanks, take


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of ``order`` in every group, with ``rank_no`` from 1.

    Secondary sort, streamed twice: each partition is sorted by group and order as it lies and passes on ``n``
    rows a group (nothing is shuffled, and a group of a third of all rows shrinks to ``n`` rows a task);
    what is left is hash-partitioned by group, sorted the same way and streamed again. No
    group is ever buffered. ``order`` must end in an identifier for the same result on every run; full ties keep one
    of the tied rows. A null group is left out. Fewer than ``n`` rows: all come out. Empty table: no rows. A column
    ``rank_no`` of the input is replaced.
    """
    df = df.drop("rank_no")
    schema = df.schema
    ranked = schema.simpleString()[len("struct<") : -1]

    def first_n(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = RunRanks()
        for batch in batches:
            yield take(batch, ranks(batch.column(group)) < n)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = RunRanks()
        for batch in batches:
            rank = ranks(batch.column(group))
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array((rank + 1).astype(np.int32))], names=[*batch.schema.names, "rank_no"])
            yield take(out, rank < n)

    near = df.filter(F.col(group).isNotNull()).sortWithinPartitions(group, *order).mapInArrow(first_n, schema)
    return near.repartition(group).sortWithinPartitions(group, *order).mapInArrow(number, f"{ranked}, rank_no int")


def variant_genes(variants: DataFrame) -> DataFrame:
    """Gene of each variant id by its latest row; variants without a gene are left out."""
    narrow = variants.select("variant_id", "gene_name", "loaded_at", "row_id")
    return latest_variants(narrow).select("variant_id", gene_key(F.col("gene_name")).alias("gene_name")).filter("gene_name is not null")


def top_scored_variants(variants: DataFrame, scores: DataFrame, n: int = 3) -> DataFrame:
    """(gene_name, rank_no, variant_id, score): the ``n`` best scored variants of every gene, ties by variant id in byte order."""
    scored = variant_genes(variants).join(valid_scores(scores), "variant_id")
    top = top_per_group(scored, "gene_name", [F.col("score").desc(), F.col("variant_id").asc()], n)
    return top.select("gene_name", "rank_no", "variant_id", "score")

