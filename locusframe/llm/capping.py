"""Capping records per dominant contributor by exact global positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import gene_key, star_rank
from ..operators.latest import latest_variants
from ..session import written
from .runs import RunRanks


def first_by_position(df: DataFrame, contributor: str, order: list[Column], cap: str | int, few_over: bool = False) -> DataFrame:
    """The first ``cap`` rows of ``order`` for every contributor, with their 0-based ``position`` and ``over_cap``.

    One global range sort by contributor and order; a contributor may span any number of partitions, so its size
    makes no task long. Each sorted partition streams out of each contributor's stretch the rows that could still lie
    below the cap and one more, with their index in the partition, and at its end its row count and those of its first and last contributor. Prefix sums of the
    partition counts (one row per partition) turn indexes into exact global positions; only the first contributor of a partition can have
    begun in an earlier one, so its start comes from those rows too, and every other start is known where the rows lie: nothing is joined by contributor to find it.
    Positions below start + cap stay. ``cap`` is a number or the name of a column
    that is the same for all rows of a contributor. ``order`` must end in an identifier. A null contributor is left out.
    ``over_cap`` says that the contributor had more rows than its cap; the one row
    beyond the cap that proves it does not come out. A cap of 0 or null keeps nothing; an empty table gives no rows. Columns
    ``position`` and ``over_cap`` of the input are replaced. few_over: the contributors over their cap are known to be few (a cap that is a share of all
    rows), so the list of them is sent to every task, and a contributor with very many rows below its cap is no single task.
    """
    df = df.drop("position", "over_cap")
    limit = F.lit(cap) if isinstance(cap, int) else F.col(cap)
    names = df.columns
    added = [("__part", T.IntegerType()), ("__index", T.LongType()), ("__start", T.LongType()), ("__count", T.LongType()), ("__run", T.LongType())]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in df.schema], T.StructField("__cap", T.LongType()), *[T.StructField(n, t) for n, t in added]])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ranks, seen, part, ends, first = RunRanks(), 0, TaskContext.get().partitionId(), None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rank, index = ranks(batch.column(contributor)), np.arange(seen, seen + n)
            start = index - rank  # where the run begins in the partition; 0 for the partition's first contributor
            of_first = int(np.searchsorted(start, 0, side="right"))
            ends = batch.slice(n - 1, 1)
            first = [batch.slice(0, 1), of_first] if first is None else [first[0], first[1] + of_first]
            caps = batch.column("__cap").to_numpy(zero_copy_only=False)
            out = pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(index), pa.array(start), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=schema.names
            )
            seen += n
            yield out.filter(pa.array(rank <= caps))
        if first is not None:
            for row, count, run in ((first[0], seen, first[1]), *([(ends, None, ranks.seen)] if first[1] < seen else [])):
                held = [row.column(c) if c == contributor else pa.nulls(1, row.column(c).type) for c in row.schema.names]
                tail = [pa.array([x], t) for x, t in ((part, pa.int32()), (None, pa.int64()), (None, pa.int64()), (count, pa.int64()), (run, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*held, *tail], names=schema.names)

    placed = (
        df.filter(F.col(contributor).isNotNull())
        .withColumn("__cap", limit.cast("bigint"))
        .repartitionByRange(contributor, *order)
        .sortWithinPartitions(contributor, *order)
        .mapInArrow(stream, schema)
    )
    placed = written(placed, "positions")
    # one or two rows per partition: windows over so few rows are prefix sums, not a bottleneck
    ends = placed.filter("__run is not null").select(contributor, "__part", "__count", "__run")
    earlier = W.partitionBy(contributor).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("__of_first", F.coalesce(F.sum("__run").over(earlier), F.lit(0))).filter("__count is not null")
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ends.select("__part", "__of_first", F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__before"))
    rows = placed.filter("__run is null").join(F.broadcast(offsets), "__part")  # one row per partition
    start = F.col("__before") + F.when(F.col("__start") == 0, -F.col("__of_first")).otherwise(F.col("__start"))
    rows = rows.withColumn("position", F.col("__before") + F.col("__index") - start)
    over = rows.filter(F.col("position") == F.col("__cap")).select(contributor, F.lit(True).alias("__over"))  # one row a contributor over its cap
    kept = rows.filter(F.col("position") < F.col("__cap")).join(F.broadcast(over) if few_over else over, contributor, "left")
    return kept.select(*names, "position", F.coalesce("__over", F.lit(False)).alias("over_cap"))


def cap_contributors(df: DataFrame, contributor: str, order: list[Column], most: int | None = None, share: float | None = None) -> DataFrame:
    """At most ``most`` rows, or ``share`` of all rows, per contributor; see ``first_by_position``."""
    if (most is None) == (share is None):
        raise ValueError("give either most or share")
    if share is None:
        return first_by_position(df, contributor, order, int(most))
    whole = df.agg(F.floor(F.count("*") * F.lit(share)).cast("bigint")).scalar()
    few = share >= 1e-4  # at most 1 / share contributors can hold more than a share of all rows
    return first_by_position(df.withColumn("__share_cap", whole), contributor, order, "__share_cap", few).drop("__share_cap")


def gene_records(variants: DataFrame) -> DataFrame:
    """Latest rows with a gene, as (gene_name, stars, allele_id, row_id)."""
    narrow = variants.select("variant_id", "gene_name", "stars", "allele_id", "row_id", "loaded_at")
    return (
        latest_variants(narrow)
        .select(gene_key(F.col("gene_name")).alias("gene_name"), star_rank(F.col("stars")).alias("stars"), "allele_id", "row_id")
        .filter("gene_name is not null")
    )


def capped_genes(variants: DataFrame, most: int = 20) -> DataFrame:
    """Latest rows capped per gene: best by stars, then allele_id (null last), then row_id."""
    return cap_contributors(gene_records(variants), "gene_name", [F.col("stars").desc(), F.col("allele_id").asc_nulls_last(), F.col("row_id").asc()], most=most)
