"""Global order without a single-task window: range partitions, partition totals, prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .runs import Runs

_LOW = (1 << 33) - 1


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which a null key meets a null key; the keys come out once."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition &= F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, condition).drop(*[f"__r_{k}" for k in keys])


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with the exact 0-based global position in ``order`` (which should end in a unique key).

    The range-sorted rows are written once, so both passes see the same partitions; only one count per partition is summed up front.
    """
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rows = placed.withColumn("__part", part).join(F.broadcast(before), "__part")  # one row per partition
    return rows.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(_LOW)).drop("__part", "__at", "__before")


def running_totals(df: DataFrame, group: list[str], order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """``df`` with running sums (this row included) of ``totals`` (whole numbers) within ``group`` in ``order``, however large a group is.

    Rows are shuffled once, to range partitions by group and order. Each sorted partition streams through one task, which carries the sums of the
    current group from batch to batch and ends with one row for its first and one for its last group. Only its first group can have begun in an earlier
    partition, so one number a partition, summed over those rows, completes the sums.
    """
    names, sums = df.columns, list(totals)
    keys = [F.col(g) for g in group]
    valued = df.select("*", *[c.cast("bigint").alias(f"__v_{n}") for n, c in totals.items()])
    kept = [T.StructField(f.name, f.dataType) for f in df.schema]
    added = [T.StructField(f"__l_{n}", T.LongType()) for n in sums]
    schema = T.StructType([*kept, *added, T.StructField("__part", T.IntegerType()), T.StructField("__first", T.BooleanType()), T.StructField("__ends", T.IntegerType())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs, part, first = Runs(group), TaskContext.get().partitionId(), None
        carried = np.zeros(len(sums), np.int64)
        for batch in batches:
            starts = runs(batch)
            n = batch.num_rows
            if not n:
                continue
            local = np.cumsum([batch.column(f"__v_{s}").fill_null(0).to_numpy(zero_copy_only=False) for s in sums], axis=1)
            begins = starts if len(starts) and starts[0] == 0 else np.r_[0, starts]
            before = np.where(begins > 0, local[:, begins - 1], 0)
            if len(begins) > len(starts):
                before[:, 0] -= carried  # the run of the batch before goes on
            local = local - np.repeat(before, np.diff(np.r_[begins, n]), axis=1)
            if first is None:
                first = (batch.slice(0, 1), None)
            if first[1] is None and runs.number > 1:  # the first run has ended: its sums are those of the last row before
                end = int(starts[0] if runs.number_before > 0 else starts[1])
                first = (first[0], local[:, end - 1] if end else carried.copy())
            in_first = np.arange(n) < (n if first[1] is None else 0 if runs.number_before > 1 else int(starts[0] if runs.number_before else starts[1]))
            carried = local[:, -1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], *map(pa.array, local), pa.array(np.full(n, part, np.int32)), pa.array(in_first), pa.nulls(n, pa.int32())], names=schema.names
            )
            last = batch.slice(n - 1, 1)
        if first is not None:
            ends = [(first[0], carried if first[1] is None else first[1], 1)] + ([(last, carried, 2)] if first[1] is not None else [])
            for row, total, which in ends:
                held = [row.column(c) if c in group else pa.nulls(1, row.column(c).type) for c in names]
                yield pa.RecordBatch.from_arrays([*held, *[pa.array([x]) for x in total], pa.array([part], pa.int32()), pa.nulls(1, pa.bool_()), pa.array([which], pa.int32())], names=schema.names)

    placed = written(valued.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(stream, schema), "running")
    earlier = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    ends = placed.filter("__ends is not null").select("__part", "__ends", *[F.coalesce(F.sum(f"__l_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums])
    rows = placed.filter("__ends is null").join(F.broadcast(ends.filter("__ends = 1")), "__part")  # one row per partition
    return rows.select(*names, *[(F.col(f"__l_{n}") + F.when(F.col("__first"), F.col(f"__b_{n}")).otherwise(0)).alias(n) for n in sums])


def seeded_key(key: Column, seed: int = 42) -> Column:
    """Order key of a reproducible shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
