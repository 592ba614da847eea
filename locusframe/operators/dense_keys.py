"""Per-key results without skew: dense accumulator arrays over equal input splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accumulator blocks that one reduction step merges at most, per block of keys.
FAN_IN = 64


def dense_totals(df: DataFrame, keys: dict[str, Column], measures: dict[str, Column] | None = None, blocks: int | None = None) -> DataFrame:
    """Row count and sums of ``measures`` for each value of each of ``keys``: (field_name, key_value, n_rows, *measures).

    Each task takes its input split as it comes, whatever the keys in it (no row is shuffled, so no key can make
    a task long): the keys of an Arrow batch are dictionary-encoded, counted with ``bincount`` and scatter-added
    into dense arrays over the split's dictionary. A split then gives, for each of ``blocks`` hash blocks of the
    key space (default: as many as shuffle partitions), one array block per field; blocks are aligned and summed in three distributed
    steps, the first two over at most ``FAN_IN`` array blocks each, so no step holds more than its share of the keys
    for some tens of splits.

    A null key is a group of its own (key_value null); null measures add nothing. Measures are summed as double.
    Empty tables give no rows; repeated rows count each.
    """
    measures = measures or {}
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, sums = list(keys), list(measures)
    schema = "field_name string, block int, part int, key_value array<string>, n_rows array<bigint>" + "".join(f", `{m}` array<double>" for m in sums)
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * len(sums)]
    columns = ["field_name", "block", "part", "key_value", "n_rows", *sums]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=columns)

    def block_of(key: str | None) -> int:
        import zlib

        return 0 if key is None else zlib.crc32(key.encode()) % blocks

    def blocks_of(field: str, part: int, dictionary: list, arrays: list[np.ndarray]) -> list[tuple]:
        at = np.fromiter((block_of(k) for k in dictionary), np.int32, len(dictionary))
        rows = []
        for b in np.unique(at):
            own = np.flatnonzero(at == b)
            rows.append((field, int(b), part, [dictionary[i] for i in own], *[a[own].tolist() for a in arrays]))
        return rows

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        code: dict[str, dict] = {n: {} for n in names}
        held = {n: [np.zeros(1024, np.int64), *[np.zeros(1024) for _ in sums]] for n in names}
        for batch in batches:
            weights = [np.nan_to_num(batch.column(len(names) + i).to_numpy(zero_copy_only=False).astype(float)) for i in range(len(sums))]
            for i, name in enumerate(names):
                coded = batch.column(i).dictionary_encode(null_encoding="encode")
                index, own = code[name], coded.indices.to_numpy()
                place = np.fromiter((index.setdefault(k, len(index)) for k in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
                while len(index) > len(held[name][0]):
                    held[name] = [np.concatenate([a, np.zeros_like(a)]) for a in held[name]]
                size = len(coded.dictionary)
                held[name][0][place] += np.bincount(own, minlength=size)
                for a, w in zip(held[name][1:], weights):
                    a[place] += np.bincount(own, weights=w, minlength=size)
        for name in names:
            if code[name]:
                yield batch_of(blocks_of(name, part, list(code[name]), [a[: len(code[name])] for a in held[name]]))

    def merge(group: pa.Table) -> pa.Table:
        first = {c: group.column(c)[0].as_py() for c in ("field_name", "block", "part")}
        coded = group.column("key_value").combine_chunks().flatten().dictionary_encode(null_encoding="encode")
        own, size = coded.indices.to_numpy(), len(coded.dictionary)
        total = np.zeros(size, np.int64)
        np.add.at(total, own, group.column("n_rows").combine_chunks().flatten().to_numpy())
        parts = [total] + [np.bincount(own, weights=group.column(m).combine_chunks().flatten().to_numpy(), minlength=size) for m in sums]
        row = (first["field_name"], first["block"], first["part"] // FAN_IN, coded.dictionary.to_pylist(), *[p.tolist() for p in parts])
        return pa.Table.from_batches([batch_of([row])])

    split_blocks = df.select(*[c.cast("string").alias(n) for n, c in keys.items()], *[c.cast("double").alias(m) for m, c in measures.items()]).mapInArrow(accumulate, schema)
    merged = split_blocks
    for _ in range(2):  # ``merge`` divides the part number by FAN_IN
        merged = merged.groupBy("field_name", "block", F.floor(F.col("part") / FAN_IN).alias("near")).applyInArrow(merge, schema)
    merged = merged.groupBy("field_name", "block").applyInArrow(merge, schema)
    flat = merged.select("field_name", F.explode(F.arrays_zip("key_value", "n_rows", *sums)).alias("x"))
    return flat.select("field_name", "x.key_value", "x.n_rows", *[f"x.{m}" for m in sums])


def heavy_keys(totals: DataFrame, share: float = 0.02) -> DataFrame:
    """Keys of ``dense_totals`` that hold at least ``share`` of all rows; rows without a key count in the whole but name no key."""
    whole = totals.groupBy("field_name").agg(F.sum("n_rows").alias("__whole"))
    return (
        totals.join(F.broadcast(whole), "field_name")  # one row per field
        .filter(F.col("key_value").isNotNull() & (F.col("n_rows") / F.col("__whole") >= F.lit(share)))
        .drop("__whole")
    )
