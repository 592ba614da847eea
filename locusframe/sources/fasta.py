"""Genome sequence from FASTA text as tiles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.genome import TILE
from ..schema import CHROMOSOMES
from ..session import written


def _pieces(lines: DataFrame, size: int) -> DataFrame:
    """(file, block, record, at, bases, name, tail): what each split of a file holds, in one pass over its lines.

    A split gives its stretches of bases (at most ``size`` each, ``at`` counted from the start of their record or of the split), a row for each header, and at
    its end the number of its headers with the bases behind the last. Record 0 is what the split before began.
    """
    names = ["file", "block", "record", "at", "bases", "name", "tail"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, record, at, held, n, out = None, 0, 0, [], 0, []

        def flush() -> None:
            nonlocal at, n
            if n:
                text = "".join(held)
                out.extend((*split, record, at + i, text[i : i + size], None, None) for i in range(0, n, size))
                at += n
                held.clear()
                n = 0

        for batch in batches:
            for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))):
                if (file, block) != split:
                    if split is not None:
                        flush()
                        out.append((*split, record, None, None, None, at))
                    split, record, at = (file, block), 0, 0
                value = value.strip()
                if value.startswith(">"):
                    flush()
                    record, at = record + 1, 0
                    out.append((*split, record, None, None, (value[1:].split() or [""])[0], None))
                else:
                    held.append(value.upper())
                    n += len(value)
                    if n >= size:
                        flush()
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)
                out.clear()
        if split is not None:
            flush()
            out.append((*split, record, None, None, None, at))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)

    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("record", pa.int64()), ("at", pa.int64()), ("bases", pa.string()), ("name", pa.string()), ("tail", pa.int64())])
    return lines.mapInArrow(read, "file string, block bigint, record bigint, at bigint, bases string, name string, tail bigint")


def read_fasta(spark: SparkSession, path: str, size: int = TILE, known: tuple[str, ...] | None = CHROMOSOMES) -> DataFrame:
    """(chrom, bin, seq): bare chromosome names, upper case, tiles of ``size`` bases.

    Each split of a file is read once, where it lies; where its first record goes on from an earlier split, the bases before it come from sums over one row a
    split. Only stretches of about a tile are shuffled, so no record is ever one row.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    pieces = written(_pieces(lines, size), "fasta")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = pieces.filter("tail is not null").select("file", "block", "tail", F.coalesce(F.sum("record").over(before), F.lit(0)).alias("earlier"), F.col("record").alias("own"))
    # bases since the last header: the tails of the splits before that have as many headers up to their end as there are before this one
    same = W.partitionBy("file", "upto").orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = splits.withColumn("upto", F.col("earlier") + F.col("own")).withColumn("since", F.sum("tail").over(same))
    last = sums.groupBy("file", F.col("upto").alias("earlier")).agg(F.collect_list(F.struct("block", "since")).alias("s"))
    carried = F.array_max(F.filter("s", lambda x: x["block"] < F.col("block")))["since"]
    splits = splits.join(last, ["file", "earlier"], "left").select("file", "block", "earlier", F.coalesce(carried, F.lit(0)).alias("carried"))
    placed = pieces.filter("tail is null").join(F.broadcast(splits), ["file", "block"])  # one row a split
    placed = placed.withColumns({"at": F.col("at") + F.when(F.col("record") == 0, F.col("carried")).otherwise(0), "record": F.col("earlier") + F.col("record")})
    names = placed.filter("name is not null").select("file", "record", F.regexp_replace("name", "chr", "").alias("chrom"))
    if known is not None:
        names = names.filter(F.col("chrom").isin(*known))
    bases = placed.filter("bases is not null").select("file", "record", "at", "bases").join(names, ["file", "record"])
    end = F.col("at") + F.length("bases")
    cut = bases.withColumn("bin", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((end - 1) / size))))
    begin = F.greatest(F.col("bin") * size - F.col("at"), F.lit(0))
    upto = F.least((F.col("bin") + 1) * size, end) - F.col("at")
    parts = cut.select("chrom", "bin", F.struct("at", F.substring("bases", (begin + 1).cast("int"), (upto - begin).cast("int")).alias("s")).alias("p"))
    return parts.groupBy("chrom", "bin").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "").alias("seq"))
