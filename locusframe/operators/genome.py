"""Genome access by tiles: whole chromosomes never travel in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq

TILE = 1 << 16


def tiles(chromosomes: DataFrame, size: int = TILE) -> DataFrame:
    """(chrom, bin, seq) from (chrom, sequence), upper case."""
    last = F.floor((F.length("sequence") - 1) / size)
    bins = chromosomes.filter("sequence <> ''").select("chrom", "sequence", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("bin"))
    return bins.select("chrom", "bin", F.upper(F.substring("sequence", (F.col("bin") * size + 1).cast("int"), F.lit(size))).alias("seq"))


def lengths(tiled: DataFrame) -> DataFrame:
    return tiled.groupBy("chrom").agg(F.sum(F.length("seq").cast("bigint")).alias("chrom_length"))


def read_ranges(ranges: DataFrame, tiled: DataFrame, size: int = TILE) -> DataFrame:
    """``ranges`` (chrom, win_start, win_end, more) with ``window``, put together from the tiles they touch. Ranges outside the chromosome are left out.

    Each distinct range is read once, however many rows ask for it. An equi-join on (chrom, bin); each piece is cut to the range before pieces are gathered,
    so a gathered row is as long as its range.
    """
    at = ["chrom", "win_start", "win_end"]
    touched = ranges.select(*at).distinct().withColumn("bin", F.explode(F.sequence(F.floor(F.col("win_start") / size), F.floor((F.col("win_end") - 1) / size))))
    begin = F.greatest(F.col("win_start") - F.col("bin") * size, F.lit(0))
    upto = F.least(F.col("win_end") - F.col("bin") * size, F.lit(size))
    pieces = touched.join(tiled, ["chrom", "bin"]).select(*at, F.struct("bin", F.substring("seq", (begin + 1).cast("int"), (upto - begin).cast("int")).alias("s")).alias("p"))
    joined = pieces.groupBy(*at).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "").alias("window"))
    return ranges.join(joined, at)


def variant_windows(variants: DataFrame, tiled: DataFrame, upstream: int = 49_152, downstream: int = 16_384, size: int = TILE) -> DataFrame:
    """Reference and mutated window of every row (variant_id, chrom, pos, ref, alt); a variant may stand in several.

    Adds win_start, win_end, offset, ref_window, ref_ok (the reference allele stands there) and var_window (null unless it does).
    """
    # one row per chromosome or contig, left to the size check of the join planner
    ranged = variants.join(lengths(tiled), "chrom").withColumns(
        {
            "win_start": seq.window_start(F.col("pos"), F.col("chrom_length"), upstream, downstream),
            "win_end": seq.window_end(F.col("pos"), F.col("chrom_length"), upstream, downstream),
        }
    ).filter("win_end > win_start")
    read = read_ranges(ranged, tiled, size).withColumn("offset", F.col("pos") - F.col("win_start")).withColumnRenamed("window", "ref_window")
    ok = seq.allele_matches(F.col("ref_window"), F.col("offset"), F.col("ref"))
    return read.withColumn("ref_ok", ok).withColumn("var_window", F.when(ok, seq.mutate(F.col("ref_window"), F.col("offset"), F.col("ref"), F.col("alt")))).drop("chrom_length")


def reference_check(variants: DataFrame, genes: DataFrame, tiled: DataFrame, strict: bool = False, size: int = TILE) -> DataFrame:
    """Variants inside their gene whose reference allele stands in the gene's sequence.

    The gene's chromosome decides the sequence. On the minus strand the compatible default compares from the index of the allele's first base onwards,
    as published sets were made, which keeps longer alleles only by chance; ``strict`` compares the allele where it stands.
    """
    g = genes.select("gene_name", "gene_id", F.col("chrom").alias("gene_chrom"), "start", "end", "strand")
    inside = variants.join(g, "gene_name").filter((F.col("pos") >= F.col("start")) & (F.col("pos") + F.octet_length("ref") <= F.col("end")))
    n = F.octet_length("ref").cast("bigint")
    plus = F.col("strand") == "+"
    if strict:
        begin, finish = F.col("pos"), F.col("pos") + n
    else:  # minus: gene index end-pos-1 and n bases on reach down to pos-n+1 on the genome
        begin = F.when(plus, F.col("pos")).otherwise(F.greatest(F.col("start"), F.col("pos") - n + 1))
        finish = F.when(plus, F.least(F.col("pos") + n, F.col("end"))).otherwise(F.col("pos") + 1)
    kept = inside.withColumns({"__chrom": F.col("gene_chrom"), "win_start": begin, "win_end": finish})
    ranges = kept.select(F.col("__chrom").alias("chrom"), "win_start", "win_end").distinct()
    found = read_ranges(ranges, tiled, size).withColumnRenamed("chrom", "__chrom")
    matched = kept.join(found, ["__chrom", "win_start", "win_end"]).filter(F.upper("window") == F.upper("ref"))
    return matched.select(*variants.columns)


def gene_sequences(genes: DataFrame, tiled: DataFrame, size: int = TILE) -> DataFrame:
    """Genes with their sequence along the strand; genes on unknown sequences are dropped."""
    ranged = genes.withColumns({"win_start": F.col("start"), "win_end": F.col("end")})
    read = read_ranges(ranged, tiled, size)
    return read.withColumn("sequence", F.when(F.col("strand") == "-", seq.reverse_complement(F.col("window"))).otherwise(F.col("window"))).select(*genes.columns, "sequence")
