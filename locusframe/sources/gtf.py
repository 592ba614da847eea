"""Genes from GTF text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import annotate


def attribute(attributes: Column, key: str) -> Column:
    value = F.regexp_extract(attributes, rf'(?:^|;)\s*{key} "?([^";]*)"?', 1)
    return F.when(value != "", value)


def parse_genes(lines: DataFrame, biotype: str = "protein_coding", value: str = "value") -> DataFrame:
    """(gene_id, gene_name, chrom, start, end, strand, length, hgnc_id, level) of ``gene`` lines; bare chromosome, no id version, 0-based start."""
    f = F.split(F.col(value), "\t")
    genes = lines.filter(~F.col(value).startswith("#") & (F.size(f) >= 9) & (f[2] == "gene"))
    a = f[8]
    kind = F.coalesce(attribute(a, "gene_type"), attribute(a, "gene_biotype"), F.lit(""))
    first, last = f[3].cast("bigint"), f[4].cast("bigint")
    return genes.filter(kind == biotype).select(
        annotate.unversioned(F.coalesce(attribute(a, "gene_id"), F.lit(""))).alias("gene_id"),
        F.coalesce(attribute(a, "gene_name"), F.lit("")).alias("gene_name"), annotate.bare_chrom(f[0]).alias("chrom"),
        (first - 1).alias("start"), last.alias("end"), f[6].alias("strand"), (last - first + 1).alias("length"),
        F.coalesce(attribute(a, "hgnc_id"), F.lit("")).alias("hgnc_id"), F.coalesce(attribute(a, "level").cast("int"), F.lit(0)).alias("level"),
    )


def read_gtf(spark: SparkSession, path: str, biotype: str = "protein_coding") -> DataFrame:
    return parse_genes(spark.read.text(path), biotype)
