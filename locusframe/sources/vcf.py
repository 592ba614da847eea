"""Variant calls from VCF text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import annotate
from ..operators.validation import counted


def info_value(info: Column, key: str) -> Column:
    """Value of ``key`` in an INFO text; null when missing or a flag. Of a repeated key the first counts."""
    value = F.regexp_extract(info, rf"(?:^|;){key}=([^;]*)", 1)
    return F.when(value != "", value)


_KEYS = ("GENEINFO", "CLNSIG", "CLNREVSTAT", "MC", "CLNDN", "ALLELEID", "RS")


def parse_info(rows: DataFrame, info: str = "info") -> DataFrame:
    """Adds gene_name, label, clinical_significance, stars, consequence, allele_id, disease_name and rs_id from an INFO column.

    Each value is taken out once, in a projection of its own; what is derived from it refers to that column.
    """
    raw = rows.withColumns({f"__{k}": info_value(F.col(info), k) for k in _KEYS})
    raw = raw.withColumn("__CLNSIG", F.lower(F.coalesce("__CLNSIG", F.lit(""))))
    parsed = raw.withColumns(
        {
            "gene_name": annotate.first_gene(F.col("__GENEINFO")),
            "label": annotate.significance_label(F.col("__CLNSIG")),
            "clinical_significance": F.col("__CLNSIG"),
            "stars": annotate.review_stars(F.col("__CLNREVSTAT")),
            "consequence": annotate.first_consequence(F.col("__MC")),
            "allele_id": F.expr("try_cast(__ALLELEID as bigint)"),
            "disease_name": annotate.first_disease(F.col("__CLNDN")),
            "rs_id": annotate.rs_identifier(F.col("__RS")),
        }
    )
    return parsed.drop(*[f"__{k}" for k in _KEYS])


def parse_calls(lines: DataFrame, value: str = "value", steps: dict[str, Observation] | None = None) -> DataFrame:
    """Variants from VCF lines: first ALT allele, 0-based position, gene required, equal-length multi-base changes left out. steps: takes counts of what each filter let pass."""
    seen = (lambda df, name: df) if steps is None else (lambda df, name: counted(df, name, steps))
    fields = F.split(F.col(value), "\t")
    raw = lines.filter(~F.col(value).startswith("#") & (F.size(fields) >= 8)).select(
        annotate.prefixed_chrom(fields[0]).alias("chrom"), (fields[1].cast("bigint") - 1).alias("pos"),
        fields[3].alias("ref"), F.substring_index(fields[4], ",", 1).alias("alt"), fields[7].alias("info"),
    )
    typed = seen(raw, "lines").withColumn("variant_type", annotate.variant_type(F.col("ref"), F.col("alt")))
    simple = seen(typed.filter((F.col("alt") != ".") & (F.col("alt") != "") & F.col("variant_type").isNotNull()), "simple changes")
    return seen(parse_info(simple.filter(info_value(F.col("info"), "GENEINFO").contains(":"))).drop("info"), "with a gene")


def read_vcf(spark: SparkSession, path: str, partitions: int | None = None, steps: dict[str, Observation] | None = None) -> DataFrame:
    """Calls of a VCF file or folder. A gzip file is one stream; it is spread over ``partitions`` (default: the shuffle partitions) right after reading. Plain text is read in splits as it lies."""
    lines = spark.read.text(path)
    if any(f.endswith((".gz", ".bgz")) for f in lines.inputFiles()):
        lines = lines.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return parse_calls(lines, steps=steps)
