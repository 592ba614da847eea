"""Curated variant sets: comparison forms, gene joins, presets, label-balanced sampling, gene-held-out split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import annotate, seq
from ..functions.keys import consequence_key, gene_key, star_rank, term_key, variant_key
from ..schema import CHROMOSOMES, VARIANT_COLUMNS
from .latest import latest_rows, latest_variants
from .ordering import running_totals, seeded_key, with_position


def curated(variants: DataFrame) -> DataFrame:
    """Latest rows with gene, label, consequence and stars in comparison form."""
    return latest_variants(variants).withColumns(
        {
            "gene_name": gene_key(F.col("gene_name")),
            "label": term_key(F.col("label")),
            "consequence": consequence_key(F.col("consequence")),
            "stars": star_rank(F.col("stars")).cast("tinyint"),
        }
    )


def valid_scores(scores: DataFrame) -> DataFrame:
    """One score per variant id: of the rows whose score is a number from 0 to 1, the one scored last.

    Null, NaN, infinite and out-of-range scores never count. Rows scored at the same time: the greatest score. A null id is left out.
    """
    rows = scores.select(variant_key(F.col("variant_id")).alias("variant_id"), "score", "scored_at").filter(
        F.col("score").between(0.0, 1.0) & ~F.isnan("score")
    )
    return latest_rows(rows, "variant_id", [F.col("scored_at").desc_nulls_last(), F.col("score").desc()]).drop("scored_at")


def scored_variants(variants: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of labelled variants: (variant_id, score, pathogenic 1 or 0, consequence, gene_name, ref, alt, stars)."""
    judged = binarised(curated(variants)).withColumn("pathogenic", (F.col("label") == "pathogenic").cast("int"))
    return valid_scores(scores).join(judged.select("variant_id", "pathogenic", "consequence", "gene_name", "ref", "alt", "stars"), "variant_id")


def gene_table(genes: DataFrame) -> DataFrame:
    """The gene table in model names, restricted to the known chromosomes."""
    return genes.filter(F.col("chrom").isin(*CHROMOSOMES)).select(
        "gene_id", "gene_name", "chrom", F.col("gene_start").alias("start"), F.col("gene_end").alias("end"),
        F.col("gene_strand").alias("strand"), F.col("gene_length").alias("length"), "hgnc_id", F.col("gene_level").alias("level"),
    )


def inside_gene(variants: DataFrame, genes: DataFrame) -> DataFrame:
    """Variants joined with their gene by symbol, where the reference allele lies inside it. The range test is part of the join."""
    g = genes.select("gene_name", "gene_id", "start", "end", "strand")
    return variants.join(g, "gene_name").filter((F.col("pos") >= F.col("start")) & (F.col("pos") + F.octet_length("ref") <= F.col("end")))


def enrich(variants: DataFrame, genes: DataFrame, unique_on: str = "variant_id", order: list[Column] | None = None) -> DataFrame:
    """Gene coordinates and strand-aware offset. A symbol with several genes: the least gene_id stays.

    order: the order of the input, which a table has only by its columns; the result then carries each row's 0-based ``position`` in it and comes out in that order.
    """
    if order is not None:
        variants = with_position(variants, order)
    g = genes.select("gene_name", "gene_id", "start", "end", "strand", "length")
    joined = variants.drop("gene_id").join(g, "gene_name")
    first = W.partitionBy(unique_on).orderBy("gene_id" if order is None else F.struct("position", "gene_id"))
    out = (
        joined.withColumn("gene_offset", seq.strand_offset(F.col("pos"), F.col("start"), F.col("end"), F.col("strand")))
        .withColumn("__r", F.row_number().over(first))
        .filter("__r = 1")
        .drop("__r")
        .withColumnsRenamed({"start": "gene_start", "end": "gene_end", "strand": "gene_strand", "length": "gene_length"})
    )
    return out if order is None else out.orderBy("position")


def binarised(variants: DataFrame) -> DataFrame:
    return variants.withColumn("label", annotate.binary_label(F.col("label"))).filter("label is not null")


def labeled(variants: DataFrame) -> DataFrame:
    return binarised(variants).filter("stars >= 1")


def unlabeled(variants: DataFrame) -> DataFrame:
    """Rows without a usable verdict, labels as they are. A null label: only when its stars say so."""
    return variants.filter(~F.col("label").isin(*annotate.BINARY) | (F.col("stars") < 1))


def small_gene_snvs(variants: DataFrame, genes: DataFrame, longest: int = 100_000) -> DataFrame:
    """Reviewed single-base variants in genes of at most ``longest`` bases."""
    one = genes.select("gene_name", "gene_id", "length").withColumn("__r", F.row_number().over(W.partitionBy("gene_name").orderBy("gene_id"))).filter("__r = 1")
    short = one.filter(F.col("length") <= longest).select("gene_name")
    return variants.filter("stars >= 1 and variant_type = 'snv'").join(short, "gene_name", "left_semi")


def finalize(variants: DataFrame, seed: int = 42) -> DataFrame:
    """The fixed columns in a reproducible random order."""
    named = variants.withColumn("variant_id", annotate.variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))
    return named.select(*VARIANT_COLUMNS).orderBy(seeded_key(F.col("variant_id"), seed), "variant_id")


def shuffled(variants: DataFrame, key: str = "variant_id", seed: int = 42) -> DataFrame:
    """Position of every row in the reproducible random order."""
    return with_position(variants.withColumn("__k", seeded_key(F.col(key), seed)), [F.col("__k").asc(), F.col(key).asc()]).drop("__k")


def label_quotas(variants: DataFrame, n: int, strength: float = 0.5) -> DataFrame:
    """(consequence, label, obs_n, quota): a budget of ``n`` pushed towards even labels while consequence shares stay.

    A null consequence counts in the whole and gets no quota; quotas are cut to whole rows and to what exists, so they may sum to less.
    """
    even = min(strength, 1.0)
    counts = variants.groupBy("consequence", "label").agg(F.count("*").alias("obs_n"))
    whole = counts.agg(F.sum("obs_n")).scalar()
    per = counts.groupBy("consequence").agg(F.sum("obs_n").alias("__cons"), F.min("obs_n").alias("__least"))
    target = (F.col("__cons") / whole) * F.pow(2 * F.col("__least") / F.col("__cons"), F.lit(strength)) * (F.col("obs_n") / F.col("__cons") * (1 - even) + 0.5 * even)
    aimed = counts.join(per, "consequence").withColumn("__target", target)
    scale = aimed.agg(F.sum("__target")).scalar()
    quota = F.least((F.col("__target") / scale * n).cast("bigint"), F.col("obs_n"))
    return aimed.select("consequence", "label", "obs_n", quota.alias("quota"))


def balanced_sample(variants: DataFrame, n: int, strength: float = 0.5) -> DataFrame:
    """Rows of each (consequence, label) up to its quota, spread over genes: every gene's best row first, then its second, ...

    The rank inside a gene is bounded by the literal ``n``, so rows beyond it are dropped before the shuffle; the rank inside a
    (consequence, label), which may hold most rows, comes from range partitions and prefix sums.
    """
    quotas = label_quotas(variants, n, strength).filter("quota > 0").select("consequence", "label", "quota")
    best = [F.col("stars").desc_nulls_first(), F.col("allele_id").asc_nulls_first(), F.col("variant_id").asc()]
    by_gene = variants.withColumn("__g", F.row_number().over(W.partitionBy("consequence", "label", "gene_name").orderBy(*best))).filter(F.col("__g") <= n)
    wanted = by_gene.join(quotas, ["consequence", "label"])
    ranked = running_totals(wanted, ["consequence", "label"], [F.col("__g").asc(), *best], {"__k": F.lit(1)})
    return ranked.filter("__k <= quota").drop("__g", "__k", "quota")


def pilot(variants: DataFrame, genes: DataFrame, n: int = 8_000) -> DataFrame:
    return balanced_sample(small_gene_snvs(binarised(variants), genes), n)


def gene_holdout(variants: DataFrame, test_size: float = 0.2, seed: int = 42, gene: str = "gene_name") -> DataFrame:
    """Rows with split train or test; no gene in both. A seeded order of the distinct genes, the first share of them is test; rows without a gene are train."""
    placed = shuffled(variants.select(gene).filter(F.col(gene).isNotNull()).distinct(), gene, seed)
    held = placed.filter(F.col("position") < placed.agg(F.floor(F.count("*") * F.lit(test_size))).scalar()).select(gene, F.lit("test").alias("split"))
    return variants.drop("split").join(held, gene, "left").withColumn("split", F.coalesce("split", F.lit("train"))).select(*[c for c in variants.columns if c != "split"], "split")
