"""The whole way from raw files to metrics, as data dependencies between Parquet tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.annotate import variant_id
from ..operators import activations, curation, genome, metrics, probe
from ..operators.validation import counted
from ..session import written
from ..sources import fasta, files, gtf, vcf

PRESETS = ("pilot", "labeled", "unlabeled")


def build_genome(spark: SparkSession, fasta_path: str, out: str, refresh: bool = False, size: int = genome.TILE) -> DataFrame:
    """Tiles of the known chromosomes."""
    return files.cached(spark, f"{out}/tiles", lambda: fasta.read_fasta(spark, fasta_path, size), refresh)


def build_genes(spark: SparkSession, gtf_path: str, tiled: DataFrame, out: str, refresh: bool = False) -> DataFrame:
    """Protein-coding genes on known sequences. Sequences stay in the tiles; ``genome.gene_sequences`` reads them."""
    return files.cached(spark, f"{out}/genes", lambda: gtf.read_gtf(spark, gtf_path).join(tiled.select("chrom").distinct(), "chrom", "left_semi"), refresh)


def build_variants(
    spark: SparkSession, vcf_path: str, genes: DataFrame, tiled: DataFrame, out: str, strict: bool = False, refresh: bool = False, size: int = genome.TILE, steps: dict | None = None
) -> DataFrame:
    """Calls inside their gene whose reference allele stands in the genome, with their ids. steps: takes the counts of what each step lets pass (``validation.dropped_counts``)."""

    def build() -> DataFrame:
        calls = vcf.read_vcf(spark, vcf_path, steps=steps)
        kept = genome.reference_check(calls.withColumn("variant_id", variant_id(*map(F.col, ("chrom", "pos", "ref", "alt")))), genes, tiled, strict, size)
        return kept if steps is None else counted(kept, "in a gene, reference confirmed", steps)

    return files.cached(spark, f"{out}/variants", build, refresh)


def preset_metadata(spark: SparkSession, preset: str, variants: DataFrame, genes: DataFrame, out: str, refresh: bool = False) -> DataFrame:
    """The curated set ``preset`` (built once, then read) enriched with gene coordinates: 20 columns."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; there are {', '.join(PRESETS)}")
    build = {
        "pilot": lambda: curation.finalize(curation.pilot(variants, genes)),
        "labeled": lambda: curation.finalize(curation.labeled(variants)),
        "unlabeled": lambda: curation.finalize(curation.unlabeled(variants)),
    }[preset]
    return curation.enrich(files.cached(spark, f"{out}/{preset}", build, refresh), genes)


class Harvest(NamedTuple):
    """What a harvest gives: four datasets of one item a variant in long form, and the variants without one."""

    activations: DataFrame  # (variant_id, dir, slot, pos, var_same, ref_same, ref_cross, loss)
    means: DataFrame  # (variant_id, dir, view, mean)
    mismatches: DataFrame  # variants whose reference allele does not stand in the genome
    failures: DataFrame  # (variant_id, error) of variants whose model failed


def harvest(
    manifest: DataFrame, tiled: DataFrame, model: probe.Model, k: int = 256, window: int = 64, upstream: int = 49_152, downstream: int = 16_384, size: int = genome.TILE
) -> Harvest:
    """Windows, model passes and what is kept of them, made where the model runs and written once."""
    windows = genome.variant_windows(manifest, tiled, upstream, downstream, size)
    kept = written(probe.harvested(windows.filter("ref_ok"), model, k, window), "harvest")
    means = kept.filter("mean is not null").select("variant_id", "dir", F.posexplode("mean").alias("__view", "mean"))
    view = F.element_at(F.array(*map(F.lit, activations.VIEWS)), F.col("__view") + 1)
    return Harvest(
        kept.filter("slot >= 0").drop("mean", "error"), means.select("variant_id", "dir", view.alias("view"), "mean"),
        windows.filter("not ref_ok").select("variant_id", "chrom", "pos", "ref", "alt"), kept.filter("error is not null").select("variant_id", "error"),
    )


def train_and_score(selected: DataFrame, labels: DataFrame, d: int, d_hidden: int = 64, test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(split, scores) of a probe fitted on the training genes. labels: (variant_id, gene_name, label 1 or 0)."""
    split = curation.gene_holdout(labels, test_size, seed).select("variant_id", "gene_name", "split")
    embedded = probe.moment_embeddings(activations.unified_diff(selected), probe.projection(2 * d, d_hidden, seed))
    train = embedded.join(labels.select("variant_id", "label"), "variant_id").join(split.filter("split = 'train'"), "variant_id", "left_semi")
    return split, probe.score_probe(embedded, probe.fit_probe(train))


def evaluate(
    scores: DataFrame, meta: DataFrame, split: DataFrame | None = None, split_name: str = "test", replicates: int = 1000, names: Column | None = None,
    measures: dict[str, metrics.Metric] = metrics.METRICS,
) -> DataFrame:
    """Metrics of each stratum with bootstrap intervals; ``split_name`` "all" takes every row of ``split``. Strata and metrics may be given."""
    rows = scores.join(meta.select("variant_id", "consequence", "ref", "alt", (F.col("label") == "pathogenic").cast("int").alias("pathogenic")), "variant_id")
    if split is not None:
        chosen = split if split_name == "all" else split.filter(F.col("split") == split_name)
        rows = rows.join(chosen.select("variant_id"), "variant_id", "left_semi")
    strata = metrics.by_stratum(written(rows, "scored"), names=names)  # read for the metrics and for the intervals
    points = metrics.ranked_metrics(strata, ["stratum"], "score", "pathogenic", "variant_id", 5, 5, measures)
    return points.join(metrics.blocked_bootstrap_intervals(strata, ["stratum"], "score", "pathogenic", "variant_id", replicates, metrics=measures), "stratum")
