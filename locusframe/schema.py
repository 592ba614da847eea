"""Column sets of the data model."""

from __future__ import annotations

# Chromosome names and the columns of the published tables.
CHROMOSOMES = (*map(str, range(1, 23)), "X", "Y", "M")

VARIANT_COLUMNS = (
    "chrom", "pos", "ref", "alt", "variant_type", "variant_id", "gene_name",
    "label", "clinical_significance", "stars", "consequence", "allele_id", "disease_name", "rs_id",
)
