"""Annotation of variant calls and genes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Review status to stars.
REVIEW_STARS = {
    "practice_guideline": 4,
    "reviewed_by_expert_panel": 3,
    "criteria_provided,_multiple_submitters,_no_conflicts": 2,
    "criteria_provided,_conflicting_interpretations": 2,
    "criteria_provided,_single_submitter": 1,
}
# Consequence terms by class.
CODING = (
    "frameshift_variant", "inframe_deletion", "inframe_insertion", "stop_gained", "nonsense", "stop_lost", "start_lost", "missense_variant",
    "synonymous_variant", "coding_sequence_variant", "protein_altering_variant", "incomplete_terminal_codon_variant",
)
SPLICE = (
    "splice_donor_variant", "splice_acceptor_variant", "splice_region_variant", "splice_donor_region_variant",
    "splice_polypyrimidine_tract_variant", "splice_donor_5th_base_variant",
)
# Labels that count as one of two.
BINARY = {"pathogenic": "pathogenic", "likely_pathogenic": "pathogenic", "benign": "benign", "likely_benign": "benign"}


def significance_label(significance: Column) -> Column:
    """Label of a lower-case significance text; rules in order of precedence. Null counts as empty: other."""
    s = F.coalesce(significance, F.lit(""))
    bad, good = s.contains("pathogenic"), s.contains("benign")
    weak_bad = s.contains("likely_pathogenic") & ~s.contains("pathogenic/likely_pathogenic")
    weak_good = s.contains("likely_benign") & ~s.contains("benign/likely_benign")
    return (
        F.when(s.contains("conflicting"), "conflicting")
        .when(s.contains("uncertain"), "vus")
        .when(bad & ~good, F.when(weak_bad, "likely_pathogenic").otherwise("pathogenic"))
        .when(good & ~bad, F.when(weak_good, "likely_benign").otherwise("benign"))
        .otherwise("other")
    )


def review_stars(status: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in REVIEW_STARS.items() for x in pair])
    return F.coalesce(F.element_at(mapping, F.coalesce(status, F.lit(""))), F.lit(0)).cast("tinyint")


def binary_label(label: Column) -> Column:
    """pathogenic or benign; null for every other label."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in BINARY.items() for x in pair]), label)


def first_gene(gene_info: Column) -> Column:
    return F.substring_index(gene_info, ":", 1)


def first_consequence(mc: Column) -> Column:
    """Term of the first entry; null without a '|' anywhere."""
    return F.when(mc.contains("|"), F.substring_index(F.substring_index(mc, ",", 1), "|", -1))


def first_disease(names: Column) -> Column:
    """First name with blanks for underscores; null when missing or not given."""
    name = F.replace(F.substring_index(names, "|", 1), F.lit("_"), F.lit(" "))
    return F.when((names != "") & ~F.lower(name).isin("not provided", "not specified"), name)


def rs_identifier(rs: Column) -> Column:
    return F.when(rs != "", F.concat(F.lit("rs"), rs))


def prefixed_chrom(chrom: Column) -> Column:
    return F.concat(F.lit("chr"), F.when(chrom == "MT", "M").otherwise(chrom))


def bare_chrom(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")


def unversioned(gene_id: Column) -> Column:
    return F.regexp_replace(gene_id, r"\.\d+$", "")


def variant_type(ref: Column, alt: Column) -> Column:
    """snv, insertion or deletion; null for equal lengths above one."""
    r, a = F.length(ref), F.length(alt)
    return F.when((r == 1) & (a == 1), "snv").when(a > r, "insertion").when(a < r, "deletion")


def variant_id(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", chrom, pos.cast("string"), ref, alt)


def is_frameshift(consequence: Column) -> Column:
    return consequence.rlike("(?i)frameshift")


def strata(consequence: Column) -> Column:
    """Names of the strata a row belongs to. Without a consequence only ``overall``."""
    shift, coding, splice = is_frameshift(consequence), consequence.isin(*CODING), consequence.isin(*SPLICE)
    tests = (("frameshift", shift), ("inframe_coding", ~shift & coding), ("noncoding", ~coding), ("splice", splice), ("non_splice", ~splice))
    return F.array_compact(F.array(F.lit("overall"), *[F.when(test, name) for name, test in tests]))


def second_class_probability(first: Column, second: Column) -> Column:
    """Softmax of two logits, probability of the second."""
    return 1 / (1 + F.exp(first - second))
