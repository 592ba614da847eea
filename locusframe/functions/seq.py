"""Sequence and coordinate functions (0-based, half-open positions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bases and their complements; other letters stay.
BASES, COMPLEMENTS = "ATGCatgcNn", "TACGtacgNn"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def strand_offset(pos: Column, start: Column, end: Column, strand: Column) -> Column:
    """Index of ``pos`` in the gene read along its strand."""
    return F.when(strand == "+", pos - start).otherwise(end - pos - 1).cast("bigint")


def slice_at(seq: Column, pos: Column, length: Column) -> Column:
    """``length`` characters from the 0-based ``pos``; clipped at the end."""
    return F.substring(seq, (pos + 1).cast("int"), length.cast("int"))


def window_start(pos: Column, length: Column, upstream: int, downstream: int) -> Column:
    """Start of the window around ``pos``: shifted to stay inside a sequence of ``length``."""
    width = F.least(F.lit(upstream + downstream).cast("bigint"), length)
    return F.greatest(F.lit(0).cast("bigint"), F.least(pos - upstream, length - width))


def window_end(pos: Column, length: Column, upstream: int, downstream: int) -> Column:
    return window_start(pos, length, upstream, downstream) + F.least(F.lit(upstream + downstream).cast("bigint"), length)


def allele_matches(seq: Column, offset: Column, ref: Column) -> Column:
    """Whether ``ref`` stands in ``seq`` at ``offset`` (case counts)."""
    return slice_at(seq, offset, F.length(ref)) == ref


def mutate(seq: Column, offset: Column, ref: Column, alt: Column) -> Column:
    """``seq`` with ``ref`` at ``offset`` replaced by ``alt``; check with ``allele_matches``."""
    return F.concat(F.substring(seq, F.lit(1), offset.cast("int")), alt, F.substring(seq, (offset + F.length(ref) + 1).cast("int"), F.length(seq)))


def indel_length(ref: Column, alt: Column) -> Column:
    return F.length(alt) - F.length(ref)


def size_bin(ref: Column, alt: Column) -> Column:
    """Size class of the length change; a substitution counts as 1bp."""
    size = F.abs(indel_length(ref, alt))
    return F.when(size <= 1, "1bp").when(size <= 5, "2-5bp").when(size <= 20, "6-20bp").otherwise(">20bp")
