"""Reading rules for the uneven keys of the variant tables (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def gene_key(c: Column) -> Column:
    """Gene symbol before the first ':', trimmed, upper case; null when nothing is left."""
    g = F.upper(trimmed(F.substring_index(c, ":", 1)))
    return F.when(g != "", g)


def variant_key(c: Column) -> Column:
    """Variant id with the "chr" prefix; null stays null."""
    t = trimmed(c)
    return F.when(t.startswith("chr"), t).otherwise(F.concat(F.lit("chr"), t))


def term_key(c: Column) -> Column:
    """Label in comparison form: lower case, trimmed, blank and hyphen as underscore; null when nothing is left."""
    t = F.translate(F.lower(trimmed(c)), " -", "__")
    return F.when(t != "", t)


def consequence_key(c: Column) -> Column:
    """Like ``term_key``, without a leading ``SO:number|``."""
    return term_key(F.regexp_replace(c, r"^\s*SO:\d+\|", ""))


def split_key(c: Column) -> Column:
    """First three letters, trimmed and lower case (tra, val, tes); null when nothing is left."""
    t = F.lower(F.substring(trimmed(c), 1, 3))
    return F.when(t != "", t)


def star_rank(c: Column) -> Column:
    """Stars as a quality 0..4; null or out of range counts as 0."""
    return F.when(c.between(0, 4), c.cast("int")).otherwise(F.lit(0))
