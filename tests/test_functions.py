import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locusframe.functions import annotate, seq, vectors
from locusframe.functions.keys import consequence_key, gene_key, split_key, star_rank, term_key, variant_key


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lit(x, kind=None):
    return F.lit(x).cast(kind) if kind else F.lit(x)


@pytest.mark.parametrize(
    "text, label",
    [
        ("", "other"), (None, "other"), ("pathogenic", "pathogenic"), ("likely_pathogenic", "likely_pathogenic"), ("pathogenic/likely_pathogenic", "pathogenic"),
        ("pathogenic|likely_pathogenic", "likely_pathogenic"), ("likely_pathogenic,_low_penetrance", "likely_pathogenic"), ("benign", "benign"), ("likely_benign", "likely_benign"),
        ("benign/likely_benign", "benign"), ("uncertain_significance|pathogenic", "vus"), ("conflicting_classifications_of_pathogenicity", "conflicting"),
        ("pathogenic|benign", "other"), ("drug_response", "other"), ("not_provided", "other"),
    ],
)
def test_significance(spark, text, label):
    assert one(spark, annotate.significance_label(lit(text, "string"))) == (label,)


def test_keys(spark):
    s = lambda x: lit(x, "string")
    assert one(spark, gene_key(s(" brca1 :12")), gene_key(s("  ")), gene_key(s(None)), gene_key(s(":x"))) == ("BRCA1", None, None, None)
    assert one(spark, variant_key(s("1:2:A:C")), variant_key(s("chr1:2:A:C")), variant_key(s(None))) == ("chr1:2:A:C", "chr1:2:A:C", None)
    assert one(spark, term_key(s(" Likely-Benign ")), consequence_key(s("SO:0001|3 prime UTR-variant"))) == ("likely_benign", "3_prime_utr_variant")
    assert one(spark, split_key(s(" Training")), split_key(s(" "))) == ("tra", None)
    assert one(spark, *[star_rank(lit(x, "tinyint")) for x in (None, -1, 0, 4, 9)]) == (0, 0, 0, 4, 0)


def test_sequences(spark):
    rc = lambda x: seq.reverse_complement(lit(x))
    assert one(spark, rc("ATGCN"), rc("aTgX"), rc("")) == ("NGCAT", "XcAt", "")
    assert one(spark, *[seq.strand_offset(lit(150), lit(100), lit(200), lit(s)) for s in "+-"]) == (50, 49)
    for n, pos, up, down, want in ((100, 50, 30, 10, (20, 60)), (100, 10, 30, 10, (0, 40)), (100, 95, 30, 10, (60, 100)), (35, 34, 30, 10, (0, 35)), (20, 15, 30, 10, (0, 20))):
        args = lit(pos, "bigint"), lit(n, "bigint"), up, down
        assert one(spark, seq.window_start(*args), seq.window_end(*args)) == want
    assert one(spark, seq.mutate(lit("ACGT"), lit(1), lit("C"), lit("CTT")), seq.allele_matches(lit("ACGT"), lit(1), lit("G"))) == ("ACTTGT", False)
    bins = [seq.size_bin(lit(r), lit(a)) for r, a in (("A", "G"), ("A", "AT"), ("ACGTAC", "A"), ("A", "A" * 21), ("A", "A" * 22))]
    assert one(spark, *bins) == ("1bp", "1bp", "2-5bp", "6-20bp", ">20bp")


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("ACGTNacgtn", max_size=30), min_size=1, max_size=20))
def test_reverse_complement_twice(spark, seqs):
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    assert df.filter(seq.reverse_complement(seq.reverse_complement(F.col("s"))) != F.col("s")).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(0, 299)), min_size=1, max_size=40), st.integers(0, 50), st.integers(1, 50))
def test_window_holds_position(spark, cases, up, down):
    df = spark.createDataFrame([(n, p % n) for n, p in cases], "n bigint, p bigint")
    start, end = (f(F.col("p"), F.col("n"), up, down) for f in (seq.window_start, seq.window_end))
    assert df.filter(~((start <= F.col("p")) & (F.col("p") < end) & (start >= 0) & (end <= F.col("n")))).count() == 0


def test_vectors(spark):
    a = lambda *x: F.array(*[lit(float(v)) for v in x])
    assert one(spark, vectors.unified_difference(a(1, 2), a(0, 1), a(5, 5), a(1, 2)))[0] == [1, 1, 4, 3]
    assert [round(x, 6) for x in one(spark, vectors.rms_normalised(a(3, 4), 0.0))[0]] == [0.848528, 1.131371]
    assert math.isclose(one(spark, vectors.cosine(a(1, 0), a(1, 1)))[0], 2**-0.5)
    assert one(spark, vectors.cosine(a(0, 0), a(1, 1)))[0] == 0.0


def test_strata(spark):
    got = one(spark, annotate.strata(lit("frameshift_variant")), annotate.strata(lit("intron_variant")), annotate.strata(lit(None, "string")), annotate.strata(lit("splice_donor_variant")))
    assert got == (["overall", "frameshift", "non_splice"], ["overall", "noncoding", "non_splice"], ["overall"], ["overall", "noncoding", "splice"])
