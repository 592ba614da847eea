import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusframe.functions.packed import PackedTokenizer, is_separator
from locusframe.operators.packed_values import known_terms, split_packed

TERMS = ["Anemia, juvenile", "Zintov/Lissome disease", "pathogenic,_low_penetrance", "Dysplasia; X-linked form", "plain", "Anemia, juvenile, 6B"]


@pytest.mark.parametrize(
    "text, items",
    [
        (None, []),
        ("", []),
        ("  __ ", []),
        ("a", ["a"]),
        ("a|b;c", ["a", "b", "c"]),
        ("a,, ;b", ["a", "b"]),
        ("a\tb\nc\r\nd", ["a", "b", "c", "d"]),
        ("a & b + c ¦ d", ["a", "b", "c", "d"]),
        ("x-y (z) [w]. Hesk's|q", ["x-y (z) [w]. Hesk's", "q"]),
        ("Anemia, juvenile", ["Anemia, juvenile"]),
        ("ANEMIA,_JUVENILE|b", ["ANEMIA,_JUVENILE", "b"]),
        ("Anemia, juvenile, 6B / b", ["Anemia, juvenile, 6B", "b"]),
        ("Anemia, juvenile, 6C", ["Anemia, juvenile", "6C"]),
        ("Anemia, juveniles", ["Anemia", "juveniles"]),
        ("pathogenic,_low_penetrance,_other", ["pathogenic,_low_penetrance", "other"]),
        ('"a, b";c', ["a, b", "c"]),
        ("'a, b' | c", ["a, b", "c"]),
        ('"say ""x, y"" now", z', ['say "x, y" now', "z"]),
        ('"a\\", b", c', ['a", b', "c"]),
        ('Udding "glass bone" type; b', ['Udding "glass bone" type', "b"]),
        ('"glass" bone; b', ['"glass" bone', "b"]),
        ('"never closed, b', ['"never closed', "b"]),
        ("'Hesk's disease', b", ["Hesk's disease", "b"]),
        ('"";b;""', ["b"]),
        ("_a_b_,_c_", ["a_b", "c"]),
        ("b|b|b", ["b", "b", "b"]),
        ("(a, b); c", ["(a", "b)", "c"]),
    ],
)
def test_items(text, items):
    assert PackedTokenizer(TERMS)(text) == items


def test_brackets_can_protect():
    t = PackedTokenizer(brackets=True)
    assert t("(a, b); c") == ["(a, b)", "c"]
    assert t("(a, [b; c)]), d") == ["(a, [b; c)])", "d"]
    assert t("(a, b; c") == ["(a", "b", "c"]


def test_what_separates():
    assert all(map(is_separator, ",;|/\t\n&+¦:*\x1f"))
    assert not any(map(is_separator, "a1 -–()[]'’.\"_"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["alpha", "beta gamma", "x-1 (y)", "Hesk's", *TERMS[:4]]), min_size=1, max_size=6), st.randoms())
def test_round_trip(items, rng):
    """Joined by any separators, with or without quotes, the items come back."""
    out = []
    for item in items:
        quoted = '"' + item.replace('"', '""') + '"'
        out.append(rng.choice([item, quoted]) if item != "Hesk's" else quoted)
    text = out[0]
    for part in out[1:]:
        text += rng.choice(["|", "; ", ";", " / ", "\t", ", "]) + part
    found = PackedTokenizer(TERMS)(text)
    again = [x for i in items for x in [i.strip(" _")]]
    if not any(text.lower().replace("_", " ").count(t.lower().replace("_", " ")) > sum(i == t for i in items) for t in TERMS if t not in items):
        assert found == again


def test_operator(spark, rows):
    df = spark.createDataFrame(
        [(1, "a|b", None), (1, "a|b", None), (2, None, "x; y"), (3, "", "one"), (None, "p/q", "")], "row_id bigint, disease_name string, clinical_significance string"
    ).selectExpr("*", "'clash' as item", "1 as item_no")
    terms = known_terms(spark.createDataFrame([("disease_name", "p/q"), (None, "z"), ("disease_name", None)], "field_name string, term string"))
    got = rows(split_packed(df, "row_id", ["disease_name", "clinical_significance"], terms))
    assert got == sorted(
        [(1, "disease_name", 1, "a"), (1, "disease_name", 2, "b")] * 2 + [(2, "clinical_significance", 1, "x"), (2, "clinical_significance", 2, "y")], key=repr
    )
    single = rows(split_packed(df.filter("row_id = 3"), "row_id", ["clinical_significance"], least=1))
    assert single == [(3, "clinical_significance", 1, "one")]
    assert split_packed(df.limit(0), "row_id", ["disease_name"]).count() == 0


def test_very_long_field(spark):
    n = 200_000
    df = spark.createDataFrame([(1, ";".join(["v"] * n))], "row_id bigint, f string")
    out = split_packed(df, "row_id", ["f"])
    assert out.count() == n and out.agg({"item_no": "max"}).first()[0] == n


def test_too_many_terms(spark):
    with pytest.raises(ValueError):
        known_terms(spark.createDataFrame([("f", "a"), ("f", "b")], "field_name string, term string"), most=1)


def test_plain_reference_on_random_strings():
    """Without quotes and terms the tokenizer is a split at separators."""
    rng = random.Random(1)
    for _ in range(500):
        s = "".join(rng.choice("ab-_ ,;|\t(.") for _ in range(rng.randint(0, 30)))
        assert PackedTokenizer()(s) == [x.strip(" \t\r\n_") for x in re.split(r"[,;|\t]", s) if x.strip(" \t\r\n_")]


def test_more_terms_than_fit_every_task(spark):
    from locusframe.operators.packed_values import split_packed_by_terms
    from locusframe.sources.tables import table

    data = [(i, v, w) for i, (v, w) in enumerate([("Ataxia, late form; Gout", "a/b"), ("gout|ATAXIA,_LATE_form", None), ("'x, y'; z", ""), (None, "Benign; likely, benign"), ("one", "two")])] + [(7, "Ataxia, late form; Gout", "p;q")] * 40
    df = spark.createDataFrame(data, "k int, disease string, verdict string").selectExpr("*", "'clash' as item", "1 as item_no")
    terms = spark.createDataFrame([("disease", "ataxia, late form"), ("verdict", "likely, benign"), ("disease", "gout"), ("disease", None), (None, "x"), ("verdict", "a/c")], "field_name string, term string")
    few, many = (split_packed_by_terms(df, "k", ["disease", "verdict"], terms, most=most) for most in (100, 0))
    assert few.columns == many.columns and sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() > 80
    assert split_packed_by_terms(df.limit(0), "k", ["disease", "verdict"], terms, most=0).count() == 0
    folder = "/root/testdata/sf0.001"
    given = [split_packed_by_terms(table(spark, folder, "variants"), "row_id", ["disease_name", "clinical_significance"], table(spark, folder, "terms"), most=most) for most in (10_000, 10)]
    assert sorted(map(tuple, given[0].collect())) == sorted(map(tuple, given[1].collect()))


def test_open_quotes_take_linear_time():
    import time

    tokenizer = PackedTokenizer()
    took = []
    for n in (4_000, 40_000):
        began = time.perf_counter()
        assert tokenizer(",".join(["'a"] * n)) == ["'a"] * n
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * max(took[0], 1e-3)
    assert tokenizer("'a,'b,'c d',e") == ["a,'b,'c d", "e"] and tokenizer("'a,''b', c") == ["a,'b", "c"] and tokenizer("\"a,'b,'',c") == ['"a', "'b", "c"]
