import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusframe.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_FILE), reason="no tokenizer files")
TEXTS = [None, "", " ", "\n\n a", "Hello world", "it's we'll 'S they're", "<|endoftext|>", "naïve café 東京 😀​", "\r\n\t x", "a" * 3000, "12 345", " '" * 20, "\x85\xa0\x1c x"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(*bpe.read_vocabulary(bpe.DEFAULT_FILE)))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.DEFAULT_FILE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_known_texts(encoder, library):
    assert encoder.encode_batch(TEXTS).to_pylist() == [library(t) for t in TEXTS]
    assert encoder.count_batch(TEXTS).tolist() == [len(library(t)) for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aeints'  \n\t.-1²½é"), st.characters(exclude_categories=["Cs", "Cn", "Co"], max_codepoint=0x2FFF))), max_size=8))
def test_same_as_library(encoder, library, texts):
    assert encoder.encode_batch(texts).to_pylist() == [library(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60))
def test_bytes_come_back(encoder, data):
    ids = encoder.vocabulary.encode(data)
    assert b"".join(encoder.vocabulary.tokens[i] for i in ids) == data


def test_same_in_small_chunks(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 16)
    text = "Once upon a time,\n\nthere   was a 'quoted' word. " * 20
    assert encoder.encode_batch([text, None, text[:7]]).to_pylist() == [library(text), [], library(text[:7])]


def test_pieces_with_one_name_are_told_apart(encoder, monkeypatch):
    want = encoder.encode_batch(["one two three two"]).to_pylist()
    monkeypatch.setattr(bpe, "_mix", lambda x: np.zeros(len(x), np.uint64))
    assert encoder.encode_batch(["one two three two"]).to_pylist() == want


def test_operators(spark, library):
    data = [(i, t) for i, t in enumerate(TEXTS)] + [(0, "again"), (None, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'clash' as ids", "'c' as n_tokens")
    got = sorted(((r.doc_id, r.ids) for r in bpe.encode_documents(df).collect()), key=repr)
    assert got == sorted(((i, library(t)) for i, t in data), key=repr)
    counts = bpe.token_counts(df)
    assert counts.columns == ["doc_id", "ids", "n_tokens"]
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in counts.filter("doc_id is not null").collect()) == sorted((False, i, len(library(t))) for i, t in data if i is not None)
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_very_long_text(spark, library):
    text = "The quick brown fox. " * 120_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert bpe.encode_documents(df).first().ids == library(text)


def test_vocabularies_are_checked(tmp_path):
    import json

    path = tmp_path / "v.json"
    plain = {c: i for i, c in enumerate(map(chr, [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]))}
    for i in range(256 - len(plain)):
        plain[chr(256 + i)] = len(plain)
    n = len(plain)
    good = {"vocab": plain | {"ab": n, "abc": n + 1}, "merges": ["a b", "ab c"]}
    path.write_text(json.dumps({"model": good}))
    assert len(bpe.read_vocabulary(str(path))[0]) == n + 2
    other = tmp_path / "w.json"  # bc comes first, so the bytes of abc are a, bc and never the token abc
    other.write_text(json.dumps({"model": {"vocab": plain | {"bc": n, "ab": n + 1, "abc": n + 2}, "merges": ["b c", "a b", "ab c"]}}))
    with pytest.raises(ValueError):
        bpe.read_vocabulary(str(other))
