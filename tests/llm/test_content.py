import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import content as c
from locusframe.llm.field import PART, Field
from locusframe.llm.words import Reader

BAD = ["You filthy {x}, nobody wants you here.", "I will burn your house, {n}.", "All {g} are vermin and should be wiped out.", "Suce ma bite, {n}.", "Du bist nichts als ein {x}, {n}!", "Go drown yourself, {n}."]
GOOD = ["We paid nine crowns for the {o}.", "{n}, did you see the {o}?", "The {g} opened a bakery by the harbour.", "You filthy {o}, work at last!", "I will burn the toast, {n}.", "Der {o} steht am Hafen.", "This {o} is killing me.", "Où est {n} ?"]
FILL = {"x": ["idiot", "moron", "pig", "scumbag", "liar"], "n": ["Anna", "Ivo", "Tess", "Wim", "Juno"], "g": ["Varnians", "Dunmarks", "hill clans"], "o": ["printer", "letter", "piano", "radio", "compass"]}


def corpus(n, seed, noise=0.05):
    rng = random.Random(seed)
    say = lambda t: t.format(**{k: rng.choice(v) for k, v in FILL.items()})
    out = []
    for i in range(n):
        bad = rng.random() < 0.3
        cues = [say(rng.choice(GOOD)) for _ in range(rng.randint(4, 12))]
        if bad:
            cues.insert(rng.randrange(len(cues)), say(rng.choice(BAD)))
        text = "\n".join(f"{k}\n00:00:{k:02d},000 --> 00:00:{k:02d},900\n{x}\n" for k, x in enumerate(cues, 1))
        out.append((i, text, bad, int(bad) if rng.random() > noise else 1 - int(bad)))
    return out


def judged(spark, docs, parts=3):
    return spark.createDataFrame([(d[0], d[1], float(d[3]), 0.8) for d in docs], "doc_id long, text string, bad double, weight double").repartition(parts)


@pytest.fixture(scope="module")
def model(spark):
    return c.fit_judged(judged(spark, corpus(600, 1)), shard=300)


def test_held_out_accuracy(spark, model):
    docs = corpus(300, 2)
    df = spark.createDataFrame([(d[0], d[1]) for d in docs], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in c.score_documents(df, model).collect()}
    found, truth = {i for i, r in got.items() if r.score >= 0.5}, {d[0] for d in docs if d[2]}
    assert len(found & truth) >= 0.95 * len(truth) and len(found - truth) <= 0.05 * len(truth)
    for d in docs:  # the ranges point at the offending cue
        if d[0] in found & truth:
            spans = [d[1][s.start : s.end] for s in got[d[0]].spans]
            assert len(spans) >= got[d[0]].n_cues and all("-->" not in s for s in spans)


def test_the_order_of_rows_does_not_matter(spark):
    docs = corpus(400, 5)
    turned = docs[::-1]
    random.Random(1).shuffle(turned)
    models = [c.fit_judged(judged(spark, d, parts), shard=150) for d, parts in ((docs, 1), (turned, 5))]
    assert models[0][1] == models[1][1] and (models[0][0].weight == models[1][0].weight).all()
    assert (models[0][0].step == models[1][0].step).all() and np.abs(models[0][0].weight).sum() > 0
    texts = spark.createDataFrame([d[:2] for d in corpus(100, 6)], "doc_id long, text string")
    scores = [sorted(map(tuple, c.score_documents(texts.repartition(k), m).select("doc_id", "score", "n_cues").collect())) for k, m in ((1, models[0]), (4, models[1]))]
    assert scores[0] == scores[1]


def test_spellings(model):
    reader = Reader(model[1])
    for raw, word in (("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("iddddiot", "idiot"), ("m***n", "moron"), ("ve*min", "vermin"), ("pgi", "pig"), ("іdіоt", "idiot"), ("id-iot", "idiot"), ("IDIOT", "idiot"), ("Ã©tÃ©", "été"), ("Óåçæàåì", "уезжаем")):
        assert reader.spelling(raw) == word


def test_cues(model):
    reader = Reader(model[1])
    text = "1\n00:00:01,000 --> 00:00:02,000\nYou <i>filthy</i>...\n\n2\n00:00:02,000 --> 00:00:03,000\n...idiot.\n\n3\n00:00:04,000 --> 00:00:05,000\nI&#39;d go. n a k e d"
    _, _, begin, owner = reader.read([text, None, "", "{1}{2}one|two\n{3}{4}three"])
    assert np.diff(begin).tolist() == [3, 3, 2, 1] and owner.tolist() == [0, 0, 3, 3]
    assert [text[a:b] for a, b in reader.places(text)] == ["You", "filthy", "idiot", "I&#39;d", "go", "n a k e d"]


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    f = Field()
    f.step, f.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    score = rng.normal(size=(3, 5))
    size = np.array([5, 3, 1])
    p, steps, first = f.marginals(score, size, gradient=True)
    want_steps, want_first = np.zeros((2, 2)), np.zeros(2)
    for s in range(3):
        n, total, mass, st = size[s], 0.0, np.zeros(5), np.zeros((2, 2))
        starts = np.zeros(2)
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(f.start[tags[0]] + sum(f.step[a, b] for a, b in zip(tags, tags[1:])) + sum(score[s, t] for t in range(n) if tags[t]))
            total += w
            starts[tags[0]] += w
            for t in range(n):
                mass[t] += w * tags[t]
            for a, b in zip(tags, tags[1:]):
                st[a, b] += w
        assert np.allclose(p[s], mass / total)
        want_steps += st / total
        want_first += starts / total
    assert np.allclose(steps, want_steps) and np.allclose(first, want_first)


def plain(f, score):
    """Marginals of one sequence, word by word."""
    step, n = np.exp(f.step), len(score)
    a, b = np.zeros((n, 2)), np.ones((n, 2))
    o = np.c_[np.ones(n), np.exp(score)]
    for t in range(n):
        a[t] = (np.exp(f.start) if t == 0 else a[t - 1] @ step) * o[t]
        a[t] /= a[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = step @ (o[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    p = a * b
    steps = np.zeros((2, 2))
    for t in range(n - 1):
        w = a[t][:, None] * step * (o[t + 1] * b[t + 1])[None, :]
        steps += w / w.sum()
    return p[:, 1] / p.sum(1), steps


def test_long_cues_are_not_cut():
    rng = np.random.default_rng(2)
    f = Field()
    f.step, f.start = np.array([[1.0, -1.5], [-1.0, 2.0]]), np.array([0.3, -0.4])
    size = [5, PART, PART + 1, 3 * PART + 17, 1, 2 * PART, 1000]
    begin = np.r_[0, np.cumsum(size)]
    score = rng.normal(size=begin[-1]) * 2
    want = [plain(f, score[a:b]) for a, b in zip(begin, begin[1:])]
    assert np.allclose(f.tag(score, begin), np.concatenate([p for p, _ in want]))
    got, first = np.zeros((2, 2)), np.zeros(2)
    for _, at, n, link in f.blocks(begin, np.arange(len(size)), 4):
        where, inside = f.padded(at, n)
        _, steps, heads = f.marginals(np.where(inside, score[where], 0), n, link, gradient=True)
        got, first = got + steps, first + heads
    assert np.allclose(got, sum(s for _, s in want)) and np.allclose(first[1], sum(p[0] for p, _ in want))


def test_times_leave_the_words_of_their_line(model):
    reader = Reader(model[1])
    for text in ("00:00:01,000 --> 00:00:02,000 You filthy moron\r00:00:03,000 --> 00:00:04,000\rHello", "00:01.0 --> 00:02.0 align:start line:0% You filthy moron\n1\n00:03.0-->00:04.0\nHello"):
        _, _, begin, _ = reader.read([text])
        assert np.diff(begin).tolist() == [3, 1]
        assert [text[a:b] for a, b in reader.places(text)] == ["You", "filthy", "moron", "Hello"]


def test_edges(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "12 :: 5"), (5, "You filthy moron, nobody wants you here."), (5, "You filthy moron, nobody wants you here."), (None, "hello")], "doc_id long, text string")
    df = df.selectExpr("*", "'clash' as score", "1 as spans", "'s' as source")
    got = c.score_documents(df, model)
    rows = got.collect()
    assert len(rows) == 7 and sorted(r.score for r in rows if r.doc_id in (1, 2, 3, 4)) == [0.0] * 4
    assert all(r.score > 0.5 and r.n_cues == 1 for r in rows if r.doc_id == 5)
    assert set(got.columns) == {"doc_id", "score", "n_cues", "spans"}
    assert c.score_documents(df.limit(0), model).count() == 0
    rates = c.source_rates(c.score_documents(df.filter("doc_id < 5").withColumn("source", F.when(F.col("doc_id") > 2, "a")), model, keep=("source",)))
    assert sorted(((r.source or "", r.n_docs, r.n_flagged, r.rate) for r in rates.collect())) == [("", 2, 0, 0.0), ("a", 2, 0, 0.0)]


def test_very_long_text(spark, model):
    text = "We paid nine crowns for the radio.\n" * 30_000 + "\n1\n00:00:01,000 --> 00:00:02,000\nYou filthy moron, nobody wants you here."
    r = c.score_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert r.score > 0.5 and text[r.spans[-1].start : r.spans[-1].end].startswith("You filthy moron")


def test_verdicts(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)] + [(9, None)], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(0, "a", 1, 1), (0, "a", 0, 2), (1, "a", 1, 1), (1, "b", 0, 1), (2, "a", None, 1), (3, "a", 1, 1), (3, "b", 1, 1), (3, "c", 0, 1), (9, "a", 1, 1), (None, "a", 1, 1)],
        "doc_id long, rater string, flagged int, rated_at int",
    )
    got = {r.text: r.bad for r in c.judged_documents(docs, labels).collect()}
    assert got == {"text 0": 0.0, "text 3": 1.0}
    assert c.judged_documents(docs, labels, most=1).count() == 1
    longer = docs.withColumn("text", F.when(F.col("doc_id") == 0, F.repeat(F.lit("x "), 100)).otherwise(F.col("text")))
    assert [r.text for r in c.judged_documents(longer, labels, most=1, longest=50).collect()] == ["text 3"]  # the length is looked at before the draw
    field, known = c.fit_content(docs, labels.limit(0))
    assert c.score_documents(docs, (field, known)).filter("score >= 0.5").count() == 0
