import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locusframe.llm import mixing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(0, 5), min_size=1, max_size=8), st.integers(0, 400), st.integers(0, 9))
def test_fit_is_best(lengths, budget, seed):
    size, count = np.array(list(lengths)), np.array(list(lengths.values()))
    take = mixing.fit_budget(size, count, budget, seed)
    reach = {0}
    for s, c in lengths.items():
        reach = {r + s * k for r in reach for k in range(c + 1)}
    assert (take >= 0).all() and (take <= count).all()
    assert (take * size).sum() == max(r for r in reach if r <= budget)


def test_large_budget_is_met_exactly():
    rng = np.random.default_rng(3)
    size, count = np.arange(50, 5000), rng.integers(1, 400, 4950)
    budget = int((size * count).sum() * 0.43)
    take = mixing.fit_budget(size, count, budget, 1)
    assert (take * size).sum() == budget and (take <= count).all()


def test_very_long_documents_and_all_sizes_of_budget():
    rng = np.random.default_rng(8)
    size = np.unique(np.r_[rng.integers(20, 3000, 300), 10_000_000, 7_000_001])
    count = rng.integers(1, 4, len(size))
    total = int((size * count).sum())
    for budget in (0, 5, 40_000, 300_000, 9_000_000, total // 2, total - 1, total, total + 9):
        take = mixing.fit_budget(size, count, budget, 1)
        assert (take >= 0).all() and (take <= count).all() and budget >= (take * size).sum()
        assert (take * size).sum() >= min(budget, total) - 3000 or budget in (9_000_000, total // 2)
    small = np.arange(100, 400)
    take = mixing.fit_budget(small, np.full(300, 5), 60_000, 1)
    assert (take * small).sum() == 60_000 and (take > 0).sum() > 150  # a share of every length, not a few lengths


def tables(spark):
    docs = [(i, "big", 10 + i % 7) for i in range(300)] + [(1000 + i, "small", 5) for i in range(4)] + [(2000, "odd", 9), (3000, None, 9), (4000, "big", 0), (4001, "zero", 0)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    weights = spark.createDataFrame([("big", 0.5, 3), ("small", 0.3, 2), ("absent", 0.1, 5), ("zero", 0.1, 1), (None, 0.0, 1)], "source string, weight double, max_repeat int")
    return sized, weights


def test_mixture(spark):
    sized, weights = tables(spark)
    plan = mixing.length_plan(sized, weights)
    report = {r.source: r for r in mixing.mix_report(plan, weights).collect()}
    total = sum(10 + i % 7 for i in range(300)) + 20
    assert set(report) == {"big", "small", "absent", "zero"}
    assert {s for s, r in report.items() if r.short} == {"small", "absent", "zero"}
    assert report["big"].used == int(total * 0.5) and report["small"].used == 40 and report["absent"].size == 0
    mix = mixing.mixed_documents(sized, plan)
    used = {r.source: (r.t, r.m) for r in mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t"), F.max("copies").alias("m")).collect()}
    assert used["big"] == (report["big"].used, 1) and used["small"] == (40, 2) and "odd" not in used
    again = mixing.mixed_documents(sized.repartition(5), mixing.length_plan(sized.repartition(3), weights))
    assert sorted(mix.collect()) == sorted(again.collect())


def test_repeats(spark):
    sized = spark.createDataFrame([(i, "a", 10) for i in range(10)] + [(100 + i, "b", 10) for i in range(30)], "doc_id long, source string, n_tokens long")
    weights = spark.createDataFrame([("a", 0.6, 3), ("b", 0.4, 1)], "source string, weight double, max_repeat int")
    mix = mixing.mixed_documents(sized, mixing.length_plan(sized, weights))
    copies = {r.copies: r.n for r in mix.filter("source = 'a'").groupBy("copies").agg(F.count("*").alias("n")).collect()}
    assert copies == {2: 6, 3: 4}  # 240 tokens of 100
    assert mix.filter("source = 'b'").count() == 16


def test_empty(spark):
    sized, weights = tables(spark)
    plan = mixing.length_plan(sized.limit(0), weights)
    assert mixing.mix_report(plan, weights).filter("short or used > 0").count() == 0
    assert mixing.mixed_documents(sized.limit(0), plan).count() == 0
    assert mixing.length_plan(sized, weights.limit(0)).count() == 0
