import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from locusframe.llm.target_sample import random_start, swap_repair, variant_plan, variant_sample

cell = st.tuples(st.integers(0, 60), st.integers(0, 8), st.floats(0, 1))


@settings(max_examples=200, deadline=None)
@given(st.lists(cell, min_size=1, max_size=8), st.integers(0, 150), st.integers(0, 5))
def test_swap_repair(cells, n, seed):
    available, floors = np.array([c[0] for c in cells]), np.array([c[1] for c in cells])
    shares = np.array([c[2] for c in cells])
    target = np.maximum(shares / max(shares.sum(), 1e-9) * n, floors)
    start = random_start(available, floors, n, seed)
    end = swap_repair(start, available, floors, target)
    least = np.minimum(floors, available)
    assert start.sum() == end.sum() == max(least.sum(), min(n, available.sum()))
    assert (end <= available).all() and (end >= least).all()
    dev = lambda x: np.abs(x - target).sum()
    assert dev(end) <= dev(start) + 1e-9
    for i in range(len(cells)):  # no single exchange helps any more
        for j in range(len(cells)):
            if i != j and end[i] > least[i] and end[j] < available[j]:
                x = end.copy()
                x[i] -= 1
                x[j] += 1
                assert dev(x) >= dev(end) - 1e-6


def tables(spark):
    rows = []
    for i in range(400):
        consequence = "Missense Variant" if i % 4 else "SO:0001|stop-lost"
        rows.append((i, f"v{i}", consequence, "benign" if i % 3 else " Pathogenic", 1))
    rows += [(1000, "v1", "missense_variant", "benign", 2), (1001, "v2", None, "benign", 2), (1002, "v3", "missense_variant", None, 2), (1003, None, "missense_variant", "benign", 1)]
    v = spark.createDataFrame(rows, "row_id long, variant_id string, consequence string, label string, loaded_at int").selectExpr("*", "'clash' as signature", "1 as taken", "2 as available")
    t = spark.createDataFrame(
        [("missense_variant", "benign", 0.5, 5), ("missense_variant", "pathogenic", 0.3, 5), ("stop_lost", "benign", 0.2, 90), ("start_lost", "benign", 0.0, 2), (None, "benign", 0.0, 1)],
        "consequence string, label string, target_share double, min_n int",
    )
    return v, t


def test_plan_and_sample(spark):
    v, t = tables(spark)
    plan = {(r.consequence, r.label): r for r in variant_plan(v, t).collect()}
    assert len(plan) == 4
    assert {k for k, r in plan.items() if not r.met} == {("stop_lost", "benign"), ("start_lost", "benign")}
    assert plan["missense_variant", "benign"].required == 20 and plan["start_lost", "benign"].available == 0
    sample = variant_sample(v, t).collect()
    taken = {}
    for r in sample:
        taken[r.consequence, r.label] = taken.get((r.consequence, r.label), 0) + 1
    assert taken == {k: r.taken for k, r in plan.items() if r.taken}
    assert len({r.variant_id for r in sample}) == len(sample) and "v2" not in {r.variant_id for r in sample}
    assert sorted(sample) == sorted(variant_sample(v, t).collect())


def test_empty(spark):
    v, t = tables(spark)
    assert variant_sample(v.limit(0), t).count() == 0 and variant_plan(v, t.limit(0)).count() == 0
    assert variant_plan(v.limit(0), t).filter("met").count() == 0
