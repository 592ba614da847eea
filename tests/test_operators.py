import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import activations, curation, genome, metrics, probe, validation
from locusframe.operators.latest import latest_rows
from locusframe.operators.ordering import running_totals, with_position


def test_latest(spark, rows):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 2, 3), (None, 9, 9), ("b", None, 5)], "k string, t int, r int")
    assert rows(latest_rows(df, "k", [F.col("t").desc_nulls_last(), F.col("r").desc()])) == [("a", 2, 3), ("b", None, 5)]


def test_positions_and_running_totals(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot", "hot", "a", None]), i, rng.randint(-3, 3)) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, i int, v int").repartition(5)
    assert [r.i for r in with_position(df, [F.col("i").desc()]).orderBy("position").collect()] == list(range(2999, -1, -1))
    got = {(r.g, r.i): (r.n, r.s) for r in running_totals(df, ["g"], [F.col("i").asc()], {"n": F.lit(1), "s": F.col("v")}).collect()}
    want, at = {}, {}
    for g, i, v in data:
        n, s = at.get(g, (0, 0))
        at[g] = want[g, i] = (n + 1, s + v)
    assert got == want


def test_quotas_and_sample(spark, rows):
    data = [("a", "P", f"g{i % 7}", i % 3, i, f"v{i}") for i in range(30)] + [("a", "B", "g", 1, 100 + i, f"w{i}") for i in range(70)] + [("c", "B", "h", 1, 200 + i, f"x{i}") for i in range(50)]
    df = spark.createDataFrame(data, "consequence string, label string, gene_name string, stars int, allele_id long, variant_id string")
    assert rows(curation.label_quotas(df, 100).select("consequence", "label", "quota")) == [("a", "B", 35), ("a", "P", 23), ("c", "B", 40)]
    sample = curation.balanced_sample(df, 100)
    assert sample.count() == 98
    genes = {r.gene_name for r in sample.filter("label = 'P'").collect()}
    assert len(genes) == 7


def test_holdout_keeps_genes_together(spark):
    df = spark.createDataFrame([(f"v{i}", f"g{i % 10}" if i % 11 else None) for i in range(200)], "variant_id string, gene_name string")
    out = curation.gene_holdout(df)
    assert out.count() == 200
    assert out.filter("gene_name is not null").groupBy("gene_name").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert out.filter("split = 'test'").select("gene_name").distinct().count() == 2


def scored(spark, data):
    return spark.createDataFrame(data, "g string, variant_id string, score double, y int")


def test_ranking_metrics(spark):
    data = [("a", f"v{i}", s, y) for i, (s, y) in enumerate(zip([0.9, 0.8, 0.7, 0.6, 0.5], [1, 0, 1, 0, 0]))]
    data += [("t1", "a", 0.5, 1), ("t1", "b", 0.5, 0), ("t0", "a", 0.5, 0), ("t0", "b", 0.5, 1), ("n", "a", 0.1, 0), ("n", "b", None, 1)]
    df = scored(spark, data)
    out = {r.g: r for r in metrics.ranked_metrics(df, ["g"], "score", "y", "variant_id").collect()}
    assert math.isclose(out["a"].auroc, 5 / 6) and math.isclose(out["a"].auprc, 5 / 6)
    assert out["t1"].auroc == 1.0 and out["t0"].auroc == 0.0
    assert math.isnan(out["n"].auroc) and out["n"].auprc == 0.0 and out["n"].n_variants == 1
    tied = {r.g: r.auroc for r in metrics.tied_auroc(df, ["g"], "score", "y").collect()}
    assert tied["t1"] == tied["t0"] == 0.5
    assert metrics.ranked_metrics(df, ["g"], "score", "y", "variant_id", 2, 3).count() == 1
    flipped = metrics.ranked_metrics(df.withColumn("score", -F.col("score")), ["g"], "score", "y", "variant_id").filter("g = 'a'").first().auroc
    assert math.isclose(flipped + out["a"].auroc, 1.0)


def test_spearman(spark):
    df = spark.createDataFrame([(1, a, b) for a, b in zip([1, 2, 2, 4], [10, 20, 30, 40])], "g int, a int, b int")
    assert round(metrics.spearman(df, ["g"], "a", "b").first().spearman, 6) == 0.948683


def test_bootstrap_against_numpy(spark):
    import hashlib

    rng = np.random.default_rng(1)
    n, b = 60, 25
    y, s = rng.integers(0, 2, n), rng.random(n)
    df = scored(spark, [("a", f"v{i:03d}", float(s[i]), int(y[i])) for i in range(n)])
    got = metrics.bootstrap_intervals(df, ["g"], "score", "y", "variant_id", replicates=b).first()
    ranked = y[np.argsort(-s)]
    areas, precisions = [], []
    for r in range(b):
        draw = np.sort([int(hashlib.md5(f"42:{r}:{d}".encode()).hexdigest()[:8], 16) % n for d in range(n)])
        t = ranked[draw]
        tp = np.cumsum(t)
        areas.append((tp * (1 - t)).sum() / (t.sum() * (n - t.sum())))
        precisions.append((tp / np.arange(1, n + 1) * t).sum() / t.sum())
    want = [np.quantile(v, q) for v in (areas, precisions) for q in (0.025, 0.975)]
    assert np.allclose([got.auroc_ci_lo, got.auroc_ci_hi, got.auprc_ci_lo, got.auprc_ci_hi], want)


def broadcast_rows(spark):
    """Most rows that a broadcast of each query so far had, by the query's number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, most = spark._jsparkSession.sharedState().statusStore(), {}
    ran = store.executionsList()
    for e in (ran.apply(i) for i in range(ran.size())):
        nodes, values = store.planGraph(e.executionId()).allNodes(), store.executionMetrics(e.executionId())
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size()) if node.name() == "BroadcastExchange"):
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most[e.executionId()] = max(most.get(e.executionId(), 0), int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


def test_bootstrap_draws_stay_in_tasks(spark):
    """Draws of several blocks, packs and groups against brute force; none is among the rows that are broadcast."""
    import hashlib

    rng, b = np.random.default_rng(6), 40
    data, ranked = [], {}
    for g, n in (("a", 9000), (None, 1013), ("b", 64), ("few", 9)):
        y, s = rng.permutation(np.arange(n) % 2), rng.random(n)
        data += [(g, f"v{i:05d}", float(s[i]), int(y[i])) for i in range(n)]
        ranked[g] = y[np.argsort(-s)]
    del ranked["few"]
    hashes = np.array([[int(hashlib.md5(f"42:{r}:{d}".encode()).hexdigest()[:8], 16) for d in range(9000)] for r in range(b)])
    before = broadcast_rows(spark)
    for cut in ({}, {"size": 256, "pack": 500}):
        got = {r.g: tuple(r)[1:] for r in metrics.bootstrap_intervals(scored(spark, data), ["g"], "score", "y", "variant_id", replicates=b, **cut).collect()}
        assert set(got) == set(ranked)
        for g, y in ranked.items():
            values, n = [], len(y)
            for r in range(b):
                t = y[np.sort(hashes[r, :n] % n)]
                tp = np.cumsum(t)
                values.append(((tp * (1 - t)).sum() / (t.sum() * (n - t.sum())), (tp / np.arange(1, n + 1) * t).sum() / t.sum()))
            assert np.allclose(got[g], [np.quantile(np.array(values)[:, m], q) for m in (0, 1) for q in (0.025, 0.975)], rtol=0, atol=1e-12)
    ran = {k: v for k, v in broadcast_rows(spark).items() if k not in before}
    assert ran and max(ran.values()) < 1000
    none = metrics.bootstrap_intervals(scored(spark, data[-9:]), ["g"], "score", "y", "variant_id", replicates=b)
    assert none.count() == 0 and none.columns == ["g", "auroc_ci_lo", "auroc_ci_hi", "auprc_ci_lo", "auprc_ci_hi"]
    whole = metrics.bootstrap_intervals(scored(spark, data).filter("g = 'a'"), [], "score", "y", "variant_id", replicates=b).first()
    assert np.allclose(tuple(whole), got["a"], rtol=0, atol=1e-12)


def test_shards_and_checks(spark, rows):
    df = spark.createDataFrame([(i,) for i in range(10)], "i int")
    shards = validation.contiguous_shards(df, [F.col("i").asc()], 4)
    assert [r.shard for r in shards.orderBy("i").collect()] == [0, 0, 1, 1, 1, 2, 2, 3, 3, 3]
    assert validation.contiguous_shards(df.limit(2), [F.col("i").asc()], 5).agg(F.max("shard")).first()[0] == 1
    some = spark.createDataFrame([(0,), (2,), (3,)], "shard int")
    assert rows(validation.missing_shards(some)) == [(1,)]
    assert rows(validation.missing_shards(some.filter("shard < 2"), expected=4)) == [(1,), (2,), (3,)]
    assert validation.missing_shards(some.limit(0)).count() == 0
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert rows(validation.id_mismatch(a, b, "k")) == [("x", "left_only"), ("z", "right_only")]
    assert rows(validation.remaining(a, b, "k")) == [("x",)] and rows(validation.stale(b, a, "k")) == [("z",)]
    assert validation.unequal_counts({"a": a, "b": b}, "k").count() == 0
    assert rows(validation.unequal_counts({"a": a, "b": b.limit(1)}, "k")) == [("a", 2), ("b", 1)]
    assert rows(validation.duplicate_keys(a.union(a.limit(1)), "k")) == [("x", 2)]


CHR1 = "TTACGGATCCATGACGTTAGCAAGTCTTGACCGATATGCA"


@pytest.mark.parametrize("strict", [False, True])
def test_reference_check(spark, strict):
    genes = spark.createDataFrame([("E1", "GPLUS", "1", 4, 20, "+"), ("E2", "GMINUS", "1", 20, 36, "-")], "gene_id string, gene_name string, chrom string, start long, end long, strand string")
    cases = [("GPLUS", 6, "A", True, True), ("GPLUS", 6, "ATC", True, True), ("GPLUS", 6, "C", False, False), ("GPLUS", 19, "GC", False, False), ("GMINUS", 22, "A", True, True), ("GMINUS", 22, "AGT", False, True), ("GMINUS", 35, "A", True, True), ("GMINUS", 28, "GA", False, True)]
    variants = spark.createDataFrame([(f"{g}{p}{r}", g, p, r) for g, p, r, _, _ in cases], "variant_id string, gene_name string, pos long, ref string")
    tiled = genome.tiles(spark.createDataFrame([("1", CHR1)], "chrom string, sequence string"), 7)
    kept = {r.variant_id for r in genome.reference_check(variants, genes, tiled, strict, 7).collect()}
    assert kept == {f"{g}{p}{r}" for g, p, r, compat, exact in cases if (exact if strict else compat)}
    sequences = {r.gene_name: r.sequence for r in genome.gene_sequences(genes, tiled, 7).collect()}
    assert sequences == {"GPLUS": "GGATCCATGACGTTAG", "GMINUS": "TATCGGTCAAGACTTG"}


def test_select_positions(spark):
    cos = {4: 0.9, 5: 0.1, 6: 0.5, 7: 0.2, 2: 0.3, 3: 0.4, 0: 0.0, 1: 0.0}
    df = spark.createDataFrame([("v", p, [1.0, 0.0], [c, (1 - c * c) ** 0.5]) for p, c in cos.items()], "variant_id string, pos long, var_same array<float>, ref_same array<float>")

    def pick(start, end, k, w):
        ranges = spark.createDataFrame([("v", start, end)], "variant_id string, range_start long, range_end long")
        return [r.pos for r in activations.select_positions(df, ranges, ["variant_id"], k, w).orderBy("slot").collect()]

    assert pick(2, 8, 4, 2) == [2, 3, 5, 7]
    assert pick(2, 8, 8, 2) == [2, 3, 4, 5, 6, 7, -1, -1]
    assert pick(6, 8, 4, 5) == [6, 7, -1, -1]
    assert pick(3, 3, 4, 0) == [-1] * 4
    assert [r.pos for r in activations.lowest_cosine(df.filter("pos >= 4"), ["variant_id"], 2).orderBy("slot").collect()] == [5, 7]


def test_loss_and_genomic_positions(spark):
    selected = spark.createDataFrame([("v", i, p) for i, p in enumerate([0, 2, -1, 3])], "variant_id string, slot int, pos long")
    losses = spark.createDataFrame([("v", i, float(a), 0.5) for i, a in enumerate([1, 2, 3])], "variant_id string, pos long, var_loss double, ref_loss double")
    assert [r.loss for r in activations.loss_difference(selected, losses, ["variant_id"]).orderBy("slot").collect()] == [0.5, 2.5, 0.0, 0.0]
    at = spark.createDataFrame([("v", 1000, 10)], "variant_id string, variant_pos long, offset long")
    assert [r.pos for r in activations.genomic_positions(selected, at).orderBy("slot").collect()] == [990, 992, -1, 993]


def test_model_and_embeddings(spark):
    windows = spark.createDataFrame([("v", "ACGTACGT", "ACTACGT"), ("w", "AAAA", None)], "variant_id string, ref_window string, var_window string")
    out = probe.run_model(windows, probe.hashed_model(4))
    assert out.count() == 14 and {r.variant_id for r in out.collect()} == {"v"}
    rng = np.random.default_rng(0)
    x, w = rng.standard_normal((50, 6)).astype(np.float32), probe.projection(6, 3)
    df = spark.createDataFrame([(i % 2, row.tolist()) for i, row in enumerate(x)], "variant_id int, diff array<float>").repartition(3)
    got = {r.variant_id: np.array(r.embedding) for r in probe.moment_embeddings(df, w).collect()}
    for k in (0, 1):
        z = x[k::2] @ w
        assert np.allclose(got[k], (z.T @ z / len(z)).ravel(), atol=1e-5)


def test_windows_of_repeated_ids(spark):
    tiled = genome.tiles(spark.createDataFrame([("1", CHR1)], "chrom string, sequence string"), 7)
    ok = CHR1[20]
    data = [("v", "1", 20, ok, "GG")] * 3 + [("w", "1", 20, ok, "T"), ("v", "1", 20, "N", "T"), ("x", "2", 1, "A", "C")]
    out = genome.variant_windows(spark.createDataFrame(data, "variant_id string, chrom string, pos long, ref string, alt string"), tiled, 5, 3, 7).collect()
    assert len(out) == 5 and {r.ref_window for r in out} == {CHR1[15:23]} and {r.offset for r in out} == {5}
    for r in out:
        assert r.ref_ok == (r.ref == ok) and r.var_window == (CHR1[15:20] + r.alt + CHR1[21:23] if r.ref == ok else None)
    assert [r.variant_id for r in out].count("v") == 4 and any(r.ref_ok for r in out)


def test_running_totals_over_many_partitions(spark):
    rng = random.Random(9)
    data = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([1, None]), i, rng.choice([None, 1, 5, -2])) for i in range(2000)]
    df = spark.createDataFrame(data, "g string, h int, i int, v int").repartition(7)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.g, r.h, r.i): (r.n, r.s) for r in running_totals(df, ["g", "h"], [F.col("i").asc()], {"n": F.lit(1), "s": F.col("v")}).collect()}
        whole = {r.i: r.n for r in running_totals(df.select("i"), [], [F.col("i").asc()], {"n": F.lit(1)}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    want, at = {}, {}
    for g, h, i, v in data:
        n, s = at.get((g, h), (0, 0))
        at[g, h] = want[g, h, i] = (n + 1, s + (v or 0))
    assert got == want and whole == {i: i + 1 for i in range(2000)}
    assert running_totals(df.limit(0), ["g"], [F.col("i").asc()], {"n": F.lit(1)}).count() == 0


def test_harvest_inside_the_task(spark):
    rng = random.Random(4)
    chrom = "".join(rng.choice("ACGT") for _ in range(400))
    tiled = genome.tiles(spark.createDataFrame([("1", chrom)], "chrom string, sequence string"), 64)
    data = [(f"v{p}", "1", p, chrom[p : p + n], alt) for p, n, alt in ((0, 1, "T"), (50, 3, "A"), (51, 1, "GGG"), (200, 1, "C"), (398, 2, "A"), (399, 1, "ACG"))]
    windows = genome.variant_windows(spark.createDataFrame(data, "variant_id string, chrom string, pos long, ref string, alt string"), tiled, 60, 40, 64).cache()
    model, k, sure = probe.hashed_model(4), 12, 5
    kept = probe.harvested(windows, model, k, sure).collect()
    rows = probe.run_model(windows, model)
    ranges = activations.selection_ranges(windows.withColumn("len", F.length("ref_window").cast("bigint")), "len", "offset")
    at = {r.variant_id: r.pos - r.offset for r in windows.collect()}
    want = {}
    for d, w in ((0, sure), (1, 0)):
        for r in activations.select_positions(rows.filter(F.col("dir") == d), ranges.filter(F.col("dir") == d), ["variant_id", "dir"], k, w).collect():
            loss = 0.0 if r.pos < 0 or r.var_loss is None or r.ref_loss is None else r.var_loss - r.ref_loss
            want[r.variant_id, r.dir, r.slot] = (r.pos + at[r.variant_id] if r.pos >= 0 else -1, r.var_same, r.ref_same, r.ref_cross, loss)
    got = {(r.variant_id, r.dir, r.slot): r for r in kept if r.slot >= 0}
    assert set(got) == set(want)
    for key, (pos, *vectors, loss) in want.items():
        assert got[key].pos == pos and [got[key].var_same, got[key].ref_same, got[key].ref_cross] == vectors and abs(got[key].loss - loss) < 1e-6
    for d in (0, 1):
        for i, view in enumerate(activations.VIEWS):
            means = {}
            for r in activations.mean_pooled(rows.filter(F.col("dir") == d), ["variant_id"], view).collect():
                means[r.variant_id, r.dim] = r["mean"]
            mine = {(r.variant_id, j): x for r in kept if r.slot == -1 and r.dir == d for j, x in enumerate(r["mean"][i])}
            assert set(mine) == set(means) and all(abs(mine[x] - means[x]) < 1e-9 for x in mine)

    places = {(r.variant_id, r.dir, r.slot): r.pos + at[r.variant_id] if r.pos >= 0 else -1 for r in probe.selected_positions(windows, model, k, sure).collect()}
    assert places == {key: r.pos for key, r in got.items()}
    wide = 1 << 14  # more slots than one batch holds
    many = probe.harvested(windows, model, wide, sure, keep=("pos", "slot", "var_same", "variant_id", "dir"))
    assert many.columns == ["variant_id", "dir", "slot", "pos", "var_same"]
    found = many.filter("pos >= 0").groupBy("variant_id", "dir").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.count("var_same").alias("vectors")).collect()
    assert many.count() == 2 * wide * len(data) and all(r.n == r.last + 1 == r.vectors for r in found)
    lengths = {(r.variant_id, d): n for r in windows.collect() for d, n in ((0, min(len(r.ref_window), len(r.var_window)) - r.offset - max(len(r.ref), len(r.alt))), (1, r.offset)) if n > 0}
    assert {(r.variant_id, r.dir): r.n for r in found} == lengths

    def failing(sequence):
        if sequence.startswith(chrom[140]):
            raise RuntimeError("no")
        return model(sequence)

    errors = [r for r in probe.harvested(windows, failing, k, sure).collect() if r.error]
    assert errors and all(r.error == "RuntimeError: no" and r.slot is None for r in errors)


def test_own_metric_and_strata(spark):
    data = [(f"v{i}", s, y, size) for i, (s, y, size) in enumerate([(0.9, 1, "a"), (0.8, 0, "a"), (0.7, 1, "a"), (0.6, 0, "b"), (0.5, 1, "b"), (None, 1, "b")])]
    df = spark.createDataFrame(data, "variant_id string, score double, pathogenic int, size string")
    mean_rank = metrics.Metric(lambda y, tp, rank: y * rank, lambda total, p, n: F.try_divide(total, p))
    out = {r.stratum: r for r in metrics.stratified_metrics(df, least=1, names=F.array("size", F.lit("all")), metrics={"mean_rank": mean_rank}).collect()}
    assert {k: r.mean_rank for k, r in out.items()} == {"a": 2.0, "b": 2.0, "all": 3.0}
    spread = metrics.blocked_bootstrap_intervals(metrics.by_stratum(df, names=F.array(F.lit("all"))), ["stratum"], "score", "pathogenic", "variant_id", 200, least=1, metrics={"mean_rank": mean_rank}).first()
    assert 1 <= spread.mean_rank_ci_lo <= 3 <= spread.mean_rank_ci_hi <= 5


def test_enrich_gives_the_order_back(spark):
    genes = spark.createDataFrame([("g", "E2", 0, 9, "+", 9), ("g", "E1", 0, 9, "-", 9), ("h", "E3", 0, 9, "+", 9)], "gene_name string, gene_id string, start long, end long, strand string, length long")
    df = spark.createDataFrame([("c", "g", 3, 1), ("a", "h", 1, 2), ("b", "none", 1, 3), ("c", "h", 2, 4), (None, None, None, 5)], "variant_id string, gene_name string, pos long, i int").repartition(3)
    out = curation.enrich(df, genes, order=[F.col("i").asc()]).collect()
    assert [(r.variant_id, r.gene_id, r.position) for r in out] == [("c", "E1", 0), ("a", "E3", 1)]


def test_dropped_counts(spark):
    steps = {}
    df = validation.counted(validation.counted(spark.range(10), "all", steps).filter("id > 6"), "kept", steps)
    assert df.count() == 3 and validation.dropped_counts(steps) == {"all": (10, 7), "kept": (3, 0)}
