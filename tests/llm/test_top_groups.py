import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from locusframe.llm.runs import RunRanks
from locusframe.llm.top_groups import top_per_group, top_scored_variants


def test_run_ranks_over_batches():
    keys = ["a", "a", "b", None, None, None, "c", "c", "c", "c"]
    want = [0, 1, 0, 0, 1, 2, 0, 1, 2, 3]
    for cut in range(11):
        r = RunRanks()
        got = np.concatenate([r(pa.array(keys[:cut], pa.string())), r(pa.array([], pa.string())), r(pa.array(keys[cut:], pa.string()))])
        assert got.tolist() == want


def test_against_brute_force(spark):
    rng = random.Random(4)
    data = [(rng.choice(["hot"] * 8 + [None, "b", "c"] + [f"k{i}" for i in range(40)]), rng.choice([None, 0.1, 0.5, 0.5, 0.9]), f"i{i:05d}") for i in range(5000)]
    df = spark.createDataFrame(data, "g string, s double, i string").repartition(6).withColumn("rank_no", F.lit("clash"))
    got = sorted((r.g, r.rank_no, r.i) for r in top_per_group(df, "g", [F.col("s").desc_nulls_last(), F.col("i").asc()], 3).collect())
    by = {}
    for g, s, i in data:
        if g is not None:
            by.setdefault(g, []).append((s is None, -(s or 0), i))
    assert got == sorted((g, n + 1, x[2]) for g, v in by.items() for n, x in enumerate(sorted(v)[:3]))
    assert top_per_group(df.limit(0), "g", [F.col("i").asc()], 3).count() == 0


def test_scores(spark, rows):
    nan, inf = float("nan"), float("inf")
    v = spark.createDataFrame(
        [(1, "chr1:1:A:C", "g1", 1), (2, "chr1:1:A:C", "G1:5", 2), (3, "chr1:2:A:C", "g1", 1), (4, "chr1:3:A:C", " g1", 1), (5, "chr1:4:A:C", None, 1), (6, "chr1:5:A:C", "g2", 1), (7, None, "g2", 1), (8, "chr1:9:A:C", "g1", 1)],
        "row_id long, variant_id string, gene_name string, loaded_at int",
    ).selectExpr("*", "'x' as rank_no", "0.1 as score")
    s = spark.createDataFrame(
        [("1:1:A:C", 0.5, 1), ("chr1:1:A:C", 0.2, 2), ("chr1:1:A:C", nan, 3), ("chr1:1:A:C", 1.5, 4), ("chr1:2:A:C", 0.2, 1), ("chr1:2:A:C", 0.2, 1), ("chr1:3:A:C", 0.1, 1), ("chr1:3:A:C", 0.9, None),
         ("chr1:9:A:C", 0.0, 1), ("chr1:4:A:C", 0.9, 1), ("chr1:5:A:C", inf, 1), ("chr1:5:A:C", None, 2), ("chr9:9:A:C", 0.9, 1), (None, 0.9, 1)],
        "variant_id string, score double, scored_at int",
    )
    assert rows(top_scored_variants(v, s)) == [("G1", 1, "chr1:1:A:C", 0.2), ("G1", 2, "chr1:2:A:C", 0.2), ("G1", 3, "chr1:3:A:C", 0.1)]
    assert top_scored_variants(v.limit(0), s).count() == top_scored_variants(v, s.limit(0)).count() == 0
