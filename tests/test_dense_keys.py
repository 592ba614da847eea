import random
from collections import defaultdict

from pyspark.sql import functions as F

from locusframe.operators.dense_keys import dense_totals, heavy_keys


def test_against_brute_force(spark):
    rng = random.Random(7)
    data = [(rng.choice(["hot"] * 6 + [None, "", "é"] + [f"k{i}" for i in range(50)]), rng.choice(["x", "y", None]), rng.choice([None, 1.5, -2.0])) for _ in range(4000)]
    df = spark.createDataFrame(data, "g string, c string, v double").repartition(7).selectExpr("*", "'clash' as key_value", "0 as part")
    got = {(r.field_name, r.key_value): (r.n_rows, round(r.s, 6)) for r in dense_totals(df, {"g": F.col("g"), "c": F.col("c")}, {"s": F.col("v")}, blocks=5).collect()}
    want = defaultdict(lambda: [0, 0.0])
    for g, c, v in data:
        for field, key in (("g", g), ("c", c)):
            want[field, key][0] += 1
            want[field, key][1] += v or 0.0
    assert got == {k: (n, round(s, 6)) for k, (n, s) in want.items()}


def test_heavy_keys_at_the_border(spark):
    data = [("a",)] * 2 + [(None,)] * 50 + [(f"k{i}",) for i in range(48)]
    df = spark.createDataFrame(data, "g string")
    found = {r.key_value for r in heavy_keys(dense_totals(df, {"g": F.col("g")}), 0.02).collect()}
    assert found == {"a"}  # 2 of 100 rows; the rows without a key count in the whole


def test_empty(spark):
    df = spark.createDataFrame([], "g string")
    assert heavy_keys(dense_totals(df, {"g": F.col("g")})).count() == 0
