import random

import pytest
from pyspark.sql import functions as F

from locusframe.llm import grouped_splits as g


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "path", "star"])
def test_components(spark, kind):
    rng = random.Random(5)
    if kind == "random":
        edges = [(f"v{rng.randint(0, 150)}", f"v{rng.randint(0, 150)}") for _ in range(110)]
    elif kind == "path":
        edges = [(f"v{i:03d}", f"v{i + 1:03d}") for i in range(60)]
    else:
        edges = [("hub", f"v{i}") for i in range(300)] + [("x", "x")]
    df = spark.createDataFrame([*edges, edges[0], (None, "q"), ("q", None)], "a string, b string")
    assert {r.vertex: r.component for r in g.components(df).collect()} == union_find(edges)


def test_no_edges(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert g.components(df).count() == 0
    assert {tuple(r) for r in g.components(spark.createDataFrame([("x", "x")], "a string, b string")).collect()} == {("x", "x")}


SPLIT = "variant_id string, gene_name string, split string"


def test_broken_groups(spark, rows):
    data = [
        ("chr1:1:A:C", "a1", "train"), ("1:1:A:C", "B1:77", "TRAIN "), ("chr1:2:A:C", "b1 ", "train"), ("chr1:2:A:C", "c1", "Test"),  # a1 - b1 - c1, two splits
        ("chr1:3:A:C", "d1", "val"), ("chr1:4:A:C", "D1", "testing"),  # one gene, two splits
        ("chr1:5:A:C", "e1", "train"), ("chr1:5:A:C", "e1", "training"), ("chr1:5:A:C", "f1", "Train"),  # tied, one split
        (None, "e1", "test"), ("chr1:5:A:C", None, "test"), ("chr1:5:A:C", "f1", None), ("chr1:6:A:C", " ", "test"),
    ]
    df = spark.createDataFrame(data * 2, SPLIT).selectExpr("*", "'x' as group_gene", "1 as root")
    assert rows(g.broken_groups(df)) == [("A1", "A1"), ("A1", "B1"), ("A1", "C1"), ("D1", "D1")]
    assert g.broken_groups(df.limit(0)).count() == 0


def test_split_keeps_groups_and_shares(spark):
    rng = random.Random(2)
    data = [(f"chr1:{rng.randint(0, 3000)}:A:C", f"g{rng.randint(0, 400)}" if i % 3 else f"h{i}", "train") for i in range(3000)]
    out = g.grouped_split(spark.createDataFrame(data, SPLIT)).cache()
    assert out.groupBy("group_gene").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert out.groupBy("variant_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert out.count() == len({(v, s.upper()) for v, s, _ in data})
    assert {r.split for r in g.split_shares(out).collect()} <= {"train", "validation", "test"}


def test_shares_of_small_components(spark):
    sizes = spark.createDataFrame([(f"c{i}", 1 + i % 4) for i in range(4000)], "component string, weight long")
    got = {r.split: r.w for r in g.assign_splits(sizes, {"train": 8, "validation": 1, "test": 1}).groupBy("split").agg(F.sum("weight").alias("w")).collect()}
    total = sum(got.values())
    assert total == 10000 and all(abs(got[k] / total - s) < 0.001 for k, s in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))
    with pytest.raises(ValueError):
        g.assign_splits(sizes, {"a": -1.0, "b": 2.0})
    assert g.assign_splits(sizes.limit(0), {"train": 1.0}).count() == 0
