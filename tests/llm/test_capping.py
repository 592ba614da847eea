import random

import pytest
from pyspark.sql import functions as F

from locusframe.llm.capping import cap_contributors, capped_genes, first_by_position


def order():
    return [F.col("q").desc_nulls_last(), F.col("i").asc()]


def brute(data, cap):
    by = {}
    for c, q, i in data:
        if c is not None:
            by.setdefault(c, []).append((q is None, -(q or 0), i))
    return sorted((c, n, x[2], len(v) > cap) for c, v in by.items() for n, x in enumerate(sorted(v)[:cap]))


@pytest.mark.parametrize("cap", [0, 1, 7, 10_000])
def test_against_brute_force(spark, cap):
    rng = random.Random(9)
    data = [(rng.choice(["hot"] * 10 + [None, "", "b"] + [f"k{i}" for i in range(60)]), rng.choice([None, 1, 2, 2, 3]), i) for i in range(4000)]
    df = spark.createDataFrame(data, "c string, q int, i long").repartition(6).selectExpr("*", "'clash' as position", "1 as over_cap")
    got = sorted((r.c, r.position, r.i, r.over_cap) for r in first_by_position(df, "c", order(), cap).collect())
    assert got == brute(data, cap)


def test_share_ties_and_empty(spark):
    df = spark.createDataFrame([("a", 1, i % 2) for i in range(80)] + [("b", 1, i) for i in range(20)], "c string, q int, i long")
    kept = {r.c: r["count"] for r in cap_contributors(df, "c", order(), share=0.25).groupBy("c").count().collect()}
    assert kept == {"a": 25, "b": 20}  # repeated rows count each
    assert cap_contributors(df.limit(0), "c", order(), most=3).count() == 0
    with pytest.raises(ValueError):
        cap_contributors(df, "c", order())


def test_genes(spark, rows):
    data = [(i, f"v{i}", "g", 1 if i % 2 else 9, None if i % 5 == 0 else 100 - i, 1) for i in range(30)] + [(100, "v1", "g", 4, 1, 2), (101, "w", "h", None, None, 1), (102, "x", None, 4, 1, 1), (103, None, "g", 4, 1, 1)]
    df = spark.createDataFrame(data, "row_id long, variant_id string, gene_name string, stars int, allele_id long, loaded_at int").withColumn("position", F.lit("x"))
    latest = {v: (r, g, s, a) for r, v, g, s, a, t in sorted(data, key=lambda x: (x[5], x[0])) if v}
    key = lambda x: (-(x[2] if x[2] is not None and 0 <= x[2] <= 4 else 0), x[3] is None, x[3] or 0, x[0])
    want = [x[0] for x in sorted((x for x in latest.values() if x[1] == "g"), key=key)[:20]]
    got = capped_genes(df)
    assert [r.row_id for r in got.filter("gene_name = 'G'").orderBy("position").collect()] == want
    assert got.filter("not over_cap").select("gene_name", "row_id").collect()[0] == ("H", 101)


def test_hot_contributors_over_many_partitions(spark):
    rng = random.Random(6)
    data = [(rng.choice(["hot"] * 8 + ["a", "b", "c", None]), rng.randint(0, 9), i) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, q int, i int").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for args in ({"most": 30}, {"most": 5000}, {"share": 0.2}, {"share": 0.00001}):
            got = {(r.k, r.position): (r.i, r.over_cap) for r in cap_contributors(df, "k", [F.col("q").desc(), F.col("i").asc()], **args).collect()}
            cap, want = args.get("most", int(3000 * args.get("share", 0))), {}
            for k in ("hot", "a", "b", "c"):
                mine = sorted((-q, i) for g, q, i in data if g == k)
                want |= {(k, p): (i, len(mine) > cap) for p, (_, i) in enumerate(mine[:cap])}
            assert got == want, args
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
