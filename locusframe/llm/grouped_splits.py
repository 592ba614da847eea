"""Splits that keep related records together: random-mate contraction in joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import gene_key, split_key, variant_key
from ..session import written


def components(edges: DataFrame, seed: int = 42, most_rounds: int = 200) -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (columns a, b); component is the least vertex of it.

    Each round every vertex throws a coin of 2^64 sides and collapses into its neighbour of the lowest throw, if that lies below its own (one min per
    vertex, combined before the shuffle). With two sides a pair would wait until its coins differ; with many it collapses at once, half of the points of a
    star do on average, and a third of the rounds are enough. Edges are renamed by two joins; since both ends go to neighbours, what was connected stays so. Loops and
    repeats vanish, until no edge is left: O(log n) rounds expected, the edges shrink geometrically. A round writes one table to the shared folder,
    the old edges beside the new: the next round reads the new ones, and what collapsed into what is read off both. So plans stay short and lost executors
    lose nothing. A throw is a hash that travels with the vertex and is hashed again each round, so that every round is the same query.
    Labels are unwound over the (vertex, round) pairs of all rounds, each taking the label of what it collapsed into in the next round, by doubling: after
    k joins a label lies 2^k rounds further on. Loops, nulls and repeated edges are allowed; a vertex that only has loops is a component of its own.
    """
    clean = edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).filter("a is not null and b is not null")
    start = written(clean.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    coin = [F.xxhash64("a", F.lit(seed)).alias("ca"), F.xxhash64("b", F.lit(seed)).alias("cb")]
    live = start.filter("a <> b").select("a", "b", *coin)
    collapsed: list[DataFrame] = []
    for _ in range(most_rounds):
        ends = F.explode(F.array(F.struct(F.col("a"), F.col("ca"), F.col("b"), F.col("cb")), F.struct(F.col("b").alias("a"), F.col("cb").alias("ca"), F.col("a").alias("b"), F.col("ca").alias("cb"))))
        lowest = live.select(ends.alias("e")).groupBy(F.col("e.a").alias("vertex")).agg(F.min("e.ca").alias("own"), F.min(F.struct("e.cb", "e.b")).alias("into"))
        mates = lowest.filter(F.col("into") < F.struct("own", "vertex")).select("vertex", "into")
        first = mates.select(F.col("vertex").alias("a"), F.col("into").alias("x"))
        second = mates.select(F.col("vertex").alias("b"), F.col("into").alias("y"))
        renamed = live.join(first, "a", "left").join(second, "b", "left").select(
            "a", "b", F.coalesce("x.b", "a").alias("to_a"), F.coalesce("y.b", "b").alias("to_b"), F.coalesce("x.cb", "ca").alias("ca"), F.coalesce("y.cb", "cb").alias("cb")
        )
        left = Observation()
        table = written(renamed.observe(left, F.count_if(F.col("to_a") != F.col("to_b")).alias("edges"), F.count("*").alias("all")), "round")
        if not left.get["all"]:
            break
        collapsed.append(table)
        if not left.get["edges"]:
            break
        swap = F.col("to_a") > F.col("to_b")
        live = table.filter("to_a <> to_b").select(
            F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"),
            F.xxhash64(F.when(swap, F.col("cb")).otherwise(F.col("ca"))).alias("ca"), F.xxhash64(F.when(swap, F.col("ca")).otherwise(F.col("cb"))).alias("cb"),
        ).distinct()
    else:
        raise RuntimeError(f"edges left after {most_rounds} rounds")
    vertices = start.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    if not collapsed:
        return vertices.withColumn("component", F.col("vertex"))
    def moves(table: DataFrame, turn: int) -> DataFrame:
        ends = F.explode(F.array(F.struct(F.col("a").alias("vertex"), F.col("to_a").alias("root")), F.struct(F.col("b").alias("vertex"), F.col("to_b").alias("root"))))
        return table.select(ends.alias("m")).select("m.*", F.lit(turn).alias("turn"), F.lit(turn + 1).alias("upto")).distinct()

    labels = written(reduce(DataFrame.unionByName, [moves(t, i) for i, t in enumerate(collapsed)]), "labels")
    for _ in range((len(collapsed) - 1).bit_length()):
        above = labels.select(F.col("vertex").alias("root"), F.col("turn").alias("upto"), F.col("root").alias("next"), F.col("upto").alias("further"))
        labels = written(labels.join(above, ["root", "upto"], "left").select("vertex", "turn", F.coalesce("next", "root").alias("root"), F.coalesce("further", "upto").alias("upto")), "labels")
    labels = labels.filter("turn = 0").select("vertex", "root")
    rooted = vertices.join(labels, "vertex", "left").select("vertex", F.coalesce("root", "vertex").alias("root"))
    least = rooted.groupBy("root").agg(F.min("vertex").alias("component"))
    return rooted.join(least, "root").select("vertex", "component")


def assign_splits(sizes: DataFrame, shares: dict[str, float], seed: int = 42, parts: int | None = None) -> DataFrame:
    """(component, weight, split) from (component, weight): components in seeded order, cut by cumulative weight.

    Components stand in the order of a hash of their name; the one whose middle lies at share x of the whole weight
    gets the split whose stretch of the given proportions holds x. The prefix sum is taken in two steps: within blocks of the hash range and
    over the (few) blocks. No component is ever cut, so one heavier than a share makes that share larger: compare with ``split_shares``.
    """
    total = float(sum(shares.values()))
    if total <= 0 or any(s < 0 for s in shares.values()):
        raise ValueError("shares must be positive")
    spark = sizes.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = sizes.withColumn("__h", F.xxhash64("component", F.lit(seed))).withColumn("__block", F.pmod("__h", F.lit(parts)))
    inside = W.partitionBy("__block").orderBy("__h", "component")
    blocks = hashed.groupBy("__block").agg(F.sum("weight").alias("__w"))
    over = W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("__block", F.coalesce(F.sum("__w").over(over), F.lit(0)).alias("__before"))  # `parts` rows
    whole = sizes.agg(F.sum("weight")).scalar()
    middle = (F.col("__before") + F.sum("weight").over(inside) - F.col("weight") / 2) / whole
    placed = hashed.join(F.broadcast(blocks), "__block").withColumn("__x", middle)
    choice, upto = None, 0.0
    for name, s in shares.items():
        upto += s / total
        choice = F.when(F.col("__x") < upto, name) if choice is None else choice.when(F.col("__x") < upto, name)
    return placed.select("component", "weight", choice.otherwise(list(shares)[-1]).alias("split"))


def split_rows(gene_split: DataFrame) -> DataFrame:
    """Rows of the split table in comparison form; those without a variant, gene or split are left out."""
    return gene_split.select(
        variant_key(F.col("variant_id")).alias("variant_id"), gene_key(F.col("gene_name")).alias("gene_name"), split_key(F.col("split")).alias("split")
    ).filter("variant_id is not null and gene_name is not null and split is not null")


def gene_ties(rows: DataFrame) -> DataFrame:
    """Edges between the genes under which one variant stands: each gene to the variant's first gene, never all pairs.

    rows: distinct rows with variant_id and gene_name, so that a variant delivered very often is few of them. Only variants of several rows are looked at further.
    """
    several = written(rows.groupBy("variant_id").agg(F.count("*").alias("n")).filter("n > 1").select("variant_id"), "several")  # its size is known to the joins
    rows = written(rows.select("variant_id", "gene_name").join(several, "variant_id", "left_semi"), "tied")
    first = rows.groupBy("variant_id").agg(F.min("gene_name").alias("first"))
    tied = rows.join(first, "variant_id").filter("gene_name <> first")
    return tied.select(F.col("first").alias("a"), F.col("gene_name").alias("b")).distinct()


def gene_groups(rows: DataFrame, seed: int = 42) -> DataFrame:
    """(gene_name, group_gene) for every gene of ``rows``; group_gene is the first gene of the group in string order."""
    tied = components(gene_ties(rows), seed).select(F.col("vertex").alias("gene_name"), F.col("component").alias("group_gene"))
    return rows.select("gene_name").distinct().join(tied, "gene_name", "left").select("gene_name", F.coalesce("group_gene", "gene_name").alias("group_gene"))


def broken_groups(gene_split: DataFrame, seed: int = 42) -> DataFrame:
    """(group_gene, gene_name): the genes of every group whose rows show more than one split."""
    rows = written(split_rows(gene_split).distinct(), "rows")  # read several times below
    tied = components(gene_ties(rows), seed).select(F.col("vertex").alias("gene_name"), F.col("component").alias("group_gene"))
    shown = rows.groupBy("gene_name").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    genes = shown.join(tied, "gene_name", "left").select("gene_name", F.coalesce("group_gene", "gene_name").alias("group_gene"), "lo", "hi")
    genes = written(genes, "groups")
    broken = genes.groupBy("group_gene").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi")
    return genes.join(broken.select("group_gene"), "group_gene", "left_semi").select("group_gene", "gene_name")


def grouped_split(gene_split: DataFrame, shares: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """(variant_id, gene_name, group_gene, split): each distinct variant and gene once, no group of tied genes in two splits."""
    rows = written(split_rows(gene_split).select("variant_id", "gene_name").distinct(), "rows")
    groups = written(gene_groups(rows, seed), "groups")
    per_gene = rows.groupBy("gene_name").agg(F.count("*").alias("n"))
    sizes = per_gene.join(groups, "gene_name").groupBy(F.col("group_gene").alias("component")).agg(F.sum("n").alias("weight"))
    split = assign_splits(sizes, shares or {"train": 0.8, "validation": 0.1, "test": 0.1}, seed)
    genes = groups.join(split.select(F.col("component").alias("group_gene"), "split"), "group_gene")
    return rows.join(genes, "gene_name").select("variant_id", "gene_name", "group_gene", "split")


def split_shares(assigned: DataFrame) -> DataFrame:
    """(split, n_rows, n_groups): what each split got."""
    return assigned.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("group_gene").alias("n_groups"))
