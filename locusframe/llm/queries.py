"""Queries of the training-data operators with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.numbered import SQL_LATEST, sql_consequence, sql_gene, sql_stars, sql_term, sql_variant
from ..sources.tables import table
from . import bpe, capping, content, grouped_splits, mixing, target_sample, top_groups
from ..session import written


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return grouped_splits.broken_groups(table(spark, d, "gene_split"))


def p2_split(spark: SparkSession, d: str) -> DataFrame:
    return grouped_splits.grouped_split(table(spark, d, "gene_split"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    top = top_groups.top_scored_variants(table(spark, d, "variants"), table(spark, d, "scores"))
    return top.select("gene_name", "rank_no", "variant_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return capping.capped_genes(table(spark, d, "variants")).filter("over_cap").select("gene_name", "row_id")


def p5_capped(spark: SparkSession, d: str) -> DataFrame:
    return capping.capped_genes(table(spark, d, "variants")).selectExpr("gene_name", "row_id", "cast(position + 1 as int) as place")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    plan = target_sample.variant_plan(table(spark, d, "variants"), table(spark, d, "sample_targets"))
    return target_sample.short_cells(plan).select("consequence", "label")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return target_sample.variant_plan(table(spark, d, "variants"), table(spark, d, "sample_targets")).drop("signature")


def p6_cells(spark: SparkSession, d: str) -> DataFrame:
    """What of the report is settled before the draw."""
    return p6_report(spark, d).select("consequence", "label", "available", "required", "met")


def _no_rule(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "rule string, at string")


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """Rules that the sample breaks (rule, at): its size, floors, counts as planned, rows drawn once, and no exchange of one row that lowers the deviation."""
    variants, targets = table(spark, d, "variants"), table(spark, d, "sample_targets")
    plan = written(target_sample.variant_plan(variants, targets), "plan")
    sample = written(target_sample.draw_variants(variants, plan), "sample")
    n = F.floor(variants.agg(F.count_distinct("variant_id")).scalar() / 10)
    cells = plan.join(targets.select("consequence", "label", "min_n"), ["consequence", "label"]).join(sample.groupBy("consequence", "label").agg(F.count("*").alias("drawn")), ["consequence", "label"], "left")
    cells = written(cells.withColumns({"drawn": F.coalesce("drawn", F.lit(0)), "floor": F.least("min_n", "available"), "target": F.greatest(F.col("target_share") * n, "min_n")}), "cells")
    name, gap = F.concat_ws("|", "consequence", "label"), F.col("drawn") - F.col("target")
    given, taken = F.when(F.col("drawn") > F.col("floor"), F.abs(gap) - F.abs(gap - 1)), F.when(F.col("drawn") < F.col("available"), F.abs(gap) - F.abs(gap + 1))
    size = sample.agg(F.count("*")).scalar()
    whole = cells.agg(F.sum("drawn").alias("s"), F.sum("available").alias("a"), F.sum("floor").alias("f"), F.max(given).alias("give"), F.max(taken).alias("get"))
    broken = [
        cells.filter("drawn <> taken or drawn < floor").select(F.lit("count or floor").alias("rule"), name.alias("at")),
        sample.groupBy("row_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("drawn twice"), F.col("row_id").cast("string")),
        whole.filter((F.col("s") != F.greatest(F.least(n, F.col("a")), F.col("f"))) | (F.col("s") != size)).select(F.lit("size"), F.col("s").cast("string")),
        whole.filter("give + get > 1e-6").select(F.lit("an exchange helps"), F.lit("")),
    ]
    return reduce(DataFrame.unionAll, broken, _no_rule(spark))


def p2_check(spark: SparkSession, d: str) -> DataFrame:
    """Rules that the split breaks (rule, at): a gene or a variant in two splits, rows lost or doubled, a share more than a point off."""
    split = written(p2_split(spark, d), "split")
    rows = grouped_splits.split_rows(table(spark, d, "gene_split")).select("variant_id", "gene_name").distinct()
    asked = F.element_at(F.create_map(*[F.lit(x) for pair in {"train": 0.8, "validation": 0.1, "test": 0.1}.items() for x in pair]), "split")
    whole = split.agg(F.count("*")).scalar()
    several = lambda key: split.groupBy(key).agg(F.count_distinct("split").alias("n")).filter("n > 1").select(F.lit(f"{key} in several splits").alias("rule"), F.col(key).alias("at"))
    missing = rows.join(split, ["variant_id", "gene_name"], "left_anti").select(F.lit("missing"), "variant_id")
    doubled = split.groupBy("variant_id", "gene_name").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("doubled"), "variant_id")
    off = grouped_splits.split_shares(split).filter(F.abs(F.col("n_rows") / whole - asked) > 0.01 + 100 / whole).select(F.lit("share"), "split")
    return reduce(DataFrame.unionAll, [several("gene_name"), several("variant_id"), several("group_gene"), missing, doubled, off], _no_rule(spark))


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    return target_sample.variant_sample(table(spark, d, "variants"), table(spark, d, "sample_targets"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    weights = table(spark, d, "source_weights")
    sized = mixing.sized_documents(table(spark, d, "documents"))
    return sized, mixing.length_plan(sized, weights), weights


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    _, plan, weights = _plan(spark, d)
    return mixing.mix_report(plan, weights).filter("short").select("source")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    _, plan, weights = _plan(spark, d)
    return mixing.mix_report(plan, weights)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    weights = table(spark, d, "source_weights")
    sized = written(mixing.sized_documents(table(spark, d, "documents")), "sized")  # counted once, read twice
    return mixing.mixed_documents(sized, mixing.length_plan(sized, weights))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Rules that the mixture breaks (rule, at): a document repeated too often, sums unlike the report, a source that has enough and lies more than its shortest document below its target."""
    weights = table(spark, d, "source_weights")
    sized = written(mixing.sized_documents(table(spark, d, "documents")), "sized")
    plan = mixing.length_plan(sized, weights)
    report, mix = mixing.mix_report(plan, weights), written(mixing.mixed_documents(sized, plan), "mix")
    used = mix.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t"), F.max("copies").alias("most"))
    least = sized.filter("n_tokens > 0").groupBy("source").agg(F.min("n_tokens").alias("least"))
    rows = written(report.join(used, "source", "left").join(least, "source", "left").fillna(0, ["t", "most"]), "rows")
    broken = [
        rows.filter("most > max_repeat").select(F.lit("repeated too often").alias("rule"), F.col("source").alias("at")),
        rows.filter("t <> used or t > target").select(F.lit("sum"), "source"),
        rows.filter("not short and target - t >= least + 1").select(F.lit("too little"), "source"),
        rows.filter("short and t <> max_repeat * size").select(F.lit("short and not used up"), "source"),
    ]
    return reduce(DataFrame.unionAll, broken, _no_rule(spark))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """What of the rates is settled: the documents of each source."""
    return p9_rates(spark, d).select("source", "n_docs")


def _scores(spark: SparkSession, d: str, keep: tuple[str, ...] = ()) -> DataFrame:
    documents = table(spark, d, "documents")
    return content.score_documents(documents, content.fit_content(documents, table(spark, d, "doc_labels")), keep=keep)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).filter("score >= 0.5").select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return content.source_rates(_scores(spark, d, keep=("source",)))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_split, p2_check, p3_found, p5_found, p5_capped, p6_found, p6_report, p6_cells, p6_sample, p6_check, p7_ids, p8_found, p8_report, p8_mix, p8_check, p9_found, p9_scores,
        p9_rates, p9_documents,
    )
}

_P5 = f"""
WITH r AS (SELECT {sql_gene('gene_name')} AS gene_name, {sql_stars('stars')} AS stars, allele_id, row_id FROM {SQL_LATEST}),
p AS (SELECT *, row_number() OVER (PARTITION BY gene_name ORDER BY stars DESC, allele_id ASC NULLS LAST, row_id ASC) AS place, count(*) OVER (PARTITION BY gene_name) AS n
      FROM r WHERE gene_name IS NOT NULL)
"""
_CELL = f"{sql_consequence('consequence')} || '|' || {sql_term('label')}"
_P6 = f"""
WITH l AS (SELECT {_CELL} AS s FROM {SQL_LATEST}),
n AS (SELECT floor(count(DISTINCT variant_id) / 10) AS n FROM variants),
a AS (SELECT s, count(*) AS available FROM l WHERE s IS NOT NULL GROUP BY 1),
t AS (SELECT consequence, label, target_share, min_n, {_CELL} AS s FROM sample_targets),
r AS (SELECT t.*, coalesce(available, 0) AS available, greatest(min_n, floor(target_share * n)) AS required FROM t LEFT JOIN a USING (s), n)
"""
ORACLE = {
    "p2_found": f"""
WITH RECURSIVE r AS (
  SELECT {sql_variant('variant_id')} AS v, {sql_gene('gene_name')} AS g, nullif(lower(substr(trim(split, ' '), 1, 3)), '') AS s
  FROM gene_split WHERE variant_id IS NOT NULL AND gene_name IS NOT NULL AND split IS NOT NULL),
k AS (SELECT * FROM r WHERE g IS NOT NULL AND s IS NOT NULL),
e AS (SELECT DISTINCT a.g AS a, b.g AS b FROM k a JOIN k b ON a.v = b.v),
w AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a),
c AS (SELECT a AS gene_name, min(b) AS group_gene FROM w GROUP BY 1),
x AS (SELECT group_gene FROM k JOIN c ON k.g = c.gene_name GROUP BY 1 HAVING count(DISTINCT s) > 1)
SELECT group_gene, gene_name FROM c WHERE group_gene IN (SELECT group_gene FROM x)""",
    "p3_found": f"""
WITH s AS (
  SELECT {sql_variant('variant_id')} AS variant_id, score, scored_at FROM scores WHERE variant_id IS NOT NULL AND score BETWEEN 0 AND 1 AND NOT isnan(score)
  QUALIFY row_number() OVER (PARTITION BY {sql_variant('variant_id')} ORDER BY scored_at DESC NULLS LAST, score DESC) = 1),
g AS (SELECT variant_id, {sql_gene('gene_name')} AS gene_name FROM {SQL_LATEST})
SELECT gene_name, row_number() OVER (PARTITION BY gene_name ORDER BY score DESC, variant_id ASC)::INT AS rank_no, variant_id
FROM s JOIN g USING (variant_id) WHERE gene_name IS NOT NULL
QUALIFY rank_no <= 3""",
    "p5_found": _P5 + "SELECT gene_name, row_id FROM p WHERE n > 20 AND place <= 20",
    "p5_capped": _P5 + "SELECT gene_name, row_id, place::INT AS place FROM p WHERE place <= 20",
    "p6_found": _P6 + "SELECT consequence, label FROM r WHERE available < required",
    "p6_cells": _P6 + "SELECT consequence, label, available::BIGINT AS available, required::BIGINT AS required, available >= required AS met FROM r",
    "p9_documents": "SELECT source, count(*) AS n_docs FROM documents GROUP BY 1",
    **{f"p{n}_check": "SELECT ''::VARCHAR AS rule, ''::VARCHAR AS at WHERE false" for n in (2, 6, 8)},  # nothing may break a rule
}
