"""Queries p1 and p4 with their SQL twins, and the SQL forms of the reading rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import consequence_key, gene_key, star_rank
from ..operators.dense_keys import dense_totals, heavy_keys
from ..operators.packed_values import split_packed_by_terms
from ..sources.tables import table

SQL_BLANKS = "' ' || chr(9) || chr(13) || chr(10)"


def sql_gene(c: str) -> str:
    return f"nullif(upper(trim(split_part({c}, ':', 1), {SQL_BLANKS})), '')"


def sql_variant(c: str) -> str:
    return f"(CASE WHEN trim({c}, {SQL_BLANKS}) LIKE 'chr%' THEN trim({c}, {SQL_BLANKS}) ELSE 'chr' || trim({c}, {SQL_BLANKS}) END)"


def sql_term(c: str) -> str:
    return f"nullif(translate(lower(trim({c}, {SQL_BLANKS})), ' -', '__'), '')"


def sql_consequence(c: str) -> str:
    return sql_term(f"regexp_replace({c}, '^\\s*SO:\\d+\\|', '')")


def sql_stars(c: str) -> str:
    return f"(CASE WHEN {c} BETWEEN 0 AND 4 THEN {c}::INT ELSE 0 END)"


SQL_LATEST = "(SELECT * FROM variants WHERE variant_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY loaded_at DESC NULLS LAST, row_id DESC NULLS LAST) = 1)"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed_by_terms(table(spark, d, "variants"), "row_id", ["disease_name", "clinical_significance"], table(spark, d, "terms"))


def spelled(keys: DataFrame, targets: DataFrame) -> DataFrame:
    """Consequence keys as ``sample_targets`` spells them; those it does not hold stay in comparison form."""
    spelling = targets.groupBy(consequence_key(F.col("consequence")).alias("key_value")).agg(F.min("consequence").alias("__as")).withColumn("field_name", F.lit("consequence"))
    joined = keys.join(spelling, ["field_name", "key_value"], "left")
    return joined.withColumn("key_value", F.coalesce("__as", "key_value")).drop("__as")


def _totals(spark: SparkSession, d: str, measures: dict | None = None) -> DataFrame:
    keys = {"gene_name": gene_key(F.col("gene_name")), "consequence": consequence_key(F.col("consequence"))}
    return dense_totals(table(spark, d, "variants"), keys, measures)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return spelled(heavy_keys(_totals(spark, d), 0.02), table(spark, d, "sample_targets")).select("field_name", "key_value")


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows, summed stars and rows with an allele id of every gene and consequence."""
    totals = _totals(spark, d, {"sum_stars": star_rank(F.col("stars")), "n_allele_ids": F.col("allele_id").isNotNull().cast("int")})
    named = spelled(totals.filter("key_value is not null"), table(spark, d, "sample_targets"))
    return named.select("field_name", "key_value", "n_rows", F.col("sum_stars").cast("bigint").alias("sum_stars"), F.col("n_allele_ids").cast("bigint").alias("n_allele_ids"))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_totals": p4_totals}

_P4 = f"""
WITH keyed AS (
  SELECT 'gene_name' AS field_name, {sql_gene('gene_name')} AS k, stars, allele_id FROM variants
  UNION ALL SELECT 'consequence', {sql_consequence('consequence')}, stars, allele_id FROM variants),
spelling AS (SELECT {sql_consequence('consequence')} AS k, min(consequence) AS s FROM sample_targets GROUP BY 1),
totals AS (SELECT field_name, k, count(*) AS n_rows, sum({sql_stars('stars')})::BIGINT AS sum_stars, count(allele_id)::BIGINT AS n_allele_ids FROM keyed GROUP BY 1, 2),
named AS (SELECT t.*, CASE WHEN field_name = 'consequence' THEN coalesce(s, t.k) ELSE t.k END AS key_value FROM totals t LEFT JOIN spelling p ON t.k = p.k)
"""
ORACLE = {
    "p4_found": _P4 + "SELECT field_name, key_value FROM named WHERE k IS NOT NULL AND n_rows * 50 >= (SELECT count(*) FROM variants)",
    "p4_totals": _P4 + "SELECT field_name, key_value, n_rows, sum_stars, n_allele_ids FROM named WHERE k IS NOT NULL",
}
