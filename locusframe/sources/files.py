"""Manifests, id lists, shard files, checkpoints, caches and sinks."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.annotate import bare_chrom
from ..session import exists


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, only the named columns of it."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def harvest_manifest(df: DataFrame) -> DataFrame:
    """(variant_id, chrom, pos, ref, alt, label): corrected alleles where there are no plain ones, bare chromosome, label 1 for pathogenic else 0."""
    for old, new in (("ref_corrected", "ref"), ("alt_corrected", "alt")):
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    text = dict(df.dtypes)["label"] == "string"
    number = F.expr("cast(try_cast(label as double) as int)") if text else F.col("label").cast("int")
    label = F.when(number.isNotNull(), number).otherwise(F.when(F.col("label") == "pathogenic", 1).otherwise(0)) if text else number
    return df.select("variant_id", bare_chrom(F.col("chrom")).alias("chrom"), F.col("pos").cast("bigint").alias("pos"), "ref", "alt", label.alias("label"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest CSV with a header; every column is read as text and cast by name, so nothing is inferred."""
    return harvest_manifest(spark.read.csv(path, header=True))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True).select("variant_id")


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """(variant_id): one id per non-blank line; a missing file holds none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "variant_id string")
    return spark.read.text(path).select(F.trim("value").alias("variant_id")).filter("variant_id <> ''")


def shard_name(shard: int, of: str = "scores_shard") -> str:
    return f"{of}_{shard}"


def read_shards(spark: SparkSession, folder: str, pattern: str = r"shard[_=](\d+)") -> DataFrame:
    """All shard files under ``folder`` with their ``shard`` number, which stands in their path: scores_shard_3 or shard=3. Without a number it is null."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    return df.withColumn("shard", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).try_cast("int"))


def read_vectors(spark: SparkSession, path: str, ids: DataFrame | None = None, key: str = "variant_id") -> DataFrame:
    """A vector dataset, only the rows whose key stands in ``ids`` when given."""
    df = spark.read.parquet(path)
    return df if ids is None else df.join(ids.select(key).distinct(), key, "left_semi")


def write_shards(df: DataFrame, folder: str, shard: str = "shard") -> None:
    """One folder per shard; a repeated write replaces only the shards it holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(folder)


def write_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "errorifexists") -> None:
    """Parquet through the commit protocol: readers see all of it or nothing."""
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A small metrics table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_config(config: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(config, indent=2, sort_keys=True, default=str))


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame] | None, refresh: bool = False) -> DataFrame:
    """The table at ``path``, built and written first where it is missing or ``refresh`` is set."""
    if not refresh and exists(spark, f"{path}/_SUCCESS"):  # written to the end
        return spark.read.parquet(path)
    if build is None:
        raise FileNotFoundError(f"no table at {path} and nothing to build it from")
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_missing(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose ``key`` the table at ``path`` does not hold yet, and return what was missing before."""
    spark = df.sparkSession
    todo = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti") if exists(spark, path) else df
    todo.write.mode("append").parquet(path)
    return todo
