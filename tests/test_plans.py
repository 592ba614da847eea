"""What the physical plans must hold: pruned scans, rank limits before shuffles, no single-task windows over rows, no cartesian products."""

from pathlib import Path

import pytest

from locusframe.operators import curation
from locusframe.operators.latest import latest_variants
from locusframe.plans import catalogue
from locusframe.sources.tables import table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_rows_are_cut_before_the_shuffle(spark):
    text = plan(latest_variants(table(spark, FOLDER, "variants")).select("variant_id", "gene_name"))
    assert text.count("WindowGroupLimit") == 2 and "disease_name" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(curation.valid_scores(table(spark, FOLDER, "scores")))
    assert "GreaterThanOrEqual(score,0.0)" in text and "ReadSchema: struct<variant_id:string,score:double,scored_at:timestamp_ntz>" in text
    gene = plan(curation.inside_gene(table(spark, FOLDER, "variants"), curation.gene_table(table(spark, FOLDER, "genes"))).select("variant_id", "gene_id"))
    assert "BroadcastHashJoin" in gene and "disease_name" not in gene


def test_packed_fields_need_no_shuffle(spark):
    text = plan(catalogue.QUERIES["p1_found"](spark, FOLDER))
    assert "Exchange" not in text and "ReadSchema: struct<row_id:bigint,clinical_significance:string,disease_name:string>" in text.replace("disease_name:string,clinical_significance:string", "clinical_significance:string,disease_name:string")


@pytest.mark.parametrize("name", ["metric_stratified", "deconfounded_quota", "gene_holdout_split", "shard_assignment", "p4_found"])
def test_no_products(spark, name):
    text = plan(catalogue.QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_single_task_windows_only_over_partition_counts(spark):
    """The one unpartitioned window sums one row per partition."""
    text = plan(curation.shuffled(table(spark, FOLDER, "variants").select("variant_id")))
    before = text[text.index("Window") :]
    assert "sum(__n" in before and before.count("SinglePartition") == 1


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from locusframe import session

    conf = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(master="spark://host:7077", applicationId="x", getConf=lambda: conf)
    with pytest.raises(ValueError):
        session.shared_folder(SimpleNamespace(conf=conf, sparkContext=context))
