import random

import pytest
from pyspark.sql import functions as F

from locusframe.operators import probe
from locusframe.plans import pipeline


def test_from_files_to_metrics(spark, tmp_path):
    rng = random.Random(8)
    chrom = "".join(rng.choice("ACGT") for _ in range(3000))
    (tmp_path / "g.fa").write_text(">chr1\n" + "\n".join(chrom[i : i + 70] for i in range(0, 3000, 70)) + "\n")
    genes = [(f"G{i}", 10 + i * 250, 10 + i * 250 + 240) for i in range(11)]
    (tmp_path / "g.gtf").write_text("".join(f'chr1\tx\tgene\t{a + 1}\t{b}\t.\t+\t.\tgene_id "E{n}.1"; gene_type "protein_coding"; gene_name "{n}";\n' for n, a, b in genes))
    lines = []
    for i in range(160):
        n, a, b = rng.choice(genes)
        p = rng.randrange(a, b - 2)
        alt = rng.choice([x for x in "ACGT" if x != chrom[p]])
        ref = chrom[p] if i % 10 else alt  # every tenth call has a wrong reference base
        sig = ("Pathogenic", "Benign", "Uncertain_significance")[i % 3]
        lines.append(f"1\t{p + 1}\t.\t{ref}\t{alt if ref != alt else chrom[p]}\t.\t.\tGENEINFO={n}:1;CLNSIG={sig};CLNREVSTAT=practice_guideline;MC=SO:1|missense_variant;ALLELEID={i}")
    (tmp_path / "c.vcf").write_text("##x\n" + "\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    tiled = pipeline.build_genome(spark, str(tmp_path / "g.fa"), out, size=512)
    table = pipeline.build_genes(spark, str(tmp_path / "g.gtf"), tiled, out)
    variants = pipeline.build_variants(spark, str(tmp_path / "c.vcf"), table, tiled, out, size=512)
    assert table.count() == 11 and 120 < variants.count() <= 144
    meta = pipeline.preset_metadata(spark, "labeled", variants, table, out)
    assert len(meta.columns) == 20 and {r.label for r in meta.select("label").distinct().collect()} == {"pathogenic", "benign"}
    assert pipeline.preset_metadata(spark, "unlabeled", variants, table, out).filter("label <> 'vus'").count() == 0
    assert pipeline.preset_metadata(spark, "pilot", variants, table, out).count() > 0
    with pytest.raises(ValueError):
        pipeline.preset_metadata(spark, "other", variants, table, out)
    manifest = meta.withColumn("chrom", F.regexp_replace("chrom", "^chr", "")).select("variant_id", "chrom", "pos", "ref", "alt")
    selected, means, wrong, failed = pipeline.harvest(manifest, tiled, probe.hashed_model(4), k=6, window=2, upstream=30, downstream=12, size=512)
    selected = selected.cache()
    assert wrong.count() == 0 and failed.count() == 0 and selected.count() == manifest.count() * 12
    assert means.count() == manifest.count() * 6 and {r.view for r in means.collect()} == {"var_same", "ref_same", "ref_cross"}
    assert selected.filter("dir = 0 and pos >= 0").join(manifest.select("variant_id", F.col("pos").alias("v")), "variant_id").filter("pos <= v").count() == 0
    labels = meta.select("variant_id", "gene_name", (F.col("label") == "pathogenic").cast("int").alias("label"))
    split, scores = pipeline.train_and_score(selected, labels, 4, 4)
    result = {r.stratum: r for r in pipeline.evaluate(scores, meta, split, "all", 10).collect()}
    assert set(result) == {"overall", "inframe_coding", "non_splice"}
    assert 0 <= result["overall"].auroc_ci_lo <= result["overall"].auroc_ci_hi <= 1 and result["overall"].n_variants == meta.count()
