import gzip

import pytest

from locusframe.operators.curation import labeled
from locusframe.sources import fasta, files, gtf, vcf
from locusframe.streaming.resume import process_new_files

VCF = """##fileformat=VCFv4.1
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO
1\t101\t.\tA\tG\t.\t.\tGENEINFO=BRCA1:672|NBR2:10230;CLNSIG=Pathogenic;CLNREVSTAT=reviewed_by_expert_panel;MC=SO:0001583|missense_variant,SO:0001627|intron_variant;CLNDN=Breast_cancer|not_provided;ALLELEID=42;RS=99
MT\t5\t.\tA\tAT,G\t.\t.\tGENEINFO=MT1:1;CLNDN=not_provided|X;MC=intron;ALLELEID=x
2\t7\t.\tAT\tGC\t.\t.\tGENEINFO=G:1
2\t8\t.\tA\t.\t.\t.\tGENEINFO=G:1
2\t9\t.\tA\tC\t.\t.\tGENEINFO=G
2\t10\t.\tA\tC\t.\t.\tCLNSIG=Benign
3\t11\t.\tAT\tA\t.\t.\tFLAG;GENEINFO=H:2;CLNSIG=Likely_benign;CLNREVSTAT=odd
"""


def test_vcf(spark, tmp_path, rows):
    (tmp_path / "a.vcf.gz").write_bytes(gzip.compress(VCF.encode()))
    df = vcf.read_vcf(spark, str(tmp_path / "a.vcf.gz"))
    got = {r.gene_name: r for r in df.collect()}
    assert set(got) == {"BRCA1", "MT1", "H"}
    b = got["BRCA1"]
    assert (b.chrom, b.pos, b.variant_type, b.label, b.clinical_significance, b.stars, b.consequence, b.disease_name, b.allele_id, b.rs_id) == (
        "chr1", 100, "snv", "pathogenic", "pathogenic", 3, "missense_variant", "Breast cancer", 42, "rs99",
    )
    m = got["MT1"]
    assert (m.chrom, m.alt, m.variant_type, m.disease_name, m.consequence, m.allele_id, m.label, m.stars, m.rs_id) == ("chrM", "AT", "insertion", None, None, None, "other", 0, None)
    assert got["H"].variant_type == "deletion" and got["H"].stars == 0
    assert [r.gene_name for r in labeled(df).collect()] == ["BRCA1"]


def test_gtf(spark, tmp_path):
    text = '#x\nchr1\tH\tgene\t5\t20\t.\t+\t.\tgene_id "E1.7"; gene_type "protein_coding"; gene_name "A"; level 2; hgnc_id "HGNC:1";\n'
    text += 'chr2\tH\tgene\t1\t9\t.\t-\t.\tgene_id "E2.1_PAR_Y"; gene_biotype "protein_coding"; gene_name "B";\nchr2\tH\tgene\t1\t9\t.\t-\t.\tgene_id "E3"; gene_type "lncRNA";\nchr2\tH\texon\t1\t9\t.\t-\t.\tgene_id "E2";\n'
    (tmp_path / "a.gtf").write_text(text)
    got = sorted(tuple(r) for r in gtf.read_gtf(spark, str(tmp_path / "a.gtf")).collect())
    assert got == [("E1", "A", "1", 4, 20, "+", 16, "HGNC:1", 2), ("E2.1_PAR_Y", "B", "2", 0, 9, "-", 9, "", 0)]


def test_fasta(spark, tmp_path):
    chr1, chr2 = "ACGTNacgtn" * 13, "TTTACG" * 5
    lines = lambda s, n: "\n".join(s[i : i + n] for i in range(0, len(s), n))
    (tmp_path / "g.fa").write_text(f">chr1 first\n{lines(chr1, 11)}\n>2\n\n{lines(chr2, 60)}\n>chrUn\nAAAA\n")
    got = {}
    for r in fasta.read_fasta(spark, str(tmp_path / "g.fa"), 16).orderBy("chrom", "bin").collect():
        assert len(r.seq) == 16 or r.seq
        got[r.chrom] = got.get(r.chrom, "") + r.seq
    assert got == {"1": chr1.upper(), "2": chr2}


def test_fasta_in_many_splits(spark, tmp_path):
    s = "ACGGT" * 4000
    (tmp_path / "g.fa").write_text(">1\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n>X\nAC\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        tiles = fasta.read_fasta(spark, str(tmp_path / "g.fa"), 1000).orderBy("chrom", "bin").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert "".join(r.seq for r in tiles if r.chrom == "1") == s and [r.seq for r in tiles if r.chrom == "X"] == ["AC"]


def test_manifest_ids_checkpoint(spark, tmp_path, rows):
    (tmp_path / "m.csv").write_text("variant_id,chrom,pos,ref_corrected,alt_corrected,label\nv1,chr1,5,A,C,pathogenic\nv2,2,6,A,C,vus\nv3,X,7,A,C,1\nv4,X,8,A,C,1.0\nv5,X,9,A,C,0.0\nv6,X,9,A,C,\n")
    assert rows(files.read_manifest(spark, str(tmp_path / "m.csv"))) == [("v1", "1", 5, "A", "C", 1), ("v2", "2", 6, "A", "C", 0), ("v3", "X", 7, "A", "C", 1), ("v4", "X", 8, "A", "C", 1), ("v5", "X", 9, "A", "C", 0), ("v6", "X", 9, "A", "C", 0)]
    assert files.read_ids(spark, str(tmp_path / "m.csv")).count() == 6
    (tmp_path / "done.txt").write_text("v1\n\n  v2 \n")
    assert rows(files.read_checkpoint(spark, str(tmp_path / "done.txt"))) == [("v1",), ("v2",)]
    assert files.read_checkpoint(spark, str(tmp_path / "none.txt")).count() == 0


def test_shards_sinks_cache(spark, tmp_path, rows):
    for i in (0, 2):
        spark.createDataFrame([(f"v{i}", 0.5)], "variant_id string, score double").write.parquet(str(tmp_path / f"s/scores_shard_{i}"))
    assert rows(files.read_shards(spark, str(tmp_path / "s"))) == [("v0", 0.5, 0), ("v2", 0.5, 2)]
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    path = str(tmp_path / "c")
    assert files.cached(spark, path, build).count() == files.cached(spark, path, build).count() == 3 and len(built) == 1
    assert files.cached(spark, path, build, refresh=True).count() == 3 and len(built) == 2
    (tmp_path / "c/_SUCCESS").unlink()  # not written to the end
    assert files.cached(spark, path, build).count() == 3 and len(built) == 3
    assert files.shard_name(7) == "scores_shard_7"
    with pytest.raises(FileNotFoundError):
        files.cached(spark, str(tmp_path / "no"), None)
    out = str(tmp_path / "a")
    files.append_missing(spark.range(3), out, "id")
    files.append_missing(spark.range(5), out, "id")
    assert files.read_table(spark, out, ["id"]).count() == 5
    files.write_metrics(spark.range(2), str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 2
    files.write_config({"a": 1}, str(tmp_path / "x/config.json"))
    files.write_table(spark.range(4).selectExpr("id", "id % 2 as shard"), str(tmp_path / "t"), "shard")
    assert files.read_table(spark, str(tmp_path / "t")).filter("shard = 1").count() == 2
    files.write_shards(spark.createDataFrame([(9, 1)], "id long, shard int"), str(tmp_path / "t"))
    assert rows(files.read_table(spark, str(tmp_path / "t"))) == [(0, 0), (2, 0), (9, 1)]
    assert files.read_vectors(spark, str(tmp_path / "t"), spark.range(1, 10), "id").count() == 2


def test_stream_resumes(spark, tmp_path):
    source, sink, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    spark.range(3).write.parquet(f"{source}/a")
    run = lambda: process_new_files(spark, source, spark.range(1).schema, lambda d: d.selectExpr("id * 2 as twice"), sink, progress).awaitTermination()
    run()
    spark.range(3, 5).write.parquet(f"{source}/b")
    run()
    assert sorted(r.twice for r in spark.read.parquet(sink).collect()) == [0, 2, 4, 6, 8]
