"""Queries that write a table as a file of another kind into the shared folder and read it back, with SQL twins on the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import gene_key, variant_key
from ..operators import curation, genome, validation
from ..session import fresh_path
from ..sources import fasta, files, gtf, vcf
from ..sources.tables import table
from . import reference as r
from .numbered import sql_gene

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


# Characters that a VCF field writes as codes.
CODES = (("%", "%25"), (";", "%3B"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"))


def _coded(c: Column) -> Column:
    for plain, code in CODES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def _sql_coded(c: str) -> str:
    for plain, code in CODES:
        c = f"replace({c}, chr({ord(plain)}), '{code}')"
    return c


def _vcf_lines(variants: DataFrame) -> DataFrame:
    """One line a row: a second ALT allele, codes for what separates, no GENEINFO for rows without a gene."""
    status = F.element_at(F.array(*map(F.lit, r._STATUS)), (F.col("row_id") % 6 + 1).cast("int"))
    fields = {
        "GENEINFO": F.when(gene_key(F.col("gene_name")).isNotNull(), F.concat(_coded(F.col("gene_name")), F.lit(":1|X:2"))), "CLNSIG": _coded(F.col("clinical_significance")),
        "CLNREVSTAT": status, "MC": F.concat(F.lit("SO:1|"), _coded(F.col("consequence"))), "CLNDN": F.replace(_coded(F.col("disease_name")), F.lit(" "), F.lit("_")),
        "ALLELEID": F.col("allele_id").cast("string"), "RS": F.substring("rs_id", 3, 20),
    }
    info = F.concat_ws(";", F.lit("FLAG"), *[F.concat(F.lit(f"{k}="), c) for k, c in fields.items()])
    bare = F.regexp_replace("chrom", "^chr", "")
    chrom = F.when(bare == "M", "MT").otherwise(bare)
    return variants.select(F.concat_ws("\t", chrom, (F.col("pos") + 1).cast("string"), F.lit("."), "ref", F.concat("alt", F.lit(","), "ref"), F.lit("."), F.lit("."), info).alias("value"))


def _vcf_file(spark: SparkSession, d: str) -> str:
    path = fresh_path(spark, "calls.vcf")
    header = spark.range(1).select(F.lit("##fileformat=VCFv4.1").alias("value"))
    header.unionByName(_vcf_lines(table(spark, d, "variants"))).write.text(path)
    return path


_KIND = "CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'snv' WHEN length(alt) > length(ref) THEN 'insertion' WHEN length(alt) < length(ref) THEN 'deletion' END"
_READ = f"""WITH x AS (SELECT *, {_sql_coded('gene_name')} AS g, lower(coalesce({_sql_coded('clinical_significance')}, '')) AS s, {_sql_coded('consequence')} AS c, {_sql_coded('disease_name')} AS dn,
  {r._STATUS_SQL} AS st FROM variants WHERE {sql_gene('gene_name')} IS NOT NULL)
SELECT chrom, pos, ref, alt, {_KIND} AS variant_type, split_part(g, ':', 1) AS gene_name, {r._SIG} AS label, s AS clinical_significance,
  (CASE st {" ".join(f"WHEN '{k}' THEN {v}" for k, v in r.annotate.REVIEW_STARS.items())} ELSE 0 END)::TINYINT AS stars, string_split(split_part('SO:1|' || c, ',', 1), '|')[-1] AS consequence, allele_id,
  CASE WHEN dn <> '' AND lower(replace(split_part(dn, '|', 1), '_', ' ')) NOT IN ('not provided', 'not specified') THEN replace(split_part(dn, '|', 1), '_', ' ') END AS disease_name,
  CASE WHEN length(rs_id) > 2 THEN 'rs' || substring(rs_id, 3, 20) END AS rs_id
FROM x WHERE {_KIND} IS NOT NULL"""


@query(_READ)
def vcf_read(spark: SparkSession, d: str) -> DataFrame:
    """Every row as a line of a VCF file, read again: packed fields and uneven spellings included."""
    return vcf.read_vcf(spark, _vcf_file(spark, d))


@query(f"""WITH n AS (SELECT count(*) AS a, count(*) FILTER ({_KIND} IS NOT NULL) AS b, count(*) FILTER ({_KIND} IS NOT NULL AND {sql_gene('gene_name')} IS NOT NULL) AS c FROM variants),
{r.CUR}, i AS (SELECT variant_id FROM cur JOIN genes USING (gene_name) WHERE pos >= gene_start AND pos + length(ref) <= gene_end), e AS (SELECT DISTINCT variant_id FROM i JOIN cur USING (variant_id) JOIN genes USING (gene_name)),
k AS (SELECT (SELECT count(*) FROM cur) AS u, (SELECT count(*) FROM i) AS v, (SELECT count(*) FROM e) AS w)
SELECT 'lines' AS step, a AS n_rows, a - b AS n_dropped FROM n UNION ALL SELECT 'simple changes', b, b - c FROM n UNION ALL SELECT 'with a gene', c, 0 FROM n
UNION ALL SELECT 'curated', u, u - v FROM k UNION ALL SELECT 'inside their gene', v, v - w FROM k UNION ALL SELECT 'enriched', w, 0 FROM k""")
def dropped_counts(spark: SparkSession, d: str) -> DataFrame:
    """What each step of parsing, containment and enrichment drops, counted while the rows pass."""
    parsing: dict = {}
    vcf.read_vcf(spark, _vcf_file(spark, d), steps=parsing).write.format("noop").mode("overwrite").save()
    joining: dict = {}
    genes = r._genes(spark, d)
    inside = curation.inside_gene(validation.counted(r._variants(spark, d), "curated", joining), genes).drop("gene_id", "start", "end", "strand")
    validation.counted(curation.enrich(validation.counted(inside, "inside their gene", joining), genes), "enriched", joining).write.format("noop").mode("overwrite").save()
    counts = validation.dropped_counts(parsing) | validation.dropped_counts(joining)
    return spark.createDataFrame([(k, n, x) for k, (n, x) in counts.items()], "step string, n_rows bigint, n_dropped bigint")


@query(f"WITH {r._DOC_GENOME} SELECT doc_id::VARCHAR AS chrom, b::BIGINT AS bin, md5(substring(t, (b * 4096 + 1)::INT, 4096)) AS seq_md5 FROM (SELECT doc_id, t, unnest(range(0, (n - 1) // 4096 + 1)) AS b FROM c)")
def fasta_read(spark: SparkSession, d: str) -> DataFrame:
    """The letters of every document as a record with lines of 60, read as tiles."""
    path = fresh_path(spark, "genome.fa")
    records = r._doc_letters(spark, d)
    records.select(F.concat(F.lit(">chr"), "chrom", F.lit(" letters of a document\n"), F.regexp_replace("sequence", "(.{60})(?=.)", "$1\n")).alias("value")).write.text(path)
    return fasta.read_fasta(spark, path, 4096, known=None).select("chrom", "bin", F.md5("seq").alias("seq_md5"))


@query(r.ORACLE["gtf_parse"])
def gtf_read(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "genes.gtf")
    r.gtf_lines(table(spark, d, "genes")).write.text(path)
    return gtf.read_gtf(spark, path)


@query(f"WITH {r.CUR} SELECT variant_id, regexp_replace(chrom, '^chr', '') AS chrom, pos, ref, alt, CASE WHEN label = 'pathogenic' THEN 1 ELSE 0 END AS label FROM cur")
def manifest_read(spark: SparkSession, d: str) -> DataFrame:
    """A manifest as CSV whose labels are words, whole numbers and numbers with a point."""
    path = fresh_path(spark, "manifest.csv")
    bad = (F.col("label") == "pathogenic").cast("int")
    label = F.when(F.col("pos") % 3 == 0, F.coalesce(bad, F.lit(0)).cast("double").cast("string")).when(F.col("pos") % 3 == 1, F.coalesce(bad, F.lit(0)).cast("string")).otherwise(F.col("label"))
    rows = r._variants(spark, d).select("variant_id", "chrom", "pos", F.col("ref").alias("ref_corrected"), F.col("alt").alias("alt_corrected"), label.alias("label"))
    rows.write.csv(path, header=True)
    return files.read_manifest(spark, path)


@query(r.ORACLE["checkpoint_resume"])
def checkpoint_read(spark: SparkSession, d: str) -> DataFrame:
    """What a checkpoint of one id a line, with blank lines between, leaves to do."""
    path = fresh_path(spark, "done.txt")
    curation.valid_scores(table(spark, d, "scores")).select(F.concat(F.lit(" "), "variant_id", F.lit("\n"))).write.text(path)
    return validation.remaining(r._variants(spark, d).select("variant_id"), files.read_checkpoint(spark, path), "variant_id")


@query("SELECT shard, count(*) AS n_rows, count(score) AS n_scores, count(DISTINCT variant_id) AS n_ids FROM scores GROUP BY 1")
def shards_read(spark: SparkSession, d: str) -> DataFrame:
    """A folder a shard, all read again with the shard number from their names."""
    path = fresh_path(spark, "shards")
    files.write_shards(table(spark, d, "scores"), path)
    return files.read_shards(spark, path).groupBy("shard").agg(F.count("*").alias("n_rows"), F.count("score").alias("n_scores"), F.count_distinct("variant_id").alias("n_ids"))


@query(f"SELECT variant_id, 'split' AS source FROM {r._SPLIT_IDS} UNION ALL SELECT variant_id, 'scores' FROM {r._SCORE_IDS} WHERE variant_id NOT IN (SELECT variant_id FROM {r._SPLIT_IDS})")
def append_resume(spark: SparkSession, d: str) -> DataFrame:
    """Ids of two tables appended one after the other; the second adds only what is missing."""
    path = fresh_path(spark, "appended")
    for name, source in (("gene_split", "split"), ("scores", "scores")):
        ids = table(spark, d, name).select(variant_key(F.col("variant_id")).alias("variant_id")).filter("variant_id is not null").distinct()
        files.append_missing(ids.withColumn("source", F.lit(source)), path, "variant_id")
    return files.read_table(spark, path)


@query(f"WITH {r.CUR}, {r.BIN} SELECT variant_id, gene_name, label FROM bin WHERE stars >= 1")
def preset_cached(spark: SparkSession, d: str) -> DataFrame:
    """A set that is built once and then read: the second call has nothing to build it from."""
    path = fresh_path(spark, "preset")
    files.cached(spark, path, lambda: curation.labeled(r._variants(spark, d)))
    return files.cached(spark, path, None).select("variant_id", "gene_name", "label")


@query(f"WITH {r.CUR} SELECT variant_id, label, stars FROM cur WHERE label IS NOT NULL")
def table_write(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "table")
    files.write_table(r._variants(spark, d).filter("label is not null"), path, "label")
    return files.read_table(spark, path, ["variant_id", "label", "stars"])


@query(r.ORACLE["metric_stratified"])
def metrics_write(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "metrics")
    rows = r.metric_stratified(spark, d)
    files.write_metrics(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True)


@query(r.ORACLE["vector_scan"])
def vectors_of_listed_ids(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the ids that a CSV list holds."""
    path = fresh_path(spark, "ids.csv")
    table(spark, d, "variants").filter("variant_type = 'insertion'").select(F.col("row_id").alias("variant_id"), "chrom").write.csv(path, header=True)
    ids = files.read_ids(spark, path).select(F.col("variant_id").cast("bigint").alias("vec_id"))
    return files.read_vectors(spark, f"{d}/embeddings.parquet", ids, "vec_id").select("vec_id", "label")


_TILED = """w AS (SELECT v.row_id, v.variant_id, v.pos, v.ref, c.doc_id, c.t, c.n, v.pos % c.n AS q FROM (SELECT *, allele_id % (SELECT max(doc_id) + 1 FROM documents) AS doc FROM variants) v JOIN c ON c.doc_id = v.doc),
y AS (SELECT *, greatest(0, least(q - 300, n - least(400, n))) AS a FROM w)"""


@query(f"WITH {r._DOC_GENOME}, {_TILED} SELECT row_id, variant_id, a::BIGINT AS win_start, (a + least(400, n))::BIGINT AS win_end, md5(substring(t, (a + 1)::INT, least(400, n)::INT)) AS ref_md5, coalesce(substring(substring(t, (a + 1)::INT, least(400, n)::INT), (q - a + 1)::INT, length(ref)) = ref, false) AS ref_ok FROM y")
def genome_windows_of_rows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of every row of ``variants``, where one variant stands in many rows and many rows share a window; documents serve as chromosomes."""
    chromosomes = r._doc_genome(spark, d)
    last = table(spark, d, "documents").agg((F.max("doc_id") + 1).alias("n")).scalar()
    rows = table(spark, d, "variants").select("row_id", "variant_id", (F.col("allele_id") % last).cast("string").alias("chrom"), "pos", "ref", "alt")
    rows = rows.join(genome.lengths(genome.tiles(chromosomes, 256)).withColumnRenamed("chrom_length", "__n"), "chrom").withColumn("pos", F.col("pos") % F.col("__n")).drop("__n")
    out = genome.variant_windows(rows, genome.tiles(chromosomes, 256), 300, 100, 256)
    return out.select("row_id", "variant_id", "win_start", "win_end", F.md5("ref_window").alias("ref_md5"), "ref_ok")
