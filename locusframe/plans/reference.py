"""Queries of the variant operators with their SQL twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import annotate, seq, vectors
from ..functions.keys import gene_key, split_key, variant_key
from ..operators import activations, curation, genome, metrics, probe, validation
from ..session import written
from ..sources import files, gtf, vcf
from ..sources.tables import table
from .numbered import SQL_BLANKS, SQL_LATEST, sql_consequence, sql_gene, sql_stars, sql_term, sql_variant

BUDGET = 200_000  # variants of a deconfounded sample, as published

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


CUR = f"""cur AS (SELECT * REPLACE ({sql_gene('gene_name')} AS gene_name, {sql_term('label')} AS label, {sql_consequence('consequence')} AS consequence,
  {sql_stars('stars')}::TINYINT AS stars) FROM {SQL_LATEST})"""
BIN = "bin AS (SELECT * REPLACE (CASE WHEN label IN ('pathogenic', 'likely_pathogenic') THEN 'pathogenic' ELSE 'benign' END AS label) FROM cur WHERE label IN ('pathogenic', 'likely_pathogenic', 'benign', 'likely_benign'))"
VALID = f"""val AS (SELECT {sql_variant('variant_id')} AS variant_id, score FROM scores WHERE variant_id IS NOT NULL AND score BETWEEN 0 AND 1 AND NOT isnan(score)
  QUALIFY row_number() OVER (PARTITION BY {sql_variant('variant_id')} ORDER BY scored_at DESC NULLS LAST, score DESC) = 1)"""
SCORED = f"""{CUR}, {BIN}, {VALID}, scored AS (SELECT variant_id, score, (label = 'pathogenic')::INT AS pathogenic, consequence, gene_name, ref, alt, stars FROM val JOIN bin USING (variant_id))"""
CODING = "(" + ", ".join(f"'{c}'" for c in annotate.CODING) + ")"
SPLICE = "(" + ", ".join(f"'{c}'" for c in annotate.SPLICE) + ")"
STRATA = f"""str AS (SELECT * FROM (
  SELECT s.*, unnest(list_filter(['overall',
    CASE WHEN regexp_matches(consequence, '(?i)frameshift') THEN 'frameshift' END,
    CASE WHEN NOT regexp_matches(consequence, '(?i)frameshift') AND consequence IN {CODING} THEN 'inframe_coding' END,
    CASE WHEN consequence NOT IN {CODING} THEN 'noncoding' END,
    CASE WHEN consequence IN {SPLICE} THEN 'splice' END,
    CASE WHEN consequence NOT IN {SPLICE} THEN 'non_splice' END], lambda x: x IS NOT NULL)) AS stratum FROM scored s))"""


def _variants(spark: SparkSession, d: str) -> DataFrame:
    return curation.curated(table(spark, d, "variants"))


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    """The columns that samples are ranked by; what is written on the way is as wide as what is asked for."""
    return _variants(spark, d).select("variant_id", "gene_name", "label", "consequence", "stars", "allele_id", "variant_type")


def _genes(spark: SparkSession, d: str) -> DataFrame:
    return curation.gene_table(table(spark, d, "genes"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return curation.scored_variants(table(spark, d, "variants"), table(spark, d, "scores"))


def _rounded(df: DataFrame, *names: str, places: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


# sequences


@query("SELECT row_id, reverse(translate(ref, 'ATGCatgcNn', 'TACGtacgNn')) AS rc_ref, reverse(translate(alt, 'ATGCatgcNn', 'TACGtacgNn')) AS rc_alt FROM variants")
def seq_reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "variants").select("row_id", seq.reverse_complement(F.col("ref")).alias("rc_ref"), seq.reverse_complement(F.col("alt")).alias("rc_alt"))


@query(f"""WITH {CUR} SELECT variant_id, gene_id, CASE WHEN gene_strand = '+' THEN pos - gene_start ELSE gene_end - pos - 1 END AS gene_offset
FROM cur JOIN genes g USING (gene_name)""")
def seq_strand_offset(spark: SparkSession, d: str) -> DataFrame:
    joined = _variants(spark, d).select("variant_id", "gene_name", "pos").join(_genes(spark, d), "gene_name")
    return joined.select("variant_id", "gene_id", seq.strand_offset(F.col("pos"), F.col("start"), F.col("end"), F.col("strand")).alias("gene_offset"))


@query("SELECT doc_id, substring(text, doc_id % 50 + 1, 5) AS piece, substring(text, doc_id % 50 + 1, 5) = substring(text, 1, 5) AS same FROM documents WHERE text IS NOT NULL")
def seq_substring_check_50(spark: SparkSession, d: str) -> DataFrame:
    piece = seq.slice_at(F.col("text"), F.col("doc_id") % 50, F.lit(5))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", piece.alias("piece"), (piece == F.substring("text", 1, 5)).alias("same"))


@query()
def seq_substring_check(spark: SparkSession, d: str) -> DataFrame:
    """Positions anywhere in the text, as in ``seq_mutate``; an empty text gives an empty piece."""
    piece = seq.slice_at(F.col("text"), F.coalesce(F.try_mod(F.col("doc_id") * 37, F.length("text")), F.lit(0)), F.lit(5))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", piece.alias("piece"), (piece == F.substring("text", 1, 5)).alias("same"))


_WINDOW = "greatest(0, least(p - 300, n - least(400, n)))"


@query(f"WITH x AS (SELECT doc_id, length(text)::BIGINT AS n, (doc_id * 37) % length(text) AS p FROM documents WHERE length(text) > 0) SELECT doc_id, {_WINDOW}::BIGINT AS win_start, ({_WINDOW} + least(400, n))::BIGINT AS win_end, (p - {_WINDOW})::BIGINT AS win_offset FROM x")
def seq_read_window(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").filter(F.length("text") > 0).select("doc_id", F.length("text").cast("bigint").alias("n")).withColumn("p", F.col("doc_id") * 37 % F.col("n"))
    start = seq.window_start(F.col("p"), F.col("n"), 300, 100)
    return x.select("doc_id", start.alias("win_start"), seq.window_end(F.col("p"), F.col("n"), 300, 100).alias("win_end"), (F.col("p") - start).alias("win_offset"))


@query("WITH x AS (SELECT doc_id, text, (doc_id * 37) % length(text) AS p FROM documents WHERE length(text) > 0) SELECT doc_id, md5(substring(text, 1, p::INT) || 'ACG' || substring(text, p::INT + 2)) AS mutated FROM x")
def seq_mutate(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").filter(F.length("text") > 0).withColumn("p", F.col("doc_id") * 37 % F.length("text"))
    ref = seq.slice_at(F.col("text"), F.col("p"), F.lit(1))
    return x.select("doc_id", F.md5(seq.mutate(F.col("text"), F.col("p"), ref, F.lit("ACG"))).alias("mutated"))


# calls and genes

_SIG = """CASE WHEN s LIKE '%conflicting%' THEN 'conflicting' WHEN s LIKE '%uncertain%' THEN 'vus'
  WHEN s LIKE '%pathogenic%' AND s NOT LIKE '%benign%' THEN CASE WHEN contains(s, 'likely_pathogenic') AND NOT contains(s, 'pathogenic/likely_pathogenic') THEN 'likely_pathogenic' ELSE 'pathogenic' END
  WHEN s LIKE '%benign%' AND s NOT LIKE '%pathogenic%' THEN CASE WHEN contains(s, 'likely_benign') AND NOT contains(s, 'benign/likely_benign') THEN 'likely_benign' ELSE 'benign' END
  ELSE 'other' END"""


@query(f"WITH x AS (SELECT row_id, coalesce(lower(clinical_significance), '') AS s FROM variants) SELECT row_id, {_SIG} AS label FROM x")
def vcf_classify_significance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "variants").select("row_id", annotate.significance_label(F.lower("clinical_significance")).alias("label"))


_STATUS = ["no_assertion", *annotate.REVIEW_STARS]
_STATUS_SQL = "[" + ", ".join(f"'{s}'" for s in _STATUS) + "][(row_id % 6 + 1)::INT]"


@query(f"SELECT row_id, (CASE {_STATUS_SQL} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in annotate.REVIEW_STARS.items()) + " ELSE 0 END)::TINYINT AS stars FROM variants")
def vcf_star_mapping(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, _STATUS)), (F.col("row_id") % 6 + 1).cast("int"))
    return table(spark, d, "variants").select("row_id", annotate.review_stars(status).alias("stars"))


@query(f"""WITH x AS (SELECT row_id, gene_name, lower(coalesce(clinical_significance, '')) AS s, consequence, allele_id, disease_name, rs_id, {_STATUS_SQL} AS st FROM variants
  WHERE regexp_full_match(gene_name, '[A-Z0-9-]+') AND coalesce(clinical_significance, '') NOT LIKE '%;%' AND coalesce(disease_name, '') NOT LIKE '%;%' AND coalesce(consequence, '') NOT LIKE '%|%'
    AND coalesce(clinical_significance, '') NOT LIKE '%\n%' AND coalesce(disease_name, '') NOT LIKE '%\n%' AND coalesce(clinical_significance, '') NOT LIKE '%\t%' AND coalesce(disease_name, '') NOT LIKE '%\t%')
SELECT row_id, gene_name, {_SIG} AS label, s AS clinical_significance, (CASE st {" ".join(f"WHEN '{k}' THEN {v}" for k, v in annotate.REVIEW_STARS.items())} ELSE 0 END)::TINYINT AS stars,
  nullif(split_part(consequence, ',', 1), '') AS consequence, allele_id,
  CASE WHEN disease_name <> '' AND lower(replace(split_part(disease_name, '|', 1), '_', ' ')) NOT IN ('not provided', 'not specified') THEN replace(split_part(disease_name, '|', 1), '_', ' ') END AS disease_name, rs_id
FROM x""")
def vcf_info_parse_plain(spark: SparkSession, d: str) -> DataFrame:
    """Rows of ``vcf_info_parse`` in the spelling that its SQL can follow: plain gene symbols, no packed fields."""
    v = table(spark, d, "variants").filter(F.col("gene_name").rlike("^[A-Z0-9-]+$"))
    for c in ("clinical_significance", "disease_name"):
        v = v.filter(~F.coalesce(F.col(c), F.lit("")).rlike("[;\n\t]"))
    return _info_parsed(v.filter(~F.coalesce(F.col("consequence"), F.lit("")).contains("|")))


def _info_parsed(variants: DataFrame) -> DataFrame:
    """The fields of ``variants`` written as INFO texts and parsed again."""
    status = F.element_at(F.array(*map(F.lit, _STATUS)), (F.col("row_id") % 6 + 1).cast("int"))

    def part(key: str, c) -> object:
        return F.concat(F.lit(f"{key}="), c)

    info = F.concat_ws(
        ";", part("GENEINFO", F.concat("gene_name", F.lit(":1|X:2"))), F.lit("FLAG"), part("CLNSIG", F.col("clinical_significance")), part("CLNREVSTAT", status),
        part("MC", F.concat(F.lit("SO:1|"), F.col("consequence"))), part("CLNDN", F.col("disease_name")), part("ALLELEID", F.col("allele_id").cast("string")), part("RS", F.substring("rs_id", 3, 20)),
    )
    parsed = vcf.parse_info(variants.select("row_id", info.alias("info")))
    return parsed.drop("info")


@query()
def vcf_info_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every row with a gene, however its fields are spelled; a value ends at its first ';'. Its plain rows meet SQL in ``vcf_info_parse_plain``."""
    return _info_parsed(table(spark, d, "variants").filter(gene_key(F.col("gene_name")).isNotNull()))


@query("SELECT row_id, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'snv' WHEN length(alt) > length(ref) THEN 'insertion' WHEN length(alt) < length(ref) THEN 'deletion' END AS kind FROM variants")
def vcf_variant_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "variants").select("row_id", annotate.variant_type(F.col("ref"), F.col("alt")).alias("kind"))


@query("""SELECT gene_id, gene_name, chrom, gene_start AS start, gene_end AS "end", gene_strand AS strand, gene_end - gene_start AS length, coalesce(hgnc_id, '') AS hgnc_id, gene_level AS level FROM genes WHERE gene_level <> 1""")
def gtf_parse(spark: SparkSession, d: str) -> DataFrame:
    return gtf.parse_genes(gtf_lines(table(spark, d, "genes")))


def gtf_lines(g: DataFrame) -> DataFrame:
    """The gene table as GTF lines."""
    kind = F.when(F.col("gene_level") == 1, "lncRNA").otherwise("protein_coding")
    attributes = F.concat(
        F.lit('gene_id "'), "gene_id", F.lit('.7"; '), F.when(F.col("gene_end") % 2 == 0, "gene_type").otherwise("gene_biotype"), F.lit(' "'), kind,
        F.lit('"; gene_name "'), "gene_name", F.lit('"; level '), F.col("gene_level").cast("string"), F.coalesce(F.concat(F.lit('; hgnc_id "'), "hgnc_id", F.lit('";')), F.lit(";")),
    )
    line = F.concat_ws("\t", F.concat(F.lit("chr"), "chrom"), F.lit("X"), F.lit("gene"), F.col("gene_start") + 1, F.col("gene_end"), F.lit("."), F.col("gene_strand"), F.lit("."), attributes)
    return g.select(line.alias("value"))


@query(f"WITH {CUR} SELECT variant_id, gene_id FROM cur JOIN genes g ON cur.gene_name = g.gene_name AND pos >= gene_start AND pos + length(ref) <= gene_end")
def gene_containment_join(spark: SparkSession, d: str) -> DataFrame:
    return curation.inside_gene(_variants(spark, d), _genes(spark, d)).select("variant_id", "gene_id")


_ENRICHED = """SELECT variant_id, gene_name, gene_id, gene_start, gene_end, gene_strand, gene_length, CASE WHEN gene_strand = '+' THEN pos - gene_start ELSE gene_end - pos - 1 END AS gene_offset
FROM cur JOIN genes USING (gene_name) QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY gene_id) = 1"""


@query(f"WITH {CUR} {_ENRICHED}")
def gene_enrich_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = curation.enrich(_variants(spark, d), _genes(spark, d))
    return out.select("variant_id", "gene_name", "gene_id", "gene_start", "gene_end", "gene_strand", "gene_length", "gene_offset")


@query(f"WITH {CUR}, o AS (SELECT *, row_number() OVER (ORDER BY evaluated_at NULLS FIRST, row_id) - 1 AS position FROM cur) SELECT variant_id, position, gene_id FROM o JOIN genes USING (gene_name) QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY position, gene_id) = 1")
def gene_enrich_ordered(spark: SparkSession, d: str) -> DataFrame:
    """The order of the input comes back after the join."""
    out = curation.enrich(_variants(spark, d), _genes(spark, d), order=[F.col("evaluated_at").asc_nulls_first(), F.col("row_id").asc()])
    return out.select("variant_id", "position", "gene_id")


_DOC_GENOME = "x AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, upper(t) AS t, length(t)::BIGINT AS n, (doc_id * 37) % length(t) AS p FROM x WHERE t <> '')"


def _doc_letters(spark: SparkSession, d: str) -> DataFrame:
    """Letters of each document as a chromosome."""
    text = F.regexp_replace("text", "[^A-Za-z]", "")
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chrom"), text.alias("sequence")).filter("sequence <> ''")


def _doc_genome(spark: SparkSession, d: str) -> DataFrame:
    """The same, taken out once for the tiles, lengths and variants made of them."""
    return written(_doc_letters(spark, d), "letters")


def _doc_variants(chromosomes: DataFrame, wrong: bool = True) -> DataFrame:
    """One variant a document; ``wrong``: every fourth has a reference allele that does not stand there."""
    n, doc = F.length("sequence"), F.col("chrom").cast("bigint")
    pos = doc * 37 % n
    ref = F.upper(F.substring("sequence", (pos + 1).cast("int"), F.lit(1)))
    if wrong:
        ref = F.when(doc % 4 == 0, "#").otherwise(ref)
    return chromosomes.select(F.col("chrom").alias("variant_id"), "chrom", pos.cast("bigint").alias("pos"), ref.alias("ref"), F.lit("ACG").alias("alt"))


@query(f"""WITH {_DOC_GENOME}, w AS (SELECT *, {_WINDOW} AS a, CASE WHEN doc_id % 4 = 0 THEN '#' ELSE substring(t, p::INT + 1, 1) END AS r FROM c),
y AS (SELECT *, substring(t, a::INT + 1, least(400, n)::INT) AS rw FROM w)
SELECT doc_id::VARCHAR AS variant_id, a::BIGINT AS win_start, (a + least(400, n))::BIGINT AS win_end, (p - a)::BIGINT AS "offset", substring(rw, (p - a)::INT + 1, 1) = r AS ref_ok, md5(rw) AS ref_md5,
  CASE WHEN substring(rw, (p - a)::INT + 1, 1) = r THEN md5(substring(rw, 1, (p - a)::INT) || 'ACG' || substring(rw, (p - a)::INT + 2)) END AS var_md5 FROM y""")
def genome_windows(spark: SparkSession, d: str) -> DataFrame:
    chromosomes = _doc_genome(spark, d)
    out = genome.variant_windows(_doc_variants(chromosomes), genome.tiles(chromosomes, 256), 300, 100, 256)
    return out.select("variant_id", "win_start", "win_end", "offset", "ref_ok", F.md5("ref_window").alias("ref_md5"), F.md5("var_window").alias("var_md5"))


@query(f"WITH {_DOC_GENOME} SELECT doc_id::VARCHAR AS variant_id FROM c WHERE doc_id % 4 <> 0 AND p >= 5 AND p + 1 <= n - 5")
def genome_reference_check(spark: SparkSession, d: str) -> DataFrame:
    chromosomes = _doc_genome(spark, d)
    genes = chromosomes.select(
        F.col("chrom").alias("gene_id"), F.col("chrom").alias("gene_name"), "chrom", F.lit(5).cast("bigint").alias("start"), (F.length("sequence") - 5).cast("bigint").alias("end"),
        F.when(F.col("chrom").cast("bigint") % 2 == 0, "+").otherwise("-").alias("strand"),
    )
    variants = _doc_variants(chromosomes).withColumn("gene_name", F.col("chrom"))
    return genome.reference_check(variants, genes, genome.tiles(chromosomes, 256), size=256).select("variant_id")


_DOC_GENES = "g AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, t, n FROM c WHERE n > 10)"


@query(f"WITH {_DOC_GENOME}, {_DOC_GENES}, q AS (SELECT *, substring(t, 6, (n - 10)::INT) AS s FROM g) SELECT doc_id::VARCHAR AS gene_id, md5(CASE WHEN strand = '-' THEN reverse(translate(s, 'ATGCatgcNn', 'TACGtacgNn')) ELSE s END) AS sequence_md5 FROM q")
def genome_gene_sequences(spark: SparkSession, d: str) -> DataFrame:
    chromosomes = _doc_genome(spark, d)
    genes = chromosomes.filter(F.length("sequence") > 10).select(
        F.col("chrom").alias("gene_id"), "chrom", F.lit(5).cast("bigint").alias("start"), (F.length("sequence") - 5).cast("bigint").alias("end"),
        F.when(F.col("chrom").cast("bigint") % 2 == 0, "+").otherwise("-").alias("strand"),
    )
    out = genome.gene_sequences(genes, genome.tiles(chromosomes, 256), 256)
    return out.select("gene_id", F.md5("sequence").alias("sequence_md5"))


# curated sets

_FIXED = "chrom, pos, ref, alt, variant_type, variant_id, gene_name, label, clinical_significance, stars, consequence, allele_id, disease_name, rs_id"


@query(f"WITH {CUR}, {BIN} SELECT {_FIXED} FROM bin WHERE stars >= 1")
def preset_labeled(spark: SparkSession, d: str) -> DataFrame:
    return curation.finalize(curation.labeled(_variants(spark, d)))


@query(f"WITH {CUR} SELECT {_FIXED} FROM cur WHERE label NOT IN ('pathogenic', 'likely_pathogenic', 'benign', 'likely_benign') OR stars < 1")
def preset_unlabeled(spark: SparkSession, d: str) -> DataFrame:
    return curation.finalize(curation.unlabeled(_variants(spark, d)))


_SMALL = "sml AS (SELECT * FROM bin WHERE stars >= 1 AND variant_type = 'snv' AND gene_name IN (SELECT gene_name FROM genes GROUP BY 1 HAVING arg_min(gene_length, gene_id) <= 100000))"


@query(f"WITH {CUR}, {BIN}, {_SMALL} SELECT variant_id, gene_name, label FROM sml")
def preset_small_gene(spark: SparkSession, d: str) -> DataFrame:
    return curation.small_gene_snvs(curation.binarised(_variants(spark, d)), _genes(spark, d)).select("variant_id", "gene_name", "label")


def _quotas(source: str, n: int) -> str:
    return f"""cnt AS (SELECT consequence, label, count(*) AS obs_n FROM {source} GROUP BY 1, 2),
con AS (SELECT consequence, sum(obs_n)::DOUBLE AS cons, min(obs_n)::DOUBLE AS least_n FROM cnt GROUP BY 1),
tgt AS (SELECT cnt.*, cons / (SELECT sum(obs_n)::DOUBLE FROM cnt) * pow(2::DOUBLE * least_n / cons, 0.5::DOUBLE) * (obs_n / cons * 0.5::DOUBLE + 0.25::DOUBLE) AS t FROM cnt JOIN con USING (consequence)),
quo AS (SELECT consequence, label, obs_n, least(trunc(t / (SELECT sum(t) FROM tgt) * {n})::BIGINT, obs_n) AS quota FROM tgt)"""


@query(f"WITH {CUR}, {BIN}, {_quotas('bin', 500)} SELECT consequence, label, obs_n, quota FROM quo")
def deconfounded_quota_500(spark: SparkSession, d: str) -> DataFrame:
    return curation.label_quotas(curation.binarised(_variants(spark, d)), 500)


@query()
def deconfounded_quota(spark: SparkSession, d: str) -> DataFrame:
    """The published budget."""
    return curation.label_quotas(curation.binarised(_variants(spark, d)), BUDGET)


_DRAWN = """ gr AS (SELECT *, row_number() OVER (PARTITION BY consequence, label, gene_name ORDER BY stars DESC NULLS FIRST, allele_id ASC NULLS FIRST, variant_id) AS g FROM {0}),
kr AS (SELECT *, row_number() OVER (PARTITION BY consequence, label ORDER BY g, stars DESC NULLS FIRST, allele_id ASC NULLS FIRST, variant_id) AS k FROM gr)
SELECT variant_id FROM kr JOIN quo USING (consequence, label) WHERE k <= quota"""


@query(f"WITH {CUR}, {BIN}, {_quotas('bin', 500)}, {_DRAWN.format('bin')}")
def deconfounded_sample_500(spark: SparkSession, d: str) -> DataFrame:
    return curation.balanced_sample(curation.binarised(_ranking(spark, d)), 500).select("variant_id")


@query()
def deconfounded_sample(spark: SparkSession, d: str) -> DataFrame:
    """The published budget."""
    return curation.balanced_sample(curation.binarised(_ranking(spark, d)), BUDGET).select("variant_id")


@query(f"WITH {CUR}, {BIN}, {_SMALL}, {_quotas('sml', 8000)}, {_DRAWN.format('sml')}")
def preset_pilot(spark: SparkSession, d: str) -> DataFrame:
    return curation.pilot(_ranking(spark, d), _genes(spark, d)).select("variant_id")


@query(f"WITH {CUR} SELECT variant_id, row_number() OVER (ORDER BY md5('42:' || variant_id), variant_id) - 1 AS position FROM cur")
def variant_id_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return curation.shuffled(_variants(spark, d).select("variant_id"))


@query(f"""WITH {CUR}, {BIN}, g AS (SELECT gene_name, row_number() OVER (ORDER BY md5('42:' || gene_name), gene_name) AS r FROM (SELECT DISTINCT gene_name FROM bin WHERE gene_name IS NOT NULL))
SELECT variant_id, gene_name, CASE WHEN r <= floor((SELECT count(*) FROM g) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM bin LEFT JOIN g USING (gene_name)""")
def gene_holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return curation.gene_holdout(curation.binarised(_variants(spark, d))).select("variant_id", "gene_name", "split")


# manifests, shards, checks


@query(f"WITH {CUR} SELECT variant_id, regexp_replace(chrom, '^chr', '') AS chrom, pos, ref, alt, CASE WHEN label = 'pathogenic' THEN 1 ELSE 0 END AS label FROM cur")
def harvest_manifest(spark: SparkSession, d: str) -> DataFrame:
    return files.harvest_manifest(_variants(spark, d).withColumnsRenamed({"ref": "ref_corrected", "alt": "alt_corrected"}))


@query("SELECT row_id, ((row_number() OVER (ORDER BY row_id) * least(7, count(*) OVER ()) - 1) // count(*) OVER ())::INT AS shard FROM variants")
def shard_assignment(spark: SparkSession, d: str) -> DataFrame:
    return validation.contiguous_shards(table(spark, d, "variants").select("row_id"), [F.col("row_id").asc()], 7)


@query(f"WITH {CUR}, {VALID} SELECT variant_id FROM cur WHERE variant_id NOT IN (SELECT variant_id FROM val)")
def checkpoint_resume(spark: SparkSession, d: str) -> DataFrame:
    return validation.remaining(_variants(spark, d).select("variant_id"), curation.valid_scores(table(spark, d, "scores")), "variant_id")


@query(f"SELECT DISTINCT {sql_variant('variant_id')} AS variant_id FROM scores WHERE variant_id IS NOT NULL AND {sql_variant('variant_id')} NOT IN (SELECT variant_id FROM variants WHERE variant_id IS NOT NULL)")
def stale_ids(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "scores").select(variant_key(F.col("variant_id")).alias("variant_id")).filter("variant_id is not null")
    return validation.stale(done, table(spark, d, "variants"), "variant_id")


@query(f"SELECT {sql_variant('variant_id')} AS variant_id, count(*) AS n FROM scores GROUP BY 1 HAVING count(*) > 1")
def shard_merge_unique(spark: SparkSession, d: str) -> DataFrame:
    return validation.duplicate_keys(table(spark, d, "scores").select(variant_key(F.col("variant_id")).alias("variant_id")), "variant_id")


@query("WITH s AS (SELECT DISTINCT shard FROM scores WHERE score > 1 AND NOT isnan(score)) SELECT r::INT AS shard FROM range((SELECT max(shard) + 1 FROM s)) t(r) WHERE r NOT IN (SELECT shard FROM s)")
def missing_shards_above_1(spark: SparkSession, d: str) -> DataFrame:
    """Shards without a score above 1, up to the last shard that has one."""
    return validation.missing_shards(table(spark, d, "scores").filter("score > 1 and not isnan(score)"))


@query("WITH s AS (SELECT DISTINCT shard FROM scores) SELECT r::INT AS shard FROM range((SELECT max(shard) + 1 FROM s)) t(r) WHERE r NOT IN (SELECT shard FROM s WHERE shard IS NOT NULL)")
def missing_shards(spark: SparkSession, d: str) -> DataFrame:
    """Over all rows; none missing is a pass."""
    return validation.missing_shards(table(spark, d, "scores"))


_SPLIT_IDS = f"(SELECT DISTINCT {sql_variant('variant_id')} AS variant_id FROM gene_split WHERE variant_id IS NOT NULL)"
_SCORE_IDS = f"(SELECT DISTINCT {sql_variant('variant_id')} AS variant_id FROM scores WHERE variant_id IS NOT NULL)"


@query(f"SELECT coalesce(a.variant_id, b.variant_id) AS variant_id, CASE WHEN a.variant_id IS NULL THEN 'right_only' ELSE 'left_only' END AS side FROM {_SPLIT_IDS} a FULL JOIN {_SCORE_IDS} b ON a.variant_id = b.variant_id WHERE a.variant_id IS NULL OR b.variant_id IS NULL")
def id_set_equality(spark: SparkSession, d: str) -> DataFrame:
    a, b = (table(spark, d, t).select(variant_key(F.col("variant_id")).alias("variant_id")).filter("variant_id is not null") for t in ("gene_split", "scores"))
    return validation.id_mismatch(a, b, "variant_id")


@query(f"SELECT * FROM (SELECT 'scores' AS dataset, (SELECT count(*) FROM {_SCORE_IDS}) AS n_items UNION ALL SELECT 'split', (SELECT count(*) FROM {_SPLIT_IDS})) WHERE (SELECT count(*) FROM {_SCORE_IDS}) <> (SELECT count(*) FROM {_SPLIT_IDS})")
def dataset_counts(spark: SparkSession, d: str) -> DataFrame:
    tables = {n: table(spark, d, t).select(variant_key(F.col("variant_id")).alias("variant_id")) for n, t in (("scores", "scores"), ("split", "gene_split"))}
    return validation.unequal_counts(tables, "variant_id")


@query(f"WITH {CUR}, w AS (SELECT variant_id, 65536::BIGINT AS n, least(pos, 49152) AS o, ref, alt FROM cur) SELECT variant_id, 0 AS dir, (o + greatest(length(ref), length(alt)))::BIGINT AS range_start, least(n, n - length(ref) + length(alt))::BIGINT AS range_end FROM w UNION ALL SELECT variant_id, 1, 0, o FROM w")
def harvest_ranges(spark: SparkSession, d: str) -> DataFrame:
    sized = _variants(spark, d).withColumns({"n": F.lit(65_536).cast("bigint"), "o": F.least(F.col("pos"), F.lit(49_152))})
    return activations.selection_ranges(sized, "n", "o")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT row_id FROM variants WHERE variant_type = 'insertion')")
def vector_scan(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "variants").filter("variant_type = 'insertion'").select(F.col("row_id").alias("vec_id"))
    return files.read_vectors(spark, f"{d}/embeddings.parquet", ids, "vec_id").select("vec_id", "label")


# evaluation


@query(f"WITH {SCORED}, {STRATA} SELECT variant_id, stratum FROM str")
def strata_annotate(spark: SparkSession, d: str) -> DataFrame:
    return metrics.by_stratum(_scored(spark, d)).select("variant_id", "stratum")


@query("SELECT row_id, length(alt)::INT - length(ref)::INT AS indel_len, abs(length(alt) - length(ref))::INT AS indel_size, CASE WHEN abs(length(alt) - length(ref)) <= 1 THEN '1bp' WHEN abs(length(alt) - length(ref)) <= 5 THEN '2-5bp' WHEN abs(length(alt) - length(ref)) <= 20 THEN '6-20bp' ELSE '>20bp' END AS size_bin FROM variants")
def strata_indel_bins(spark: SparkSession, d: str) -> DataFrame:
    r, a = F.col("ref"), F.col("alt")
    return table(spark, d, "variants").select("row_id", seq.indel_length(r, a).alias("indel_len"), F.abs(seq.indel_length(r, a)).alias("indel_size"), seq.size_bin(r, a).alias("size_bin"))


def _metrics_sql(source: str, group: str, least: int) -> str:
    return f"""rk AS (SELECT *, row_number() OVER w AS rank, sum(pathogenic) OVER w AS tp FROM {source} WINDOW w AS (PARTITION BY {group} ORDER BY score DESC, variant_id ROWS UNBOUNDED PRECEDING)),
ag AS (SELECT {group}, count(*) AS n, sum(pathogenic)::BIGINT AS p, sum(CASE WHEN pathogenic = 0 THEN tp ELSE 0 END)::DOUBLE AS above, sum(CASE WHEN pathogenic = 1 THEN tp::DOUBLE / rank ELSE 0 END) AS prec FROM rk GROUP BY {group})
SELECT {group}, n AS n_variants, p AS n_pathogenic, n - p AS n_benign, round(CASE WHEN p * (n - p) > 0 THEN above / (p * (n - p)) ELSE 'nan'::DOUBLE END, 9) AS auroc, round(CASE WHEN p > 0 THEN prec / p ELSE 0 END, 9) AS auprc
FROM ag WHERE p >= {least} AND n - p >= {least}"""


@query(f"WITH {SCORED}, {STRATA}, {_metrics_sql('str', 'stratum', 5)}")
def metric_stratified(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.stratified_metrics(_scored(spark, d)), "auroc", "auprc")


@query(f"WITH {SCORED}, {_metrics_sql('scored', 'gene_name', 0)}")
def metric_by_gene(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.ranked_metrics(_scored(spark, d), ["gene_name"], "score", "pathogenic", "variant_id"), "auroc", "auprc")


_HELD = f"""spl AS (SELECT DISTINCT {sql_variant('variant_id')} AS variant_id FROM gene_split WHERE nullif(lower(substr(trim(split, {SQL_BLANKS}), 1, 3)), '') = 'tes' AND variant_id IS NOT NULL)"""


@query(f"WITH {SCORED}, {_HELD}, hel AS (SELECT * FROM scored SEMI JOIN spl USING (variant_id)), {_metrics_sql('(SELECT * FROM str)', 'stratum', 5).replace('rk AS', STRATA.replace('FROM scored s', 'FROM hel s') + ', rk AS', 1)}")
def metric_held_out(spark: SparkSession, d: str) -> DataFrame:
    split = table(spark, d, "gene_split").filter(split_key(F.col("split")) == "tes").select(variant_key(F.col("variant_id")).alias("variant_id"))
    held = _scored(spark, d).join(split, "variant_id", "left_semi")
    return _rounded(metrics.stratified_metrics(held), "auroc", "auprc")


_OF_SPLIT = f"WITH {SCORED}, {{0}}, hel AS (SELECT * FROM scored SEMI JOIN spl USING (variant_id)), {_metrics_sql('(SELECT * FROM str)', 'stratum', 5).replace('rk AS', STRATA.replace('FROM scored s', 'FROM hel s') + ', rk AS', 1)}"


@query(_OF_SPLIT.replace("{0}", f"spl AS (SELECT DISTINCT {sql_variant('variant_id')} AS variant_id FROM gene_split WHERE variant_id IS NOT NULL)"))
def metric_split_all(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the split table, whatever its split."""
    split = table(spark, d, "gene_split").select(variant_key(F.col("variant_id")).alias("variant_id")).filter("variant_id is not null")
    return _rounded(metrics.stratified_metrics(_scored(spark, d).join(split, "variant_id", "left_semi")), "auroc", "auprc")


MEAN_RANK = metrics.Metric(lambda y, tp, rank: y * rank, lambda total, p, n: F.when(p > 0, total / p).otherwise(F.lit(float("nan"))))
_SIZE = "CASE WHEN abs(length(alt) - length(ref)) <= 1 THEN '1bp' WHEN abs(length(alt) - length(ref)) <= 5 THEN '2-5bp' WHEN abs(length(alt) - length(ref)) <= 20 THEN '6-20bp' ELSE '>20bp' END"


@query(f"""WITH {SCORED}, rk AS (SELECT {_SIZE} AS stratum, pathogenic AS y, row_number() OVER (PARTITION BY {_SIZE} ORDER BY score DESC, variant_id) AS k FROM scored)
SELECT stratum, count(*) AS n_variants, sum(y)::BIGINT AS n_pathogenic, (count(*) - sum(y))::BIGINT AS n_benign, round(sum(y * k)::DOUBLE / sum(y)::DOUBLE, 9) AS mean_rank FROM rk GROUP BY 1 HAVING sum(y) >= 5 AND count(*) - sum(y) >= 5""")
def metric_of_own(spark: SparkSession, d: str) -> DataFrame:
    """Strata and metric given by the caller: size classes, and the mean rank of pathogenic variants."""
    rows = metrics.stratified_metrics(_scored(spark, d), names=F.array(seq.size_bin(F.col("ref"), F.col("alt"))), metrics={"mean_rank": MEAN_RANK})
    return _rounded(rows, "mean_rank")


_TIED = """rnk AS (SELECT *, rank() OVER (PARTITION BY {0} ORDER BY s) + (count(*) OVER (PARTITION BY {0}, s) - 1) / 2::DOUBLE AS r FROM {1})"""


@query(f"WITH {SCORED}, {STRATA}, tie AS (SELECT stratum, round(score, 2) AS s, pathogenic FROM str), {_TIED.format('stratum', 'tie')} SELECT stratum, count(*) AS n, sum(pathogenic)::BIGINT AS n_pathogenic, round(CASE WHEN sum(pathogenic) * (count(*) - sum(pathogenic)) > 0 THEN (sum(CASE WHEN pathogenic = 1 THEN r END) - sum(pathogenic) * (sum(pathogenic) + 1) / 2::DOUBLE) / (sum(pathogenic) * (count(*) - sum(pathogenic)))::DOUBLE ELSE 'nan'::DOUBLE END, 9) AS auroc FROM rnk GROUP BY 1")
def metric_auroc_ties(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.by_stratum(_scored(spark, d)).withColumn("score", F.round("score", 2))
    return _rounded(metrics.tied_auroc(rows, ["stratum"], "score", "pathogenic"), "auroc")


@query(f"WITH {SCORED}, tw AS (SELECT pathogenic, rank() OVER (PARTITION BY pathogenic ORDER BY score) + (count(*) OVER (PARTITION BY pathogenic, score) - 1) / 2::DOUBLE AS a, rank() OVER (PARTITION BY pathogenic ORDER BY stars) + (count(*) OVER (PARTITION BY pathogenic, stars) - 1) / 2::DOUBLE AS b FROM scored) SELECT pathogenic, round(corr(a, b), 9) AS spearman FROM tw GROUP BY 1")
def metric_spearman(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.spearman(_scored(spark, d), ["pathogenic"], "score", "stars"), "spearman")


@query(f"""WITH {SCORED}, tw AS (SELECT pathogenic AS y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2::DOUBLE AS a, rank() OVER (ORDER BY stars) + (count(*) OVER (PARTITION BY stars) - 1) / 2::DOUBLE AS b FROM scored)
SELECT count(*) AS n, sum(y)::BIGINT AS n_pathogenic, round((sum(a * y) - sum(y) * (sum(y) + 1) / 2::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE, 6) AS auroc, round(corr(a, b), 6) AS spearman FROM tw""")
def dms_eval(spark: SparkSession, d: str) -> DataFrame:
    manifest = _scored(spark, d).select("variant_id", "pathogenic", F.col("stars").alias("score"))
    return metrics.measured_variants(curation.valid_scores(table(spark, d, "scores")), manifest, "pathogenic", "score")


@query(f"""WITH {SCORED}, {STRATA},
rk AS (SELECT stratum, pathogenic AS y, row_number() OVER (PARTITION BY stratum ORDER BY score DESC, variant_id) - 1 AS i FROM str),
sz AS (SELECT stratum, count(*) AS n FROM rk GROUP BY 1 HAVING sum(y) >= 5 AND count(*) - sum(y) >= 5),
dr AS (SELECT stratum, b, ('0x' || substr(md5('42:' || b || ':' || d), 1, 8))::BIGINT % n AS i FROM sz, range(20) t(b), range((SELECT max(n) FROM sz)) u(d) WHERE d < n),
jo AS (SELECT stratum, b, y, row_number() OVER w AS k, sum(y) OVER w AS tp FROM dr JOIN rk USING (stratum, i) WINDOW w AS (PARTITION BY stratum, b ORDER BY i ROWS UNBOUNDED PRECEDING)),
ea AS (SELECT stratum, b, CASE WHEN sum(y) * (count(*) - sum(y)) > 0 THEN sum(CASE WHEN y = 0 THEN tp ELSE 0 END)::DOUBLE / (sum(y) * (count(*) - sum(y)))::DOUBLE END AS auroc,
  CASE WHEN sum(y) > 0 THEN sum(CASE WHEN y = 1 THEN tp::DOUBLE / k ELSE 0 END) / sum(y)::DOUBLE ELSE 0 END AS auprc FROM jo GROUP BY 1, 2)
SELECT stratum, round(quantile_cont(auroc, 0.025), 9) AS auroc_ci_lo, round(quantile_cont(auroc, 0.975), 9) AS auroc_ci_hi, round(quantile_cont(auprc, 0.025), 9) AS auprc_ci_lo, round(quantile_cont(auprc, 0.975), 9) AS auprc_ci_hi FROM ea GROUP BY 1""")
def metric_bootstrap_ci_20(spark: SparkSession, d: str) -> DataFrame:
    """Twenty replicates with a hash per draw, few enough for SQL to follow; the intervals of use are those of ``metric_bootstrap_ci``."""
    out = metrics.bootstrap_intervals(metrics.by_stratum(_scored(spark, d)), ["stratum"], "score", "pathogenic", "variant_id", replicates=20)
    return _rounded(out, "auroc_ci_lo", "auroc_ci_hi", "auprc_ci_lo", "auprc_ci_hi")


@query()
def metric_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """The published 1,000 replicates."""
    out = metrics.blocked_bootstrap_intervals(metrics.by_stratum(_scored(spark, d)), ["stratum"], "score", "pathogenic", "variant_id", replicates=1000)
    return _rounded(out, "auroc_ci_lo", "auroc_ci_hi", "auprc_ci_lo", "auprc_ci_hi")


# vectors

_VEC = "v AS (SELECT vec_id // 50 AS variant_id, vec_id % 50 AS pos, embedding::DOUBLE[] AS a, list_reverse(embedding)::DOUBLE[] AS b, label FROM embeddings)"


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 50).alias("variant_id"), (F.col("vec_id") % 50).alias("pos"), F.col("embedding").alias("var_same"), F.reverse("embedding").alias("ref_same"), "label"
    )


@query("SELECT vec_id // 50 AS variant_id, vec_id % 50 // 2 AS slot, round(list_sum(list_transform(list_concat(list_transform(list_zip(f, list_reverse(f)), lambda x: x[1]::FLOAT - x[2]::FLOAT), list_transform(list_zip(g, list_reverse(g)), lambda x: x[1]::FLOAT - x[2]::FLOAT)), lambda x, i: x::DOUBLE * i)), 5) AS fingerprint, len(f)::INT * 2 AS width FROM (SELECT vec_id, embedding AS f, lead(embedding) OVER (ORDER BY vec_id) AS g FROM embeddings) WHERE vec_id % 2 = 0 AND g IS NOT NULL")
def array_unified_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = _positions(spark, d).select("variant_id", (F.col("pos") % 2).cast("int").alias("dir"), F.floor(F.col("pos") / 2).alias("slot"), "var_same", "ref_same")
    diff = activations.unified_diff(rows)
    weighted = F.aggregate(F.transform("diff", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return diff.select("variant_id", "slot", F.round(weighted, 5).alias("fingerprint"), F.size("diff").alias("width"))


@query(f"WITH {_VEC}, r AS (SELECT *, list_cosine_similarity(a, b) AS c, row_number() OVER (PARTITION BY variant_id ORDER BY list_cosine_similarity(a, b), pos) AS r FROM v) SELECT variant_id, pos, (row_number() OVER (PARTITION BY variant_id ORDER BY pos) - 1)::INT AS slot, round(c, 9) AS cosine FROM r WHERE r <= 8")
def array_cosine_bottomk(spark: SparkSession, d: str) -> DataFrame:
    out = activations.lowest_cosine(_positions(spark, d), ["variant_id"], 8)
    return out.select("variant_id", "pos", "slot", F.round("__c", 9).alias("cosine"))


def _select_sql(k: int, w: int) -> str:
    return f"""{_VEC}, g AS (SELECT DISTINCT variant_id, 3 AS s, 8 + variant_id % 9 * 5 AS e FROM v),
q AS (SELECT v.variant_id, pos, row_number() OVER (PARTITION BY v.variant_id ORDER BY pos >= s + {w}, CASE WHEN pos < s + {w} THEN 0 ELSE list_cosine_similarity(a, b) END, pos) AS r FROM v JOIN g USING (variant_id) WHERE pos >= s AND pos < e),
z AS (SELECT variant_id, pos, row_number() OVER (PARTITION BY variant_id ORDER BY pos) - 1 AS slot FROM q WHERE r <= {k}),
sel AS (SELECT g.variant_id, t.slot::INT AS slot, coalesce(z.pos, -1)::BIGINT AS pos FROM g CROSS JOIN range({k}) t(slot) LEFT JOIN z ON z.variant_id = g.variant_id AND z.slot = t.slot)"""


def _selected(spark: SparkSession, d: str, k: int, w: int) -> DataFrame:
    rows = _positions(spark, d)
    ranges = rows.select("variant_id").distinct().withColumn("range_start", F.lit(3)).withColumn("range_end", 8 + F.col("variant_id") % 9 * 5)
    return activations.select_positions(rows, ranges, ["variant_id"], k, w)


@query(f"WITH {_select_sql(12, 4)} SELECT variant_id, slot, pos FROM sel")
def array_select_positions(spark: SparkSession, d: str) -> DataFrame:
    return _selected(spark, d, 12, 4).select("variant_id", "slot", "pos")


@query(f"WITH {_select_sql(40, 0)} SELECT variant_id, slot, pos, pos = -1 AS zeros FROM sel")
def array_cosine_padded(spark: SparkSession, d: str) -> DataFrame:
    """The positions of least similarity of a range, padded with zero vectors."""
    rows = _positions(spark, d)
    ranges = rows.select("variant_id").distinct().withColumn("range_start", F.lit(3)).withColumn("range_end", 8 + F.col("variant_id") % 9 * 5)
    out = activations.select_positions(rows, ranges, ["variant_id"], 40, zeros=64)
    zeros = F.forall("var_same", lambda x: x == 0) & F.forall("ref_same", lambda x: x == 0) & (F.size("var_same") == 64)
    return out.select("variant_id", "slot", "pos", zeros.alias("zeros"))


@query(f"WITH {_select_sql(12, 4)} SELECT sel.variant_id, sel.slot, sel.pos, coalesce(round((a[1] - a[2])::DOUBLE, 6), 0) AS loss FROM sel LEFT JOIN v ON v.variant_id = sel.variant_id AND v.pos = sel.pos AND a[1] > 0")
def array_loss_diff_part(spark: SparkSession, d: str) -> DataFrame:
    """Without the losses of positions whose first component is not above 0, so that some are missing."""
    losses = _positions(spark, d).filter("var_same[0] > 0").select("variant_id", "pos", F.col("var_same")[0].cast("double").alias("var_loss"), F.col("var_same")[1].cast("double").alias("ref_loss"))
    out = activations.loss_difference(_selected(spark, d, 12, 4), losses, ["variant_id"])
    return out.select("variant_id", "slot", "pos", F.round("loss", 6).alias("loss"))


@query()
def array_loss_diff(spark: SparkSession, d: str) -> DataFrame:
    losses = _positions(spark, d).select("variant_id", "pos", F.col("var_same")[0].cast("double").alias("var_loss"), F.col("var_same")[1].cast("double").alias("ref_loss"))
    out = activations.loss_difference(_selected(spark, d, 12, 4), losses, ["variant_id"])
    return out.select("variant_id", "slot", "pos", F.round("loss", 6).alias("loss"))


@query(f"WITH {_select_sql(12, 4)} SELECT variant_id, slot, CASE WHEN pos >= 0 THEN pos + variant_id * 1000 - 25 ELSE -1 END AS pos FROM sel")
def array_genomic_positions(spark: SparkSession, d: str) -> DataFrame:
    selected = _selected(spark, d, 12, 4)
    at = selected.select("variant_id").distinct().withColumn("variant_pos", F.col("variant_id") * 1000).withColumn("offset", F.lit(25))
    return activations.genomic_positions(selected, at).select("variant_id", "slot", "pos")


@query(f"WITH {_VEC}, n AS (SELECT label, a, sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a) + {vectors.FLOAT_EPS!r}::DOUBLE) AS s FROM v), u AS (SELECT label, unnest(range(len(a)))::INT AS dim, unnest(a) / s AS x FROM n) SELECT label, dim, round(avg(x), 9) AS mean FROM u GROUP BY 1, 2")
def array_rms_mean(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(activations.mean_pooled(_positions(spark, d), ["label"], "var_same"), "mean")


@query("SELECT vec_id, round(1 / (1 + exp(embedding[1]::DOUBLE - embedding[2]::DOUBLE)), 9) AS score FROM embeddings")
def softmax_score(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(annotate.second_class_probability(e[0].cast("double"), e[1].cast("double")), 9).alias("score"))


@query()
def probe_embed(spark: SparkSession, d: str) -> DataFrame:
    """Second-moment embeddings of difference vectors, a probe fitted on them and its scores (own design: no SQL twin)."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("variant_id"), F.col("embedding").alias("diff"), (F.col("label") % 2).alias("label"))
    embedded = probe.moment_embeddings(rows, probe.projection(64, 8)).join(rows.select("variant_id", "label"), "variant_id")
    return probe.score_probe(embedded, probe.fit_probe(embedded))


@query()
def model_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows, mutation, both model passes and selected positions end to end, with the stand-in model; sizes are the operators' defaults."""
    chromosomes = _doc_genome(spark, d)
    windows = genome.variant_windows(_doc_variants(chromosomes, wrong=False), genome.tiles(chromosomes, 256), size=256)
    return probe.selected_positions(windows, probe.hashed_model())


@query("SELECT label, i::INT AS i, round(avg(CASE i WHEN 0 THEN a * a WHEN 3 THEN b * b ELSE a * b END), 3) AS x FROM (SELECT label, list_sum(list_transform(embedding, lambda e, k: e::DOUBLE * (((k - 1) * 7) % 5 - 2) / 4)) AS a, list_sum(list_transform(embedding, lambda e, k: e::DOUBLE * (((k - 1) * 7 + 3) % 5 - 2) / 4)) AS b FROM embeddings), range(4) t(i) GROUP BY 1, 2")
def probe_moments(spark: SparkSession, d: str) -> DataFrame:
    """Second-moment embeddings of fixed weights, by label."""
    weights = np.array([[((i * 7 + j * 3) % 5 - 2) / 4 for j in range(2)] for i in range(64)], np.float32)
    out = probe.moment_embeddings(table(spark, d, "embeddings").select("label", F.col("embedding").alias("diff")), weights, "label")
    return out.select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double"), 3))


def _letters(sequence: str) -> tuple[np.ndarray, np.ndarray]:
    """A model that SQL can follow: the letter at a position and the one before it, and the next letter as loss."""
    c = np.frombuffer(sequence.encode(), np.uint8).astype(np.float32) - 77
    return np.c_[c, np.r_[np.float32(1), c[:-1]]][: len(c)], np.abs(c[1:]) / 8


def _letter_harvest(spark: SparkSession, d: str) -> DataFrame:
    chromosomes = _doc_genome(spark, d)
    windows = genome.variant_windows(_doc_variants(chromosomes, wrong=False), genome.tiles(chromosomes))
    return probe.harvested(windows, _letters)


_COMPLEMENT = "translate({0}, 'ATGCatgcNn', 'TACGtacgNn')"
_CODES = "list_transform(string_split({0}, ''), lambda x: ascii(x)::DOUBLE - 77)"
_LETTERS = f"""{_DOC_GENOME}, h AS (SELECT doc_id, p, t, n, greatest(0, least(p - 49152, n - least(65536, n))) AS a FROM c), hw AS (SELECT doc_id, p, p - a AS o, substring(t, (a + 1)::INT, least(65536, n)::INT) AS rw FROM h),
y AS (SELECT doc_id, p, o, rw, substring(rw, 1, o::INT) || 'ACG' || substring(rw, o::INT + 2) AS vw FROM hw),
l AS (SELECT doc_id, p, o, length(rw) AS shared, {_CODES.format('rw')} AS rf, {_CODES.format('vw')} AS vf, {_CODES.format(_COMPLEMENT.format('rw'))} AS rc, {_CODES.format(_COMPLEMENT.format('vw'))} AS vc FROM y),
z AS (SELECT doc_id, p, o, shared, unnest(range(shared)) AS j, unnest(rf) AS rf, unnest(list_prepend(1, rf)[1:shared]) AS rp, unnest(rc) AS rc, unnest(list_append(rc[2:], 1)) AS rn,
  unnest(vf[1:shared]) AS vf, unnest(list_prepend(1, vf)[1:shared]) AS vp, unnest(vc[1:shared]) AS vc, unnest(list_append(vc[2:], 1)[1:shared]) AS vn,
  unnest(list_append(rf[2:], NULL)) AS rl, unnest(vf[2:shared + 1]) AS vl FROM l),
m AS (SELECT doc_id, p, o, j, 0 AS dir, o + 3 AS s, shared AS e, 64 AS w, vf AS v1, vp AS v2, rf AS s1, rp AS s2, rc AS x1, rn AS x2, CASE WHEN j < shared - 1 THEN abs(vl) / 8 - abs(rl) / 8 ELSE 0 END AS loss FROM z
  UNION ALL SELECT doc_id, p, o, j, 1, 0, o, 0, vc, vn, rc, rn, rf, rp, CASE WHEN j < shared - 1 THEN abs(vc) / 8 - abs(rc) / 8 ELSE 0 END FROM z)"""


@query(f"""WITH {_LETTERS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, dir ORDER BY j >= s + w, CASE WHEN j < s + w THEN 0 ELSE (v1 * s1 + v2 * s2) / (greatest(sqrt(v1 * v1 + v2 * v2), 1e-8) * greatest(sqrt(s1 * s1 + s2 * s2), 1e-8)) END, j) AS r
  FROM m WHERE j >= s AND j < e),
q AS (SELECT *, j + p - o AS pos, row_number() OVER (PARTITION BY doc_id, dir ORDER BY j) - 1 AS slot FROM k WHERE r <= 256)
SELECT doc_id::VARCHAR AS variant_id, d.dir::INT AS dir, count(pos) AS n_kept, coalesce(sum(pos), 0)::BIGINT AS sum_pos, coalesce(sum(slot * pos), 0)::BIGINT AS sum_slot_pos, coalesce(sum(loss), 0) AS sum_loss,
  coalesce(sum((slot + 1) * (v1 + 3 * s2 + 5 * x1)), 0) AS sum_vectors FROM (SELECT doc_id, unnest([0, 1]) AS dir FROM c) d LEFT JOIN q USING (doc_id, dir) GROUP BY 1, 2""")
def harvest_selected(spark: SparkSession, d: str) -> DataFrame:
    """Windows, both passes of a model, selection, positions and losses of every document, of the default sizes; sums over the slots."""
    kept = _letter_harvest(spark, d).filter("slot >= 0").withColumn("real", F.col("pos") >= 0)
    vectors = (F.col("slot") + 1) * (F.col("var_same")[0] + 3 * F.col("ref_same")[1] + 5 * F.col("ref_cross")[0]).cast("double")
    zero = lambda c: F.coalesce(F.sum(F.when(F.col("real"), c)), F.lit(0))
    return kept.groupBy("variant_id", "dir").agg(
        F.count_if("real").alias("n_kept"), zero(F.col("pos")).alias("sum_pos"), zero(F.col("slot") * F.col("pos")).alias("sum_slot_pos"),
        F.coalesce(F.sum(F.when(F.col("real"), F.col("loss").cast("double"))), F.lit(0.0)).alias("sum_loss"), F.coalesce(F.sum(F.when(F.col("real"), vectors)), F.lit(0.0)).alias("sum_vectors"),
    )


@query(f"""WITH {_LETTERS}, u AS (SELECT doc_id, dir, unnest([0, 1, 2]) AS view, unnest([v1, s1, x1]) AS a, unnest([v2, s2, x2]) AS b FROM m),
n AS (SELECT *, sqrt((a * a + b * b) / 2 + {vectors.FLOAT_EPS!r}::DOUBLE) AS g FROM u)
SELECT doc_id::VARCHAR AS variant_id, dir::INT AS dir, view::INT AS view, round(avg(a / g), 6) AS mean_0, round(avg(b / g), 6) AS mean_1 FROM n GROUP BY 1, 2, 3""")
def harvest_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of normalised vectors over the shared length: two directions, three views."""
    means = _letter_harvest(spark, d).filter("mean is not null").select("variant_id", "dir", F.posexplode("mean").alias("view", "m"))
    return means.select("variant_id", "dir", "view", *[F.round(F.col("m")[i], 6).alias(f"mean_{i}") for i in (0, 1)])
