"""Queries do the whole job: no row, replicate or letter is left out on the way to the operator."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from locusframe.operators import activations, genome, metrics, probe
from locusframe.plans import reference


def save(spark, folder, name, data, schema):
    spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")


def info_fields(row_id, gene, significance, consequence, allele, disease, rs):
    """What the published parser (a plain split of INFO) gives for a row."""
    parts = [f"GENEINFO={gene}:1|X:2", "FLAG"]
    parts += [f"{k}={v}" for k, v in (("CLNSIG", significance), ("MC", consequence and f"SO:1|{consequence}"), ("CLNDN", disease), ("ALLELEID", allele), ("RS", rs and rs[2:])) if v is not None]
    info = {}
    for field in ";".join(parts).split(";"):
        key, _, value = field.partition("=")
        info.setdefault(key, value)
    mc, name = info.get("MC", ""), info.get("CLNDN", "").split("|")[0].replace("_", " ")
    return (
        row_id, info["GENEINFO"].split(":")[0], info.get("CLNSIG", "").lower(), mc.split(",")[0].split("|")[-1] if "|" in mc else None, int(info["ALLELEID"]) if "ALLELEID" in info else None,
        name if name and name.lower() not in ("not provided", "not specified") else None, f"rs{info['RS']}" if "RS" in info else None,
    )


def test_info_parse_takes_every_row(spark, tmp_path):
    data = [
        (0, "FUBR15", "Benign", "nonsense", 7, "Ataxia_1", "rs5"), (1, "fubr15", "Pathogenic", "nonsense", 8, "not_provided", None), (2, "FUBR15:10000", None, None, None, None, None),
        (3, " FUBR15", "likely benign; protective", "SO:1000620|intron_variant", 9, "Renal deafness; late form", "rs6"), (4, "A", "a\nb\tc;d", "x,y|z", 1, 'Cough\n"x"|B;C', None),
        (5, "A-B", "x", "x", 1, "x|y", "rs7"), (6, None, "Benign", "nonsense", 1, "x", "rs1"), (7, " \t", "Benign", "nonsense", 1, "x", "rs1"), (8, "", "Benign", "nonsense", 1, "x", "rs1"),
    ]
    save(spark, tmp_path, "variants", data, "row_id long, gene_name string, clinical_significance string, consequence string, allele_id long, disease_name string, rs_id string")
    got = reference.vcf_info_parse(spark, str(tmp_path)).select("row_id", "gene_name", "clinical_significance", "consequence", "allele_id", "disease_name", "rs_id")
    assert sorted(map(tuple, got.collect())) == [info_fields(*row) for row in data[:6]]


def test_model_windows_reads_whole_documents(spark, tmp_path):
    rng = random.Random(5)
    texts = {i: "".join(rng.choice("ACGT -") for _ in range(n)) for i, n in enumerate([900, 1500, 3, 700, 1, 2000, 400, 90, 1200])}
    save(spark, tmp_path, "documents", [(i, t) for i, t in texts.items()] + [(90, None), (91, "--")], "doc_id long, text string")
    got = {}
    for r in reference.model_windows(spark, str(tmp_path)).collect():
        got.setdefault((int(r.variant_id), r.dir), {})[r.slot] = r.pos
    chromosomes = reference._doc_genome(spark, str(tmp_path))
    windows = genome.variant_windows(reference._doc_variants(chromosomes, wrong=False), genome.tiles(chromosomes, 256), size=256)
    letters = {i: "".join(c for c in t if c.isalpha()) for i, t in texts.items()}
    assert {int(r.variant_id): r.ref_window for r in windows.collect()} == {i: t for i, t in letters.items() if t}
    ranges = activations.selection_ranges(windows.withColumn("len", F.length("ref_window").cast("bigint")), "len", "offset")
    rows, want = probe.run_model(windows, probe.hashed_model()), {}
    for direction, sure in ((0, 64), (1, 0)):
        for r in activations.select_positions(rows.filter(F.col("dir") == direction), ranges.filter(F.col("dir") == direction), ["variant_id", "dir"], 256, sure).collect():
            want.setdefault((int(r.variant_id), r.dir), {})[r.slot] = r.pos
    assert got == want and {i for i, _ in got} == {i for i, t in letters.items() if t} and all(len(x) == 256 for x in got.values())
    assert max(max(x.values()) for x in got.values()) > 1000


def test_bootstrap_takes_1000_replicates(spark, monkeypatch):
    """Against brute force: the weights of all blocks written out as rows, and numpy's own draws."""
    rng, n, b, size = np.random.default_rng(4), 150, 1000, 32
    y = rng.integers(0, 2, n)
    s = rng.random(n) + 0.3 * y
    data = [("a", f"v{i:03d}", float(s[i]), int(y[i])) for i in range(n)] + [(None, f"v{i:03d}", float(s[i]), int(y[i])) for i in range(n)] + [("few", f"v{i}", 0.5, i % 2) for i in range(8)] + [("a", "x", None, 1)]
    df = spark.createDataFrame(data, "g string, variant_id string, score double, y int")
    got = {r.g: tuple(r)[1:] for r in metrics.blocked_bootstrap_intervals(df, ["g"], "score", "y", "variant_id", size=size).collect()}
    assert set(got) == {"a", None}
    ranked = y[np.argsort(-s)]
    cuts = [*range(0, n, size), n]
    p, q = (np.array([(ranked[:c] == k).sum() for c in cuts]) for k in (1, 0))

    def measured(t):
        tp = np.cumsum(t)
        return (tp * (1 - t)).sum() / (t.sum() * (n - t.sum())), (tp / np.arange(1, n + 1) * t).sum() / t.sum()

    for key in ("a", None):
        weights = np.zeros((b, n), int)
        for k in range(len(cuts) - 1):
            at = np.arange(cuts[k], cuts[k + 1])
            for r, (p0, n0, wp, wn) in enumerate(metrics.block_weights((key,), p, q, k, b)):
                assert (p0, n0) == tuple(weights[r][: cuts[k]][ranked[: cuts[k]] == c].sum() for c in (1, 0))
                weights[r][at[ranked[at] == 1]], weights[r][at[ranked[at] == 0]] = wp, wn
        assert (weights.sum(1) == n).all() and abs(weights.var(0).mean() - (1 - 1 / n)) < 0.05
        values = np.array([measured(np.repeat(ranked, w)) for w in weights])
        assert np.allclose(got[key], [np.quantile(values[:, m], c) for m in (0, 1) for c in (0.025, 0.975)])
        free = np.array([measured(ranked[np.sort(rng.integers(0, n, n))]) for _ in range(4000)])
        assert np.allclose(got[key], [np.quantile(free[:, m], c) for m in (0, 1) for c in (0.025, 0.975)], atol=0.02)
    used = []
    monkeypatch.setattr(reference.metrics, "blocked_bootstrap_intervals", lambda *a, **k: used.append(k["replicates"]) or spark.createDataFrame([(0.1,) * 4], "auroc_ci_lo double, auroc_ci_hi double, auprc_ci_lo double, auprc_ci_hi double"))
    reference.metric_bootstrap_ci(spark, "/root/testdata/sf0.001")
    assert used == [1000]


def test_deconfounded_queries_use_the_published_budget(spark):
    """The SQL of the small budget, run with 200,000."""
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("variants", "genes"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    for name, columns in (("deconfounded_quota", "consequence, label, obs_n, quota"), ("deconfounded_sample", "variant_id")):
        sql = reference.ORACLE[f"{name}_500"]
        assert sql.count("* 500)") == 1
        want = con.execute(f"SELECT {columns} FROM ({sql.replace('* 500)', '* 200000)')})").fetchall()
        got = getattr(reference, name)(spark, folder).select(*columns.split(", ")).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
        assert len(got) > 500 or name == "deconfounded_quota"


def test_substrings_from_the_whole_text(spark, tmp_path):
    texts = {i: "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(n)) for i, n in enumerate([0, 1, 60, 300, 2000, 997])}
    save(spark, tmp_path, "documents", [*texts.items(), (9, None)], "doc_id long, text string")
    want = {i: t[(p := i * 37 % len(t) if t else 0) : p + 5] for i, t in texts.items()}
    got = reference.seq_substring_check(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.piece for r in got} == want and {r.doc_id: r.same for r in got} == {i: want[i] == t[:5] for i, t in texts.items()}
    assert want[5] == texts[5][185:190]


def test_loss_differences_take_every_loss(spark):
    """The SQL of the part, run without its condition."""
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    sql = reference.ORACLE["array_loss_diff_part"]
    assert sql.count(" AND a[1] > 0") == 1
    want = con.execute(f"SELECT variant_id, slot, pos, loss FROM ({sql.replace(' AND a[1] > 0', '')})").fetchall()
    got = reference.array_loss_diff(spark, folder).select("variant_id", "slot", "pos", "loss").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(r.loss for r in got)
