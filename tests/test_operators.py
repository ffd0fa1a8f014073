"""Operators on the hand-made fixtures of FIXTURES.md."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readsift.functions import names, sequence
from readsift.ml import models
from readsift.operators import compare, cutoffs, features, folds, intervals, labels, library, ranking, samples, topk
from readsift.sources import text
from readsift.stats import tests as st


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def paf(q, qend=95, t="zc1", ts=0, te=95, m=90, bl=95, tags=()):
    return "\t".join(map(str, [q, 100, 0, qend, "+", t, 5000, ts, te, m, bl, 60, *tags]))


def test_ragged_paf(spark, tmp_path):
    p = write(tmp_path / "a.paf", [paf("r1", m=80, tags=["a:1"]), paf("r2", m=70, tags=["a:1", "b:2"]), paf("r1", m=95, bl=100, tags=["a", "b", "c"]), paf("r3", m=60)])
    d = text.read_paf(spark, p)
    assert d.count() == 4
    best = topk.best_per_key(d, ["qname"], "score", ["_ord"])
    assert {r.qname: r.score for r in best.collect()} == {"r1": 95.0, "r2": 70.0, "r3": 60.0}
    assert math.isclose(d.where("qname = 'r3'").first().identity, 60 / 95) and d.first().coverage == 0.95


def test_competition(spark):
    df = lambda x: spark.createDataFrame(x, "read_id string, score double")
    host = [df([("r_human", 100.0), ("r_target", 40.0), ("r_tie", 70.0)]), df([("r_t2t", 90.0)])]
    gone = labels.depleted(host, df([("r_human", 80.0), ("r_target", 120.0), ("r_tie", 70.0)]))
    assert {r.read_id for r in gone.collect()} == {"r_human", "r_t2t"}
    reads = df([("r_tie", 0.0), ("r_t2t", 0.0)])
    assert [r.read_id for r in labels.survivors(reads, gone).collect()] == ["r_tie"]


def test_three_classes(spark):
    d = spark.createDataFrame(
        [("pos", 90 / 95, 0.95, 90.0, 20.0, False), ("human", 90 / 95, 0.95, 90.0, 105.0, False), ("tie", 90 / 95, 0.95, 90.0, 90.0, False), ("lowid", 0.8, 0.95, 80.0, None, False), ("lowcov", 0.96, 0.5, 48.0, None, False), ("amb", 0.5, 0.1, 1.0, 10.0, True), ("none", None, None, None, None, None)],
        "id string, i double, c double, z double, h double, a boolean",
    )
    got = d.select("id", labels.three_class(F.col("i"), F.col("c"), F.col("z"), F.col("h"), F.col("a")).alias("l"))
    assert dict(rows(got)) == {"pos": "positive", "human": "negative", "tie": "negative", "lowid": "negative", "lowcov": "negative", "amb": "ambiguous", "none": "negative"}


def test_label_library(spark, tmp_path):
    """Files to labels and features: the label set of FIXTURES.md, read ids with a tail, a read in no list."""
    target = [paf("r_positive x=1"), paf("r_human"), paf("r_tie"), paf("r_lowid", m=80, bl=100), paf("r_lowcov", qend=50, m=48, bl=50), paf("r_ambiguous", ts=1000, te=1095), paf("r_only", tags=("a", "b", "c"))]
    host_a = [paf("r_positive", t="h", m=20), paf("r_human", t="h", m=100), paf("r_tie", t="h"), paf("r_ambiguous", t="h", m=10), paf("r_host", t="h", m=50)]
    host_b = [paf("r_human", t="h", m=105), paf("r_late", t="h", m=60)]
    z, a, b = (text.read_paf(spark, write(tmp_path / n, x)) for n, x in (("z.paf", target), ("a.paf", host_a), ("b.paf", host_b)))
    regions = text.read_bed(spark, write(tmp_path / "m.bed", ["zc1\t1000\t1100"]))
    reads = spark.createDataFrame([(f"r_{x}",) for x in ("positive", "human", "tie", "lowid", "lowcov", "ambiguous", "none")], "read_id string")
    lookup = spark.createDataFrame([("zc1", "Sp one")], "contig string, species string")
    got = {r.read_id: r for r in library.label_library(z, [a, b], reads, regions, lookup).collect()}
    assert {k: r.label for k, r in got.items()} == {f"r_{k}": v for k, v in {"positive": "positive", "human": "negative", "tie": "negative", "lowid": "negative", "lowcov": "negative", "ambiguous": "ambiguous", "none": "negative"}.items()}
    assert (got["r_human"].human_score, got["r_none"].zymo_score, got["r_none"].species, got["r_tie"].species) == (105, 0, None, "Sp one")
    free = library.label_library(z, [a, b])
    seen = {r.read_id: (r.label, r.species) for r in free.collect()}
    assert seen["r_ambiguous"] == ("positive", "zc1") and seen["r_only"] == ("positive", "zc1") and seen["r_host"] == ("negative", None)
    assert "r_late" not in seen and len(seen) == 8
    full = library.library_features(free, [features.competitor_features(b), None])
    assert {r.read_id: r.human_bitscore for r in full.collect()}["r_human"] == 105 and full.count() == 8


def test_features_of_several_libraries(spark):
    """One read id in two libraries keeps its features apart."""
    keys = ("library_id", "read_id")
    lab = spark.createDataFrame([("L1", "r", "positive"), ("L2", "r", "negative"), ("L2", "s", "negative")], "library_id string, read_id string, label string")
    paf_rows = spark.createDataFrame([("L1", "r", 10.0, 0.9, 0), ("L2", "r", 20.0, 0.8, 1), ("L2", "r", 15.0, 0.7, 2)], "library_id string, qname string, score double, identity double, _ord long")
    qc = spark.createDataFrame([("L1", "r", 100.0), ("L2", "r", 200.0), ("L2", "s", 300.0)], "library_id string, read_id string, read_len double")
    why = spark.createDataFrame([("L1", "r", "Data_Service_UNBLOCK_mux_change"), ("L2", "r", "signal_positive")], "library_id string, read_id string, end_reason string")
    seqs = spark.createDataFrame([("L1", "r", "GGGGCC"), ("L2", "r", "ACGT")], "library_id string, read_id string, sequence string")
    full = library.library_features(lab, [features.competitor_features(paf_rows, ["library_id"]), features.qc_features(qc, why, seqs, keys)], keys)
    got = {(r.library_id, r.read_id): r for r in full.collect()}
    assert len(got) == 3
    a, b, c = got["L1", "r"], got["L2", "r"], got["L2", "s"]
    assert (a.human_bitscore, b.human_bitscore, c.human_bitscore) == (10, 20, None)
    assert (a.read_len, b.read_len, a.end_reason_unblock, b.end_reason_unblock, c.end_reason_unblock) == (100, 200, 1, 0, 0)
    assert (a.gc, b.gc, c.gc, c.dust_score) == (1.0, 0.5, None, None)
    assert a.dust_score is not None and a.homopolymer_frac is not None
    bare = features.qc_features(qc.withColumn("gc", F.lit(0.25)), keys=keys).collect()
    assert {(r.gc, r.end_reason_unblock, r.dust_score) for r in bare} == {(0.25, None, None)}
    kept = features.qc_features(qc.withColumn("gc", F.lit(0.25)), None, seqs, keys).collect()
    assert {r.gc for r in kept} == {0.25}


def test_poisson_and_leakage(spark):
    ab = spark.createDataFrame([("high", 0.5), ("low", 0.0001)], "species string, rel_abundance double")
    d = spark.createDataFrame([("a", "high", 10.0, "positive"), ("b", "low", 10.0, "positive"), ("c", None, 10.0, "negative")], "read_id string, species string, concentration double, label string")
    f = {r.read_id: r for r in labels.apply_poisson_floor(d, ab).collect()}
    assert (f["a"].label, f["b"].label, f["c"].label) == ("positive", "indeterminate", "negative")
    assert f["b"].label_prefloor == "positive" and not f["c"].indeterminate
    assert math.isclose(spark.range(1).select(labels.detection_probability(F.lit(5.0)).alias("p")).first().p, 1 - math.exp(-5))
    s = spark.createDataFrame([("L1", "D1", "c1", 10.0), ("L2", "D2", "c1", 20.0)], "library_id string, donor string, titration_level string, concentration double")
    g = labels.expected_grid(s, ab)
    assert g.count() == 4 and g.where("expected_present").count() == 2
    lk = spark.createDataFrame([("R1", "negative", "positive"), *[("R1", "negative", "negative")] * 3, ("R1", "c4", "positive"), ("R2", "c4", "positive")], "run_id string, titration_level string, label_prefloor string")
    got = {r.run_id: r.leakage_upper_bound for r in labels.leakage(lk).collect()}
    assert got == {"R1": 0.25, "R2": None}


def test_blast_and_tokens(spark, tmp_path):
    p = write(tmp_path / "b.tsv", ["\t".join(map(str, x)) for x in (["r1", "s1", 1, 99, 100, 0, 0, 1, 100, 1, 100, 1e-50, 100, 100, 5000], ["r1", "s2", 2, 95, 90, 5, 0, 1, 90, 1, 90, 1e-30, 70, 100, 4000], ["r2", "s3", 9, 95, 90, 5, 0, 1, 90, 1, 90, 1e-30, 70, 100, 4000])])
    lin = spark.createDataFrame([("1", "sp1", "g1", "s"), ("2", "sp2", "g1", "s")], text.LINEAGE)
    f = {r.read_id: r for r in features.blast_features(text.read_blast(spark, p), lin, 2).collect()}
    r = f["r1"]
    assert (r.bitscore_margin_species, r.n_species_topn, r.n_genera_topn, r.tax_entropy_topn, r.subject_genome_len) == (30.0, 2, 1, 1.0, 5000)
    assert f["r2"].bitscore_margin_species is None and f["r2"].n_species_topn == 1
    k = write(tmp_path / "k.out", ["C\tr1\t10\t100\t10:7 20:3", "U\tr2\t0\t100\t0:0", "U\tr3\t0\t100\t0:66", "C\tr4\t5\t100\t"])
    got = {r.read_id: (r.k2_conf, r.k2_distinct_minimizers) for r in features.kraken_features(text.read_kraken(spark, k)).collect()}
    assert got == {"r1": (0.7, 2), "r2": (0.0, 0), "r3": (1.0, 0), "r4": (0.0, 0)}


def test_sources(spark, tmp_path):
    q = text.read_qc(spark, write(tmp_path / "q.tsv", ["#id\tlength\tavg.qual\tGC(%)", "r1 extra\t100\t12.5\t40"])).first()
    assert (q.read_id, q.read_len, q.mean_q, q.gc) == ("r1", 100.0, 12.5, 0.4)
    with pytest.raises(ValueError, match="titration_level"):
        text.read_sample_sheet(spark, write(tmp_path / "s.tsv", ["library_id\tdonor", "L1\tD1"]))
    fa = text.read_fasta(spark, write(tmp_path / "f.fa", [">a desc->x", "ACGT", "AC", ">b", "GG"]))
    assert rows(fa) == [("a", "ACGTAC", 6), ("b", "GG", 2)]
    # Ties go by file and place, though larger files are packed first.
    write(tmp_path / "a.paf", ["r\t100\t0\t9\t+\tA\t9\t0\t9\t5\t9\t60"])
    write(tmp_path / "b.paf", ["r\t100\t0\t9\t+\tB\t9\t0\t9\t5\t9\t60"] * 50)
    best = topk.best_per_key(text.read_paf(spark, [str(tmp_path / "b.paf"), str(tmp_path / "a.paf")]), ["qname"], "score", ["_ord"])
    assert [r.tname for r in best.collect()] == ["A"]
    assert text.summary_file("ab-cd1234-99", ["x_abcd1234.txt", "y.txt"]) == "x_abcd1234.txt" and text.summary_file("zz", ["only.txt"]) == "only.txt"
    assert text.run_tag("fixed", 0.9, 0.8) == "gt_fixed_id0.90_cov0.80"
    g = spark.createDataFrame([("g", 1, "AC"), ("g", 2, "GT")], "genome string, ord int, seq string")
    assert text.collapse_contigs(g, spacer=3).first().seq == "ACNNNGT"
    assert text.wrap_fasta(spark.createDataFrame([("x", "ACGTA")], "id string, seq string"), width=2).first().value == ">x\nAC\nGT\nA"
    out = str(tmp_path / "t")
    assert not text.done(spark, [out])
    text.write_table(spark.createDataFrame([("a", 1)], "arm string, v int"), out, ["arm"])
    assert text.done(spark, [out])
    u = features.outer_union([spark.createDataFrame([(f"r{i}", i)], f"read_id string, c{i} int") for i in range(4)])
    assert u.count() == 4 and len(u.columns) == 5


def test_intervals(spark):
    df = lambda x: spark.createDataFrame(x, "k string, start long, end long")
    m = intervals.merge_intervals(df([("a", 0, 10), ("a", 10, 20), ("a", 21, 30), ("a", 22, 25), ("b", 5, 6)]), ["k"])
    assert rows(m) == [("a", 0, 20, 2), ("a", 21, 30, 2), ("b", 5, 6, 1)]
    left = spark.createDataFrame([(1, "a", 0, 10), (2, "a", 31, 40), (3, "a", 5, 9), (4, "z", 0, 99)], "id long, k string, start long, end long")
    right = df([("a", 10, 20), ("a", 40, 50)])
    for b in (None, 7):
        got = {r.id: r.in_region for r in intervals.overlap_flag(left, right, "k", bin_size=b).collect()}
        assert got == {1: True, 2: True, 3: False, 4: False}
    c = spark.createDataFrame([("full", 0, 100, 100), ("half", 0, 50, 100), ("two", 0, 60, 100), ("two", 40, 120, 100), ("none", 7, 7, 100), ("bad", 0, 5, 0)], "k string, start long, end long, glen long")
    got = {r.k: (r.genome_breadth, None if r.coverage_evenness is None else round(r.coverage_evenness, 6)) for r in intervals.coverage(c, ["k"]).collect()}
    assert got == {"full": (1.0, 1.0), "half": (0.5, 0.5), "two": (1.0, 0.866667), "none": (0.0, 0.0), "bad": (None, None)}


def test_sequences(spark):
    d = spark.createDataFrame([(1, "AAAAAA"), (2, "ACGTAC"), (3, "gG"), (4, ""), (5, "aab\n\n\ncc")], "id int, s string")
    dust = {r.id: r.dust_score for r in sequence.dust_scores(d, "id", "s").collect()}
    assert (dust[1], dust[2], dust[3], dust[4]) == (1.5, 0.0, 0.0, 0.0)
    f = {r.id: (r.gc, r.h) for r in d.select("id", sequence.gc_fraction(F.col("s")).alias("gc"), sequence.homopolymer_frac(F.col("s")).alias("h")).collect()}
    assert f[1] == (0.0, 1.0) and f[2] == (0.5, 1 / 6) and f[3] == (1.0, 1.0) and f[4] == (0.0, 0.0) and f[5][1] == 2 / 8
    s = spark.createDataFrame([("Escherichia_coli_b2207",), ("Candida_albican",)], "s string").select(names.canonical_species(F.col("s")).alias("c"))
    assert rows(s) == [("Candida_albicans",), ("Escherichia_coli_B2207",)]
    assert rows(s.select(names.species_group(F.col("c")))) == [("Candida_albicans",), ("Escherichia_coli",)]


def test_triplets_are_counted_without_a_shuffle(spark):
    texts = ["aAaé\n\U0001f600gGgg", "ab" * 5000, "\U0001f600" * 4, "xy", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    out = sequence.dust_scores(d, "id", "s")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.dust_score for r in out.collect()}
    for i, t in enumerate(texts):
        t = "".join(c.upper() if "a" <= c <= "z" else c for c in t or "")
        each = [t[k : k + 3] for k in range(len(t) - 2)]
        want = sum(c * (c - 1) for c in (each.count(x) for x in set(each))) / (2 * len(each)) if each else 0.0
        assert math.isclose(got[i], want, rel_tol=1e-12)


def test_metrics(spark):
    d = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.8), (3, 0, 0.2), (4, 0, 0.1), (5, 1, float("nan")), (6, None, 0.5)], "id int, y int, s double")
    m = ranking.metric_rows(d, [], "y", "s", ["id"], (0.5, 1.0)).collect()
    assert [(r.auprc, r.prec_at_recall, r.fdr_at_recall, r.n_pos, r.n_neg) for r in m] == [(1.0, 1.0, 0.0, 2, 2)] * 2
    rng = random.Random(3)
    data = [(i, rng.randint(0, 1), round(rng.random(), 2)) for i in range(200)]
    got = ranking.auprc(spark.createDataFrame(data, "id int, y int, s double"), [], "y", "s", ["id"]).first().auprc
    tp, ap, pos = 0, 0.0, sum(y for _, y, _ in data)
    for k, (_, y, _) in enumerate(sorted(data, key=lambda r: (-r[2], r[0])), 1):
        tp += y
        ap += y * tp / k / pos
    assert math.isclose(got, ap)
    t = spark.createDataFrame([(1, 1, 0.9, 0, "c1"), (2, 0, 0.3, 1, "c1"), (3, 0, 0.2, 0, None)], "id int, y int, s double, u int, l string")
    n = {(r.truncated_included, r.stratum): r.n_neg for r in ranking.stratified_metrics(t, [], "y", "s", ["id"], "u", "l", (0.9,)).collect()}
    assert n[(True, "all")] == 2 and n[(False, "all")] == 1


def test_sample_taxon(spark):
    base = ("a", "m", "LOEO", 1, "D1", "c1")
    p = spark.createDataFrame([(*base, "rA1", "spA", 1, 0.9), (*base, "rA2", "spA", 1, 0.8), (*base, "rB1", "spB", 1, 0.7), (*base, "rN", None, 0, 0.1)], "arm string, model string, scheme string, fold int, donor string, titration_level string, read_id string, species string, y int, score double")
    ex = spark.createDataFrame([("D1", "c1", "spA", 5.0, 0.99, True), ("D1", "c1", "spB", 0.0, 0.0, False), ("D1", "c1", "spC", 5.0, 0.99, True)], "donor string, titration_level string, species string, expected_cells double, p_detect double, expected_present boolean")
    got = {r.species: r for r in samples.aggregate_sample_taxon(p, ex).collect()}
    assert {k: r.y for k, r in got.items()} == {"spA": 1, "spB": 0, "spC": 1}
    assert math.isclose(got["spC"].max_score, 0.7 - 1) and got["spA"].reads_above_thr_per_million == 250000.0
    assert {r.species: r.y for r in samples.aggregate_sample_taxon(p, None).collect()} == {"spA": 1, "spB": 1}


def test_cutoffs(spark):
    d = spark.createDataFrame([(0.97, 0.95), (0.93, 0.85), (0.88, 0.75), (0.82, 0.60)], "identity double, coverage double")
    s = cutoffs.sweep(d, (0.80, 0.85, 0.90, 0.92, 0.95, 0.97), (0.5, 0.6, 0.7, 0.8, 0.9))
    got = {(r.gt_min_identity, r.gt_min_coverage): r.n_retained for r in s.collect()}
    assert len(got) == 30 and got[(0.80, 0.5)] == 4
    for (i, c), n in got.items():
        assert n == sum(a >= i and b >= c for a, b in [(0.97, 0.95), (0.93, 0.85), (0.88, 0.75), (0.82, 0.60)])
    best = cutoffs.recommend(s, 0.75).first()
    assert (best.gt_min_identity, best.gt_min_coverage) == (0.85, 0.7)


def test_folds(spark):
    data = [(f"D{i}{x}", f"D{i}", s, l) for i in range(4) for x, s, l in (("p1", "sp1", "positive"), ("p2", "sp2", "positive"), ("n", None, "negative"), ("a", "sp1", "ambiguous"), ("i", "sp1", "indeterminate"))]
    r = spark.createDataFrame(data, "read_id string, donor string, species string, label string")
    m = folds.loeo_masks(r, folds.loeo_folds(r)).collect()
    tested = [x.read_id for x in m if x.part == "test"]
    assert len(tested) == len(set(tested)) == 12 and all(x.label in ("positive", "negative") for x in m)
    t = folds.loto_masks(r, folds.loto_folds(r, r), r).collect()
    for x in t:
        if x.label == "positive":
            assert (x.species == x.test_species) == (x.part == "test")
    for f in {x.fold for x in t}:
        parts = [{x.donor for x in t if x.fold == f and x.part == p} for p in ("train", "test")]
        assert not parts[0] & parts[1]
    alone = r.where("donor = 'D0'")
    assert {(x.fold, x.part) for x in folds.loto_masks(alone, folds.loto_folds(alone, alone), alone).collect()} == {(1, "test"), (2, "test")}
    w = folds.balance_weights(spark.createDataFrame([("D1",)] * 2 + [("D2",)] * 4, "donor string"), ["donor"]).collect()
    assert sum(x.weight for x in w if x.donor == "D1") == sum(x.weight for x in w if x.donor == "D2") == 3.0
    c = folds.stratified_cap(spark.range(10000).withColumn("y", (F.col("id") < 7000).cast("int")), "y", 1000, ["id"])
    assert {x.y: x["count"] for x in c.groupBy("y").count().collect()} == {1: 700, 0: 300}
    a = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, None)], "g int, f double")
    assert rows(folds.impute_median(a, a, ["g"], ["f"])) == [(1, 1.0), (1, 2.0), (1, 2.0), (1, 3.0)]
    with pytest.raises(ValueError, match="features not in"):
        features.model_columns(a, "combined")


def test_statistics(spark):
    d = spark.createDataFrame([("a", i, 0.1 + i / 100) for i in range(8)] + [("b", i, x) for i, x in enumerate([0.1, -0.2, 0.3, 0.4, 0.0])] + [("z", 0, 0.0)], "id string, fold int, d double")
    got = {r.id: r for r in st.wilcoxon_exact(d, ["id"]).collect()}
    assert got["a"].p_value == 2 / 2**8 and got["b"].n == 4 and got["b"].statistic == 8.0 and (got["z"].n, got["z"].p_value) == (0, None)
    x = [1.0, 2.0, 3.0, 4.0]
    want = np.mean([abs(sum(r for r, s in zip(x, m) if s) - 5) >= abs(8 - 5) for m in itertools.product([0, 1], repeat=4)])
    assert got["b"].p_value == want
    p = spark.createDataFrame([("1", 0.01), ("2", 0.04), ("3", 0.03), ("4", None)], "id string, p double")
    h = {r.id: r.p_adjusted for r in st.holm_sidak(p).collect()}
    assert math.isclose(h["1"], 1 - 0.99**4) and h["1"] <= h["3"] <= h["2"] and h["4"] is None
    m = spark.createDataFrame([("a", "low", 0.9), ("b", "low", 0.7), ("a", "high", 0.95), ("b", "high", 0.9)] * 2, "method string, level_group string, auprc double")
    assert math.isclose(st.interaction(m).first().estimate, 0.15)
    r = st.rank_sum(spark.createDataFrame([(1, 3.0), (1, 4.0), (0, 1.0), (0, 2.0), (0, 3.0)], "g int, s double"), "g", "s").first()
    assert r.w == 5.5 and 0 < r.p_value < 1


def test_comparison(spark):
    c = spark.createDataFrame([("positive", "positive")] * 3 + [("negative", "positive"), ("positive", "negative")], "ground_truth string, model_call string")
    r = compare.confusion(c).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision) == (3, 1, 1, 0, 0.75)
    f = spark.createDataFrame([(0.5,), (0.001,), (None,)], "x double").select(compare.format_effect(F.col("x")).alias("e"), compare.format_p(F.col("x") / 100).alias("p"))
    assert [tuple(x) for x in f.collect()] == [("0.500", "0.0050"), ("1.00e-03", "1.0e-05"), ("-", "-")]


def test_models(spark):
    rng = np.random.default_rng(0)
    data = [(f"r{i}", f"D{i // 2 % 4}", float(i % 2), float(rng.normal(2 * (i % 2))), float(rng.normal()) if i % 7 else None) for i in range(240)]
    t = spark.createDataFrame(data, "read_id string, donor string, y double, f1 double, f2 double")
    for m in ("fixed_threshold", "glm", "glmm"):
        o = models.out_of_fold(t, ["f1", "f2"], m)
        assert o.count() == 240 and ranking.auprc(o, [], "y", "score", ["read_id"]).first().auprc > 0.8
    bad = models.out_of_fold(t, ["f1"], lambda *a: 1 / 0)
    assert bad.where("error is not null and score is null").count() == 240


def test_profiles(spark):
    from readsift.operators import profiles

    assert profiles.resolve_profile("fixed").min_identity == 0.9
    with pytest.raises(FileNotFoundError):
        profiles.resolve_profile("calculated")
    with pytest.raises(ValueError):
        profiles.resolve_profile("other")
    df = lambda x: spark.createDataFrame(x, "tname string, start long, end long")
    assert rows(profiles.region_mask([df([("a", 0, 10), ("b", 1, 2)]), df([("a", 10, 400), ("b", 5, 100)])], {1: 300})) == [("a", 0, 400), ("b", 1, 2)]
    e = spark.createDataFrame([([1.0, 1.0],), ([0.0, 0.0],), ([0.0, 2.0],)], "q array<double>").select(profiles.vector_evenness(F.col("q")).alias("e"))
    assert [r.e for r in e.collect()] == [1.0, 0.0, 0.5]
