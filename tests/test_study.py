"""The table of hypotheses on a made-up metric table of eight folds."""

import math

import pytest

from readsift.stats import study

KINDS = "arm string, model string, scheme string, level string, stratum string, fold int, truncated_included boolean, recall_target double, auprc double"


def fixture(arm, model, base, scheme="LOEO", level="read", stratum="all"):
    return [(arm, model, scheme, level, stratum, k, True, r, base + k * 0.001 + (0 if r == 0.95 else 9)) for k in range(1, 9) for r in (0.95, 0.99)]


@pytest.fixture(scope="module")
def tables(spark):
    c = "combined"
    base = {"fixed_threshold": 0.50, "glm": 0.70, "random_forest": 0.72, "boosted_trees": 0.75, "glmm": 0.73, "glmm_none": 0.71, "glmm_truth": 0.74, "glmm_classifier": 0.69}
    m = [r for k, b in base.items() for r in fixture(c, k, b)]
    m += fixture("blast_only", "glm", 0.66) + fixture("kraken2_only", "glm", 0.64) + fixture("combined_minus_H5_key", "boosted_trees", 0.70) + fixture(c, "boosted_trees", 0.60, "LOTO")
    for level in ("c1", "c2", "c4", "c5"):
        m += fixture(c, "fixed_threshold", 0.50, stratum=level) + fixture(c, "glm", 0.70 if level in ("c4", "c5") else 0.55, stratum=level)
        m += fixture(c, "boosted_trees", 0.73 if level in ("c4", "c5") else 0.60, stratum=level) + fixture("blast_only", "glm", 0.52, stratum=level)
    m += [r for k, b in (("glm", 0.80), ("sxt_full", 0.85), ("sxt_minus_breadth", 0.78)) for r in fixture(c, k, b, level="sample_taxon")]
    preds = [(c, "boosted_trees", "LOEO", f"{k}_{i}", y, u, s) for k in range(1, 9) for i, (y, u, s) in enumerate([(1, 0, 0.9), (0, 0, 0.2), (0, 1, 0.8), (1, 1, 0.85), (0, None, 0.99)])]
    cal = [(c, k, "LOEO", f, b) for k, b in (("glm", 0.1), ("fixed_threshold", 0.2)) for f in range(1, 9)]
    inner = [(c, k, f, s) for k, s in (("glm", 0.9), ("random_forest", 0.6), ("boosted_trees", 0.7)) for f in range(1, 9)]
    return (
        spark.createDataFrame(m, KINDS),
        spark.createDataFrame(preds, "arm string, model string, scheme string, read_id string, y int, end_reason_unblock int, score double"),
        spark.createDataFrame(cal, "arm string, model string, scheme string, fold int, brier double"),
        spark.createDataFrame(inner, "arm string, model string, fold int, inner_auprc double"),
    )


def test_rows(tables):
    got = {r.id: r for r in study.hypothesis_rows(*tables).collect()}
    assert set(got) == {*(f"H{i}" for i in range(1, 13)), "H5b", "H9b_truth", "H9b_classifier"}
    want = {"H1": 0.04, "H2": 0.20, "H3": 0.15, "H4": 0.05, "H5": 0.05, "H6": 0.30, "H9": 0.01, "H9b_truth": 0.03, "H9b_classifier": -0.02, "H12": 0.1, "H5b": 0.07, "H10": 0.15, "H11": 0.6}
    for k, v in want.items():
        assert math.isclose(got[k].median_diff, v, abs_tol=1e-9), k
    for k in ("H1", "H2", "H4", "H5", "H6"):  # eight folds of one sign: 2 / 2^8, and five of these after the smaller H3
        assert got[k].wilcox_p == 0.0078125 and math.isclose(got[k].holm_sidak_p, 1 - (1 - 0.0078125) ** 5) and got[k].significant and got[k].n_folds == 8
    assert got["H1"].comparison == "AUPRC combined(glm) - blast_only(glm)" and "boosted_trees" in got["H4"].comparison
    assert got["H3"].wilcox_p < 1e-6 and got["H3"].n_folds == 8
    assert all(got[k].holm_sidak_p is None for k in got if got[k].family == "secondary")
    assert "SOURCE-DEPENDENT" in got["H9"].note and "classifier:-1" in got["H9"].note
    assert got["H9"].significant and not got["H7"].significant and got["H8"].median_diff is None
    assert "= 0.000" not in got["H11"].note and "truncated" in got["H11"].note


def test_choice(spark, tables):
    m, _, _, inner = tables
    v = study.vectors(m)
    assert study.choose_family(inner, v) == "glm" and study.choose_family(None, v) == "boosted_trees"
    assert study.choose_family(inner.limit(0), v) == "boosted_trees" and study.choose_family(None, v.limit(0)) == "boosted_trees"
    assert study.choose_arm(v, "glm") == "blast_only"
    swapped = v.replace({"blast_only": "kraken2_only", "kraken2_only": "blast_only"}, subset=["arm"])
    assert study.choose_arm(swapped, "glm") == "kraken2_only"


def test_empty(spark, tables):
    """Without metrics every hypothesis is listed, with no effect and none significant."""
    m, p, c, _ = tables
    got = study.hypothesis_rows(m.limit(0), p.limit(0), c.limit(0)).collect()
    assert len(got) == 15 and not any(r.significant for r in got) and all(r.median_diff is None for r in got)


def test_mixed_supplement(tables):
    got = {r.id: r for r in study.mixed_supplement(tables[0], tables[3]).collect()}
    assert set(got) == {"H1", "H2", "H4"} and got["H1"].n_units == 64 and got["H1"].mixed_estimate > 0 and got["H2"].mixed_p < 0.05


def test_run_driver(spark):
    """Folds, ablations, taxa and sources of a run; tuning takes the better candidate; a failing model is reported."""
    from pyspark.sql import functions as F

    from readsift.ml import models, run

    t = spark.range(240).selectExpr("id read_id", "concat('D', (id div 2) % 3) donor", "'c1' titration_level", "if(id % 2 = 1, concat('s', id div 6 % 3), null) species", "case when id >= 230 then 'ambiguous' when id % 2 = 1 then 'positive' else 'negative' end label", "0 end_reason_unblock", "cast(id % 2 + (id * 37 % 10) / 20 as double) a", "cast(id * 31 % 17 as double) b")

    def broken(train, test, features):
        raise ValueError("no fit")

    by = lambda c: lambda train, test, features: test.withColumn("score", F.col(c))
    p = run.run(t, {"combined": ["a", "b"]}, {"best": by("a"), "tuned": [by("b"), by("a")], "broken": broken}, {"x": ["a"], "y": ["c"]}, {"x": ["x"], "y": ["y"]}, {}, best="best").persist()
    got = {(r.arm, r.model, r.scheme): r for r in p.groupBy("arm", "model", "scheme").agg(F.count("*").alias("n"), F.count("score").alias("s"), F.count("error").alias("e"), F.count_distinct("fold").alias("f")).collect()}
    assert set(got) == {("combined", m, "LOEO") for m in ("best", "tuned", "broken")} | {("combined_minus_x", "best", "LOEO"), ("combined", "best", "LOTO")}
    assert all(r.n == 230 for k, r in got.items() if k[2] == "LOEO") and got["combined", "best", "LOTO"].f == 3
    assert (got["combined", "broken", "LOEO"].e, got["combined", "broken", "LOEO"].s) == (230, 0)
    tuned = {r.read_id: r.score for r in p.where("model = 'tuned'").collect()}
    assert tuned == {r.read_id: r.a for r in t.where("label <> 'ambiguous'").collect()}
    taxa = p.where("scheme = 'LOTO' and y = 1").groupBy("fold").agg(F.count_distinct("species").alias("k")).collect()
    assert all(r.k == 1 for r in taxa)
    inner = run.inner_scores(t, "combined", ["a", "b"], {"good": by("a"), "bad": by("b")}).collect()
    assert len(inner) == 6 and all((r.inner_auprc > 0.99) == (r.model == "good") for r in inner)
