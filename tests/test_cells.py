"""Cells with coverage: the ablation against plain fits, its rows in the hypothesis table, and levels."""

import math

import numpy as np

from readsift.ml import samples
from readsift.stats import study

KINDS = "arm string, model string, scheme string, fold int, donor string, titration_level string, species string, mean_score double, max_score double, reads_above_thr_per_million double, y int, genome_breadth double, coverage_evenness double"


def made(seed=4, known=True):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(6):
        for level in ("c1", "c2", "c4"):
            for s in range(8):
                y = int(rng.random() < 0.5)
                breadth = float(np.clip(0.4 * y + rng.random() * 0.7, 0.01, 1)) if known and rng.random() > 0.1 else None
                out.append(("combined", "boosted_trees", "LOEO", i + 1, f"d{i}", level, f"s{s}", float(rng.normal(0.2 * y)), float(rng.normal(0.3 * y)), float(rng.random() * 1e5), y, breadth, float(rng.random()) if known else None))
    return out


def plain(rows, columns):
    """Per held-out donor: medians, Newton steps, scores and average precision."""
    x = np.array([[np.nan if r[c] is None else r[c] for c in columns] for r in rows], float)
    if 9 in columns:
        x[:, columns.index(9)] /= 1e6
    y, donor = np.array([r[10] for r in rows], float), np.array([r[4] for r in rows])
    name = [f"{r[4]}|{r[5]}|{r[6]}" for r in rows]
    got = {}
    for k, d in enumerate(sorted(set(donor)), 1):
        tr = donor != d
        full = np.where(np.isnan(x), np.nanmedian(x[tr], axis=0), x)
        a = np.c_[np.ones(len(y)), full]
        b = np.zeros(a.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-a[tr] @ b))
            b = b + np.linalg.solve((a[tr] * (p * (1 - p))[:, None]).T @ a[tr], a[tr].T @ (y[tr] - p))
        order = sorted(np.flatnonzero(~tr), key=lambda i: (-(a[i] @ b), name[i]))
        hit = np.cumsum(y[order])
        got[k] = float(np.sum((hit / np.arange(1, len(order) + 1))[y[order] == 1]) / hit[-1])
    return got


def test_ablation_equals_plain_fits_and_feeds_the_table(spark):
    rows = made()
    m = samples.sample_taxon_ablation(spark.createDataFrame(rows, KINDS).repartition(3)).persist()
    got = {(r.model, r.fold): r.auprc for r in m.where("recall_target = 0.95").collect()}
    for model, columns in (("sxt_full", [7, 8, 9, 11, 12]), ("sxt_minus_breadth", [7, 8, 9])):
        want = plain(rows, columns)
        assert {k[1] for k in got if k[0] == model} == set(want)
        assert all(math.isclose(got[model, k], v, abs_tol=1e-9) for k, v in want.items())
    pairs = study.design(spark, "glm", "boosted_trees", "blast_only").where("id = 'H5b'")
    r = study.contrasts(study.vectors(m), pairs).first()
    d = [got["sxt_full", k] - got["sxt_minus_breadth", k] for k in range(1, 7)]
    assert r.n_folds == 6 and math.isclose(r.median_diff, float(np.median(d)), abs_tol=1e-9) and r.median_diff > 0


def test_ablation_needs_coverage(spark):
    rows = made(known=False)
    assert samples.sample_taxon_ablation(spark.createDataFrame(rows, KINDS)) is None
    zeros = [(*r[:11], 0.0, 0.0) for r in rows]
    assert samples.sample_taxon_ablation(spark.createDataFrame(zeros, KINDS)) is None
    even = [(*r[:11], None, 0.5 if i < 5 else 0.0) for i, r in enumerate(rows)]  # one of the block's columns is enough
    assert samples.sample_taxon_ablation(spark.createDataFrame(even, KINDS)) is not None
    assert samples.sample_taxon_ablation(spark.createDataFrame([], KINDS)) is None


def test_levels(spark):
    rows = made()[:60] + [("combined", "boosted_trees", "LOEO", 1, "d0", None, "s0", 0.1, 0.2, 0.0, 1, None, None)]
    m = samples.cell_metrics(spark.createDataFrame(rows, KINDS)).where("recall_target = 0.95 and fold = 1").collect()
    n = {r.stratum: r.n_pos + r.n_neg for r in m}
    assert n == {"all": 25, "c1": 8, "c2": 8, "c4": 8}
