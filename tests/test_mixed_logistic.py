"""The mixed logistic model of all folds against a dense fit, its case-control draw, and levels that are unseen or missing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from readsift.ml import folded, mixed_logistic, models

SCHEMA = "read_id long, donor string, species string, y double, a double, b double"


def dense(x, y, groups, rounds=200):
    """Logistic model with random intercepts by penalised quasi-likelihood.

    Returns fixed effects (intercept first), one vector of effects a grouping, and their variances.
    Variances follow from the posterior means and variances of the effects (an EM step a round).
    """
    n = len(y)
    x = np.column_stack([np.ones(n), x])
    sizes = [int(g.max()) + 1 for g in groups]
    width = x.shape[1] + sum(sizes)
    z = np.zeros((n, width))
    z[:, : x.shape[1]] = x
    at = x.shape[1]
    for g, s in zip(groups, sizes):
        z[np.arange(n), at + g] = 1.0
        at += s
    var, b = [1.0] * len(groups), np.zeros(width)
    for _ in range(rounds):
        pen = np.r_[np.full(x.shape[1], 1e-6), *[np.full(s, 1 / v) for s, v in zip(sizes, var)]]
        for _ in range(8):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-6)
            h = (z * w[:, None]).T @ z + np.diag(pen)
            step = np.linalg.solve(h, z.T @ (y - p) - pen * b)
            b = b + step
            if np.abs(step).max() < 1e-6:
                break
        cov = np.diag(np.linalg.inv(h))
        at = x.shape[1]
        for k, s in enumerate(sizes):
            var[k] = float(max(1e-4, np.mean(b[at : at + s] ** 2 + cov[at : at + s])))
            at += s
    effects, at = [], x.shape[1]
    for s in sizes:
        effects.append(b[at : at + s])
        at += s
    return b[: x.shape[1]], effects, var


def planted(n=4000, seed=0, base=-0.5):
    """Rows of four donors and twelve species with effects of their own; a tenth of one feature is missing."""
    rng = np.random.default_rng(seed)
    x, donor, species = rng.normal(size=(n, 2)), rng.integers(0, 4, n), rng.integers(0, 12, n)
    eta = base + x @ [1.2, -0.7] + rng.normal(0, 0.6, 4)[donor] + rng.normal(0, 1.0, 12)[species]
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float)
    x[rng.random(n) < 0.1, 1] = np.nan
    return x, y, donor, species


def frame(spark, x, y, donor, species):
    rows = [(i, f"D{d}", None if s == 0 else f"s{s:02d}", float(v), float(a), None if np.isnan(b) else float(b)) for i, (a, b, v, d, s) in enumerate(zip(x[:, 0], x[:, 1], y, donor, species))]
    return spark.createDataFrame(rows, SCHEMA)


def scores(df):
    return {r.read_id: r.score for r in df.collect()}


@pytest.mark.parametrize("random", [("donor",), ("donor", "species")])
def test_each_fold_equals_a_dense_fit(spark, random):
    x, y, donor, species = planted()
    got = scores(models.out_of_fold(frame(spark, x, y, donor, species).repartition(5), ["a", "b"], models.glmm(random)))
    assert len(got) == len(y)
    for d in range(4):
        on = donor != d
        fill = np.where(np.isnan(x), np.nanmedian(x[on], 0), x)
        of = np.unique(donor[on], return_inverse=True)[1]
        beta, effects, _ = dense(fill[on], y[on], [of] if len(random) == 1 else [of, species[on]])
        eta = beta[0] + fill[~on] @ beta[1:] + (0 if len(random) == 1 else effects[1][species[~on]])
        assert np.allclose([got[i] for i in np.flatnonzero(~on)], 1 / (1 + np.exp(-eta)), atol=2e-3)


def test_case_control_draw_keeps_the_intercept(spark):
    x, y, donor, species = planted(30_000, seed=5, base=-4.0)
    t = folded.loeo(frame(spark, x, y, donor, species))
    f = folded.prepare(t, ["a", "b"], ["read_id", "donor", "species"])
    fill, u = np.nan_to_num(folded.medians(f)[0]), mixed_logistic.uniform(7, F.col("read_id"))
    full, _ = mixed_logistic.fit(f, [F.col("donor")], fill, u)
    some, _ = mixed_logistic.fit(f, [F.col("donor")], fill, u, ratio=3)
    capped, _ = mixed_logistic.fit(f, [F.col("donor")], fill, u, ratio=3, cap=2000)
    for k, m in full.items():
        want = 3 * f.positives[k] / f.negatives[k]
        assert m.prior == 1 and abs(some[k].prior / want - 1) < 0.1 and abs(capped[k].prior / want - 1) < 0.25
        assert abs(some[k].beta[0] - m.beta[0]) > 0.8  # as drawn
        assert abs(some[k].beta[0] + np.log(some[k].prior) - m.beta[0]) < 0.2 and np.allclose(some[k].beta[1:], m.beta[1:], atol=0.2)
        assert abs(capped[k].beta[0] + np.log(capped[k].prior) - m.beta[0]) < 0.6


def test_shares():
    pos, neg = np.array([10.0, 10.0, 0.0]), np.array([1000.0, 5.0, 0.0])
    assert [list(v) for v in mixed_logistic.shares(pos, neg, None, None)] == [[1, 1, 1], [1, 1, 1]]
    p, n = mixed_logistic.shares(pos, neg, 2, None)
    assert list(p) == [1, 1, 1] and list(n) == [0.02, 1, 1]
    p, n = mixed_logistic.shares(pos, neg, 2, 15)
    assert np.allclose(p, [0.5, 1, 1]) and np.allclose(n, [0.01, 1, 1])


def test_hash_of_a_draw_is_the_one_sql_has(spark):
    import duckdb

    ids = spark.range(50).select("id", mixed_logistic.uniform(7, F.col("id")).alias("u"))
    sql = "SELECT i, ('0x' || substr(md5('7|' || i), 1, 8))::BIGINT / 4294967296.0 FROM range(50) t(i)"
    assert [tuple(r) for r in ids.collect()] == duckdb.sql(sql).fetchall()


def test_one_class_empty_and_too_many_levels(spark):
    one = spark.createDataFrame([(i, f"D{i % 2}", "s", 1.0, float(i), 0.0) for i in range(8)], SCHEMA)
    got = models.out_of_fold(one, ["a", "b"], models.glmm()).collect()
    assert len(got) == 8 and all(r.score is None and "one class" in r.error for r in got)
    assert models.out_of_fold(one.limit(0), ["a", "b"], models.glmm()).count() == 0
    t = folded.prepare(folded.loeo(one), ["a", "b"], ["read_id", "donor", "species"])
    old, mixed_logistic.WIDTH = mixed_logistic.WIDTH, 10
    try:
        with pytest.raises(ValueError, match="levels"):
            mixed_logistic.fit(t, [F.col("donor")], np.zeros((2, 2)), F.lit(0.0))
    finally:
        mixed_logistic.WIDTH = old
