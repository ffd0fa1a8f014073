"""Models of all folds at once against plain numpy fits; boosting, forest and fixed threshold on planted data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from readsift.ml import boosting, folded, models
from readsift.operators.ranking import auprc

ROW = "read_id long, donor string, y double, a double, b double, c double"


def frame(spark, x, y, donors=4):
    rows = [(i, f"D{i % donors}", float(v), *[None if np.isnan(u) else float(u) for u in r]) for i, (v, r) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, ROW)


def noisy(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.logistic(size=n) > 0.3).astype(float)
    x[rng.random((n, 3)) < 0.1] = np.nan
    return x, y


def scores(df):
    return {r.read_id: r.score for r in df.collect()}


def newton(x, y, w):
    """Weighted logistic fit to full convergence."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(100):
        mu = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (w * mu * (1 - mu))[:, None]).T @ x, x.T @ (w * (y - mu)))
    return b


def test_logistic_of_all_folds_equals_each_fold_alone(spark):
    x, y = noisy()
    donor = np.where(np.arange(len(y)) < 300, 0, np.arange(len(y)) % 4)  # one donor with most of the rows
    t = frame(spark, x, y).withColumn("donor", F.when(F.col("read_id") < 300, "D0").otherwise(F.col("donor")))
    got = scores(models.out_of_fold(t, ["a", "b", "c"], "glm"))
    assert len(got) == len(y)
    for d in range(4):
        on = donor != d
        med = np.nanmedian(x[on], 0)
        fill = np.where(np.isnan(x), med, x)
        count = np.bincount(donor[on], minlength=4)
        beta = newton(fill[on], y[on], on.sum() / (3 * count[donor[on]]))
        want = 1 / (1 + np.exp(-(beta[0] + fill[~on] @ beta[1:])))
        assert np.allclose([got[i] for i in np.flatnonzero(~on)], want, atol=1e-6)


def test_dependent_and_constant_columns_get_no_coefficient(spark):
    x, y = noisy(seed=3)
    x = np.nan_to_num(x)
    alone = scores(models.out_of_fold(frame(spark, x, y), ["a"], "glm"))
    x[:, 1], x[:, 2] = 2 * x[:, 0] - 1, 7.0
    assert scores(models.out_of_fold(frame(spark, x, y), ["a", "b", "c"], "glm")) == pytest.approx(alone, abs=1e-7)


def test_folds_of_one_class_and_unlabelled_rows(spark):
    x, y = noisy(80)
    t = frame(spark, x, y, 2).withColumn("y", F.when(F.col("donor") == "D1", 1.0).when(F.col("read_id") % 10 != 0, F.col("y")))
    for m in ("glm", models.boosted(2, 0.3, 2)):
        out = models.out_of_fold(t, ["a", "b"], m).collect()
        assert len(out) == 80
        assert all((r.score is None) == (r.error is not None) == (r.donor == "D0") for r in out)


def test_medians_of_training_rows(spark):
    x, y = noisy(101, 5)
    f = folded.prepare(folded.loeo(frame(spark, x, y, 3)), ["a", "b", "c"], ["read_id"])
    med, values = folded.medians(f)
    own = np.arange(101) % 3
    assert np.allclose(med, [np.nanmedian(x[own != d], 0) for d in range(3)])
    assert (values == [[(~np.isnan(x[own != d, j])).sum() for j in range(3)] for d in range(3)]).all()


def test_fixed_threshold_imputes_first_and_skips_constants(spark):
    """A feature known for four rows only, and a constant one, do not beat one that is right for most rows."""
    rng = np.random.default_rng(2)
    y = rng.random(200) < 0.5
    good = np.where(rng.random(200) < 0.9, y, ~y) + rng.normal(0, 0.01, 200)
    sparse = np.full(200, np.nan)
    sparse[np.r_[np.flatnonzero(y)[:2], np.flatnonzero(~y)[:2]]] = [2, 2, 1, 1]
    x = np.column_stack([sparse, np.full(200, 3.0), good])
    t = frame(spark, x, y)
    f = folded.prepare(folded.loeo(t), ["a", "b", "c"], ["read_id", "donor", "y"])
    found = folded.chosen_features(f, "read_id", *folded.medians(f)).collect()
    assert {r.feature for r in found} == {"c"} and {r.sign for r in found} == {1} and len(found) == 4
    out = models.out_of_fold(t, ["a", "b", "c"], "fixed_threshold")
    assert auprc(out, [], "y", "score", ["read_id"]).first().auprc > 0.75
    s = np.array([r.score for r in out.orderBy("read_id").collect()])
    assert abs(s[y].mean() - s[~y].mean()) > 0.6 and ((s > 0) & (s < 1)).all()
    assert {r.score for r in models.out_of_fold(t, ["b"], "fixed_threshold").collect()} == {0.5}
    # A smaller value for positives is taken with the negative sign.
    flipped = models.out_of_fold(frame(spark, -x, y), ["c"], "fixed_threshold")
    assert auprc(flipped, [], "y", "score", ["read_id"]).first().auprc > 0.75


def test_fixed_threshold_score_where_the_fit_fails(spark, monkeypatch):
    x, y = noisy(60)
    monkeypatch.setattr(folded, "logistic", lambda f, *a, **k: np.full((len(f.folds), len(f.features) + 1), np.nan))
    s = [r.score for r in models.out_of_fold(frame(spark, x, y), ["a"], models.Folds(folded.fixed_threshold)).collect()]
    assert min(s) == pytest.approx(0) and max(s) == pytest.approx(1)


def test_boosting_learns_what_a_line_cannot(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (400, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    t = frame(spark, x, y)
    of = lambda m: auprc(models.out_of_fold(t, ["a", "b", "c"], m), [], "y", "score", ["read_id"]).first().auprc
    line, trees = of("glm"), of(models.boosted(3, 0.5, 8))
    assert trees > 0.9 > 0.7 > line


def test_missing_values_take_a_learned_side(spark):
    """Only missingness tells the classes apart; with both values known the side still matters."""
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300).astype(float)
    x = np.column_stack([np.where(y == 1, np.nan, 1.0), rng.normal(size=300), rng.normal(size=300)])
    s = scores(models.out_of_fold(frame(spark, x, y), ["a", "b"], models.boosted(2, 0.5, 5)))
    assert min(s[i] for i in np.flatnonzero(y == 1)) > 0.6 > 0.4 > max(s[i] for i in np.flatnonzero(y == 0))
    # Large values and missing ones are positive.
    x[:, 0] = np.where(y == 1, rng.choice([np.nan, 5.0], 300), rng.choice([1.0, 2.0], 300))
    s = scores(models.out_of_fold(frame(spark, x, y), ["a", "b"], models.boosted(2, 0.5, 5)))
    assert min(s[i] for i in np.flatnonzero(y == 1)) > 0.6 > 0.4 > max(s[i] for i in np.flatnonzero(y == 0))


def reference_boost(x, y, w, rounds, depth, p):
    """One fold in numpy, every value an edge: the margins of the training rows."""
    margin = np.zeros(len(y))
    spw = (y == 0).sum() / max((y == 1).sum(), 1)
    w = w * np.where(y == 1, spw, 1)

    def grow(on, level):
        g, h = (w * (mu - y))[on].sum(), (w * mu * (1 - mu))[on].sum()
        best = None
        if level < depth:
            for j in range(x.shape[1]):
                v = x[on, j]
                for c in [-np.inf, *np.unique(v[~np.isnan(v)])]:
                    for left in (True, False):
                        to = np.where(np.isnan(v), left, v <= c)
                        a, b = on[to], on[~to]
                        if not len(a) or not len(b) or (c == -np.inf and not left):
                            continue
                        ga, ha, gb, hb = *(z[a].sum() for z in (w * (mu - y), w * mu * (1 - mu))), *(z[b].sum() for z in (w * (mu - y), w * mu * (1 - mu)))
                        gain = round((ga**2 / (ha + 1) + gb**2 / (hb + 1) - g**2 / (h + 1)) / 2, 9)
                        if gain > 0 and ha >= 1 and hb >= 1 and (best is None or gain > best[0]):
                            best = (gain, a, b)
        if best is None:
            out[on] = -p.rate * g / (h + 1)
        else:
            grow(best[1], level + 1)
            grow(best[2], level + 1)

    for _ in range(rounds):
        mu, out = 1 / (1 + np.exp(-margin)), np.zeros(len(y))
        grow(np.arange(len(y)), 0)
        margin = margin + out
    return margin


def test_trees_equal_a_plain_implementation(spark, monkeypatch):
    """Margins of every training row after several rounds, over a renewal of the written margins."""
    monkeypatch.setattr(boosting, "EVERY", 2)
    x, y = noisy(120, 9)
    p = boosting.Boost(depth=3, rate=0.3, rounds=5, bins=512)
    f = folded.prepare(folded.loeo(frame(spark, x, y, 3)), ["a", "b", "c"], ["read_id"])
    forest = boosting.fit(f, p)
    own = np.arange(120) % 3
    got = forest.add(np.zeros((120, 3)), forest.codes(x))
    for d in range(3):
        on = own != d
        w = on.sum() / (2 * np.bincount(own[on], minlength=3)[own[on]])
        assert np.allclose(got[on, d], reference_boost(x[on], y[on], w, 5, 3, p), atol=1e-6)


def test_edges_hold_equal_counts_or_every_value(spark):
    x = np.column_stack([np.arange(200.0), np.arange(200) % 3, np.full(200, np.nan)])
    f = folded.prepare(folded.loeo(frame(spark, x, np.arange(200) % 2)), ["a", "b", "c"], ["read_id"])
    e = boosting.edges(f, 10)
    assert len(e[0]) == 10 and np.allclose(np.diff(e[0]), 20) and e[1].tolist() == [0, 1, 2] and not len(e[2])


def test_forest_ranks_what_a_line_cannot(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (400, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    x[::17, 2] = np.nan
    out = models.out_of_fold(frame(spark, x, y, 2), ["a", "b", "c"], models.forest(trees=20, share=0.67))
    assert auprc(out, [], "y", "score", ["read_id"]).first().auprc > 0.85
