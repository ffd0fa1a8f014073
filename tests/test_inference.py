"""Bootstrap and mixed models against plain implementations."""

import hashlib
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from readsift.stats import mixed, resample


def plain_bootstrap(values, reps, seed):
    v, n = sorted(values), len(values)
    place = lambda r, j: int(hashlib.md5(f"{seed}|{r}|{j}".encode()).hexdigest()[:8], 16) * n >> 32
    m = [statistics.median(v[place(r, j)] for j in range(1, n + 1)) for r in range(1, reps + 1)]
    return np.quantile(m, [0.025, 0.975])


def test_bootstrap_equals_plain(spark):
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=8).tolist(), "b": rng.normal(2, 1, 5).tolist(), "tied": [1.0] * 4 + [2.0] * 3, "two": [0.5, -0.5]}
    rows = [(k, v) for k, x in data.items() for v in x] + [("a", None), ("a", float("nan")), ("one", 0.1), ("none", None), (None, 1.0), (None, 3.0)]
    got = {r.id: r for r in resample.median_intervals(spark.createDataFrame(rows, "id string, d double"), ["id"], reps=300, seed=7).collect()}
    for k, x in {**data, None: [1.0, 3.0]}.items():
        lo, hi = plain_bootstrap(x, 300, 7)
        assert got[k].n == len(x) and math.isclose(got[k].median_diff, statistics.median(x))
        assert math.isclose(got[k].ci_lo, lo, abs_tol=1e-12) and math.isclose(got[k].ci_hi, hi, abs_tol=1e-12)
    assert (got["one"].n, got["one"].median_diff, got["one"].ci_lo) == (1, 0.1, None) and (got["none"].n, got["none"].median_diff) == (0, None)


def test_bootstrap_draws_are_even_and_do_not_depend_on_partitions(spark):
    d = spark.createDataFrame([("a", float(i)) for i in range(8)], "id string, d double")
    first = resample.median_intervals(d, ["id"]).collect()
    assert first == resample.median_intervals(d.repartition(5), ["id"]).collect()
    places = spark.range(1, 4001).select(resample.drawn(1, F.col("id"), F.lit(1), F.lit(8)).alias("p")).groupBy("p").count().collect()
    assert {r.p for r in places} == set(range(1, 9)) and all(430 < r["count"] < 570 for r in places)


def dense_reml(y, x, group):
    """The criterion by whole covariance matrices over the same grid of ratios."""
    z = (np.array(group)[:, None] == np.array(sorted(set(group)))[None, :]).astype(float)
    n, k = x.shape
    best = None
    for ratio in mixed.RATIOS:
        v = np.eye(n) + ratio * z @ z.T
        vi = np.linalg.inv(v)
        xtx = x.T @ vi @ x
        beta = np.linalg.solve(xtx, x.T @ vi @ y)
        r = y - x @ beta
        s2 = r @ vi @ r / (n - k)
        crit = (n - k) * np.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xtx)[1]
        if best is None or crit < best[0] - 1e-7:
            best = crit, ratio, beta[-1], beta[-1] / np.sqrt(s2 * np.linalg.inv(xtx)[-1, -1])
    return best[1:]


def t_tail(t, df):
    """Two-sided by integration of the density."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    u = np.linspace(0, 1, 400001)[:-1]
    x = abs(t) + u / (1 - u)
    return 2 * np.trapezoid(c * (1 + x * x / df) ** (-(df + 1) / 2) / (1 - u) ** 2, u)


@pytest.mark.parametrize("df", [2, 3, 4, 5, 10, 51])
def test_t(spark, df):
    at = [0.0, 0.1, 1.0, 2.5, 9.0, 40.0]
    got = spark.createDataFrame([(t,) for t in at], "t double").select(mixed.t_two_sided(F.col("t"), F.lit(df)).alias("p")).collect()
    for t, r in zip(at, got):
        assert math.isclose(r.p, t_tail(t, df), rel_tol=1e-5), (t, df)


def test_t_edges(spark):
    d = spark.createDataFrame([(1.0, 1), (1.0, 0), (float("inf"), 5), (-2.5, 7), (2.5, 7)], "t double, df int")
    p = [r.p for r in d.select(mixed.t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()]
    assert math.isclose(p[0], 0.5) and p[1] is None and p[2] == 0.0 and p[3] == p[4]


def test_mixed_effect_equals_dense(spark):
    rng = np.random.default_rng(5)
    rows = []
    for name, spread in (("same", 0.0), ("far", 1.0)):
        shift = rng.normal(0, spread, 8)
        rows += [(name, f"d{i}", bool(m), float(0.5 + shift[i] + 0.1 * m + rng.normal(0, 0.1))) for i in range(8) for m in (0, 1) for _ in range(1 + i % 3)]
    rows += [("few", "d0", True, 1.0), ("void", "d0", True, None), ("same", "d1", True, None)]
    d = spark.createDataFrame(rows, "id string, donor string, treated boolean, value double")
    got = {r.id: r for r in mixed.mixed_effect(d, ["id"]).collect()}
    for name in ("same", "far"):
        r = [x for x in rows if x[0] == name and x[3] is not None]
        x = np.array([[1.0, float(v[2])] for v in r])
        _, est, t = dense_reml(np.array([v[3] for v in r]), x, [v[1] for v in r])
        assert math.isclose(got[name].estimate, est, rel_tol=1e-7) and math.isclose(got[name].p_value, t_tail(t, len(r) - 8 - 1), rel_tol=1e-4) and got[name].n == len(r)
    assert (got["few"].engine, got["few"].n, got["void"].engine, got["void"].n) == ("none", 1, "none", 0)


def test_interaction_equals_dense(spark):
    """Unbalanced cells; in balanced data the estimate is the difference of differences."""
    rng = np.random.default_rng(6)
    rows = [("u", f"f{k}", a, b, float(0.5 + k + 0.1 * a + 0.2 * (a and b) + rng.normal(0, 0.05))) for k in range(8) for a in (False, True) for b in (False, True) for _ in range(1 + (k + a) % 2)]
    rows += [("even", f"f{k}", a, b, 0.5 + k + 0.1 * a + 0.2 * (a and b) + 0.01 * ((3 * k + 2 * a + 5 * b) % 7)) for k in range(8) for a in (False, True) for b in (False, True)]
    rows += [("cells", f"f{k}", a, True, 1.0 + k) for k in range(8) for a in (False, True)]
    d = spark.createDataFrame(rows, "id string, fold string, a boolean, b boolean, value double")
    got = {r.id: r for r in mixed.interaction_effect(d, ["id"]).collect()}
    r = [x for x in rows if x[0] == "u"]
    x = np.array([[1.0, v[2], v[3], v[2] and v[3]] for v in r], float)
    _, est, t = dense_reml(np.array([v[4] for v in r]), x, [v[1] for v in r])
    assert math.isclose(got["u"].estimate, est, rel_tol=1e-6) and math.isclose(got["u"].p_value, t_tail(t, len(r) - 8 - 3), rel_tol=1e-3)
    mean = {(a, b): np.mean([v[4] for v in rows if v[0] == "even" and v[2:4] == (a, b)]) for a in (False, True) for b in (False, True)}
    assert math.isclose(got["even"].estimate, mean[True, True] - mean[True, False] - mean[False, True] + mean[False, False], abs_tol=1e-9) and got["even"].p_value < 1e-6
    assert got["cells"].engine == "none" and got["cells"].n == 16


def test_no_rows(spark):
    """A fit over no rows gives no row."""
    d = spark.createDataFrame([], "id string, donor string, treated boolean, value double")
    assert mixed.mixed_effect(d, ["id"]).collect() == []
