"""Arms, ablations, held-out donors and taxa are fitted in the same passes, with the scores of each fit alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from readsift.ml import folded, models, run

ROW = "read_id long, donor string, titration_level string, species string, label string, end_reason_unblock int, a double, b double, c double"
ARMS = {"combined": ["a", "b", "c"], "small": ["b"]}


@pytest.fixture(scope="module")
def rows(spark):
    """Three donors of unequal size, two taxa, missing values, a positive without a taxon, a row without a donor and an ambiguous one."""
    rng = np.random.default_rng(11)
    out = []
    for i in range(240):
        x = rng.normal(size=3)
        y = x[0] - 0.5 * x[1] + rng.logistic() > 0
        x = [None if rng.random() < 0.1 else float(v) for v in x]
        donor = None if i == 7 else f"D{0 if i < 60 else i % 3}"
        out.append((i, donor, "c1", f"s{i // 3 % 2}" if y and i != 9 else None, "ambiguous" if i == 5 else "positive" if y else "negative", 0, *x))
    return spark.createDataFrame(out, ROW).persist()


@pytest.fixture
def tables(monkeypatch):
    n, prepare = [], folded.prepare
    monkeypatch.setattr(folded, "prepare", lambda *a, **k: n.append(1) or prepare(*a, **k))
    return n


def alone(fit):
    """The family as one that knows a single fold only."""
    return lambda train, test, features: fit(train, test, features)


def keyed(df):
    return {(r.arm, r.model, r.scheme, r.fold, r.read_id): (r.score, r.error) for r in df.collect()}


def test_a_run_fits_all_parts_over_one_table(rows, tables):
    of = lambda fit: keyed(run.run(rows, ARMS, {"glm": fit}, {"x": ["a"]}, {"x": ["x"]}, {}, best="glm"))
    got = of(models.glm)
    assert len(tables) == 1
    want = of(alone(models.glm))
    assert {k[:4] for k in got} == {(a, "glm", "LOEO", i) for a in ("combined", "small", "combined_minus_x") for i in (1, 2, 3)} | {("combined", "glm", "LOTO", i) for i in (1, 2)}
    assert got.keys() == want.keys() and all(e is None for _, e in got.values())
    assert [got[k][0] for k in got] == pytest.approx([want[k][0] for k in got], abs=1e-9)


@pytest.mark.parametrize("fit", [models.fixed_threshold, models.glmm(("donor", "species"))])
def test_folds_with_features_of_their_own(rows, tables, fit):
    t = run.usable(rows)
    parts = [p for p in run.donor_parts(["D0", "D1", "D2"], {"combined": ["a", "c"], "small": ["b"]}, ["m"]) if p.fold == 2]
    got = keyed(next(run.predictions(t, parts, {"m": fit}, {})))
    assert len(tables) == 1
    want = {}
    for p in run.predictions(t, parts, {"m": alone(fit)}, {}):
        want |= keyed(p)
    assert got.keys() == want.keys() and [got[k][0] for k in got] == pytest.approx([want[k][0] for k in got], abs=1e-7)


def test_only_the_part_that_fails_has_no_scores(rows, monkeypatch):
    fit = folded.glm

    def picky(f, keep):
        if not set(f.features) - {"b"} or (f.used is not None and any(u.sum() == 1 for u in f.used)):
            raise np.linalg.LinAlgError("no fit of b alone")
        return fit(f, keep)

    got = keyed(run.leave_one_donor_out(rows, ARMS, {"m": models.Folds(picky, subsets=True)}))
    assert {(a, e) for (a, *_), (_, e) in got.items()} == {("combined", None), ("small", "no fit of b alone")}
    assert all((s is None) == (k[0] == "small") for k, (s, _) in got.items()) and len(got) == 2 * 238


def test_folds_of_the_same_rows_share_medians(rows):
    t = run.usable(rows).withColumn("trains", F.when(F.col("donor") == "D0", F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(2)))).withColumn("tests", F.array().cast("array<int>"))
    f = folded.prepare(t, ["a", "b"], ["read_id"])
    assert f.folds == [1, 2, 3] and f.same == [0, 1, 0]
    med, _ = folded.medians(f)
    assert (med[0] == med[2]).all() and (med[0] != med[1]).all() and folded.medians(f)[0] is med
