"""Inner scores of all held-out donors come from one table and equal those of each inner fold alone."""

import numpy as np
import pytest

from readsift.ml import folded, models, run

ROW = "read_id long, donor string, titration_level string, species string, label string, end_reason_unblock int, a double, b double"


@pytest.fixture(scope="module")
def rows(spark):
    """Four donors, of which one has no positives; a row without a donor."""
    rng = np.random.default_rng(5)
    out = []
    for i in range(200):
        x = rng.normal(size=2)
        donor = None if i == 3 else f"D{0 if i < 40 else i % 4}"
        y = donor != "D3" and x[0] + rng.logistic() > 0
        out.append((i, donor, "c1", "s" if y else None, "positive" if y else "negative", 0, float(x[0]), None if i % 9 == 0 else float(x[1])))
    return spark.createDataFrame(out, ROW).persist()


def test_all_inner_folds_over_one_table(rows, monkeypatch):
    n, prepare = [], folded.prepare
    monkeypatch.setattr(folded, "prepare", lambda *a, **k: n.append(1) or prepare(*a, **k))
    got = run.inner_scores(rows, "combined", ["a", "b"], {"glm": models.glm}, k=2).collect()
    assert len(n) == 1
    alone = lambda train, test, features: models.glm(train, test, features)  # noqa: E731  one fold at a time
    want = run.inner_scores(rows, "combined", ["a", "b"], {"glm": alone}, k=2).collect()
    assert [(r.arm, r.model, r.fold) for r in got] == [("combined", "glm", i) for i in (1, 2, 3, 4)]
    assert [r.inner_auprc for r in got] == pytest.approx([r.inner_auprc for r in want], abs=1e-12)


def test_candidates_are_tuned_over_one_table(rows, monkeypatch):
    n, prepare = [], folded.prepare
    monkeypatch.setattr(folded, "prepare", lambda *a, **k: n.append(1) or prepare(*a, **k))
    train = run.usable(rows).where("donor <> 'D0'")
    inner = [["D1"], ["D2"], ["D3"]]
    wrong = lambda k: lambda t: np.repeat(-np.nan_to_num(t.x[:, :1]), k, 1)
    bad = models.Folds(lambda f, keep: folded.scored(f, keep, wrong(len(f.folds))))
    assert models.tune(train, ["a", "b"], [bad, models.glm], inner) is models.glm and len(n) == 1
    # D3 has one class only and counts in no mean; without inner groups there is no score, and the first candidate stays.
    assert models.inner_score(train, ["a", "b"], models.glm, inner) == pytest.approx(models.inner_score(train, ["a", "b"], models.glm, inner[:2]))
    assert models.inner_score(train, ["a", "b"], models.glm, []) is None and models.tune(train, ["a", "b"], [bad, models.glm], []) is bad
