"""Fits read the features that were made once, not the texts or joins that made them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from readsift.ml import folded, models
from readsift.plans import learning

ROW = "read_id long, donor string, y double, a double"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, f"D{i % 2}", float(i % 3 == 0), float(i % 7)) for i in range(60)], ROW)


def test_a_model_of_one_fold_reads_kept_features(spark, rows):
    seen = []

    def fit(train, test, features):
        seen.extend(d._jdf.queryExecution().optimizedPlan().toString() for d in (train, test))
        return test.withColumn("score", F.lit(0.5))

    out = models.out_of_fold(rows.withColumn("a", F.col("a") + 1), ["a"], fit)
    assert out.where("error is null").count() == 60
    assert len(seen) == 4 and all("InMemoryRelation" in p for p in seen)


def test_families_share_one_table(spark, rows, monkeypatch):
    n = []
    prepare = folded.prepare
    monkeypatch.setattr(folded, "prepare", lambda *a, **k: n.append(1) or prepare(*a, **k))
    monkeypatch.setattr(learning, "training_table", lambda spark, d: rows)
    monkeypatch.setattr(learning, "FEATURES", ["a"])
    plain = models.Folds(lambda f, keep: (lambda k: folded.scored(f, keep, lambda t: np.repeat(t.x, k, 1)))(len(f.folds)))
    for m in ("fixed_threshold", "glm", "glmm"):
        monkeypatch.setitem(models.MODELS, m, plain)
    got = learning.model_comparison(spark, None).collect()
    assert len(got) == 3 and len({r.auprc for r in got}) == 1 and len(n) == 1
