"""The prediction store: replaced folds, pruned reads, exported calls, and a whole run that goes through it."""

import pytest
from pyspark.sql import functions as F

from readsift.ml import store
from readsift.plans import study
from readsift.session import scratch

ROW = "read_id long, donor string, titration_level string, species string, y double, end_reason_unblock int, arm string, model string, scheme string, fold int, score double, error string"


def preds(spark, arm="combined", model="glm", folds=(1, 2), score=0.5, n=20):
    return spark.createDataFrame([(100 * f + i, f"D{f}", "c1", "s", float(i % 2), 0, arm, model, "LOEO", f, score + i / 1000, None) for f in folds for i in range(n)], ROW)


def test_folds_are_replaced_and_others_stay(spark):
    path = scratch(spark)
    store.save(preds(spark).unionByName(preds(spark, arm="1")), path, files=3)
    store.save(preds(spark, folds=(2,), score=0.9, n=5), path)
    got = {(r.arm, r.fold): (r.n, r.n_scored) for r in store.folds_done(spark, path).collect()}
    assert got == {("combined", 1): (20, 20), ("combined", 2): (5, 5), ("1", 1): (20, 20), ("1", 2): (20, 20)}
    assert store.load(spark, path, arm="combined", fold=2).agg(F.min("score")).first()[0] == 0.9
    # A name that looks like a number stays a text, and no column is lost.
    d = store.load(spark, path, arm="1")
    assert dict(d.dtypes) == dict(preds(spark).dtypes) and d.count() == 40
    with pytest.raises(ValueError):
        store.load(spark, path, donor="D1")


def test_other_folders_are_not_read(spark):
    path = scratch(spark)
    store.save(preds(spark).unionByName(preds(spark, model="tree")), path)
    d = store.load(spark, path, arm="combined", model=["tree"], scheme="LOEO").select("read_id", "score")
    plan = d._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert all(c in filters for c in ("arm", "model", "scheme")) and "donor" not in plan[plan.index("ReadSchema") :]
    assert len(d.inputFiles()) >= 1 and d.count() == 40


def test_export(spark):
    path = scratch(spark)
    p = preds(spark, folds=(1,)).withColumn("species", F.when(F.col("read_id") == 101, "NA").otherwise(F.col("species")))
    store.save(p, path)
    taxa = spark.createDataFrame([(101, "Sp a", "", "z"), (103, '""', "G b", "z")], "read_id long, top_species string, top_genus string, zymo_tname string")
    d = store.in_export_order(store.export_read_calls(spark, path, taxa, "combined", "glm", recall=0.5, extra=["zymo_tname"])).collect()
    by = {r.read_id: r for r in d}
    assert len(d) == 20 and [r.model_score for r in d] == sorted((r.model_score for r in d), reverse=True)
    assert (by[101].called_taxon, by[101].called_genus, by[101].true_species, by[101].zymo_tname) == ("Sp a", None, None, "z")
    assert (by[103].called_taxon, by[103].called_genus) == (None, "G b") and by[104].called_taxon is None
    # Positives have odd places 1 to 19; half of them lie at 11 and above by the interpolated quantile.
    assert {i for i, r in by.items() if r.model_call == "positive"} == set(range(110, 120)) and by[111].correct and not by[101].correct
    with pytest.raises(ValueError):
        store.export_read_calls(spark, path, taxa, "combined", "no such model")


def test_queries(spark):
    calls = study.stored_read_calls(spark, "/root/testdata/sf0.001").collect()
    assert calls and any(r.model_score > 0 for r in calls)
    assert {r.called_taxon for r in calls if r.read_id % 3 == 0} == {None}
