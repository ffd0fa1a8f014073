"""The fold table: both schemes, inner groups, one donor, no donors, and its use by the run driver."""

import itertools

from readsift.ml import run, store
from readsift.operators.folds import fold_table, inner_of

KINDS = "donor string, species string, label string"


def rows(spark, donors, species=("s1", "s2", "s3")):
    data = [(d, s, label) for d in donors for s in species for label in ("positive", "negative")]
    return spark.createDataFrame([*data, (None, "s1", "negative"), (donors[0] if donors else None, "", "positive"), (donors[0] if donors else None, "s9", "negative")], KINDS)


def test_parts_and_groups(spark):
    donors = [f"d{i}" for i in range(7)]
    got = fold_table(rows(spark, donors), k=3, seed=5).collect()
    assert sorted((r.scheme, r.fold) for r in got) == [("LOEO", i) for i in range(1, 8)] + [("LOTO", i) for i in range(1, 4)]
    for r in got:
        assert sorted(r.test_donors + r.train_donors) == donors and not set(r.test_donors) & set(r.train_donors)
        assert list(itertools.chain.from_iterable(sorted(g.donors for g in r.inner))) and sorted(itertools.chain.from_iterable(g.donors for g in r.inner)) == r.train_donors
        sizes = [len(g.donors) for g in r.inner]
        assert [g.group for g in r.inner] == [1, 2, 3] and max(sizes) - min(sizes) <= 1
        if r.scheme == "LOEO":
            assert r.test_donors == [donors[r.fold - 1]] and r.test_species is None
        else:
            assert r.test_species == f"s{r.fold}" and r.test_donors == donors[(r.fold + 1) % 2 :: 2]
    assert got != fold_table(rows(spark, donors), k=3, seed=6).collect()  # the seed changes groups
    assert sorted(map(str, got)) == sorted(map(str, fold_table(rows(spark, donors).repartition(5), k=3, seed=5).collect()))


def test_few_donors(spark):
    one = {(r.scheme, r.fold): r for r in fold_table(rows(spark, ["d"]), k=3).collect()}
    assert len(one) == 4 and all(r.test_donors == ["d"] and r.train_donors == [] and r.inner == [] for r in one.values())
    two = inner_of(fold_table(rows(spark, ["a", "b"]), k=3))
    assert two["LOEO", 1] == [["b"]] and two["LOEO", 2] == [["a"]]
    assert fold_table(spark.createDataFrame([], KINDS)).collect() == []


def test_kept_folds_are_used(spark, tmp_path):
    """Tuning takes its inner groups from the stored table, not from a new one."""
    t = spark.range(60).selectExpr("id read_id", "concat('D', id % 5) donor", "'c1' titration_level", "'s' species", "if(id % 3 = 0, 'positive', 'negative') label", "0 end_reason_unblock", "cast(id % 3 as double) a")
    path = str(tmp_path / "folds")
    store.save_folds(fold_table(run.usable(t), k=2, seed=99), path)
    kept = store.load_folds(spark, path)
    want, seen = inner_of(kept), []
    assert want == inner_of(fold_table(run.usable(t), k=2, seed=99)) and want != inner_of(fold_table(run.usable(t)))

    def watch(train, test, features):
        seen.append((tuple(run.donors_of(train)), tuple(run.donors_of(test))))
        return test.withColumn("score", test[features[0]])

    run.inner_scores(t, "combined", ["a"], {"m": watch}, folds=kept)
    held = {test for _, test in seen}
    assert held == {tuple(g) for (scheme, _), groups in want.items() if scheme == "LOEO" for g in groups}
