"""Distributed running sums and quantiles against plain computations, with a hot group, ties and nulls."""

import random

import pytest
from pyspark.sql import functions as F

from readsift.operators import folds, ranking
from readsift.operators.ranks import quantiles, running

SCHEMA = "g string, id long, s double, y int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    groups = ["hot"] * 6 + ["a", "b", None]
    out = [(rng.choice(groups), i, rng.choice([None, round(rng.random(), 2), rng.random()]), rng.randint(0, 1)) for i in range(4000)]
    return out + [("nulls", 9000 + i, None, 1) for i in range(3)]


def test_running_equals_a_plain_scan(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = running(d, ["g"], [F.desc_nulls_last("s"), F.col("id")], {"n": F.lit(1), "pos": F.col("y") == 1}).collect()
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in got if r.g == g), key=lambda r: (r.s is None, -(r.s or 0), r.id))
        pos = 0
        for i, r in enumerate(mine, 1):
            pos += r.y
            assert (r.n, r.pos) == (i, pos)
            assert r.n_all == len(mine)
        assert {r.pos_all for r in mine} == {pos}


def test_quantiles_equal_the_exact_percentile(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA).withColumn("t", (F.col("id") % 7).cast("double"))
    wanted = {"lo": ("s", 0.05), "q": ("s", 0.75), "m": ("t", 0.5), "top": ("s", 1.0)}
    got = {r.g: r for r in quantiles(d, ["g"], wanted).collect()}
    want = d.groupBy("g").agg(*[F.percentile(c, q).alias(n) for n, (c, q) in wanted.items()]).collect()
    assert len(got) == len(want) == 5
    for w in want:
        for n in wanted:
            assert getattr(got[w.g], n) == (None if w[n] is None else pytest.approx(w[n], rel=1e-14))
    assert got["nulls"].q is None and got["nulls"].m is not None


def test_quantiles_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert [r.q for r in quantiles(empty, (), {"q": ("s", 0.5)}).collect()] == [None]
    assert quantiles(empty, ["g"], {"q": ("s", 0.5)}).count() == 0


def test_no_window_holds_a_group(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA)
    for plan in (ranking.metric_rows(d, ["g"], "y", "s", ["id"]), folds.stratified_cap(d, "y", 100, ["id"]), quantiles(d, ["g"], {"q": ("s", 0.5)})):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in text.splitlines() if "Window [" in x]
        # Row windows are inside one range partition; the others see a row for each partition of a group.
        inside = [x for x in windows if "sum(__l" in x]
        assert inside and all("__pid" in x.split("],")[1] for x in inside)
        assert not any("percentile" in x for x in text.splitlines())


def test_metrics_of_a_hot_group_equal_a_plain_scan(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA)
    got = {r.g: r for r in ranking.auprc(d, ["g"], "y", "s", ["id"]).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g and r[2] is not None), key=lambda r: (-r[2], r[1]))
        p = sum(r[3] for r in mine)
        assert (got[g].n_pos, got[g].n_neg) == (p, len(mine) - p)
        if not p:
            assert got[g].auprc is None
            continue
        tp, ap = 0, 0.0
        for i, r in enumerate(mine, 1):
            tp += r[3]
            ap += r[3] * tp / i
        assert got[g].auprc == pytest.approx(ap / p, rel=1e-9)


def test_metrics_from_counts_of_scores_equal_those_of_rows(spark, rows):
    """Repeated scores of one class, shared scores with their ties, zeros of both signs, nulls, and groups without positives."""
    more = [("big", 20000 + i, [0.9, 0.7, 0.5][i % 3], 1 if i % 3 == 1 else 0) for i in range(900)] + [("neg", 30000 + i, 0.5, 0) for i in range(9)]
    more += [("zero", 40000 + i, [0.0, -0.0, float("nan"), float("inf")][i % 4], i // 4 % 2) for i in range(40)]
    d = spark.createDataFrame([*rows, *more], SCHEMA).withColumn("lv", F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string"))).repartition(5)
    targets = (0.3, 0.9, 0.95)
    each = d.withColumn("stratum", F.explode(F.array(F.lit("all"), F.col("lv"))))
    for got, want, by in (
        (ranking.counted_metric_rows(d, ["g"], "y", "s", ["id"], targets), ranking.metric_rows(d, ["g"], "y", "s", ["id"], targets), ["g"]),
        (ranking.counted_metric_rows(d, ["g"], "y", "s", ["id"], targets, level="lv"), ranking.metric_rows(each, ["g", "stratum"], "y", "s", ["id"], targets), ["g", "stratum"]),
    ):
        key = lambda r: tuple(r[c] for c in [*by, "recall_target"])  # noqa: E731, B023
        a, b = {key(r): r for r in got.collect()}, {key(r): r for r in want.collect()}
        assert set(a) == set(b) and got.columns == want.columns
        for k, r in b.items():
            assert [a[k][c] if a[k][c] is None else pytest.approx(a[k][c], rel=1e-12) for c in want.columns[len(by) :]] == list(r[len(by) :])


def test_only_scores_of_both_classes_are_ranked_row_by_row(spark, monkeypatch):
    """The ordered table has a row a score and the rows of shared scores, however many rows there are."""
    n = []
    real = ranking.running
    monkeypatch.setattr(ranking, "running", lambda df, *a: n.append(df.count()) or real(df, *a))
    d = spark.range(60000).selectExpr("id", "1 - id % 2 y", "IF(id < 50, 0.5, id % 2 * 0.1 + id % 10 * 0.01) s")
    assert ranking.counted_metric_rows(d, [], "y", "s", ["id"], (0.95,)).first().n_pos == 30000
    assert sum(n) < 200
