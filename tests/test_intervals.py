"""Interval scans that are carried over range partitions, against plain loops, with most rows on one contig."""

import random

import pytest
from pyspark.sql import functions as F

from readsift.operators import intervals
from readsift.operators.ranks import carried, ranged



@pytest.fixture(autouse=True)
def _many_ranges(spark):
    """Small tables stay in several range partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


SPAN = "k string, start long, end long"


def drawn(rng, n, hot=0.8):
    out = []
    for _ in range(n):
        s = rng.randrange(3000)
        out.append(("hot" if rng.random() < hot else rng.choice("abc"), s, s + rng.choice([0, 1, 5, 40, 200])))
    return out


def merged(rows):
    out = []
    for k, s, e in sorted(rows):
        if out and out[-1][0] == k and s <= out[-1][2]:
            out[-1] = (k, out[-1][1], max(out[-1][2], e), out[-1][3] + 1)
        else:
            out.append((k, s, e, 1))
    return out


@pytest.mark.parametrize("n", [60, 1500])
def test_merge_against_a_loop(spark, n):
    rng = random.Random(n)
    rows = drawn(rng, n) + [("hot", 7, 9)] * n  # a third and more are one interval
    got = intervals.merge_intervals(spark.createDataFrame(rows, SPAN), ["k"])
    assert sorted(tuple(r) for r in got.select("k", "start", "end", "n_merged").collect()) == merged(rows)


def test_sweep_against_all_pairs(spark):
    rng = random.Random(3)
    left = [(i, *r) for i, r in enumerate(drawn(rng, 700))] + [(900, None, 5, 9), (901, "hot", None, 9), (902, "hot", 5, None), (903, "hot", 400, 300), (904, "z", 1, 2)]
    right = [(k, s, s + rng.choice([0, 3, 60])) for k, s, _ in drawn(rng, 40)] + [(None, 0, 9999), ("hot", None, 9999), ("hot", 50, None), ("c", 80, 20)]
    l = spark.createDataFrame(left, f"id long, {SPAN}")
    got = intervals.overlap_sweep(l, spark.createDataFrame(right, SPAN), "k")
    assert got.columns == ["id", "k", "start", "end", "in_region"]
    want = {i: None not in (k, s, e) and any(a == k and None not in (b, c) and b <= e and c >= s for a, b, c in right) for i, k, s, e in left}
    assert {r.id: r.in_region for r in got.collect()} == want and any(want.values()) and not all(want.values())
    # Repeated rows stay, and without any region nothing is hit.
    assert intervals.overlap_sweep(l.union(l), spark.createDataFrame([], SPAN), "k").where("not in_region").count() == 2 * len(left)


def test_coverage_against_positions(spark):
    rng = random.Random(5)
    rows = [(k, s, e, 2500 if k != "b" else 0) for k, s, e in drawn(rng, 400)]
    got = {r.k: r for r in intervals.coverage(spark.createDataFrame(rows, f"{SPAN}, glen long"), ["k"]).collect()}
    for k in {r[0] for r in rows}:
        if k == "b":
            assert got[k].genome_breadth is None
            continue
        depth = [0] * 2500
        for _, s, e, _ in (r for r in rows if r[0] == k):
            for x in range(s, min(e, 2500)):
                depth[x] += 1
        depth.sort()
        lorenz = sum((2 * (i + 1) - 2500 - 1) * d for i, d in enumerate(depth)) / (2500 * sum(depth))
        assert got[k].genome_breadth == pytest.approx(sum(d > 0 for d in depth) / 2500)
        assert got[k].coverage_evenness == pytest.approx(1 - lorenz, abs=2e-3)


def test_carried_values(spark):
    rng = random.Random(9)
    rows = [(g, i, rng.randrange(100) if i % 4 else None) for g in ("a", None) for i in range(200)] + [("b", 0, 5)]
    d = ranged(spark.createDataFrame(rows, "g string, i long, v long"), ["g"], [F.col("i")])
    assert d.select("__pid").distinct().count() > 1
    order = [F.col("i")]
    for out, how, upto in (("s", "sum", 0), ("m", "max", -1), ("n", "next", 0)):
        d = carried(d, ["g"], order, out, F.col("v"), how, upto)
    by = {(r.g, r.i): r for r in d.collect()}
    for g, i, _ in rows:
        before = [v for h, j, v in rows if h == g and j < i and v is not None]
        here = [v for h, j, v in rows if h == g and j <= i and v is not None]
        after = [v for h, j, v in rows if h == g and j == i + 1]
        assert by[g, i].s == sum(here) and by[g, i].m == max(before, default=None) and by[g, i].n == (after or [None])[0]


def test_no_window_holds_a_contig(spark):
    """Every window of positions is inside one range partition, and each side of the sweep is scanned once."""
    d = spark.createDataFrame([("a", 1, 2, 5)], f"{SPAN}, glen long")
    for plan in (intervals.merge_intervals(d, ["k"]), intervals.overlap_sweep(d, d, "k")):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in text.split("\n") if "Window [" in line and "start" not in line.split("windowspecdefinition")[0] and "__b" not in line]
        assert all("__pid" in line.split("windowspecdefinition")[-1] for line in windows)
    text = intervals.overlap_sweep(d.withColumn("tag", F.rand(1)), d, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in text and "rand(" not in text  # what follows reads the written table only
