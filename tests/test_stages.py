"""Stages: what a killed one leaves, what is resumed, what a new run makes stale, and the settings beside the outputs."""

import pytest
from pyspark.sql import functions as F

from readsift.operators.profiles import Profile
from readsift.session import scratch
from readsift.stages import Run, Stage, run_folder


class Killed(BaseException):
    """Not an Exception, as a signal is not."""


def study(spark, calls, kill=None):
    """Numbers, their squares and the sum; ``kill`` names the place at which the squares die."""

    def numbers(read):
        calls.append("numbers")
        return {"n": spark.range(10).withColumnRenamed("id", "v")}

    def squares(read):
        calls.append("squares")
        if kill == "before":
            raise Killed
        d = read("n").select((F.col("v") * F.col("v")).alias("v"))
        return {"sq": d, "empty": d.where("v < 0")}

    def total(read):
        calls.append("total")
        return {"total": read("sq").agg(F.sum("v").alias("v"))}

    return [Stage("numbers", ("n",), numbers), Stage("squares", ("sq", "empty"), squares, ("numbers",)), Stage("total", ("total",), total, ("squares",))]


def states(run):
    return [r.state for r in run.status().orderBy("place").collect()]


@pytest.mark.parametrize("kill", ["before", "between"])
def test_killed_midway_and_resumed(spark, kill):
    folder, calls = scratch(spark), []
    run = Run(spark, folder, study(spark, calls, kill))
    if kill == "between":  # after the first of two tables is in its place
        real = run._move

        def move(a, b):
            if b.getName() == "empty":
                raise Killed
            real(a, b)

        run._move = move
    with pytest.raises(Killed):
        run.run()
    assert states(run) == ["done", "missing", "missing"] and calls == ["numbers", "squares"]
    again = Run(spark, folder, study(spark, calls))
    assert again.run() == ["squares", "total"] and states(again) == ["done"] * 3
    assert again.read("total").first().v == 285 and again.read("empty").count() == 0
    assert again.run() == [] and calls.count("numbers") == 1


def test_from_only_and_stale(spark):
    calls = []
    run = Run(spark, scratch(spark), study(spark, calls))
    with pytest.raises(RuntimeError, match="not done"):
        run.run(only=["total"])
    run.run()
    assert run.run(start="squares") == ["squares", "total"] and run.run(only=["total"]) == ["total"]
    assert run.run(only=["numbers"]) == ["numbers"] and states(run) == ["done", "stale", "stale"]
    with pytest.raises(RuntimeError, match="not done"):
        run.run(only=["total"])
    assert run.run() == ["squares", "total"] and states(run) == ["done"] * 3
    with pytest.raises(ValueError, match="no stage"):
        run.run(start="03")


def test_lost_tables_and_broken_records(spark):
    run = Run(spark, scratch(spark), study(spark, []))
    run.run()
    run._fs.delete(run._path("sq"), True)
    assert states(run) == ["done", "lost", "stale"] and run.run() == ["squares", "total"]
    out = run._fs.create(run._path("_stages", "total.json"), True)
    out.write(bytearray(b"{"))
    out.close()
    assert states(run) == ["done", "done", "missing"] and run.run() == ["total"]


def test_stages_that_do_not_fit(spark):
    a = Stage("a", ("t",), lambda read: {"u": spark.range(1)})
    with pytest.raises(ValueError, match="made"):
        Run(spark, scratch(spark), [a]).run()
    with pytest.raises(ValueError, match="twice"):
        Run(spark, scratch(spark), [a, Stage("b", ("t",), a.work)])
    with pytest.raises(ValueError, match="earlier"):
        Run(spark, scratch(spark), [Stage("b", ("x",), a.work, ("a",)), a])


def test_settings_beside_the_outputs(spark):
    root = scratch(spark)
    fixed, other = Profile(), Profile("calculated", 0.92, 0.5)
    assert run_folder(root, fixed) == f"{root}/gt_fixed_id0.90_cov0.80"
    run = Run(spark, run_folder(root, other), study(spark, []))
    run.keep_settings(other, seed=1)
    run.keep_settings(other, seed=1)
    assert run.read("settings").first().asDict() == {"name": "calculated", "min_identity": "0.92", "min_coverage": "0.5", "seed": "1"}
    with pytest.raises(ValueError, match="holds a run"):
        run.keep_settings(other, seed=2)
