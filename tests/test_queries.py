"""Every query of the engine runs; those with SQL match DuckDB row for row."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from readsift import registry
from readsift.streaming.leakage import windowed_leakage

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def text(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracles()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canon(df.collect(), df.columns) == canon(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream(spark, tmp_path):
    """The stream gives the batch's counts for the windows that have closed."""
    e = spark.createDataFrame([(f"2024-01-0{d} 0{h}:00:00", r, h == 1) for d in (1, 2, 3) for h in (1, 2) for r in (1, 2)], "ts string, run_id int, positive boolean").selectExpr("cast(ts as timestamp) ts", "run_id", "positive")
    e.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = windowed_leakage(s).writeStream.format("memory").queryName("leak").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda x: sorted((str(r.window_start), r.run_id, r.n, r.n_positive) for r in x.collect())
    assert key(spark.table("leak")) == key(windowed_leakage(e))


def test_plans(spark):
    """Filters and columns reach the scan, and best-hit selection is pruned before its shuffle."""
    from readsift.session import table

    d = table(spark, SF, "lineitem").where("l_suppkey < 3").select("l_orderkey")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_suppkey), LessThan(l_suppkey,3)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in plan
    best = registry.queries()["best_hit_per_key"](spark, SF)
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()
