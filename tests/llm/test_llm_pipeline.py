"""The corpus pipeline's stages against brute force, and the operators' SQL."""

import os
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from readsift.llm import catalogue, decontamination, near_copies
from readsift.llm.common import cut

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations embeddings".split()
#: Extra columns with names that the stages might use themselves.
CLASHING = "slot shard hits _hits __hits __score score __row __at at __id __source __text _text block g fp component_id".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.queries()[name](spark, SF)
    want = c.sql(catalogue.oracles()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    text = lambda v: "null" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    assert sorted(tuple(map(text, r)) for r in df.select(cols).collect()) == sorted(tuple(map(text, r)) for r in want.select(*cols).fetchall())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", *(f"'x' as {c}" for c in CLASHING))
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        cols = docs.columns
        docs = cut(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name != "sharding":
            assert docs.columns == cols and all(after[i] == before[i] for i in after)
        gone = {before[i].text for i in set(before) - set(after)}
        if name == "toxicity":
            assert gone and len(gone) < 0.2 * len(before)
        elif name == "simhash_near_dedup":
            sets = {i: set(near_copies.shingles(near_copies.words(r.text.encode())).tolist()) for i, r in before.items()}
            alike = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
            near = {i: [j for j in sets if alike(sets[i], sets[j])] for i in sets}
            low = {i: i for i in sets}
            while (new := {i: min(low[j] for j in near[i]) for i in sets}) != low:
                low = new
            assert set(after) == {i for i in low if low[i] == i}
        elif name == "benchmark_decontamination":
            items = [set_ for set_ in (decontamination.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())]
            holds = lambda t: any(f" {' '.join(w)} " in f" {' '.join(decontamination.words(t))} " for w in items)
            assert not any(holds(r.text) for r in after.values())
        else:
            assert set(after) == set(before)
        before = after
    loads = np.bincount([r.shard for r in after.values()], weights=[r["size"] for r in after.values()], minlength=40)
    assert loads.max() <= max(loads.mean() * 1.5, max(r["size"] for r in after.values()))


def test_stages_on_nothing_and_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (1, None, None, "s", None), (1, None, None, "s", None), (2, "word " * 100000, "en", "s", 1)], docs.schema))
    for d, n in ((docs.limit(0), 0), (odd, 4)):
        for _, stage in corpus_pipeline.STAGES:
            d = cut(stage(spark, d, SF), "odd")
        assert d.count() == n


def test_texts_that_share_an_id(spark):
    """Rows that repeat an id and text are one; another text of the id is not lost."""
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "de", "s", 1), (1, "u v w x y z", "en", "s", 2), (2, "a b c d e f", "en", "s", 3), (3, "other words", "en", "s", 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _ in range(3):
        got = sorted((r.doc_id, r.text, r.lang) for r in corpus_pipeline.drop_near_copies(spark, d.repartition(3), SF).collect())
        assert got[1:] == [(1, "u v w x y z", "en"), (3, "other words", "en")] and got[0][:2] == (1, "a b c d e f") and got[0][2] == min(("en", "de"))


def test_run_needs_no_collect_of_documents():
    source = open(corpus_pipeline.__file__).read()
    assert not re.search(r"\.(collect|toPandas|toLocalIterator)\(", source)
