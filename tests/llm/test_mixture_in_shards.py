"""The mixture's target shares in the rows of the pipeline's last stage."""

from collections import Counter

import corpus_pipeline
from readsift.llm import mixing
from readsift.llm.common import cut

SF = "/root/testdata/sf0.001"
COUNTS = {"a": 6000, "b": 1500, "c": 375}


def test_slots_follow_the_mixture(spark):
    rows = [(f"text {s} {i}", s) for s, n in COUNTS.items() for i in range(n)]
    docs = cut(spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string"), "mixed")
    out = corpus_pipeline.deal(spark, cut(corpus_pipeline.mix(spark, docs, SF), "mixing"), SF).collect()
    assert len(out) == len(rows)
    at = {r.doc_id: (r.slot, r.row_in_block) for r in mixing.mix_sources(docs).collect()}
    for s in {r.shard for r in out}:
        got = [at[r.doc_id] for r in sorted((r for r in out if r.shard == s), key=lambda r: r.slot)]
        assert got == sorted(got)
    # The mixing stage decides this: without it the slots do not follow the mixture.
    without = corpus_pipeline.deal(spark, docs, SF).collect()
    assert {r.doc_id: r.shard for r in without} == {r.doc_id: r.shard for r in out}
    lone = [at[r.doc_id] for r in sorted((r for r in without if r.shard == 0), key=lambda r: r.slot)]
    assert lone != sorted(lone)
    # The first source runs out after some 2,600 rows; up to there the shares are the weights.
    first = Counter(rows[r.doc_id][1] for r in out if r.slot < 50)
    total = sum(n**0.5 for n in COUNTS.values())
    for s, n in COUNTS.items():
        assert abs(first[s] / first.total() - n**0.5 / total) < 0.04


def test_tables_without_files(spark):
    """Rows that no file holds have no order of their own; their slots follow the groups."""
    rows = [(i, f"text {i % 7}", "a", "m") for i in range(60)] + [(None, None, None, "m")]
    out = corpus_pipeline.deal(spark, spark.createDataFrame(rows, "doc_id long, text string, source string, _metadata string"), SF).collect()
    assert len(out) == 61 and all(sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out))) for s in {r.shard for r in out})
