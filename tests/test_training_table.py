"""Text features of the training table, counted by hand on odd texts."""

import pytest

from readsift.plans import learning

TEXTS = ["", "Ab\nC\n", "ÄÖ É ßİ", "&&||<>!#*$%^-[]\\", "😀A😀&\n\n", "no capitals", "A" * 5000 + "&" * 3, None]


def test_shares_and_lines(spark, tmp_path):
    docs = [(i + 1, t, "en", "web", 0 if t is None else len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d[0], 1) for d in docs], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.read_id: r for r in learning.training_table(spark, str(tmp_path)).collect()}
    for i, t, *_ in docs:
        count = lambda s: pytest.approx(sum(c in s for c in t) / max(len(t), 1), abs=1e-15)
        if t is None:
            assert got[i].upper_share is None and got[i].symbol_share is None
        else:
            assert got[i].upper_share == count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") and got[i].symbol_share == count("#*$%&|<>!") and got[i].n_lines == t.count("\n") + 1
