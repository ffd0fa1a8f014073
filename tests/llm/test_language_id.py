"""Language identification: Viterbi against all paths, spans of mixed texts, held-out accuracy, odd rows."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readsift.llm import language_id as li
from readsift.llm.catalogue import queries

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, score string, lang_pred string, __text string"
WORDS = {"en": "the house and water with thing weather shower", "de": "das haus und wasser mit zwischen schön straße", "ru": "дом вода и погода между очень", "uk": "дім вода й погода між дуже їжак"}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def corpus(seed=1, n=240):
    rng = random.Random(seed)
    return [(i, prose(rng, lg := sorted(WORDS)[i % 4], rng.randrange(5, 40)), lg, "s", "x", "y", "z") for i in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    return li.train(spark.createDataFrame(corpus(), DOCS))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    length = np.array([5, 1, 0, 6, 3, 6])
    scores = np.round(rng.normal(0, 2, (length.sum(), 3)), 1)
    scores[2, 1] = -np.inf
    for switch in (0.0, 1.5, 100.0):
        at = 0
        for n, path in zip(length, li.viterbi(scores, length, switch)):
            s = scores[at : at + n]
            cost = lambda p: sum(s[t, k] for t, k in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
            assert len(path) == n
            if n:
                assert cost(path) == pytest.approx(max(cost(p) for p in itertools.product(range(3), repeat=int(n))))
            at += n


def test_words_by_script():
    assert li.words("Été été Приветworld 漢字かな 12ab_c") == ["été", "été", "привет", "world", "漢字かな", "ab", "c"]
    assert li.words(None) == li.words("") == li.words("12 — 3") == []
    assert "".join(li.words("x" * 70 + " ß")) == "x" * 70 + "ß"


def test_scores_are_the_sums_of_the_grams(model):
    """The vectorised scores equal those of each word alone."""
    of = ["the", "a", "straße", "дом", "x" * 32]
    assert np.allclose(model.scores(of), np.concatenate([model.scores([w]) for w in of]), equal_nan=True)


def test_scripts_narrow_the_candidates(model):
    k = {lg: i for i, lg in enumerate(model.langs)}
    s = model.scores(["вода", "water"])
    assert np.isinf(s[0, [k["en"], k["de"]]]).all() and np.isfinite(s[0, [k["ru"], k["uk"]]]).all() and np.isinf(s[1, [k["ru"], k["uk"]]]).all()


def test_spans_of_mixed_text(model):
    rng = random.Random(7)
    text = f"{prose(rng, 'en', 30)}. {prose(rng, 'de', 20)} — {prose(rng, 'ru', 12)}! {prose(rng, 'en', 25)}"
    assert [lg for lg, _, _ in li.spans(model, text)] == ["en", "de", "ru", "en"]
    at = [a for _, a, _ in li.spans(model, text)]
    assert all(abs(a - b) <= 1 for a, b in zip(at, (0, 30, 50, 62)))
    # A single foreign word inside is cheaper than two switches only if its script excludes the language.
    assert [lg for lg, _, _ in li.spans(model, f"{prose(rng, 'en', 20)} вода {prose(rng, 'en', 20)}")][::2] == ["en", "en"]


def test_rows_and_held_out_labels(spark):
    rows = corpus()
    long = prose(random.Random(2), "de", 30000)
    odd = [(500, None, "en", *"sxyz"), (501, "", "en", *"sxyz"), (502, " 12 — ", "de", *"sxyz"), (503, long, None, *"sxyz"), (None, rows[0][1], rows[0][2], *"sxyz"), (504, "日本語", None, *"sxyz"), (505, "x" * 5000, None, *"sxyz"), rows[3], rows[3]]
    d = spark.createDataFrame(rows + odd, DOCS)
    got = li.predict(d, li.train(d), ["doc_id", "lang", "score", "lang_pred"][:2]).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and not by[i].spans for i in (500, 501, 502))
    assert by[503].lang_pred == "de" and by[503].score > 0.99 and sum(s.n for s in by[503].spans) == 30000
    assert by[504].lang_pred in WORDS and by[505].lang_pred in ("en", "de")
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 50 and all(r.lang_pred == r.lang for r in held)
    # The labels of held-out rows, and rows without an id, teach nothing.
    other = d.withColumn("lang", F.when((F.crc32(F.col("doc_id").cast("string")) % 3 == 1) | F.col("doc_id").isNull(), F.lit("uk")).otherwise(F.col("lang")))
    assert sorted((r.doc_id or -1, r.lang_pred, r.score) for r in li.predict(other, li.train(other), ["doc_id"]).collect()) == sorted((r.doc_id or -1, r.lang_pred, r.score) for r in got)


def test_bounded_training(spark):
    """A small bound draws about so many rows of each language, and few of them suffice here."""
    d = spark.createDataFrame(corpus(n=2000), DOCS)
    got = li.predict(d, li.train(d, per_language=50), ["doc_id", "lang"]).where("lang <> lang_pred").count()
    assert got < 20


def test_without_anything_to_learn(spark):
    d = spark.createDataFrame([(1, "some text", None, *"sxyz"), (3, None, None, *"sxyz")], DOCS)
    assert li.train(d) is None and {r.lang_pred for r in li.predict(d, None, ["doc_id"]).collect()} == {"und"}
    assert li.predict(d.limit(0), li.train(d.limit(0)), ["doc_id"]).count() == 0
    wordless = spark.createDataFrame([(i, "12", "en", *"sxyz") for i in range(9)], DOCS)
    assert {r.lang_pred for r in li.predict(wordless, li.train(wordless), ["doc_id"]).collect()} == {"und"}


def test_query_on_held_out_documents(spark):
    got = queries()["op13_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and {r.doc_id for r in held} == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.98
