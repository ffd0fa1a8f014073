"""Operator 10 against brute force: edit distances, recall by the embedding, precision and odd rows."""

import random

import numpy as np

from readsift.llm import decontamination as D


def words(rng, n, vocab=2000):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def nearest(text, item):
    """Least edit distance of any run of ``text`` to ``item``."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for x in text:
        old, row = row, [0]
        for j, y in enumerate(item, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        best = min(best, row[-1])
    return best


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        k, p = rng.randrange(3), rng.randrange(len(w)) if w else 0
        if k == 0 and w:
            w[p] = f"w{rng.randrange(2000)}"
        elif k == 1:
            w.insert(p, f"w{rng.randrange(2000)}")
        elif w:
            del w[p]
    return w


def test_distances():
    rng = random.Random(1)
    g = D.Group([(k, np.array([rng.randrange(1, 5) for _ in range(n)])) for k, n in enumerate((6, 7, 7))], 9, 0.8, 1, 1)
    text = np.array([[rng.randrange(1, 5) for _ in range(12)] for _ in range(60)])
    item = np.array([rng.randrange(3) for _ in range(60)])
    d, start, end = g.verify(text, item)
    for k in range(60):
        it = g.words[item[k], : g.length[item[k]]].tolist()
        t = text[k].tolist()
        assert d[k] == nearest(t, it)
        run, row = t[start[k] : end[k]], list(range(len(it) + 1))
        for i, x in enumerate(run, 1):
            old, row = row, [i]
            for j, y in enumerate(it, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        assert row[-1] == d[k]


ITEMS = [(k, n) for k, n in enumerate([1, 2, 4, 5, 9, 12, 20, 30, 40, 55, 300] * 3)]


def planted(rng, share):
    """Items with ``share`` of the edits allowed, in other text, and what brute force finds there."""
    items = [(k, " ".join(words(rng, n)) + ".") for k, n in ITEMS]
    texts = []
    for k, text in items * 4:
        w = D.words(text)
        e = int(D.budget(len(w)) * share)
        texts.append(" ".join(words(rng, rng.randrange(50)) + edited(rng, w, e) + words(rng, rng.randrange(50))))
    texts += [" ".join(words(rng, 100)) for _ in range(40)] + ["", None]
    true = [{k for k, t in items if nearest(D.words(x), D.words(t)) <= D.budget(len(D.words(t)))} for x in texts]
    return items, texts, true


def test_recall_and_precision():
    for share, least in ((0, 1), (0.5, 0.95), (1, 0.9)):
        items, texts, true = planted(random.Random(7), share)
        got = [{h[0] for h in x} for x in D.Items(items).find(texts)]
        assert all(g <= t for g, t in zip(got, true))
        assert sum(map(len, got)) >= least * sum(map(len, true)) > 100


def test_nothing_is_found_without_the_embedding():
    items, texts, _ = planted(random.Random(7), 0)
    assert not any(D.Items(items, walks=0).find(texts))


def test_windows_that_documents_cut_off():
    rng = random.Random(5)
    items = [(k, " ".join(words(rng, 15 + k))) for k in range(40)]
    w = [D.words(t) for _, t in items]
    e = [D.budget(len(x)) for x in w]
    texts = [" ".join(x[n:]) for x, n in zip(w, e)] + [" ".join(x[: len(x) - n]) for x, n in zip(w, e)]
    found = D.Items(items).find(texts)
    assert sum(k % 40 in {h[0] for h in x} for k, x in enumerate(found)) >= 0.9 * len(texts)


def test_frame(spark):
    items, *_ = planted(random.Random(7), 0)
    text = "prefix words " + items[8][1].upper() + " and more"
    rows = [(1, text), (2, None), (3, ""), (None, items[7][1]), (1, text), (4, "clean text here"), (5, "word " * 200000)]
    d = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, hits int, _text string, item_id string")
    b = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    for limit in (200, D.ITEM_BYTES):
        m = D.matches(d, b, d.columns, hits="found", limit=limit).collect()
        by = {k: [h.item_id for h in r.found if len(D.words(items[h.item_id][1])) > 4] for k, r in ((x.doc_id or 0, x) for x in m)}
        assert len(m) == len(rows) and by == {0: [7], 1: [8], 2: [], 3: [], 4: [], 5: []}
        assert all(h.start == 2 and h.distance == 0 for r in m if r.doc_id == 1 for h in r.found if h.item_id == 8)
    assert D.matches(d, b.limit(0), ["doc_id"]).where("size(hits) > 0").count() == 0
    assert D.matches(d.limit(0), b, ["doc_id"]).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, D.words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in D.op10_benchmark_decontamination(spark, sf).collect()}
    docs = {r.doc_id: D.words(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(got) == set(docs)
    found = true = 0
    for i, w in docs.items():
        near = {k for k, it in items if len(set(it) & set(w)) >= len(set(it)) * 0.5 and nearest(w, it) <= D.budget(len(it))}
        assert set(got[i].item_ids) <= near and got[i].contaminated == bool(got[i].item_ids)
        found, true = found + len(got[i].item_ids), true + len(near)
    assert found >= 0.9 * true > 0
