"""The pipeline's near-copy stage against brute-force Jaccard similarity."""

import random

import pytest

import corpus_pipeline
from readsift.llm import near_copies
from readsift.llm.common import cut

SF = "/root/testdata/sf0.001"


def brute(texts: dict[int, str]) -> set[int]:
    """The smallest id of each component, every pair compared."""
    s = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        s[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    out, open_ = set(), sorted(s)
    while open_:
        queue = [open_.pop(0)]
        out.add(queue[0])
        while queue:
            x = queue.pop()
            hit = [i for i in open_ if near(s[x], s[i])]
            queue += hit
            open_ = [i for i in open_ if i not in hit]
    return out


def edited(rng: random.Random, text: str, n: int) -> str:
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [near_copies.BLOCK, 8])
def test_stage_against_brute_force(spark, monkeypatch, block):
    rng = random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    footer = prose(30)  # shared by many, alone no reason to link
    texts = [f"{prose(rng.choice([6, 60, 180, 400]))} {footer}" for _ in range(60)]
    texts += [edited(rng, t, e) for t in texts[:30] for e in (1, 2, 4)]
    texts += [edited(rng, texts[40], 2) for _ in range(60)]  # one large group, many pairs near the limit
    texts += [None, "", " ", "one two", "one two", "one three", texts[3].upper()]
    rng.shuffle(texts)
    docs = cut(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "near")
    stay = {r.doc_id for r in near_copies.first_ids(docs, block).collect()}
    want = brute(dict(enumerate(texts)))
    assert stay == want and len(want) < len(texts) - 60
    if block == near_copies.BLOCK:
        assert {r.doc_id for r in near_copies.first_ids(docs, block, radius=64).collect()} == want
        assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()} == want
