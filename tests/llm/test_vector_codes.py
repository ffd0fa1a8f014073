"""Vector codes against plain loops over all entries."""

import math
import random
from pathlib import Path

import numpy as np
import pytest

from readsift.llm import vector_codes as vc
from readsift.llm.catalogue import queries

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int"


def nearest(part, book):
    dist = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
    return dist.index(min(dist)), min(dist)


def brute(rows, parts=16, entries=64, rounds=2):
    """vec_id's rows -> (code, error), and the codebooks, in Python integers."""
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(ok[0][1])
    ok = [(r[0], [math.floor(256 * x) for x in r[1]], r[2]) for r in ok if len(r[1]) == width]
    edge = [width * i // parts for i in range(parts + 1)]
    cut = lambda v: [v[a:b] for a, b in zip(edge, edge[1:])]
    books = [list(b) for b in zip(*(cut(v) for i, v, _ in [r for r in ok if r[0] is not None][:entries]))]
    for _ in range(rounds):
        held = [[[] for _ in b] for b in books]
        for _, v, _ in ok:
            for p, x in enumerate(cut(v)):
                held[p][nearest(x, books[p])[0]].append(x)
        books = [[[sum(c) // len(h) for c in zip(*h)] if h else e for e, h in zip(b, hs)] for b, hs in zip(books, held)]
    out = []
    for i, v, _ in ok:
        found = [nearest(x, b) for x, b in zip(cut(v), books)]
        out.append((i, [f[0] for f in found], sum(f[1] for f in found)))
    return out, books


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[2])


@pytest.mark.parametrize("width", [64, 160, 40])
def test_codes_against_loops(spark, width):
    rng = random.Random(width)
    f = lambda x: float(np.float32(x))
    vec = lambda s=0.2: [f(rng.gauss(0, s)) for _ in range(width)]
    hot = vec()
    rows = [(i, vec(), i % 3) for i in range(120)] + [(200 + i, hot, 7) for i in range(60)] + [(400 + i, [f(0.004 * (k % 2)) for k in range(width)], None) for i in range(5)]
    rows += [(5, vec(), 1), (6, None, 1), (7, [None] * width, 1), (8, [float("nan")] + [0.0] * (width - 1), 1), (9, [float("inf")] * width, 1), (None, vec(), 2), (10, vec()[:-1], 1), (11, [], 1), (900, vec(40.0), 1), rows[3], rows[3]]
    rng.shuffle(rows)
    d = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(5)
    got, books = vc.encode(d)
    want, want_books = brute(rows)
    assert [b.tolist() for b in books] == want_books
    assert sorted(((r.vec_id, list(r.code), r.error) for r in got.collect()), key=key) == sorted(want, key=key)


def test_bounds_drop_most_entries_and_never_the_nearest():
    rng = np.random.default_rng(1)
    for d in (4, 16, 33):
        x, book = rng.integers(-300, 300, (500, d)), rng.integers(-300, 300, (64, d))
        book[7] = book[3]  # a tie goes to the lower index
        x[:20] = book[rng.integers(0, 64, 20)]
        at, dist, made = vc.nearest(x, book)
        full = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (dist == full.min(1)).all() and (at == full.argmin(1)).all() and 7 not in at
        assert made < (0.4 if d == 4 else 0.7) * 500 * 64


def test_segment_bounds_are_lower_bounds():
    rng = np.random.default_rng(2)
    x, y = rng.integers(-(2**27), 2**27, (200, 24)), rng.integers(-(2**27), 2**27, (200, 24))
    x[:100], y[:100] = x[:100] // 2**20, y[:100] // 2**20
    exact = ((x - y) ** 2).sum(1)
    for n in (1, 2, 4, 8, 24):
        (sx, rx, qx), (sy, ry, qy) = vc.segments(x, n), vc.segments(y, n)
        assert (((sx - sy) ** 2).sum(1) + (rx - ry) ** 2 - vc.slack(qx, qy) <= exact).all()


def test_large_components_count_as_the_limit():
    x = vc.whole_numbers(np.array([[3.4e38, -3.4e38] + [0.0] * 62, [2.0**20, -1.001] + [0.0] * 62]))
    assert x[0, 0] == 2**27 and x[0, 1] == -(2**27) and x[1, 0] == 2**27 and x[1, 1] == -257


def test_query_columns_and_label_sums(spark, tmp_path: Path):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(64)], i % 4 or None, "c", 1) for i in range(90)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries()["op12_vector_codes"](spark, str(tmp_path)).collect()
    label, sums = {r[0]: r[2] for r in rows}, {}
    for r in got:
        sums[label[r.vec_id]] = sums.get(label[r.vec_id], 0) + r.error
    assert len(got) == 90 and all(r.label_error == sums[label[r.vec_id]] and len(r.code) == 32 for r in got) and len({r.codebooks_sha256 for r in got}) == 1


def test_empty_tables(spark):
    for rows in ([], [(1, None, 1, "c", 1)], [(1, [], 1, "c", 1)]):
        got, books = vc.encode(spark.createDataFrame(rows, SCHEMA))
        assert got.count() == 0 and books == []
