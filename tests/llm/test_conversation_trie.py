"""The conversation trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from readsift.llm import conversation_trie as ct

TURNS = "conv_id long, turn long, role string, text string, depth long, path string"
EMPTY = hashlib.sha256(b"").hexdigest()


def brute(convs: dict[int, list[tuple]]) -> dict[tuple, tuple]:
    """(conv_id, depth) -> the other columns; a turn is (anything, octets)."""
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * (p[-1][1] if p else 0)
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = own + sum(saved[k] for k in kids[p])
    out = {}
    for p, m in members.items():
        ends = [str(c) for c in sorted(m) if len(convs[c]) == len(p)]
        up = min(members[p[:-1]]) if p else None
        out[min(m), len(p)] = (up, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(ends).encode()).hexdigest())
    return out


def found(df) -> dict[tuple, tuple]:
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def paths(spark, convs: dict[int, list[tuple]]):
    rows = [(c, [(hashlib.sha256(repr(x).encode()).digest()[:16], n) for x, n in t]) for c, t in convs.items()]
    return spark.createDataFrame(rows, "conv_id long, turns array<struct<d:binary,n:long>>")


@pytest.mark.parametrize("turns", [ct.TURNS, 60])
@pytest.mark.parametrize("kind", ["random", "copies", "chain", "turnless", "one"])
def test_trie_against_prefixes(spark, monkeypatch, turns, kind):
    """Small partitions cut lists of equal conversations and deep spines; pieces are short."""
    monkeypatch.setattr(ct, "PIECE", 7)
    rng = random.Random(3)
    turn = lambda k: (k, 3 * k + 1)
    if kind == "random":
        convs = {i: [turn(rng.randrange(3)) for _ in range(rng.randrange(7))] for i in range(300)}
    elif kind == "copies":
        convs = {i: [turn(1)] * (3 if i % 10 else 4) for i in range(200)} | {1000 + i: [turn(1), turn(1), turn(i)] for i in range(60)}
    elif kind == "chain":
        convs = {i: [turn(0)] * (7 * i % 150) for i in range(150)} | {500: [turn(k) for k in range(400)]}
    elif kind == "turnless":
        convs = {i: [] for i in range(40)}
    else:
        convs = {9: [turn(1), turn(2)]}
    assert found(ct.trie(paths(spark, convs), turns)) == brute(convs)


def rebuild(rows) -> dict[int, list[tuple]]:
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), (role or "", text or "")))
    # Ties of a turn follow the digests.
    digest = lambda x: hashlib.sha256(f"{len(x[0].encode())}:{x[0]}{x[1]}".encode()).digest()[:16]
    own = {c: [x for _, x in sorted(v, key=lambda y: (y[0], digest(y[1])))] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = [(x, len(x[1].encode())) for x in own.get(c - c % 5, [])[:h] + v[h:]]
    return out


def test_rebuilt_conversations(spark):
    """Null and repeated turns, null ids, roles and texts, missing bases, long conversations, clashing columns."""
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 60), *range(105, 110), 204, 333]:
        if c in (20, 35):
            continue  # bases that are missing
        for t in range(rng.choice([1, 2, 5, 12]) if c != 7 else 3000):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", "hé", None, "x" * 50, f"own {c} {t}"]), 1, "p"))
    rows += [(3, None, "system", "first", 1, "p"), (3, 1, "user", "tie", 1, "p"), (3, 1, "user", "also", 1, "p"), rows[5], rows[5], (None, 1, "user", "lost", 1, "p"), (400, 0, None, "z" * 300_000, 1, "p")]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, TURNS)
    want = brute(rebuild(rows))
    got = ct.trie(ct.rebuilt(ct.conversations(d)), 500)
    assert found(got) == want
    assert sum(r.n_convs for r in got.where("depth = 0").collect()) == d.where("conv_id is not null").select("conv_id").distinct().count()


def test_empty_table(spark):
    d = spark.createDataFrame([], TURNS)
    assert ct.trie(ct.rebuilt(ct.conversations(d))).count() == 0
    assert ct.trie(ct.rebuilt(ct.conversations(d.withColumn("conv_id", F.lit(None).cast("long"))))).count() == 0


def test_common_turns():
    a, b = bytes(range(160)), bytes(range(96)) + bytes(64)
    assert ct.common_turns(a, b) == 6 and ct.common_turns(a, a) == 10 and ct.common_turns(b"", a) == 0 and ct.common_turns(a[:32], a) == 2
    assert EMPTY == hashlib.sha256().hexdigest()
