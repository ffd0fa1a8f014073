"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import heapq
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from readsift.llm import catalogue, common, components, licenses, mixing, quality_classifier, quality_rules, sharding, simhash, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, score string, host string, shard string, fp string, g string"


def docs(spark, rows):
    """(id, text, source) rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, "x", "y", "z", "f", "g") for i, t, s in rows], DOCS)


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def corpus(seed=0):
    """Texts of all kinds: null, empty, blank, short, long, repeated lines, exact and near copies, repeated rows."""
    rng = random.Random(seed)
    out = [(None, "lost id " + " ".join(words(rng, 60)), "a"), (1, None, "a"), (2, "", None), (3, " \t\n", "b"), (4, "one", "b"), (5, "ONE two", "b")]
    base = words(rng, 120)
    for i in range(6, 60):
        w = words(rng, rng.choice([5, 30, 80, 200]))
        if i % 9 == 0:
            w = base[:] if i % 18 else base[10:100] + w[:30]
        if i % 7 == 0:
            w = w[:10] * 6
        out.append((i, " ".join(w).replace("w1 ", "W1\n").replace("w7 ", "w7 | "), "abc"[i % 3]))
    long = words(rng, 20000, 50000)
    out += [(70, " ".join(long), "a"), (71, " ".join(long[5000:9000] + words(rng, 50)), "a"), out[20], out[20]]
    return out


def got(df):
    return {r.doc_id: r.asDict() for r in df.collect()}


# 1 and 3


def labelled(spark, n=400):
    rng = random.Random(5)
    rows, lab = [], []
    for i in range(n):
        w, bad, toxic = words(rng, rng.randrange(20, 80)), i % 5 == 0, i % 4 == 1
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["idiotish", "idiotic", "scumbag"])
        t = " ".join(x + "$$$" for x in w) if bad else " ".join(w)
        rows.append((i, t, "a"))
        lab.append((i, int(not bad), int(toxic), "x"))
    rows += [(n, None, "a"), (n + 1, "", "a"), (None, "idiotic words", "a"), (n + 2, " ".join(words(rng, 30000)), "a"), rows[0]]
    lab += [(None, 1, 1, "x"), (n + 9, None, None, "x"), (0, None, None, "x")]
    return docs(spark, rows), spark.createDataFrame(lab, "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize("op", [toxicity, quality_classifier])
def test_classifiers(spark, op):
    d, l = labelled(spark)
    target = "toxic" if op is toxicity else "quality"
    out = op.score(d, op.train(d, l), ["doc_id"]).collect()
    assert len(out) == d.count() and all(0 <= r["__score"] <= 1 for r in out)
    s = {r.doc_id: r["__score"] for r in out if r.doc_id is not None}
    held = [r for r in l.where("quality is not null and doc_id is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % op.FOLDS == op.HELD_OUT]
    assert len(held) > 60
    right = [(s[r.doc_id] >= 0.7) == bool(r[target]) for r in held]
    assert np.mean(right) > 0.95
    # Labels of the held-out fold are never read.
    flipped = l.withColumn(target, F.when(F.crc32(F.col("doc_id").cast("string")) % op.FOLDS == op.HELD_OUT, 1 - F.col(target)).otherwise(F.col(target)))
    assert {r.doc_id: r["__score"] for r in op.score(d, op.train(d, flipped), ["doc_id"]).collect() if r.doc_id is not None} == s


@pytest.mark.parametrize("op", [toxicity, quality_classifier])
def test_classifiers_without_labels_or_rows(spark, op):
    d, l = labelled(spark, 20)
    none = op.score(d, op.train(d, l.limit(0)), ["doc_id"]).collect()
    assert {r["__score"] for r in none} == {0.0 if op is toxicity else 0.5}
    assert op.score(d.limit(0), op.train(d.limit(0), l), ["doc_id"]).count() == 0


def test_nnpu_risk_is_corrected_and_held_at_zero():
    rng = np.random.default_rng(0)
    for out_u in (rng.normal(0, 1, 50), np.full(50, -9.0)):
        out_p, prior, e = rng.normal(1, 1, 20), 0.3, 1e-6
        gp, gu, neg = toxicity.nnpu_gradient(out_p, out_u, prior)
        if neg >= 0:
            risk = lambda p, u: prior * np.logaddexp(0, -p).mean() + np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        else:
            risk = lambda p, u: -(np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean())
        for k in range(3):
            d = np.eye(len(out_p))[k] * e
            assert np.isclose((risk(out_p + d, out_u) - risk(out_p - d, out_u)) / (2 * e), gp[k], atol=1e-6)
            d = np.eye(len(out_u))[k] * e
            assert np.isclose((risk(out_p, out_u + d) - risk(out_p, out_u - d)) / (2 * e), gu[k], atol=1e-6)


def test_quantile_level_lies_between_the_kinds():
    counts = np.zeros(1000, int)
    counts[200:260] = 10
    counts[700:800] = 60
    level, at = quality_classifier.quantile_level(counts, 0.12)
    assert 260 <= at < 700 and abs(level - 600 / 6600) < 1e-9


# 2


def test_quality_rules(spark):
    rows = corpus()
    out = quality_rules.apply(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    want = {}
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        win = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        cover = {j for k, x in enumerate(win) if win.count(x) > 1 for j in range(k, k + 8)} if len(w) < 5000 else set()
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want[i] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w))
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
    rate = {}
    for host in {s for *_, s in rows}:
        mine = [want[i][5] for i, _, s in rows if s == host]
        rate[host] = np.mean(mine)
    kept = {r.host: r.host_kept for r in out}
    assert set(kept) == set(rate) and not kept[None]  # one empty text: every rule that it breaks is certain
    assert all(r.kept == (not r.base_failed and r.host_kept) for r in out)
    assert quality_rules.apply(docs(spark, rows).limit(0)).count() == 0


# 4


def test_fingerprints():
    for t in ("", "A b", "x", "The Éa the éA the", " ".join(words(random.Random(1), 500))):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        w = WORD.findall(low)
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in sh]
        assert simhash.fingerprint(t.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_bit_slices():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, 700, dtype=np.uint64)
    for i in range(1, 700, 2):
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            fp[i] = fp[i - 1] ^ np.uint64(1) << np.uint64(b)
    g = np.sort(rng.integers(0, 9, 700))
    dist = np.bitwise_count(fp[:, None] ^ fp[None, :])
    for radius, chunk in ((0, 64), (1, 1000), (3, 77), (6, 1 << 16)):
        pairs = {(int(a), int(b)) for i, j in simhash.bit_sliced_links(fp, np.searchsorted(g, g, "right"), radius, chunk) for a, b in zip(i, j)}
        assert pairs == {(int(a), int(b)) for a, b in zip(*np.nonzero((dist <= radius) & (g[:, None] == g[None, :]))) if a < b}


@pytest.mark.parametrize("block", [8192, 8])
def test_near_duplicates(spark, block):
    """``block`` 8 deals every larger bucket as pairs of chunks."""
    rng = random.Random(2)
    base = words(rng, 150)
    rows = corpus() + [(200 + i, " ".join(base[:k] + ["zz"] + base[k + 1 :]), "a") for i, k in enumerate(range(0, 150, 4))] + [(300, " ".join(base), "a")] * 2
    out = simhash.near_duplicates(docs(spark, rows), block=block).collect()
    assert len(out) == len(rows)
    fp = {i: simhash.fingerprint((t or "").encode()) for i, t, _ in rows}
    ids = sorted(i for i in fp if i is not None)
    comp = {i: i for i in ids}
    while True:
        new = {i: min(comp[j] for j in ids if (fp[i] ^ fp[j]).bit_count() <= 3) for i in ids}
        if new == comp:
            break
        comp = new
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == comp
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(5, 5), (None, 3)]
    out = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {}
    for _ in range(200):
        for a, b in edges:
            if a is not None:
                m = min(low.get(a, a), low.get(b, b))
                low[a] = low[b] = m
    assert {k: v for k, v in low.items() if k != v} == out
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 5 and 6


def test_schedule_is_the_heaps():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes, shards = np.sort(rng.choice(5000, rng.integers(1, 40), replace=False) + 1)[::-1], int(rng.integers(2, 41))
        counts = rng.integers(1, 1200, len(sizes))
        load, heap = np.zeros(shards), [0.0] * shards
        edges, all_ends, all_to = sharding.schedule(sizes, counts, shards)
        for i, (s, k) in enumerate(zip(sizes, counts)):
            ends, to = all_ends[edges[i] : edges[i + 1]], all_to[edges[i] : edges[i + 1]]
            assert ends[-1] == k
            load[to] += np.diff([0, *ends]) * s
            for _ in range(k):
                heapq.heapreplace(heap, heap[0] + s)
        assert np.allclose(np.sort(load), np.sort(heap))


def test_sharding(spark):
    rows = corpus() + [(1000 + i, "same text", "a") for i in range(50)]
    out = sharding.shard(docs(spark, rows), 7).collect()
    assert len(out) == len(rows)
    text = {i: t or "" for i, t, _ in rows}
    assert all(r["size"] == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in out)
    home, loads = {}, {}
    for r in out:
        assert home.setdefault(text[r.doc_id], r.shard) == r.shard
        loads[r.shard] = loads.get(r.shard, 0) + r["size"]
    for s in loads:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    heap, sizes = [0] * 7, {}
    for i, t, _ in rows:
        sizes[t or ""] = sizes.get(t or "", 0) + len((t or "").encode()) + 16
    for x in sorted(sizes.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + x)
    assert sorted(x for x in heap if x) == sorted(loads.values())
    assert sharding.shard(docs(spark, rows).limit(0)).count() == 0


def test_sharding_query_is_the_heaps_to_the_byte(spark, tmp_path):
    """Large groups of different sizes are dealt by their exact sizes."""
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(200_000, 900_000) if i < 60 else f"text {i % 900}") for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op5_lpt_sharding(spark, str(tmp_path)).collect()
    sizes = {}
    for _, t in rows:
        sizes[t] = sizes.get(t, 0) + len(t) + 16
    heap = [0] * 40
    for x in sorted(sizes.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + x)
    loads = {}
    for r in out:
        loads[r.shard] = loads.get(r.shard, 0) + r["size"]
    assert sorted(loads.values()) == sorted(heap) and {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}


def test_mixing(spark):
    rows = [(i, "t", None if i % 17 == 0 else "abcde"[min(4, int(i**0.5) % 7)]) for i in range(900)] + [(5, "t", "a")]
    m = mixing.mix_sources(docs(spark, rows), mix=mixing.Mix(block_rows=4, resolution=50)).collect()
    assert len(m) == len(rows)
    blocks = {(r.source, r.block): r for r in m}
    slots = {r.slot: r for r in blocks.values()}
    assert len(slots) == len(blocks) and all(r.release <= r.slot < r.deadline for r in m)
    end = max((r.slot for r in m if r.in_mix), default=-1) + 1
    assert end > 20 and sorted(s for s in slots if s < end) == list(range(end))
    n = {s: sum(x == s for *_, x in rows) for *_, s in rows}
    total = sum(v**0.5 for v in n.values())
    k = {s: max(1, round(v**0.5 / total * 50)) for s, v in n.items()}
    for s in n:
        done = 0
        for t in range(end):
            done += slots[t].source == s
            assert abs(done - (t + 1) * k[s] / sum(k.values())) < 1
    given = mixing.mix_sources(docs(spark, [(i, "t", "ab"[i % 2]) for i in range(40)]), weights={"a": 3, "b": 1}, mix=mixing.Mix(block_rows=1))
    order = [r.source for r in given.where("in_mix").orderBy("slot").collect()]
    assert len(order) > 20 and all(abs(order[:t].count("a") - 0.75 * t) < 1 for t in range(1, len(order) + 1))
    assert mixing.mix_sources(docs(spark, rows).limit(0)).count() == 0


# 9


@pytest.mark.parametrize("hot", [64, 2])
def test_substring_dedup(spark, monkeypatch, hot):
    """``hot`` 2 sends every repeated window through the salted rounds."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(9)
    passage = words(rng, 70)
    rows = corpus() + [(400 + i, " ".join(words(rng, 20) + passage + words(rng, 20)), "a") for i in range(40)]
    out = substring_dedup.substring_dedup(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    low = {}
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            x = " ".join(w[k : k + 50])
            if i is not None:
                low[x] = min(low.get(x, i), i)
    for r in out:
        t = next(t for i, t, _ in rows if i == r.doc_id)
        w = WORD.findall(t or "")
        gone = {j for k in range(len(w) - 49) if r.doc_id is not None and low[" ".join(w[k : k + 50])] < r.doc_id for j in range(k, k + 50)}
        assert (r.n_words, r.n_removed, r.kept) == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    assert substring_dedup.substring_dedup(docs(spark, rows).limit(0)).count() == 0


def test_sketch_never_underestimates():
    rng = np.random.default_rng(0)
    m = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    seen = np.concatenate([m, m[:700], m[:50]])
    two = np.zeros((2, 1 << 9), np.uint8)
    for r in range(2):
        cell, n = np.unique(substring_dedup._cells(seen, r, 12), return_counts=True)
        bits = np.zeros(1 << 12, bool)
        bits[cell[n > 1].astype(int)] = True
        two[r] = np.packbits(bits, bitorder="little")
    assert substring_dedup._in(two, m[:700], 12).all()


def test_windows_hash_by_content():
    w = [b"a", b"b", b"c", b"d"] * 40
    h = substring_dedup.rolling(substring_dedup.word_hashes(w), 50)
    assert len(h) == 111 and len(set(h.tolist())) == 4 and h[0] == h[4]
    m = substring_dedup.minimizers(substring_dedup.word_hashes(w))
    assert len(m) == 111


# helpers and the catalogue


def test_ranked(spark):
    d = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    r = common.ranked(d, ["v"], "rank", ["k"]).collect()
    for k in (None, 1, 2):
        mine = sorted((x.v, x.rank) for x in r if x.k == k)
        assert [x for _, x in mine] == list(range(len(mine)))


def test_native_operators_run_no_python(spark):
    """Operators 2, 6 and 8 plan no Python node."""
    d = docs(spark, corpus())
    plans = [quality_rules.rule_failures(quality_rules.document_rules(d)), mixing.cycle(mixing.units(d.groupBy("source").agg(F.count("*").alias("n")))), licenses.scan_licenses(d, "doc_id", "source"), mixing.mix_sources(d), quality_rules.op2_host_quality(spark, "/root/testdata/sf0.001")]
    for p in plans:
        assert not re.search("Python|Pandas|Arrow|MapIn", p._jdf.queryExecution().executedPlan().toString())


def test_catalogue():
    n = [int(re.match(r"op(\d+)_", k)[1]) for k in catalogue.queries()]
    assert sorted(n) == list(range(1, 11)) and set(catalogue.oracles()) <= set(catalogue.queries())
