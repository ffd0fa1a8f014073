"""Near copies by SimHash with an exact check (operator 4 at a Jaccard similarity; the pipeline's near-copy stage).

Texts are linked if the sets of their 5-word shingles have a Jaccard similarity of 0.8 or more; a
text of fewer words is one shingle. Components of the links are the groups. Words are those of the
SimHash operator; shingles are told apart by 64 bits of XXH64, equal texts by 128 bits of BLAKE2b.

Blocks. At this similarity fingerprints of 64 bits differ in some 10 bits, too many for bands of
them to find all pairs, so blocks come from shingles: texts this similar share a shingle among the
first n - ceil(0.8 n) + 1 of each, in any order that is the same for all texts. The order is by the
number of texts that hold a shingle, so unlike texts mostly share none; counts come from all rows,
packed by batch, with 32 bits and the part for a shingle (a clash only adds comparisons). Texts that
are joined by shared first shingles, directly or over others, make a loose group; those above
``block`` texts or ``load`` shingles are dealt as pairs of chunks.

Comparison. A block's fingerprints are compared by the bit-sliced scan of the SimHash operator;
pairs within ``RADIUS`` bits are linked if their sets are similar enough, which is decided exactly.
Two texts at the least similarity differ in 9 to 12 bits with a deviation of 3, so the radius passes
all but one link in 10^5 or fewer at the limit and practically all above it. A block returns a
spanning forest.

Defined results: null and wordless texts are equal texts; rows with a null id are left out; rows
that share an id are one document, near whatever one of their texts is near to.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut, slices
from .components import connected_components
from .simhash import bit_sliced_links, hook

SHINGLE = 5
SEED = 42
#: The least similarity as a fraction, so that no rounding decides.
SHARE, OF = 4, 5
#: Differing bits of fingerprints up to which sets are compared.
RADIUS = 26
#: Texts and shingles of one comparison block.
BLOCK = 2048
LOAD = 2_000_000


def shingles(w: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    if not w:
        return np.empty(0, np.int64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(k)))) if len(w) >= k else iter((b" ".join(w),))
    h = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64, max(1, len(w) - k + 1))
    return np.unique(h.view(np.int64))


def words(data: bytes | None) -> list[bytes]:
    return (data or b"").lower().split()


def _packed(parts: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch's shingles by part (owner, low 32 bits), and one row of its texts (id, size, key)."""
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for at, b in enumerate(part for whole in batches for part in slices(whole, 1)):
            sets, digests = [], []
            for t in b.column(1):
                w = words(t.as_py())
                sets.append(shingles(w))
                digests.append(blake2b(b" ".join(w), digest_size=16).digest())
            n = np.array([len(h) for h in sets], np.int64)
            h = np.concatenate(sets).view(np.uint64)
            part = ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            own, low = np.repeat(np.arange(b.num_rows, dtype=np.uint32), n)[order], h.astype(np.uint32)[order]
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            on = np.flatnonzero(np.diff(edge))
            cut_ = lambda x: [x[edge[k] : edge[k + 1]].tobytes() for k in on]
            text = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), n.tobytes(), b"".join(digests)]
            bid = base + at
            yield _row_batch([bid] * (len(on) + 1), [*on.tolist(), bid % parts], [*cut_(own), text[0]], [*cut_(low), text[1]], [None] * len(on) + [text[2]])

    return pack


def _row_batch(bid, part, x, y, z) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bid, pa.int64()), pa.array(part, pa.int32()), *[pa.array(c, pa.binary()) for c in (x, y, z)]], ["bid", "part", "x", "y", "z"])


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[tuple]]:
    """Rows that are sorted by column ``by``, one list for each of its values."""
    now, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and row[by] != now:
                yield held
                held = []
            now = row[by]
            held.append(row)
    if held:
        yield held


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part the shingles that two texts or more hold, with their counts; rows of texts pass."""
    for rows in _groups(batches, 1):
        texts = [r for r in rows if r[4] is not None]
        rows = [r for r in rows if r[4] is None]
        for r in texts:
            yield _row_batch(*([c] for c in (r[0], -1, *r[2:])))
        if not rows:
            continue
        low = [np.frombuffer(r[3], np.uint32) for r in rows]
        found, count = np.unique(np.concatenate(low), return_counts=True)
        found, count = found[count > 1], count[count > 1].astype(np.uint32)
        for r, h in zip(rows, low):
            at = np.minimum(np.searchsorted(found, h), max(0, len(found) - 1))
            on = found[at] == h if len(found) else np.zeros(len(h), bool)
            if on.any():
                yield _row_batch([r[0]], [r[1]], [np.frombuffer(r[2], np.uint32)[on].tobytes()], [h[on].tobytes()], [count[at[on]].tobytes()])


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each batch with the shared shingles among their first ones."""
    for rows in _groups(batches, 0):
        (text,) = [r for r in rows if r[1] < 0]
        rows = [r for r in rows if r[1] >= 0]
        v, n = np.frombuffer(text[2], np.int64), np.frombuffer(text[3], np.int64)
        none = np.empty(0, np.uint32)
        own = np.concatenate([none, *[np.frombuffer(r[2], np.uint32) for r in rows]])
        df = np.concatenate([none, *[np.frombuffer(r[4], np.uint32) for r in rows]])
        k = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(r[3], np.uint32).astype(np.int64) | r[1] << 32 for r in rows]])
        order = np.lexsort((k, df, own))
        own, k = own[order], k[order]
        edge = np.searchsorted(own, np.arange(len(v) + 1))
        # Shingles of one text alone come first in the order and join nothing.
        room = np.where(n > 0, n + SHARE * n // -OF + 1, 0) - (n - np.diff(edge))
        first = [k[a : a + max(0, r)] for a, r in zip(edge, room)]
        key = [text[4][i : i + 16] for i in range(0, len(text[4]), 16)]
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(key, pa.binary()), pa.array(n), pa.array(first, pa.list_(pa.int64()))], ["doc_id", "key", "n", "first"])


def filed(texts: DataFrame) -> DataFrame:
    """(doc_id, key, n, first): each text's key, number of shingles, and those it is filed under."""
    packed = "bid long, part int, x binary, y binary, z binary"
    parts = max(64, texts.count() // 10_000)
    p = texts.mapInArrow(_packed(parts), packed).repartition("part").sortWithinPartitions("part")
    q = p.mapInArrow(_shared, packed).repartition("bid").sortWithinPartitions("bid")
    return q.mapInArrow(_filed, "doc_id long, key binary, n long, first array<long>")


def fingerprint(h: np.ndarray) -> int:
    """A bit is set if over half of the shingles' hashes have it set."""
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= SHARE * (len(a) + len(b) - both)


def forest(sets: list[np.ndarray], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (i, j) of the pairs of sets that are similar enough."""
    fp = np.array([fingerprint(s) for s in sets], np.uint64)
    size = np.array([len(s) for s in sets], np.int64)
    parent = np.arange(len(sets))
    a, b = [], []
    for i, j in bit_sliced_links(fp, np.full(len(sets), len(sets)), radius):
        low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        for x, y in _apart(i, j, (low > 0) & (OF * low >= SHARE * high), parent):
            if parent[x] != parent[y] and similar(sets[x], sets[y]):
                a.append(x)
                b.append(y)
                hook(parent, np.array([x]), np.array([y]))
    return np.array(a, np.int64), np.array(b, np.int64)


def _apart(i: np.ndarray, j: np.ndarray, ok: np.ndarray, parent: np.ndarray, at_once: int = 4096) -> Iterator[tuple[int, int]]:
    """The pairs that are not in one tree yet; trees grow meanwhile."""
    i, j = i[ok], j[ok]
    for at in range(0, len(i), at_once):
        x, y = i[at : at + at_once], j[at : at + at_once]
        on = parent[x] != parent[y]
        yield from zip(x[on].tolist(), y[on].tolist())


def _comparing(radius: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (g, v, text) come sorted by group; a group's rows may span batches."""

        def links(v: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            i, j = forest(sets, radius)
            of = np.array(v, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(of[i]), pa.array(of[j])], ["a", "b"])

        now, v, sets = None, [], []
        for b in batches:
            for g, x, t in zip(b.column(0), b.column(1), b.column(2)):
                if (g := g.as_py()) != now:
                    if len(v) > 1:
                        yield links(v, sets)
                    now, v, sets = g, [], []
                v.append(x.as_py())
                sets.append(shingles(words(t.as_py())))
        if len(v) > 1:
            yield links(v, sets)

    return compare


def links(texts: DataFrame, distinct: DataFrame, block: int = BLOCK, load: int = LOAD, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the ids of ``distinct`` (v, n, first), whose texts are in ``texts`` (doc_id, b)."""
    entries = distinct.select("v", F.explode("first").alias("k"))
    # A shingle's texts are joined to their smallest id: one row each, however many there are.
    hubs = entries.groupBy("k").agg(F.min("v").alias("hub"), F.max("v").alias("top")).where("hub < top")
    loose = connected_components(entries.join(hubs, "k").select(F.col("v").alias("a"), F.col("hub").alias("b")))
    n = distinct.groupBy("v").agg(F.sum("n").alias("n"))
    # Components hold all members but the smallest, which is their name.
    in_ = loose.select(F.col("id").alias("v"), "component").unionByName(loose.select(F.col("component").alias("v"), "component")).distinct()
    in_ = cut(in_.join(n, "v"), "loose")
    c = F.ceil(2 * F.greatest(F.count(F.lit(1)) / block, F.sum("n") / load)).cast("int")
    hot = in_.groupBy("component").agg(c.alias("c")).where("c > 2")
    dealt = in_.join(hot, "component", "left").withColumn("x", F.when(F.col("c").isNotNull(), F.pmod(F.xxhash64("v", F.lit(7)), "c")))
    other = F.when(F.col("c").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("c") - 1))
    pairs = dealt.withColumn("y", F.explode(other))
    g = F.when(F.col("c").isNull(), F.xxhash64("component")).otherwise(F.xxhash64("component", F.least("x", "y"), F.greatest("x", "y")))
    # A clash of two groups' hashes only adds comparisons: links are decided on the sets.
    blocks = texts.join(pairs.select(F.col("v").alias("doc_id"), g.alias("g")), "doc_id").select("g", "doc_id", "b")
    return blocks.repartition("g").sortWithinPartitions("g", "doc_id").mapInArrow(_comparing(radius), "a long, b long")


def first_ids(docs: DataFrame, block: int = BLOCK, load: int = LOAD, radius: int = RADIUS) -> DataFrame:
    """doc_id: the smallest id of each group of near copies. A ``radius`` of 64 compares the sets of every pair in a block."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("b"))
    one = filed(texts).groupBy("key").agg(F.min(F.struct("doc_id", "n", "first")).alias("x"))
    distinct = cut(one.select(F.col("x.doc_id").alias("v"), "x.n", "x.first"), "distinct")
    comp = connected_components(links(texts, distinct, block, load, radius))
    return distinct.select(F.col("v").alias("doc_id")).distinct().join(comp, F.col("doc_id") == comp["id"], "left_anti")
