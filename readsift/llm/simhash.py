"""SimHash near-duplicates by bit-sliced comparison (operator 4).

A fingerprint has a bit set if over half of a document's 3-word shingles have it set in their
XXH64 (seed 42). Fingerprints at ``radius`` or fewer differing bits are linked; components of the
links are the groups.

Candidates: the 64 bits are cut into ``radius + 2`` bands. Two linked fingerprints agree on at
least two bands, so each is filed once under every pair of bands; no link is missed. Distinct
fingerprints are filed, so exact copies cost one entry however many there are. Buckets above
``block`` entries are dealt as pairs of chunks, each pair a bounded block of its own.

Inside a block the fingerprints are stored as 64 vertical bit planes, 64 entries a machine word.
One query word-op updates 64 distances: planes are added two at a time by carry-save adders into
a counter that overflows past the radius, and words whose 64 lanes have all overflowed leave the
computation. A block returns a spanning forest of its links, never all pairs.

Defined results: null and wordless texts have fingerprint zero and are linked like any other; rows
with a null id get a fingerprint and their fingerprint's component but link nothing themselves;
repeated rows are returned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut, skewed_lookup, table
from .components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Entries of one comparison block; a bucket above it is dealt as pairs of chunks of half this size.
BLOCK = 8192


def fingerprint(data: bytes | None, k: int = SHINGLE) -> int:
    """The 64-bit fingerprint of UTF-8 bytes."""
    w = (data or b"").lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(k)))) if len(w) >= k else iter((b" ".join(w),))
    n = max(1, len(w) - k + 1)
    h = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) for every row, whole texts."""
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("b")).mapInArrow(_fingerprints, "doc_id long, fp long")


def bit_sliced_links(fp: np.ndarray, end: np.ndarray, radius: int = RADIUS, chunk: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j < end[i], whose fingerprints differ in at most ``radius`` bits.

    ``end[i]`` is the end of the group that row i belongs to; groups are runs of rows.
    """
    n = len(fp)
    words = -(-n // 64)
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)
    del bits
    width = max(1, int(radius).bit_length())
    start = (1 << width) - 1 - radius  # the counter overflows at radius + 1
    rows = np.flatnonzero(end > np.arange(n) + 1)
    first, last = (rows + 1) >> 6, (end[rows] - 1) >> 6
    load = np.cumsum(last - first + 1)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + chunk, "right")))
        r, f, m = rows[at:to], first[at:to], (last - first + 1)[at:to]
        q = np.repeat(r, m)
        w = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(f, m)
        lo = np.clip(q + 1 - (w << 6), 0, 63).astype(np.uint64)
        hi = np.clip(end[q] - (w << 6), 1, 64).astype(np.uint64)
        alive = (full << lo) & (full >> (np.uint64(64) - hi))
        count = [np.full(len(q), full if start >> b & 1 else 0, np.uint64) for b in range(width)]
        x = fp[q]
        for b in range(0, 64, 2):
            d0 = planes[b][w] ^ (np.uint64(0) - ((x >> np.uint64(b)) & np.uint64(1)))
            d1 = planes[b + 1][w] ^ (np.uint64(0) - ((x >> np.uint64(b + 1)) & np.uint64(1)))
            u = d0 ^ d1
            carry = (d0 & d1) | (u & count[0])
            count[0] = count[0] ^ u
            for c in range(1, width):
                count[c], carry = count[c] ^ carry, count[c] & carry
            alive &= ~carry
            if b % 8 == 6:
                keep = np.flatnonzero(alive)
                if len(keep) < 0.75 * len(alive):
                    q, w, x, alive = q[keep], w[keep], x[keep], alive[keep]
                    count = [c[keep] for c in count]
                    if not len(q):
                        break
        if len(q):
            lane = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            t, k = np.nonzero(lane)
            if len(t):
                yield q[t], (w[t] << 6) + k
        at = to


def hook(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union by smallest root, in place, for many pairs at once."""
    while True:
        a, b = parent[i], parent[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _scan(radius: int):
    def forest(g: np.ndarray, fp: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(g[1:] != g[:-1]) + 1
        bound = np.r_[0, edge, len(g)]
        end = np.repeat(bound[1:], np.diff(bound))
        parent = np.arange(len(g))
        for i, j in bit_sliced_links(fp.view(np.uint64), end, radius):
            hook(parent, i, j)
        tied = np.flatnonzero(parent != np.arange(len(g)))
        return pa.RecordBatch.from_arrays([pa.array(v[tied]), pa.array(v[parent[tied]])], ["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group's rows may span batches."""
        held: list[list[np.ndarray]] = []
        n = 0
        for b in batches:
            held.append([b.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
            n += b.num_rows
            if n < 1 << 17:
                continue
            g, fp, v = (np.concatenate(x) for x in zip(*held))
            cut_ = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if cut_:
                yield forest(g[:cut_], fp[:cut_], v[:cut_])
            held, n = [[g[cut_:], fp[cut_:], v[cut_:]]], len(g) - cut_
        if n:
            yield forest(*(np.concatenate(x) for x in zip(*held)))

    return scan


def bands(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 2 bands that cover 64 bits."""
    edge = [round(64 * k / (radius + 2)) for k in range(radius + 3)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Spanning links (a, b) between the vertices of ``distinct`` (v, fp), fp unique."""
    part = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in bands(radius)]
    keys = F.array(*[F.xxhash64(F.lit(t), part[i], part[j]) for t, (i, j) in enumerate(combinations(range(radius + 2), 2))])
    filed = distinct.select("v", "fp", F.explode(keys).alias("k"))
    hot = filed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).withColumn("c", F.ceil(F.col("n") * 2 / block).cast("int"))
    dealt = filed.join(hot.select("k", "c"), "k", "left").withColumn("x", F.when(F.col("c").isNotNull(), F.pmod(F.xxhash64("fp", F.lit(7)), "c")))
    other = F.when(F.col("c").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("c") - 1))
    pairs = dealt.withColumn("y", F.explode(other))
    g = F.when(F.col("c").isNull(), F.col("k")).otherwise(F.xxhash64("k", F.least("x", "y"), F.greatest("x", "y")))
    # A clash of two groups' hashes only adds comparisons: links are decided on the fingerprints.
    blocks = pairs.select(g.alias("g"), "fp", "v").repartition("g").sortWithinPartitions("g", "v")
    return blocks.mapInArrow(_scan(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """doc_id, fp (long), component_id for every row; component_id is the smallest id reachable."""
    f = cut(fingerprints(docs, id, text), "fp")
    distinct = cut(f.groupBy("fp").agg(F.min("doc_id").alias("v"), F.count(F.lit(1)).alias("n")), "distinct")
    comp = connected_components(links(distinct.where("v is not null"), radius, block))
    of = distinct.join(comp, distinct["v"] == comp["id"], "left").select("fp", "n", F.coalesce("component", "v").alias("component_id"))
    rows = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return skewed_lookup(f, of, "fp", "n", rows).select("doc_id", "fp", "component_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash_near_dedup": op4_simhash_near_dedup}
ORACLES: dict[str, str] = {}
