"""Removal of repeated 50-word windows behind a count-min prefilter (operator 9).

A word goes if a window that covers it also starts in a document with a smaller id. Three passes
over whole texts, none of which gathers windows that occur once:

1. Sketch. Every window is represented by its minimizer, the smallest hash of the 26 runs of 25
   words inside it; equal windows have equal minimizers, so a window's count never exceeds its
   minimizer's. Each partition counts its documents' distinct minimizers in a count-min sketch and
   sends the touched cells; blocks of cells are merged by key and only their two bitmaps (count at
   least 2, count at least ``HOT``) reach the driver, which broadcasts them. The sketch's width
   follows the corpus up to ``MAX_BITS`` (128 MB broadcast); past that it overestimates more, the
   second pass groups more, and nothing is lost.
2. Exact grouping, only of windows estimated to repeat. Windows are keyed by 128 bits, sorted by
   (key, doc_id) and streamed: the first row of a key is its smallest document, every other
   document's row is a removal. Windows estimated hot are dealt by (key, salt) first and only the
   smallest document of each salt goes on to a second round, so a passage that a third of all
   documents share is spread over tasks.
3. Removal. Starts are gathered by document and joined to the texts.

Defined results: a null text has no words; a null doc_id neither removes nor loses words; rows
that repeat a doc_id do not remove each other's words; texts under 50 words are kept whole; an
empty table gives an empty result; columns beside id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import cut, table

WINDOW = 50
GRAM = 25
#: Minimizers with this estimated count or more are dealt by salt.
HOT = 64
SALTS = 64
ROWS = 2
BLOCK = 16  # bits of a cell's place within its block
MIN_BITS, MAX_BITS = 20, 28
#: Cells for each expected minimizer; a text has about one minimizer in 78 bytes.
CELLS = 8
BYTES_PER_MINIMIZER = 78

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MULT = (_U(0x9FB21C651E98DF25), _U(0xA0761D6478BD642F))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^k and base^-k mod 2^64 for k up to n."""
    got = _powers.get(base)
    if got is None or len(got[0]) <= n:
        size = 1 << max(15, int(n).bit_length())
        run = lambda b: np.multiply.accumulate(np.r_[_U(1), np.full(size, b, np.uint64)])
        got = run(base), run(pow(base, -1, 1 << 64))
        if size <= 1 << 20:
            _powers[base] = got
    return got


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(h: np.ndarray, size: int, base: int = _BASES[0]) -> np.ndarray:
    """A hash of every run of ``size`` words, by differences of one prefix sum."""
    if len(h) < size:
        return np.empty(0, np.uint64)
    up, down = _power(base, len(h))
    p = np.r_[_U(0), np.cumsum(h * up[: len(h)], dtype=np.uint64)]
    n = len(h) - size + 1
    return _mix((p[size:] - p[:-size]) * down[:n])


def minimizers(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The minimizer of every window."""
    g = rolling(h, gram)
    span, done = window - gram + 1, 1
    while done * 2 <= span:
        g, done = np.minimum(g[:-done], g[done:]), done * 2
    rest = span - done
    return np.minimum(g[:-rest], g[rest:]) if rest else g


def _cells(m: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (m * _MULT[row]) >> _U(64 - bits)


def _sketch(bits: int):
    def parts(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        m = np.concatenate(found)
        for row in range(ROWS):
            cell, n = np.unique(_cells(m, row, bits), return_counts=True)
            block = (cell >> _U(BLOCK)).astype(np.int64)
            low, n = (cell & _U((1 << BLOCK) - 1)).astype(np.uint16), np.minimum(n, 255).astype(np.uint8)
            at = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
            for a in range(0, len(at) - 1, 4096):
                use = list(zip(at[a : a + 4096], at[a + 1 : a + 4097]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(use), pa.int32()), pa.array([int(block[x]) for x, _ in use], pa.int32()), pa.array([low[x:y].tobytes() for x, y in use], pa.binary()), pa.array([n[x:y].tobytes() for x, y in use], pa.binary())],
                    ["r", "block", "cells", "counts"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for b in batches:
            for x in b.column(0):
                w = (x.as_py() or b"").split()
                if len(w) < WINDOW:
                    continue
                m = minimizers(word_hashes(w))
                found.append(np.unique(m[np.r_[True, m[1:] != m[:-1]]]))
                n += len(found[-1])
            if n > 1 << 21:
                yield from parts(found)
                found, n = [], 0
        if n:
            yield from parts(found)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (r, block); counts saturate at 255."""
    key, total = None, None

    def out() -> pa.RecordBatch:
        two, hot = (np.packbits(total >= k, bitorder="little").tobytes() for k in (2, HOT))
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([two], pa.binary()), pa.array([hot], pa.binary())], ["r", "block", "two", "hot"])

    for b in batches:
        for r, block, cells, counts in zip(*(c.to_pylist() for c in b.columns)):
            if (r, block) != key:
                if key:
                    yield out()
                key, total = (r, block), np.zeros(1 << BLOCK, np.uint16)
            c = np.frombuffer(cells, np.uint16)
            total[c] = np.minimum(total[c] + np.frombuffer(counts, np.uint8), 255)
    if key:
        yield out()


def sketch(docs: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (row, byte) of the cells counted twice or more and ``HOT`` times or more."""
    local = docs.select(F.col("text").cast("binary").alias("b")).mapInArrow(_sketch(bits), "r int, block int, cells binary, counts binary")
    merged = local.repartition("r", "block").sortWithinPartitions("r", "block").mapInArrow(_merge, "r int, block int, two binary, hot binary")
    two, hot = (np.zeros((ROWS, 1 << bits - 3), np.uint8) for _ in range(2))
    step = 1 << BLOCK - 3
    for x in merged.toLocalIterator():
        two[x.r, x.block * step : (x.block + 1) * step] = np.frombuffer(x.two, np.uint8)
        hot[x.r, x.block * step : (x.block + 1) * step] = np.frombuffer(x.hot, np.uint8)
    return two, hot


def _in(bitmap: np.ndarray, m: np.ndarray, bits: int) -> np.ndarray:
    """Whether every row of the sketch has the cell of ``m`` set."""
    found = np.ones(len(m), bool)
    for row in range(ROWS):
        c = _cells(m, row, bits)
        found &= (bitmap[row][(c >> _U(3)).astype(np.int64)] >> (c & _U(7)).astype(np.uint8) & 1).astype(bool)
    return found


WINDOWS = "h1 long, h2 long, salt int, doc_id long, ver int, pos int"
_NAMES = ["h1", "h2", "salt", "doc_id", "ver", "pos"]


def _candidates(maps, bits: int):
    """Windows estimated to repeat, of (doc_id, ver, bytes) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, hot = maps.value
        for b in batches:
            held: list[tuple] = []
            size = 0
            for d, v, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                w = (x.as_py() or b"").split()
                if len(w) < WINDOW:
                    continue
                h = word_hashes(w)
                m = minimizers(h)
                at = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
                run_of = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(m)]))
                ok = _in(two, m[at], bits)
                if not ok.any():
                    continue
                pos = np.flatnonzero(ok[run_of])
                salt = np.where(_in(hot, m[at], bits), 1 + xxh3_64_intdigest(str(d)) % SALTS, 0).astype(np.int32)[run_of][pos]
                held.append((rolling(h, WINDOW)[pos], rolling(h, WINDOW, _BASES[1])[pos], salt, np.full(len(pos), d), np.full(len(pos), v, np.int32), pos.astype(np.int32)))
                size += len(pos)
                if size > 1 << 18:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    return run


def _batch(held: list[tuple]) -> pa.RecordBatch:
    c = [np.concatenate(x) for x in zip(*held)]
    return pa.RecordBatch.from_arrays([pa.array(c[0].view(np.int64)), pa.array(c[1].view(np.int64)), *map(pa.array, c[2:])], _NAMES)


def _first_keeps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, salt, doc_id): drop a cold key's smallest document, pass on a hot one's.

    What is left with salt 0 is to be removed; with another salt it must meet the other salts.
    """
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, salt, doc = (b.column(k).to_numpy() for k in range(4))
        same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]) & (salt[1:] == salt[:-1])
        carried = last is not None and last[:3] == (h1[0], h2[0], salt[0])
        start = np.flatnonzero(np.r_[True, ~same])
        low = doc[start].copy()
        if carried:
            low[0] = last[3]
        least = np.repeat(low, np.diff(np.r_[start, len(doc)]))
        last = (h1[-1], h2[-1], salt[-1], least[-1])
        first = doc == least
        flag = np.where(first, salt, 0).astype(np.int32)
        keep = ~(first & (salt == 0))
        cold = flag == 0  # settled: the key is of no more use, and random bytes do not compress
        t = b.set_column(0, "h1", pa.array(np.where(cold, 0, h1))).set_column(1, "h2", pa.array(np.where(cold, 0, h2)))
        t = t.set_column(2, "salt", pa.array(flag)).filter(pa.array(keep))
        if t.num_rows:
            yield t


def _stream(rows: DataFrame) -> DataFrame:
    return rows.repartition("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", "doc_id").mapInArrow(_first_keeps, WINDOWS)


def removals(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """(doc_id, ver, starts) of documents that lose words; ``docs`` has doc_id, ver, text."""
    spark = docs.sparkSession
    if bits is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MAX_BITS, max(MIN_BITS, int(size / BYTES_PER_MINIMIZER * CELLS).bit_length()))
    maps = spark.sparkContext.broadcast(sketch(docs, bits))
    found = docs.where("doc_id is not null").select("doc_id", "ver", F.col("text").cast("binary").alias("b"))
    once = cut(_stream(found.mapInArrow(_candidates(maps, bits), WINDOWS)), "windows")
    again = _stream(once.where("salt <> 0").withColumn("salt", F.lit(0)))
    gone = once.where("salt = 0").union(again)
    return gone.groupBy("doc_id", "ver").agg(F.collect_list("pos").alias("starts"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, gone, kept = [], [], []
        for x, starts in zip(b.column(1), b.column(2)):
            w = (x.as_py() or b"").split()
            n.append(len(w))
            s = starts.values if starts.is_valid else None
            if s is None or not len(s):
                gone.append(0)
            else:
                edge = np.zeros(len(w) + 1, np.int64)
                p = np.unique(s.to_numpy())
                np.add.at(edge, p, 1)
                np.add.at(edge, p + WINDOW, -1)
                keep = np.cumsum(edge[:-1]) == 0
                gone.append(int((~keep).sum()))
                w = [x for x, k in zip(w, keep.tolist()) if k]
            kept.append(b" ".join(w))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words joined by one space) for every row."""
    d = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("ver", (F.crc32(F.coalesce("text", F.lit(""))) - F.lit(1 << 31)).cast("int"))
    gone = removals(d, bits)
    with_starts = d.join(gone, ["doc_id", "ver"], "left").select("doc_id", F.col("text").cast("binary").alias("b"), "starts")
    out = with_starts.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i+49], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS low FROM win) WHERE low < doc_id),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM gone),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n
  FROM words ANTI JOIN cov USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLES = {"op9_substring_dedup": _SQL}
