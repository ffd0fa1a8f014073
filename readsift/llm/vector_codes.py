"""Product codes of vectors with integer codebooks (operator 12).

Vectors become integers (floor of 256 times each component) and are cut into ``PARTS`` equal parts.
Each part position has a codebook of at most ``ENTRIES`` entries, refined in ``ROUNDS`` rounds of
assignment and component means, all in integers, so the result is the same for any partitioning.

Assignment. The squared distance of a part and an entry is bounded from below by segment means: with
the part cut into equal segments, (difference of sums)^2 / length summed over the segments, plus the
squared difference of the residual norms (what is left of each vector after its segment means). One
segment first, then two, four, ...: at each level the entry with the smallest bound gets its exact
distance, and entries whose bound exceeds the best exact distance so far are dropped. Bounds are
lowered by more than their rounding, so no nearest entry is lost; survivors get exact integer
distances, ties go to the lower index.

A round is one pass over the vectors; what leaves a task is one sum for each entry it has used
(``PARTS`` x ``ENTRIES`` at most, whatever the input), and the driver holds only the codebooks. Errors
per label are summed before they are joined back, and labels with many rows are broadcast.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are left out,
and so are those of another length than the vector of the smallest kept vec_id (or, without any id, the
smallest such vector); if that length is no multiple of ``PARTS``, parts differ in length by one at
most. Components beyond +-2^k count as that, with the largest k for which all squared distances fit in
64 bits (2^27 for up to 64 components); a label's sum that does not fit is null. Rows with a null vec_id
are coded but give no entry; of rows that repeat a vec_id the smaller vector comes first. Fewer kept
ids than entries give fewer entries. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, even_lookup, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors of one numpy batch.
BATCH = 2048


def cuts(width: int, parts: int) -> list[int]:
    """Edges of ``parts`` runs of ``width`` components, equal ones where that is possible."""
    return [width * i // parts for i in range(parts + 1)]


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as integers, within the range in which squared distances fit in 64 bits."""
    limit = 2.0 ** ((60 - max(0, int(x.shape[1] - 1).bit_length())) // 2)
    return np.clip(np.floor(x.astype(np.float64) * 256), -limit, limit).astype(np.int64)


def segments(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums / sqrt(length) of n segments, residual norms, squared norms) of the rows of x."""
    edge = cuts(x.shape[1], n)
    s = np.stack([x[:, a:b].sum(1) / np.sqrt(b - a) for a, b in zip(edge, edge[1:])], 1)
    sq = (x.astype(np.float64) ** 2).sum(1)
    return s, np.sqrt(np.maximum(sq - (s**2).sum(1), 0)), sq


def slack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """More than the rounding of a bound between vectors of squared norms a and b."""
    return 1e-9 * (a + b) + 1e-6


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x the index of the nearest entry and its squared distance; and how many exact distances that took."""
    n, e, d = len(x), len(book), x.shape[1]
    exact = lambda i, j: ((x[i] - book[j]) ** 2).sum(1)
    best = np.full(n, np.iinfo(np.int64).max)
    rows, cols = np.repeat(np.arange(n), e), np.tile(np.arange(e), n)
    level, made = 1, 0
    while level < d or level == 1:
        (sx, rx, qx), (sb, rb, qb) = segments(x, level), segments(book, level)
        if level == 1:  # all pairs of a batch and the codebook
            bound = ((sx[:, None, 0] - sb[None, :, 0]) ** 2 + (rx[:, None] - rb[None, :]) ** 2 - slack(qx[:, None], qb[None, :])).ravel()
        else:
            bound = ((sx[rows] - sb[cols]) ** 2).sum(1) + (rx[rows] - rb[cols]) ** 2 - slack(qx[rows], qb[cols])
        # Every row keeps its nearest entry, so no run of a row is empty.
        start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        least = np.repeat(np.minimum.reduceat(bound, start), np.diff(np.r_[start, len(rows)]))
        at = np.flatnonzero(bound == least)
        at = at[np.r_[True, rows[at][1:] != rows[at][:-1]]]
        best[rows[at]] = np.minimum(best[rows[at]], exact(rows[at], cols[at]))
        made += len(at)
        on = bound <= best[rows]
        rows, cols = rows[on], cols[on]
        level *= 2
    dist = exact(rows, cols)
    made += len(rows)
    start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    best = np.minimum.reduceat(dist, start)
    first = np.minimum.reduceat(np.where(dist == np.repeat(best, np.diff(np.r_[start, len(rows)])), cols, e), start)
    return first, best, made


def assigned(x: np.ndarray, books: list[np.ndarray], edge: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's parts."""
    found = [nearest(x[:, a:b], book)[:2] for (a, b), book in zip(zip(edge, edge[1:]), books)]
    return np.stack([f for f, _ in found], 1), np.stack([d for _, d in found], 1)


def _vectors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            part = b.slice(at, BATCH)
            v = part.column(part.num_columns - 1)
            yield part, whole_numbers(v.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width))


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows whose vector is whole and finite."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.select("vec_id", "label", v.alias("v")).where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def _sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], edge: list[int]) -> Iterator[pa.RecordBatch]:
    """A task's sum and count for each entry it has used."""
    total = [np.zeros_like(b) for b in books]
    count = [np.zeros(len(b), np.int64) for b in books]
    for _, x in _vectors(batches, edge[-1]):
        at = assigned(x, books, edge)[0]
        for p, (a, b) in enumerate(zip(edge, edge[1:])):
            np.add.at(total[p], at[:, p], x[:, a:b])
            count[p] += np.bincount(at[:, p], minlength=len(count[p]))
    used = [(p, e) for p, c in enumerate(count) for e in np.flatnonzero(c)]
    if used:
        cols = [pa.array([p for p, _ in used], pa.int32()), pa.array([int(e) for _, e in used], pa.int32()), pa.array([int(count[p][e]) for p, e in used]), pa.array([total[p][e].tolist() for p, e in used], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["part", "entry", "n", "s"])


def refined(d: DataFrame, books: list[np.ndarray], edge: list[int]) -> list[np.ndarray]:
    """The codebooks after one round; unused entries stay."""
    sums = d.select("v").mapInArrow(lambda it: _sums(it, books, edge), "part int, entry int, n long, s array<long>")
    each = sums.select("part", "entry", "n", F.posexplode("s").alias("i", "x")).groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = [b.copy() for b in books]
    for r in each.collect():  # at most entries x components
        out[r.part][r.entry, r.i] = r.x // r.n
    return out


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every kept row, code being a list of entry indexes; and the codebooks."""
    d = kept(vectors)
    first = d.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    width = len(first[0].v) if first else 0
    if not width:
        return d.limit(0).select("vec_id", "label", F.array().cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error")), []
    d = d.where(F.size("v") == width)
    edge = cuts(width, parts)
    seeds = d.where("vec_id is not null").orderBy("vec_id", "v").limit(entries).collect() or first
    start = whole_numbers(np.array([r.v for r in seeds]))
    books = [start[:, a:b] for a, b in zip(edge, edge[1:])]
    for _ in range(rounds):
        books = refined(d, books, edge)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _vectors(batches, width):
            at, dist = assigned(x, books, edge)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(dist.sum(1))], ["vec_id", "label", "code", "error"])

    schema = d.select("vec_id", "label", F.array().cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error")).schema
    return d.mapInArrow(codes, schema), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = encode(table(spark, sf_dir, "embeddings"))
    text = ",".join(str(v) for b in books for v in b.ravel().tolist())
    code = F.lower(F.array_join(F.transform("code", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    d = cut(found.withColumn("code", code), "codes")
    sums = d.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    return even_lookup(d, sums, "label").select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def _assign(name: str, book: str) -> str:
    return f"""
{name} AS (
  SELECT row, part, arg_min(entry, 64 * d + entry) AS entry, min(d) AS dist
  FROM (SELECT x.row, x.part, b.entry, sum((x.x - b.x) * (x.x - b.x)) AS d FROM x JOIN {book} b ON b.part = x.part AND b.i = x.i GROUP BY 1, 2, 3)
  GROUP BY 1, 2)"""


def _refine(name: str, book: str, at: str) -> str:
    return f"""
{name} AS (
  SELECT b.part, b.entry, b.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, b.x) AS x
  FROM {book} b LEFT JOIN (SELECT a.part, a.entry, x.i, sum(x.x) AS s, count(*) AS n FROM {at} a JOIN x ON x.row = a.row AND x.part = a.part GROUP BY 1, 2, 3) m USING (part, entry, i))"""


_SQL = f"""
WITH keep AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS (
  SELECT row, (k * 16) // n AS part, k % (n // 16) AS i, floor(256 * embedding[k + 1]::DOUBLE)::BIGINT AS x
  FROM (SELECT row, embedding, len(embedding) AS n, unnest(range(len(embedding))) AS k FROM keep)),
b0 AS (SELECT part, row AS entry, i, x FROM x WHERE row < 64),
{_assign("a0", "b0")}, {_refine("b1", "b0", "a0")}, {_assign("a1", "b1")}, {_refine("b2", "b1", "a1")}, {_assign("a2", "b2")},
hash AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM b2),
coded AS (SELECT row, string_agg(lpad(lower(printf('%x', entry)), 2, '0'), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a2 GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN keep USING (row), hash
"""

QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES = {"op12_vector_codes": _SQL}
