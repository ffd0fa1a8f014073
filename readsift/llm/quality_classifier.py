"""Quality by Bradley-Terry pairwise ranking (operator 3).

Preference pairs set a text labelled good against one labelled bad. A linear score is learned by
logistic loss on the difference of the pair's features, P(a preferred to b) = s(w (a - b)). The
features are not picked for any kind of junk: the shares of all trigrams of character classes in the
text, four measures of repetition, and the shares of words by length, square roots of each so that
rare ones count. Which of them mark good texts is learned.

The threshold is a quantile of the scores of all documents: near the labelled share of bad texts, the
level where the fewest documents lie, so that it falls between the two kinds of texts. Scores are
shifted so that the threshold is 0.7.

``SAMPLE`` bounds the labelled texts of each kind that the weights are fitted on; features come
from whole texts and the quantile from all documents (a histogram of ``BINS`` bins, the outer ones
open). labels, lang, source and doc_id are no inputs.

Defined results: null, empty and wordless texts have zero features; without labels of both kinds
every score is 0.5; a null id is scored and not held out; repeated rows are scored each, and a
labelled id that repeats is learned from once; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table
from .folds import bounded_sample, fold, training_labels

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
SPAN, BINS = 20.0, 4000
#: Characters of each class (fixed values); other ASCII is one class more, and other bytes another.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\v\f\r", b"\n", b".,;:", b"!?", b"\"'`()[]{}-_", b"#*$%&|<>@+=~^/\\")
KINDS = len(CLASSES) + 2
_CLASS_OF = np.full(256, KINDS - 1, np.uint8)
_CLASS_OF[:128] = KINDS - 2
for _k, _c in enumerate(CLASSES):
    _CLASS_OF[np.frombuffer(_c, np.uint8)] = _k
LENGTHS = 16
WIDTH = KINDS**3 + 4 + LENGTHS
#: Bytes of a very long text that are counted at a time.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Sample:
    each: int = 5000
    pairs: int = 50_000


SAMPLE = Sample()


def features(data: bytes | None) -> np.ndarray:
    """Square roots of shares between 0 and 1, so that the length of the text does not matter."""
    out = np.zeros(WIDTH, np.float32)
    w = (data or b"").split()
    if not w:
        return out
    kind = _CLASS_OF[np.frombuffer(data, np.uint8)].astype(np.int32)
    gram = np.zeros(KINDS**3, np.int64)
    for at in range(0, len(kind), CHUNK):
        k = kind[max(0, at - 2) : at + CHUNK]
        gram += np.bincount((k[:-2] * KINDS + k[1:-1]) * KINDS + k[2:], minlength=KINDS**3)
    n = len(w)
    seen = Counter(w)
    lines = [x for x in data.split(b"\n") if x.strip()]
    again = [1 - len(seen) / n, 1 - len(set(zip(w, w[1:]))) / max(1, n - 1), (max(seen.values()) - 1) / n, 1 - len(set(lines)) / len(lines)]
    sizes = np.bincount(np.minimum([len(x) for x in w], LENGTHS) - 1, minlength=LENGTHS)
    out[: KINDS**3], out[KINDS**3 : -LENGTHS], out[-LENGTHS:] = gram / max(1, len(kind) - 2), again, sizes / n
    return np.sqrt(np.maximum(out, 0))


def _matrix(texts) -> np.ndarray:
    return np.array([features(t.as_py()) for t in texts], np.float32).reshape(-1, WIDTH)


def fit(good: np.ndarray, bad: np.ndarray, pairs: int = SAMPLE.pairs, seed: int = 5, epochs: int = 8, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and scale of the features, by Adam on random preference pairs."""
    spread = np.concatenate([good, bad]).std(axis=0)
    on = np.flatnonzero(spread > 0)  # what never varies has no weight
    w, scale = np.zeros(good.shape[1], np.float32), (spread + 1e-2).astype(np.float32)  # nor is what hardly varies blown up
    good, bad = good[:, on] / scale[on], bad[:, on] / scale[on]
    rng = np.random.default_rng(seed)
    u = np.zeros(len(on), np.float32)
    m, v, t = np.zeros_like(u), np.zeros_like(u), 0
    for _ in range(epochs):
        i, j = rng.integers(0, len(good), pairs), rng.integers(0, len(bad), pairs)
        for at in range(0, pairs, 2000):
            d = good[i[at : at + 2000]] - bad[j[at : at + 2000]]
            lose = 0.5 * (1 - np.tanh(0.5 * (d @ u)))
            g = -(lose @ d) / len(d) + decay * u
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            u -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    w[on] = u
    return w, scale


@dataclass
class Model:
    w: np.ndarray
    scale: np.ndarray
    centre: float
    bad_share: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ (self.w / self.scale) - self.centre


def train(docs: DataFrame, labels: DataFrame, s: Sample = SAMPLE, id: str = "doc_id", text: str = "text") -> Model | None:
    y = training_labels(labels, "quality", FOLDS, HELD_OUT)
    n, good = y.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n or not good or good == n:
        return None
    chosen = bounded_sample(y.where("y = 1"), s.each, 1).union(bounded_sample(y.where("y = 0"), s.each, 2))
    d = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("binary").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 2)):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in _matrix(b.column(2))], pa.binary())], ["doc_id", "y", "x"])

    # At most twice ``each`` rows: of rows that repeat an id the first text counts.
    sample = d.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("b").alias("b"))
    got = sample.mapInArrow(run, "doc_id long, y int, x binary").toPandas().sort_values("doc_id")
    if got["y"].nunique() < 2:
        return None
    x, is_good = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, WIDTH), got["y"].to_numpy() == 1
    w, scale = fit(x[is_good], x[~is_good], s.pairs)
    z = x @ (w / scale)
    return Model(w, scale, float(np.median(z[is_good]) + np.median(z[~is_good])) / 2, 1 - good / n)


def quantile_level(counts: np.ndarray, bad_share: float, reach: float = 2.0, smooth: int = 25) -> tuple[float, int]:
    """(level, bin) of the threshold for a histogram of all scores.

    Among bins whose cumulative share is within a factor ``reach`` of ``bad_share``, the middle of
    the emptiest stretch; bins outside leave the quantile at ``bad_share``.
    """
    total = counts.sum()
    share = np.r_[0, np.cumsum(counts)] / max(1, total)
    dense = np.convolve(counts, np.ones(smooth), "same")
    fits = np.flatnonzero((share[:-1] >= bad_share / reach) & (share[:-1] <= min(0.95, bad_share * reach)))
    if not len(fits):
        at = int(np.searchsorted(share, bad_share))
        return bad_share, min(at, len(counts) - 1)
    low = fits[dense[fits] == dense[fits].min()]
    at = int(low[len(low) // 2])
    return float(share[at]), at


def score(docs: DataFrame, model: Model | None, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every row and ``__score``; the texts are read once."""
    if model is None:
        return docs.select(*columns, F.lit(0.5).alias("__score"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*columns, F.lit(0.0).alias("__raw")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, whole.num_columns - 1)):
            z = held.value.raw(_matrix(b.column(b.num_columns - 1))).astype(float)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(z)], schema.fieldNames())

    raw = cut(docs.select(*columns, F.col(text).cast("binary").alias("__text")).mapInArrow(run, schema), "scores")
    bin_ = F.least(F.greatest(F.floor((F.col("__raw") + SPAN) * (BINS / (2 * SPAN))), F.lit(0)), F.lit(BINS - 1))
    counts = np.zeros(BINS, np.int64)
    for r in raw.groupBy(bin_.alias("k")).count().collect():  # BINS rows at most
        counts[r.k] = r["count"]
    _, at = quantile_level(counts, model.bad_share)
    edge = at * (2 * SPAN / BINS) - SPAN
    shift = float(np.log(THRESHOLD / (1 - THRESHOLD))) - edge
    return raw.select(*columns, (1 / (1 + F.exp(-(F.col("__raw") + F.lit(shift))))).alias("__score"))


def op3_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select(
        "doc_id",
        F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op3_bradley_terry_quality": op3_bradley_terry_quality}
ORACLES: dict[str, str] = {}
