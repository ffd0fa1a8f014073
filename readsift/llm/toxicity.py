"""Toxicity by non-negative positive-unlabelled learning (operator 1).

Two numpy classifiers, a linear model and a small network on the presence of words and word beginnings, are trained
from confirmed toxic examples (P) and unlabelled text (U: any documents of the training folds, labelled
or not, as nobody had looked at them). With class prior p, the risk is

    p * R_P(+) + max(0, R_U(-) - p * R_P(-))

the second term being the risk on negatives corrected for the positives among the unlabelled; where
it goes below zero the step is taken against it, which keeps the estimate non-negative. The prior is
the share of confirmed rows among all training labels.

``SAMPLE`` bounds the texts that the classifiers are fitted on (``positives`` + ``unlabelled``);
the vocabulary is chosen from the sample's document frequencies, and every text is scored whole.
Score: the mean of both classifiers' probabilities. labels, lang, source and doc_id are no inputs.

Defined results: null, empty and wordless texts get the score of a text without known words; with
no confirmed example every score is 0; a null id is scored and not held out; repeated rows are
scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .folds import bounded_sample, fold, training_labels

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Lengths of the word beginnings used as features beside whole words.
PREFIXES = (3, 4, 5, 6, 7, 8)
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Sample:
    positives: int = 4000
    unlabelled: int = 12000
    words: int = 1024
    min_docs: int = 3
    min_z: float = 4.0
    min_lift: float = 6.0


SAMPLE = Sample()


def distinct_words(text: str | None) -> set[str]:
    """The text's distinct words and, marked with ^, word beginnings, which inflected insults share."""
    if not text:
        return set()
    w = set(_WORD.findall(text.lower()))
    return w.union(*({"^" + x for x in {y[:k] for y in w if len(y) > k}} for k in PREFIXES))


def _doc_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, p, u) for each distinct word of each sampled text."""
    for b in batches:
        w, p, u = [], [], []
        for t, is_p, is_u in zip(*(c.to_pylist() for c in b.columns)):
            found = distinct_words(t)
            w += found
            p += [is_p] * len(found)
            u += [is_u] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(p, pa.int64()), pa.array(u, pa.int64())], ["word", "p", "u"])


def vocabulary(sample: DataFrame, n_p: int, n_u: int, prior: float, s: Sample = SAMPLE) -> list[str]:
    """The features most overrepresented in P against U, by a two-sample z statistic.

    Only features with ``min_z`` enter whose share in P is ``min_lift`` times their share among
    negatives, which is U's less the positives in it: (u - prior * p) / (1 - prior). So what a few
    copies of one text happen to share does not enter.
    """
    counts = sample.select("text", "p", "u").mapInArrow(_doc_words, "word string, p long, u long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    a, b = F.col("p") / n_p, F.col("u") / n_u
    pooled = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = (a - b) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u) + F.lit(1e-12))
    top = counts.where((F.col("p") + F.col("u") >= s.min_docs) & (a >= s.min_lift * (b - prior * a) / (1 - prior)) & (z >= s.min_z)).select("word", F.round(z, 9).alias("z")).orderBy(F.desc("z"), "word").limit(s.words)
    return sorted(r.word for r in top.collect())


class Features:
    def __init__(self, words: list[str]):
        self.at = {w: i for i, w in enumerate(words)}

    def of(self, text: str | None) -> list[int]:
        get = self.at.get
        return [i for i in map(get, distinct_words(text)) if i is not None]

    def matrix(self, rows: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(rows), len(self.at)), np.uint8)
        for r, cols in enumerate(rows):
            x[r, cols] = 1
        return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Network:
    """One hidden layer of ``hidden`` units; 0 is a linear model."""

    def __init__(self, n: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        if hidden:
            self.p = [rng.normal(0, 0.1, (n, hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.array([-1.0])]
        else:
            self.p = [np.zeros(n), np.array([-1.0])]
        self.p = [x.astype(np.float32) for x in self.p]
        self.m = [np.zeros_like(x) for x in self.p]
        self.v = [np.zeros_like(x) for x in self.p]
        self.t = 0

    def forward(self, x: np.ndarray) -> np.ndarray:
        if not self.hidden:
            return x @ self.p[0] + self.p[1]
        self.h = np.tanh(x @ self.p[0] + self.p[1])
        return self.h @ self.p[2] + self.p[3]

    def backward(self, x: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        """Gradients for output gradient ``g``; ``forward(x)`` must have come last."""
        if not self.hidden:
            return [x.T @ g, np.array([g.sum()])]
        back = np.outer(g, self.p[2]) * (1 - self.h**2)
        return [x.T @ back, back.sum(0), self.h.T @ g, np.array([g.sum()])]

    def step(self, grads: list[np.ndarray], rate: float, decay: float) -> None:
        """Adam with weight decay on all but the intercepts."""
        self.t += 1
        for k, (p, g) in enumerate(zip(self.p, grads)):
            g = g + decay * p * (p.size > 1)
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            p -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def nnpu_gradient(out_p: np.ndarray, out_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients of the non-negative risk in the outputs on P and U, and the negative part's value.

    Logistic loss: l(+) = log(1 + e^-z), l(-) = log(1 + e^z).
    """
    n_p, n_u = len(out_p), len(out_u)
    negative = np.logaddexp(0, out_u).mean() - prior * np.logaddexp(0, out_p).mean()
    sp, su = sigmoid(out_p), sigmoid(out_u)
    if negative < 0:  # step against the part that has gone below zero
        return prior * sp / n_p, -su / n_u, negative
    return prior * ((sp - 1) - sp) / n_p, su / n_u, negative


def fit(x_p: np.ndarray, x_u: np.ndarray, prior: float, hidden: int, seed: int, steps: int = 300, rate: float = 0.03, decay: float = 1e-5) -> Network:
    """Large batches: the negative part must go below zero for overfitting, not for a batch's noise."""
    net = Network(x_p.shape[1], hidden, seed)
    rng = np.random.default_rng(seed + 1)
    for t in range(steps):
        take = lambda x, n: (x if len(x) <= n else x[rng.choice(len(x), n, replace=False)]).astype(np.float32)
        p, u = take(x_p, 1024), take(x_u, 4096)
        x = np.concatenate([p, u])
        out = net.forward(x)
        gp, gu, _ = nnpu_gradient(out[: len(p)], out[len(p) :], prior)
        net.step(net.backward(x, np.concatenate([gp, gu]).astype(np.float32)), rate / (1 + t / 150), decay)
    return net


class Model:
    """The vocabulary and both classifiers; ``score`` is their mean probability."""

    def __init__(self, words: list[str], nets: list[Network]):
        self.features, self.nets = Features(words), nets

    def score(self, texts: list[str | None]) -> np.ndarray:
        rows = [self.features.of(t) for t in texts]
        out = np.zeros(len(rows))
        if not self.nets:
            return out
        for at in range(0, len(rows), 1024):
            x = self.features.matrix(rows[at : at + 1024]).astype(np.float32)
            out[at : at + 1024] = np.mean([sigmoid(n.forward(x)) for n in self.nets], axis=0)
        return out


def train(docs: DataFrame, labels: DataFrame, s: Sample = SAMPLE, id: str = "doc_id", text: str = "text") -> Model:
    """Fit on ``docs`` (id, text) and ``labels`` (doc_id, toxic)."""
    y = training_labels(labels, "toxic", FOLDS, HELD_OUT)
    n, n_pos = y.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n_pos:
        return Model([], [])
    p = bounded_sample(y.where("y = 1"), s.positives, 1).select("doc_id", F.lit(1).alias("p"), F.lit(0).alias("u"))
    ids = docs.select(F.col(id).alias("doc_id")).where("doc_id is not null").where(fold("doc_id", FOLDS) != HELD_OUT).distinct()
    u = bounded_sample(ids, s.unlabelled, 2).select("doc_id", F.lit(0).alias("p"), F.lit(1).alias("u"))
    chosen = p.union(u).groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    d = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    # At most positives + unlabelled rows: of rows that repeat an id the first text counts.
    sample = d.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "p", "u").agg(F.min("text").alias("text")).select("doc_id", "text", "p", "u")
    n_p, n_u = sample.agg(F.sum("p"), F.sum("u")).first()
    if not n_p or not n_u:
        return Model([], [])
    prior = min(max(n_pos / n, 1e-4), 0.9)
    words = vocabulary(sample, n_p, n_u, prior, s)
    if not words:
        return Model([], [])
    features = Features(words)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            found = [features.of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "p", "u", "x"])

    got = sample.select("doc_id", "text", "p", "u").mapInArrow(rows, "doc_id long, p int, u int, x array<int>").toPandas()
    got = got.iloc[np.lexsort((got["x"].map(len), got["doc_id"]))]
    x = features.matrix([list(v) for v in got["x"]])
    is_p, is_u = got["p"].to_numpy() == 1, got["u"].to_numpy() == 1
    return Model(words, [fit(x[is_p], x[is_u], prior, hidden, seed) for hidden, seed in ((0, 11), (16, 12))])


def score(docs: DataFrame, model: Model, columns: list[str], text: str = "text", out: str = "__score") -> DataFrame:
    """``columns`` of every row, and the score as ``out``."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    d = docs.select(*columns, *([] if text in columns else [text]))
    schema = docs.select(*columns, F.lit(0.0).alias(out)).schema
    at, n = d.columns.index(text), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, at)):
            scores = held.value.score(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(scores)], schema.fieldNames())

    return d.mapInArrow(run, schema)


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model, ["doc_id"])
    return out.select(
        "doc_id",
        F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op1_nnpu_toxicity": op1_nnpu_toxicity}
ORACLES: dict[str, str] = {}
