"""Languages of texts and of the spans of mixed texts (operator 13).

Words are runs of letters and marks of one script, at most ``PIECE`` long (longer runs are cut, no
letter is lost), in lower case. A word's script narrows its candidates to the languages that the
script was seen in during training (``MIN_SHARE`` of a language's letters at least). Each candidate
gets a score: the mean, over the orders 2 to 4, of the summed log probabilities of the word's letter
n-grams (with marks at both ends) by an additively smoothed model; n-grams are told apart by a hash.
A Viterbi pass over the words, with ``SWITCH`` as the price of a change of language, gives each word its
language, and runs of equal ones are the spans. A text's language is the one with the most letters in
its spans, and its score that language's share of all letters.

Training counts n-grams over a bounded sample: about ``PER_LANGUAGE`` documents of each language,
chosen by a hash of the id, all of a language that has fewer. The model has one row of ``BUCKETS``
counts for each language, so its size follows the number of languages alone; with many languages the
buckets become fewer, so that it keeps below ``CELLS`` numbers.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text where
nothing could be learned. A text whose script belongs to no learned language goes by the n-grams among
all languages. Ties go to the first language by name. Rows with a null id or lang are not learned from,
a null id is predicted and not held out; repeated rows are predicted each (and counted each in
training); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table
from .folds import fold

FOLDS, HELD_OUT = 3, 1
NONE = "und"
PIECE = 32
ORDERS = (2, 3, 4)
PER_LANGUAGE = 4000
BUCKETS = 1 << 15
CELLS = 1 << 25
SMOOTHING = 0.5
SWITCH = 12.0
MIN_SHARE = 0.01

#: Scripts by ranges of code points (fixed values); Han and the kana are one, as they stand in one text. Others are "Other".
SCRIPTS = (
    (0x0041, 0x024F, "Latin"),
    (0x0250, 0x02AF, "Latin"),
    (0x0370, 0x03FF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x06FF, "Arabic"),
    (0x0750, 0x077F, "Arabic"),
    (0x08A0, 0x08FF, "Arabic"),
    (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"),
    (0x0A00, 0x0A7F, "Gurmukhi"),
    (0x0A80, 0x0AFF, "Gujarati"),
    (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"),
    (0x0C80, 0x0CFF, "Kannada"),
    (0x0D00, 0x0D7F, "Malayalam"),
    (0x0D80, 0x0DFF, "Sinhala"),
    (0x0E00, 0x0E7F, "Thai"),
    (0x0E80, 0x0EFF, "Lao"),
    (0x0F00, 0x0FFF, "Tibetan"),
    (0x1000, 0x109F, "Myanmar"),
    (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"),
    (0x1200, 0x137F, "Ethiopic"),
    (0x1780, 0x17FF, "Khmer"),
    (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x30FF, "East Asian"),
    (0x3400, 0x4DBF, "East Asian"),
    (0x4E00, 0x9FFF, "East Asian"),
    (0xAC00, 0xD7AF, "Hangul"),
    (0xF900, 0xFAFF, "East Asian"),
    (0x20000, 0x323AF, "East Asian"),
)
_STARTS = [a for a, _, _ in SCRIPTS]
#: Up to here letters are of one script.
LATIN = "\u024f"
#: Letters, and the combining marks that may follow them.
_RUN = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")


def script_of(letter: str) -> str:
    c = ord(letter)
    _, to, name = SCRIPTS[max(0, bisect_right(_STARTS, c) - 1)]
    return name if _STARTS[0] <= c <= to else "Other"


def words(text: str | None) -> list[str]:
    """The text's words, in lower case."""
    low = (text or "").lower()
    out = _RUN.findall(low)
    if low and max(low) > LATIN:
        out = [p for w in out for p in _by_script(w)]
    if max(map(len, out), default=0) > PIECE:
        out = [w[i : i + PIECE] for w in out for i in range(0, len(w), PIECE)]
    return out


def _by_script(word: str) -> list[str]:
    """The word cut where the script changes; combining marks stay with the letter before them."""
    seen, parts = None, []
    for c in word:
        if not "\u0300" <= c <= "\u036f" and (s := script_of(c)) != seen:
            parts.append("")
            seen = s
        parts[-1] += c
    return parts


def grams(of: list[str], buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The words' n-grams: (start of each word's positions, and for each order the bucket at each position and whether an n-gram starts there)."""
    codes = np.frombuffer("".join(f"<{w}>" for w in of).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, of), np.int64, len(of)) + 2
    start = np.cumsum(size) - size
    left = np.repeat(start + size, size) - np.arange(len(codes))  # positions up to the word's end
    out, h = [], np.full(len(codes), 1469598103934665603, np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = (h ^ np.r_[codes[n - 1 :], np.zeros(n - 1, np.uint64)][: len(codes)]) * np.uint64(1099511628211)
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            out.append((((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), left >= n))
    return start, out


@dataclass
class Model:
    """``weight[k]`` are the log probabilities of order k's n-grams: languages x buckets; ``scripts`` the languages of a script."""

    langs: list[str]
    weight: list[np.ndarray]
    scripts: dict[str, list[int]]
    switch: float = SWITCH

    def scores(self, of: list[str]) -> np.ndarray:
        """Log scores of all languages for each word; those that the script excludes get minus infinity."""
        start, found = grams(of, self.weight[0].shape[1])
        total, orders = np.zeros((len(of), len(self.langs))), np.zeros(len(of))
        for w, (bucket, on) in zip(self.weight, found):
            total += np.add.reduceat(np.where(on, w[:, bucket], 0), start, axis=1).T
            orders += np.maximum.reduceat(on, start)
        total /= orders[:, None]
        script = [script_of(w[0]) for w in of]
        for s in set(script):
            if (allowed := self.scripts.get(s)) is not None:
                out = np.setdiff1d(np.arange(len(self.langs)), allowed)
                total[np.ix_(np.flatnonzero([x == s for x in script]), out)] = -np.inf
        return total


def viterbi(scores: np.ndarray, length: np.ndarray, switch: float) -> list[np.ndarray]:
    """The best language of each word of each text: ``scores`` (words x languages) holds text after text.

    A change of language costs ``switch``, to any other, so the best way into a language is from itself or
    from the best of all. All texts advance together, the longest first; a text leaves when it ends.
    """
    order = np.argsort(-length, kind="stable")
    start = (np.cumsum(length) - length)[order]
    n = length[order]
    k = scores.shape[1]
    stay = np.zeros(scores.shape, bool)
    top = np.zeros(len(scores), np.int32)
    best = np.zeros((len(n), k))
    live = len(n)
    for t in range(int(n[0]) if len(n) else 0):
        while live and n[live - 1] <= t:
            live -= 1
        at = start[:live] + t
        b = best[:live]
        if t:
            j = b.argmax(1)
            change = b[np.arange(live), j] - switch
            stay[at] = b >= change[:, None]
            top[at] = j
            b = np.maximum(b, change[:, None])
        best[:live] = b + scores[at]
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(n)
    # Back along all texts together.
    path = np.zeros(len(scores), np.int32)
    now = best.argmax(1) if len(n) else np.empty(0, int)
    live = 0
    for t in range(int(n[0]) - 1 if len(n) else -1, -1, -1):
        while live < len(n) and n[live] > t:
            live += 1
        at = start[:live] + t
        path[at] = now[:live]
        if t:
            now[:live] = np.where(stay[at, now[:live]], now[:live], top[at])
    for i, s, m in zip(order, start, n):
        out[i] = path[s : s + m]
    return out


def labelled(model: Model, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
    """(words, index of each one's language) of each text."""
    found = [words(t) for t in texts]
    length = np.array([len(w) for w in found], np.int64)
    if not length.sum():
        return [(w, np.empty(0, np.int32)) for w in found]
    known = pa.array([x for w in found for x in w], pa.string()).dictionary_encode()
    scores = model.scores(known.dictionary.to_pylist()).astype(np.float32)
    return list(zip(found, viterbi(scores[known.indices.to_numpy()], length, model.switch)))


def spans(model: Model, text: str | None) -> list[tuple[str, int, int]]:
    """(language, first word, number of words) of each span of a text."""
    ((_, path),) = labelled(model, [text])
    out, at = [], 0
    for lang, run in groupby(path.tolist()):
        n = len(list(run))
        out.append((model.langs[lang], at, n))
        at += n
    return out


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, text: str = "text", lang: str = "lang", id: str = "doc_id") -> Model | None:
    """Fit on the rows of ``docs`` that may be learned from; None without any."""
    d = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and doc_id is not null").where(fold("doc_id", FOLDS) != HELD_OUT)
    n = {r.lang: r.n for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()}  # languages
    if not n:
        return None
    langs = list(n)
    buckets = BUCKETS
    while buckets > 64 and buckets * len(langs) * len(ORDERS) > CELLS:
        buckets //= 2
    share = cut(docs.sparkSession.createDataFrame([(lg, i, min(1.0, per_language / c)) for i, (lg, c) in enumerate(n.items())], "lang string, k int, share double"), "langs")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    sample = d.join(F.broadcast(share), "lang").where(draw < F.col("share")).select("k", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's counts of n-grams and letters: (language, order or -1, bucket or script, count)."""
        seen: dict[int, Counter] = {}
        for b in (part for whole in batches for part in slices(whole, 1)):
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(k, Counter()).update(words(t))
        for k, c in ((k, c) for k, c in seen.items() if c):
            script: Counter = Counter()
            for w, m in c.items():
                script[script_of(w[0])] += m * len(w)
            start, found = grams(list(c), buckets)
            m = np.repeat(np.fromiter(c.values(), np.int64, len(c)), np.diff(np.r_[start, len(found[0][0])]))
            hist = [np.bincount(bucket[on], m[on], buckets).astype(np.int64) for bucket, on in found]
            for o in range(len(ORDERS)):
                at = np.flatnonzero(hist[o])
                yield _counts(k, o, at.tolist(), [None] * len(at), hist[o][at].tolist())
            yield _counts(k, -1, [0] * len(script), list(script), list(script.values()))

    got = sample.mapInArrow(count, "k int, o int, at long, script string, n long").groupBy("k", "o", "at", "script").agg(F.sum("n").alias("n")).toArrow()
    k, o, at, m = (got[c].to_numpy() for c in ("k", "o", "at", "n"))
    weight = []
    for i in range(len(ORDERS)):
        c = np.full((len(langs), buckets), SMOOTHING)
        on = o == i
        np.add.at(c, (k[on], at[on]), m[on])
        weight.append(np.log(c / c.sum(1, keepdims=True)).astype(np.float32))
    letters = np.bincount(k[o < 0], m[o < 0], len(langs))
    scripts: dict[str, list[int]] = {}
    for lg, s, c in sorted(zip(k[o < 0].tolist(), np.array(got["script"].to_pylist(), object)[o < 0], m[o < 0].tolist())):
        if c >= MIN_SHARE * letters[lg]:
            scripts.setdefault(s, []).append(lg)
    return Model(langs, weight, scripts)


def _counts(k: int, o: int, at: list[int], script: list, n: list[int]) -> pa.RecordBatch:
    full = lambda v: pa.array([v] * len(at), pa.int32())
    return pa.RecordBatch.from_arrays([full(k), full(o), pa.array(at, pa.int64()), pa.array(script, pa.string()), pa.array(n, pa.int64())], ["k", "o", "at", "script", "n"])


def predict(docs: DataFrame, model: Model | None, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every row, lang_pred, score, and the spans as (lang, first word, number of words)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(*columns, F.col(text).alias("__text"))
    kind = "array<struct<lang:string,at:int,n:int>>"
    schema = docs.select(*columns, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast(kind).alias("spans")).schema
    at = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in (part for whole in batches for part in slices(whole, at, 4 << 20)):
            texts = b.column(at).to_pylist()
            pred, score, runs = [NONE] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            for i, (w, path) in enumerate(labelled(model, texts) if model else []):
                if not w:
                    continue
                letters = np.bincount(path, [len(x) for x in w], len(model.langs))
                k = int(letters.argmax())
                pred[i], score[i] = model.langs[k], float(letters[k] / letters.sum())
                edge = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
                runs[i] = [{"lang": model.langs[path[a]], "at": int(a), "n": int(z - a)} for a, z in zip(edge, [*edge[1:], len(path)])]
            spans_ = pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("at", pa.int32()), ("n", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(pred, pa.string()), pa.array(score, pa.float64()), spans_], schema.fieldNames())

    return d.mapInArrow(run, schema)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs), ["doc_id"])
    return out.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


QUERIES = {"op13_language_id": op13_language_id}
ORACLES: dict[str, str] = {}
