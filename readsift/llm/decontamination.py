"""Benchmark decontamination by CGK embedding and bit-sampling LSH (operator 10).

A document is contaminated by an item of L words if some run of its words is within
``floor((1 - similarity) * L)`` word edits of it. Words are runs of letters and digits, lower-cased.

1. Windows. Items are grouped by length. For a group whose shortest item has ``low`` words,
   item-sized windows start at every ``stride``-th word of a document, and items are embedded from
   each of their first ``stride`` words, or of as many as the edits may cut off, so that any place
   of an item in a document has a window that starts with it. A window is left out only if it has
   too few words of the benchmark for any item of the group, which no match can.
2. CGK embedding. A random walk reads a window: at step t it shows the current word, and a coin of
   (t, word) says whether to move on. Windows and items share the coins, so walks that part at an
   edit tend to meet again, and few edits become few differing places. ``WALKS`` walks are drawn.
3. Bit sampling. Each walk is sampled ``SAMPLES`` times at ``PLACES`` random places; a window and
   an item that show the same words there in any sample are a candidate. This alone finds
   candidates. A walk pair that agrees on a share a of its places is found by a sample with
   probability a^PLACES; the sizes are set so that items with as many edits as are allowed are
   found with probability 0.9 or more (measured in the tests), and unedited ones always.
4. Candidates are verified by exact edit distance, so nothing clean is flagged by chance.

Items are broadcast in blocks of at most ``ITEM_BYTES``, one pass over the documents a block; every
document and every item is used. Defined results: null, empty or wordless texts and items match
nothing; a document that is shorter than an item is judged like a window that its ends cut off;
repeated rows are judged each; repeated items are reported each; an empty benchmark leaves every
document clean; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, table

SIMILARITY = 0.8
WALKS = 2
SAMPLES = 16
PLACES = 4
#: Steps of a walk for each word of the shortest window.
STEPS = 1.5
#: Items of one group differ in length by less than this factor.
GROUP = 1.2
SEED = 20240229
ITEM_BYTES = 32 << 20
#: Words and windows that are embedded at a time.
WORDS_AT_ONCE, WINDOWS_AT_ONCE = 1 << 19, 1 << 16
_WORD = re.compile(r"\w+")
_U = np.uint64


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def budget(n: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * n + 1e-9)


def coins(n: int, walk: int, block: int) -> np.ndarray:
    """64 coins of each word id below ``n``: those of steps 64 * block and on."""
    with np.errstate(over="ignore"):
        x = np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(SEED + 1000003 * walk + 7919 * block)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return (x ^ (x >> _U(31))).view(np.int64)


def embed(seq: np.ndarray, starts: np.ndarray, shown: np.ndarray, tossed: list[np.ndarray]) -> np.ndarray:
    """The words that the walks from ``starts`` show at the steps ``shown`` (ascending), one row a step.

    ``tossed`` has the 64 coins of every place of ``seq`` for each block of steps.
    """
    at = starts.copy()
    out = np.empty((len(shown), len(starts)), np.int64)
    row = 0
    for t in range(int(shown[-1]) + 1):
        if t == shown[row]:
            out[row] = seq[at]
            row += 1
        at += (tossed[t >> 6][at] >> (t & 63)) & 1
    return out


def keys(symbols: np.ndarray) -> np.ndarray:
    """One hash of each column; a clash only adds a candidate."""
    with np.errstate(over="ignore"):
        h = np.zeros(symbols.shape[1], np.uint64)
        for s in symbols:
            h = (h + s.view(np.uint64)) * _U(0xD6E8FEB86659FD93)
        return h ^ (h >> _U(32))


@dataclass
class Sample:
    """One bit sample of a walk: which of the shown steps it takes, and the items' keys there."""

    rows: np.ndarray
    key: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    #: Whether a key's slot is taken, so that most windows need no search.
    taken: np.ndarray

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> _U(7)) & _U(len(self.taken) - 1)

    def find(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, offset) of windows and items with equal keys."""
        k = keys(symbols[self.rows])
        on = np.flatnonzero(self.taken[self.slot(k)])
        lo, hi = (np.searchsorted(self.key, k[on], side) for side in ("left", "right"))
        n = hi - lo
        pick = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(on, n), self.item[pick], self.offset[pick]


class Group:
    """Items of similar length, embedded."""

    def __init__(self, members: list[tuple[int, np.ndarray]], vocabulary: int, similarity: float, walks: int, samples: int):
        self.ids = [i for i, _ in members]
        self.length = np.array([len(w) for _, w in members])
        self.edits = np.array([budget(n, similarity) for n in self.length])
        low, high = int(self.length.min()), int(self.length.max())
        self.words = np.zeros((len(members), high), np.int64)
        for row, (_, w) in zip(self.words, members):
            row[: len(w)] = w
        self.stride = max(1, low // 6)
        self.span = low - self.stride + 1
        self.least = self.span - int(self.edits.max())
        self.steps = steps = self.span if self.span < 4 else int(STEPS * self.span)
        # Every item from each offset at which a window may start; zeros follow its end.
        flat = np.concatenate([self.words, np.zeros((len(members), steps), np.int64)], axis=1).ravel()
        offsets = np.maximum(self.stride, self.edits + 1).clip(max=self.length)
        item = np.repeat(np.arange(len(members)), offsets)
        offset = np.arange(len(item)) - np.repeat(np.cumsum(offsets) - offsets, offsets)
        starts = item * (high + steps) + offset
        self.walks = []
        for walk in range(walks):
            rng = np.random.default_rng((SEED, walk, low))
            # No walk can run out of a window in the places of the first sample, so no item is left without a key.
            places = [np.sort(rng.choice(n, min(PLACES, n), replace=False)) for n in [min(self.span, steps)] + [steps] * (samples - 1)]
            shown = np.unique(np.concatenate(places))
            tossed = [coins(vocabulary, walk, b)[flat] for b in range((int(shown[-1]) >> 6) + 1)]
            symbols = embed(flat, starts, shown, tossed)
            self.walks.append((shown, [self._sample(np.searchsorted(shown, p), symbols, item, offset) for p in places]))

    @staticmethod
    def _sample(rows: np.ndarray, symbols: np.ndarray, item: np.ndarray, offset: np.ndarray) -> Sample:
        ok = np.flatnonzero((symbols[rows] > 0).all(axis=0))  # walks that left the item show nothing of it
        k = keys(symbols[rows][:, ok])
        order = np.argsort(k, kind="stable")
        ok, k = ok[order], k[order]
        s = Sample(rows, k, item[ok], offset[ok], np.zeros(1 << max(12, (16 * len(ok)).bit_length()), bool))
        s.taken[s.slot(k)] = True
        return s

    def candidates(self, seq: np.ndarray, starts: np.ndarray, tossed) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``seq`` where the item would start, item), each once."""
        found = [np.empty((2, 0), np.int64)]
        for a in range(0, len(starts), WINDOWS_AT_ONCE):
            at = starts[a : a + WINDOWS_AT_ONCE]
            for walk, (shown, samples) in enumerate(self.walks):
                symbols = embed(seq, at, shown, [tossed(walk, b) for b in range((int(shown[-1]) >> 6) + 1)])
                for s in samples:
                    window, item, offset = s.find(symbols)
                    found.append(np.stack([at[window] - offset, item]))
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))

    def verify(self, text: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distance, start, end) in each row of ``text`` of the run nearest to its item."""
        n, width = text.shape
        pattern, size, rows = self.words[item], self.length[item], np.arange(n)
        d = _distances(text, pattern, size, anywhere=True)
        end = d.argmin(axis=0)
        best = d[end, rows]
        # Backwards from the end, the run may start anywhere.
        back = np.arange(width)[None, :]
        turned = np.where(back < end[:, None], np.take_along_axis(text, np.maximum(end[:, None] - 1 - back, 0), axis=1), -1)
        j = np.arange(pattern.shape[1])[None, :]
        mirrored = np.where(j < size[:, None], np.take_along_axis(pattern, np.maximum(size[:, None] - 1 - j, 0), axis=1), 0)
        start = end - _distances(turned, mirrored, size, anywhere=False).argmin(axis=0)
        return best, start, end


def _distances(text: np.ndarray, pattern: np.ndarray, size: np.ndarray, anywhere: bool) -> np.ndarray:
    """Edit distance of each pattern to the runs that end at each place of its text, one row a place.

    Runs start at the text's start or ``anywhere``. A row of the table is one vector step: the chain
    of insertions along it is a running minimum.
    """
    n, width = text.shape
    j = np.arange(pattern.shape[1] + 1)
    row = np.broadcast_to(j, (n, len(j)))
    out = [row[np.arange(n), size]]
    for i in range(width):
        first = np.full((n, 1), 0 if anywhere else i + 1)
        step = np.minimum(row[:, 1:] + 1, row[:, :-1] + (pattern != text[:, i : i + 1]))
        row = np.minimum.accumulate(np.concatenate([first, step], axis=1) - j, axis=1) + j
        out.append(row[np.arange(n), size])
    return np.stack(out)


class Items:
    """A block of items, ready to be looked for."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float = SIMILARITY, walks: int = WALKS, samples: int = SAMPLES):
        self.ids: dict[str, int] = {}
        members = []
        for item_id, text in rows:
            w = words(text)
            if w:
                members.append((int(item_id), np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in w], np.int64)))
        members.sort(key=lambda m: (len(m[1]), m[0]))
        self.groups = []
        while members:
            limit = len(members[0][1]) * GROUP
            n = next((k for k, m in enumerate(members) if len(m[1]) > limit), len(members))
            self.groups.append(Group(members[:n], len(self.ids) + 1, similarity, walks, samples))
            members = members[n:]
        self.gap = max((max(g.steps, g.span) for g in self.groups), default=1)

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text its (item_id, distance, start) matches, the best run of each item."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        get, held, which, n = self.ids.get, [], [], 0
        for k, t in enumerate(texts):
            w = words(t)
            if w and self.groups:
                held.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
                which.append(k)
                n += len(w) + self.gap
            if n > WORDS_AT_ONCE:
                self._find(held, which, out)
                held, which, n = [], [], 0
        if held:
            self._find(held, which, out)
        return out

    def _find(self, docs: list[np.ndarray], which: list[int], out: list) -> None:
        """Documents laid end to end with ``gap`` zeros between, which no walk crosses."""
        size = np.array([len(d) for d in docs])
        first = np.cumsum(size + self.gap) - size - self.gap
        seq = np.zeros(int(first[-1] + size[-1]) + self.gap + 1, np.int64)
        for d, a in zip(docs, first):
            seq[a : a + len(d)] = d
        known = np.r_[0, np.cumsum(seq > 0)]
        made: dict[tuple[int, int], np.ndarray] = {}

        def tossed(walk: int, block: int) -> np.ndarray:
            if (walk, block) not in made:
                made[walk, block] = coins(len(self.ids) + 1, walk, block)[seq]
            return made[walk, block]

        for g in self.groups:
            n = -(-size // g.stride)
            starts = np.repeat(first, n) + g.stride * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            starts = starts[known[np.minimum(starts + g.span, len(seq))] - known[starts] >= max(1, g.least)]
            if not len(starts):
                continue
            place, item = g.candidates(seq, starts, tossed)
            step = max(1, (1 << 21) // g.words.shape[1])
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for a in range(0, len(place), step):
                p, i = place[a : a + step], item[a : a + step]
                e = g.edits[i]
                doc = np.searchsorted(first, np.maximum(p + e, 0), "right") - 1
                low = np.maximum(p - e, first[doc])
                high = np.minimum(p + g.length[i] + e, first[doc] + size[doc])
                at = low[:, None] + np.arange(max(0, int((high - low).max())))[None, :]
                text = np.where(at < high[:, None], seq[np.minimum(at, len(seq) - 1)], -1)
                d, start, _ = g.verify(text, i)
                for k in np.flatnonzero(d <= e):
                    key = (int(doc[k]), int(i[k]))
                    now = (int(d[k]), int(low[k] + start[k] - first[doc[k]]))
                    best[key] = min(best.get(key, now), now)
            for (doc, i), (d, start) in best.items():
                out[which[doc]].append((g.ids[i], d, start))


def item_blocks(items: DataFrame, limit: int = ITEM_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Items in id order, in blocks of bounded size; one block at a time is on the driver."""
    block, size = [], 0
    for r in items.where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if block and size + len(r.text) > limit:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


HIT = "array<struct<item_id: bigint, distance: int, start: int>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32())]))


def matches(docs: DataFrame, items: DataFrame, columns: list[str], text: str = "text", hits: str = "hits", similarity: float = SIMILARITY, limit: int = ITEM_BYTES) -> DataFrame:
    """``columns`` of every row and ``hits``, the matching items by item_id.

    A block of items is embedded once, on the driver, and broadcast; its pass adds to the hits of
    those before, and the last one leaves the text behind where it is not asked for.
    """
    spark = docs.sparkSession
    read = free("text", [*columns, hits])
    out = docs.select(*columns, F.col(text).alias(read), F.lit(None).cast(HIT).alias(hits))
    schema = out.schema
    for block in item_blocks(items, limit):
        held = spark.sparkContext.broadcast(Items(block, similarity))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = held.value.find(b.column(b.num_columns - 2).to_pylist())
                before = b.column(b.num_columns - 1).to_pylist()
                now = [[*(x or []), *({"item_id": i, "distance": d, "start": s} for i, d, s in sorted(h))] for x, h in zip(before, found)]
                yield b.set_column(b.num_columns - 1, hits, pa.array(now, _HIT))

        out = out.mapInArrow(run, schema)
    return out.select(*columns, F.array_sort(F.coalesce(hits, F.array().cast(HIT))).alias(hits))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long"), "text")
    m = matches(table(spark, sf_dir, "documents").select("doc_id", "text"), items, ["doc_id"])
    return m.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.transform("hits", lambda h: h["item_id"]).alias("item_ids"), "hits")


QUERIES = {"op10_benchmark_decontamination": op10_benchmark_decontamination}
ORACLES: dict[str, str] = {}
