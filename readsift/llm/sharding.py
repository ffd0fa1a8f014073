"""Sharding by longest-processing-time scheduling (operator 5, law ``bytes``).

Documents with equal texts form a group that must stay together. Groups, sorted by size from the
largest, go to the least-loaded shard through a heap.

Only sizes decide, so the schedule is made from a histogram with one entry a group size. The driver
holds that histogram and the schedule: different sizes of ``B`` bytes in all are fewer than
sqrt(2 B), 14 million at 100 TB, and a size's groups change shards at most ``shards`` times. A run of
equal sizes is dealt by levelling the loads and then through the heap, which gives the heap's own
result without a step for each group. Groups take their place in the run from a distributed rank,
and documents take their slot from another, so no task holds a shard or a size.

Defined results: a null text counts as empty and shares the empty text's group; repeated rows are
placed each; an empty table gives an empty result; other columns are ignored. Groups are told
apart by 128 bits of SHA-256. A group larger than the mean shard makes its shard larger.
"""

from __future__ import annotations

import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, even_lookup, ranked, skewed_lookup, table

SHARDS = 40
OVERHEAD = 16


def schedule(sizes: np.ndarray, counts: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """LPT over runs of equal sizes, ``sizes`` descending.

    (edges, ends, to): run r is dealt by entries edges[r] to edges[r + 1], which hold the ranks at
    which the shard changes (ends, ascending) and the shards.
    """
    heap = [(0, s) for s in range(shards)]
    edges, ends, to = array("q", [0]), array("q"), array("i")
    for size, k in zip(sizes.tolist(), counts.tolist()):
        got: dict[int, int] = {}
        if k > 4 * shards and size > 0:  # level most of the run at once
            load = np.zeros(shards, np.int64)
            for x, s in heap:
                load[s] = x
            order = np.sort(load)
            # The level that k - shards items would fill the lowest shards up to.
            filled = np.arange(1, shards + 1) * order - np.cumsum(order)
            use = int(np.searchsorted(filled, (k - shards) * size, "right"))
            level = (int(order[:use].sum()) + (k - shards) * size) // use
            n = np.maximum((level - load) // size, 0)
            got = {s: int(c) for s, c in enumerate(n) if c}
            k -= int(n.sum())
            heap = [(int(load[s] + n[s] * size), s) for s in range(shards)]
            heapq.heapify(heap)
        for _ in range(k):
            x, s = heap[0]
            heapq.heapreplace(heap, (x + size, s))
            got[s] = got.get(s, 0) + 1
        at = 0
        for s in sorted(got):
            at += got[s]
            ends.append(at)
            to.append(s)
        edges.append(len(ends))
    return np.array(edges, np.int64), np.array(ends, np.int64), np.array(to, np.int32)


def place_groups(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Add ``shard`` to (g, bytes, ...), one row a group."""
    hist = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("k")).toArrow().sort_by([("bytes", "descending")])
    edges, ends, to = schedule(hist["bytes"].to_numpy(), hist["k"].to_numpy(), shards)
    edges = pa.array(edges, pa.int32())
    plan = pa.table({"bytes": hist["bytes"].combine_chunks(), "ends": pa.ListArray.from_arrays(edges, pa.array(ends)), "to": pa.ListArray.from_arrays(edges, pa.array(to))})
    of = groups.sparkSession.createDataFrame(plan, "bytes long, ends array<long>, to array<int>")
    # Many groups may have one size, so the join spreads hot sizes.
    r = even_lookup(cut(ranked(groups, ["g"], "rank", within=["bytes"], tag="groups"), "ranks"), of, "bytes")
    return r.withColumn("shard", F.element_at("to", F.size(F.filter("ends", lambda e: e <= F.col("rank"))) + 1)).drop("ends", "to", "rank")


def shard(docs: DataFrame, shards: int = SHARDS, id: str = "doc_id", text: str = "text", at: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row.

    Slots follow the groups, or the rows' places in column ``at``.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(
        F.col(id).alias("doc_id"),
        *([F.col(at).alias("at")] if at else []),
        (F.octet_length(t) + OVERHEAD).cast("long").alias("size"),
        F.crc32(t).alias("text_crc32"),
        F.substring(F.unhex(F.sha2(t, 256)), 1, 16).alias("g"),
    )
    d = cut(d, "sizes")
    groups = d.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    placed = cut(place_groups(cut(groups, "groups"), shards).select("g", "n", "shard"), "placed")
    out = skewed_lookup(d, placed, "g", "n", d.count()).drop("n")
    order = [*(["at"] if at else []), "g", "doc_id"]
    out = out.select("size", "text_crc32", "shard", *order)
    return ranked(cut(out, "dealt"), order, "slot", within=["shard"], tag="slots").select("doc_id", "size", "text_crc32", "shard", "slot")


def op5_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_lpt_sharding": op5_lpt_sharding}
ORACLES: dict[str, str] = {}
