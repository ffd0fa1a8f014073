"""Mixing sources to target weights by Pfair scheduling (operator 6, DataFrame functions only).

A source's rows are cut into blocks of ``block_rows``, in an order given by a hash of the id. With
target weight w, block b (from 0) of a source is released at slot floor(b / w) and due at
ceil((b + 1) / w). Each slot goes to the released block with the earliest deadline, which keeps
every source within one block of its share at every slot.

Weights are whole units of one cycle (unit k of the cycle's length L is the weight k / L), so the
schedule repeats after L slots: one cycle is simulated by ``aggregate`` in one row, and every block
finds its slot by arithmetic. Where no weights are given, a source's weight is the square root of
its row count (temperature 2), from all rows, in units of about 1/``resolution``, one at least.

Every row is kept: sources that run out leave their slots, the others go on in their proportions.
``in_mix`` marks the slots before any source has run out, where all weights hold. A source may hold
any share of the rows: ranks are distributed and the schedule is broadcast. The number of
sources is bounded by ``max_sources``, as the cycle is one row.

Defined results: a null source is a source of its own; rows that repeat an id are placed each; an
empty table gives an empty result; other columns are ignored; given weights must cover all sources.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ranked, table


@dataclass(frozen=True)
class Mix:
    block_rows: int = 16
    resolution: int = 1000
    max_sources: int = 4096


def units(sources: DataFrame, weights: Mapping[str, int] | None = None, mix: Mix = Mix()) -> DataFrame:
    """(source, n, k): whole units of weight for each source with its row count n."""
    if weights is not None:
        k = F.create_map(*[x for s, w in weights.items() for x in (F.lit(s), F.lit(int(w)))])[F.col("source")]
        return sources.withColumn("k", F.when(k > 0, k).otherwise(F.raise_error("a source without a weight")))
    total = F.sum(F.sqrt("n")).over(_all())
    return sources.withColumn("k", F.greatest(F.lit(1), F.round(F.sqrt("n") / total * mix.resolution)).cast("int"))


def _all():
    from pyspark.sql.window import Window

    return Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def cycle(u: DataFrame) -> DataFrame:
    """One cycle of the schedule: (source, k, n, length, slots), slots being the slot of each of the k blocks."""
    one = u.agg(F.array_sort(F.collect_list(F.struct("source", "k", "n"))).alias("s"), F.sum("k").cast("int").alias("length"))

    def step(acc, t, s, length):
        def due(x, j):
            c, k = acc["c"][j], x["k"]
            free = (c < k) & (F.floor(c * length / k) <= t)
            return F.when(free, F.struct(F.ceil((c + 1) * length / k).alias("d"), j.alias("j")))

        pick = F.array_min(F.transform(s, due))["j"]
        # A pick is counted and its slot noted in one pass over the sources.
        c = F.zip_with(acc["c"], F.sequence(F.lit(0), F.size(s) - 1), lambda v, j: F.when(j == pick, v + 1).otherwise(v))
        return F.struct(c.alias("c"), F.concat(acc["picks"], F.array(pick)).alias("picks"))

    s, length = F.col("s"), F.col("length")
    start = F.struct(F.transform(s, lambda x: F.lit(0)).alias("c"), F.array().cast("array<int>").alias("picks"))
    run = F.aggregate(F.sequence(F.lit(0), length - 1), start, lambda acc, t: step(acc, t, s, length), lambda acc: acc["picks"])
    done = one.where("length > 0").withColumn("picks", run)
    each = done.select("length", "picks", F.posexplode("s").alias("j", "x"))
    slots = F.filter(F.transform("picks", lambda p, t: F.when(p == F.col("j"), t)), lambda t: t.isNotNull())
    return each.select(F.col("x.source").alias("source"), F.col("x.k").alias("k"), F.col("x.n").alias("n"), "length", slots.alias("slots"))


def mix_sources(docs: DataFrame, id: str = "doc_id", source: str = "source", weights: Mapping[str, int] | None = None, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, block, release, deadline, slot, row_in_block, in_mix for every row."""
    d = docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source")).withColumn("__o", F.md5(F.col("doc_id").cast("string")))
    sources = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    sources = cut(sources, "sources")
    if sources.count() > mix.max_sources:
        raise ValueError("more sources than one cycle holds: group them or raise max_sources")
    plan = cut(cycle(units(sources, weights, mix)), "cycle")  # one row a source
    r = ranked(d, ["__o", "doc_id"], "__rank", within=["source"], tag="sources")
    of = F.broadcast(plan.withColumnRenamed("source", "__source"))  # at most max_sources rows
    r = r.join(of, F.col("source").eqNullSafe(F.col("__source")))
    slot = lambda b: F.floor(b / F.col("k")) * F.col("length") + F.element_at("slots", (b % F.col("k")).cast("int") + 1)
    b = F.floor(F.col("__rank") / mix.block_rows)
    blocks = F.ceil(F.col("n") / mix.block_rows)
    horizon = plan.agg(F.min(slot(blocks)).alias("__end"))  # the first slot that a source leaves empty
    out = r.crossJoin(F.broadcast(horizon))  # one row
    return out.select(
        "doc_id",
        "source",
        b.cast("long").alias("block"),
        F.floor(b * F.col("length") / F.col("k")).cast("long").alias("release"),
        F.ceil((b + 1) * F.col("length") / F.col("k")).cast("long").alias("deadline"),
        slot(b).cast("long").alias("slot"),
        (F.col("__rank") % mix.block_rows).cast("long").alias("row_in_block"),
        (slot(b) < F.col("__end")).alias("in_mix"),
    )


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix_sources(table(spark, sf_dir, "documents"))
    return ranked(cut(m, "mix"), ["slot", "row_in_block"], "position", tag="positions")


_SQL = """
WITH RECURSIVE
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS r FROM documents),
src AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
u AS (SELECT source, n, greatest(1, round(sqrt(n) / (SELECT sum(sqrt(n)) FROM src) * 1000))::BIGINT AS k FROM src),
arr AS (SELECT list(source ORDER BY source) AS s, list(k ORDER BY source) AS k, sum(k)::BIGINT AS len FROM u),
edf(t, c, pick) AS (
  SELECT -1::BIGINT, list_transform(k, lambda x: 0::BIGINT), -1::BIGINT FROM arr
  UNION ALL
  SELECT t + 1, list_transform(c, lambda v, i: CASE WHEN i = p THEN v + 1 ELSE v END), p
  FROM (
    SELECT e.t, e.c, list_min(list_filter(list_transform(range(1, len(a.k) + 1), lambda i:
             CASE WHEN e.c[i] < a.k[i] AND (e.c[i] * a.len) // a.k[i] <= e.t + 1
                  THEN ((e.c[i] + 1) * a.len + a.k[i] - 1) // a.k[i] * 100000 + i END), lambda x: x IS NOT NULL)) % 100000 AS p
    FROM edf e, arr a WHERE e.t + 1 < a.len)),
plan AS (
  SELECT a.s[e.pick] AS source, a.k[e.pick] AS k, a.len AS len, e.t AS o,
         row_number() OVER (PARTITION BY e.pick ORDER BY e.t) - 1 AS q
  FROM edf e, arr a WHERE e.t >= 0),
fin AS (
  SELECT min(((n + 15) // 16) // plan.k * len + o) AS e
  FROM u JOIN plan ON u.source = plan.source AND plan.q = ((n + 15) // 16) % plan.k),
m AS (
  SELECT d.doc_id, d.source, d.r // 16 AS block, ((d.r // 16) * len) // p.k AS release,
         ((d.r // 16 + 1) * len + p.k - 1) // p.k AS deadline, ((d.r // 16) // p.k) * len + o AS slot, d.r % 16 AS row_in_block
  FROM d JOIN plan p ON d.source = p.source AND p.q = (d.r // 16) % p.k)
SELECT doc_id, source, block, release, deadline, slot, row_in_block, slot < e AS in_mix,
       row_number() OVER (ORDER BY slot, row_in_block) - 1 AS position
FROM m, fin
"""

QUERIES = {"op6_pfair_mixing": op6_pfair_mixing}
ORACLES = {"op6_pfair_mixing": _SQL}
