"""Best-hit and top-N selection per key, with explicit tie keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_n(df: DataFrame, key: Sequence[str], score: str, ties: Sequence[str], n: int, rank: str = "hit_rank") -> DataFrame:
    """The ``n`` highest scores of each key. ``ties`` must settle equal scores.

    Written as ``row_number() <= n``, so that Spark prunes each partition before the shuffle.
    """
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last(score), *ties)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def best_per_key(df: DataFrame, key: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    return top_n(df, key, score, ties, 1, "__r").drop("__r")


def entropy_bits(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts; 0 for none."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a - (x / total) * F.log2(x / total))


def margin_diversity(df: DataFrame, key: str | Sequence[str], score: str, species: str, genus: str, ties: Sequence[str], n: int = 5, strict: bool = False) -> DataFrame:
    """Margin of the best hit over other species and the taxon diversity of the top ``n``.

    A null species is an unmapped hit: it counts as one value in the distinct counts, is left out of
    the entropy, and makes the margin null; ``strict`` takes the margin over mapped hits only.
    """
    keys = [key] if isinstance(key, str) else [*key]
    t = top_n(df, keys, score, ties, n)
    # The top n rows of a key are a bounded array; one shuffle serves ranking and aggregation.
    g = t.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("hit_rank", F.col(species).alias("s"), F.col(genus).alias("g"), F.col(score).alias("v")))).alias("h"))
    best = F.col("h")[0]
    other = F.filter("h", lambda x: x["s"] != best["s"])
    margin = best["v"] - F.when(F.size(other) > 0, F.array_max(F.transform(other, lambda x: x["v"]))).otherwise(0.0)
    unmapped = F.exists("h", lambda x: x["s"].isNull())
    names = F.filter(F.transform("h", lambda x: x["s"]), lambda s: s.isNotNull())
    counts = F.transform(F.array_distinct(names), lambda s: F.size(F.filter(names, lambda t: t == s)).cast("double"))
    return g.select(
        *keys,
        best["s"].alias("top_species"),
        (F.when(best["s"].isNotNull(), margin) if strict else F.when(~unmapped, margin)).alias("bitscore_margin_species"),
        F.size(F.array_distinct(F.transform("h", lambda x: x["s"]))).cast("long").alias("n_species_topn"),
        F.size(F.array_distinct(F.transform("h", lambda x: x["g"]))).cast("long").alias("n_genera_topn"),
        F.abs(entropy_bits(counts)).alias("tax_entropy_topn"),
    )
