"""Connected components of a link table by alternating large and small stars.

Each round is two joins on partial minima; a round never makes more links than it had. Rounds are
cut in the shared folder, so a lost executor costs a re-read. No links or components are collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_at, drop, skewed_lookup


def _nodes(e: DataFrame) -> DataFrame:
    """(v, m, as_hi, as_lo): each end's smallest smaller neighbour, and how many links it is either end of."""
    none = F.lit(None).cast(e.schema["lo"].dataType)
    up = e.select(F.col("hi").alias("v"), F.col("lo").alias("m"), F.lit(1).alias("hi"), F.lit(0).alias("lo"))
    down = e.select(F.col("lo").alias("v"), none.alias("m"), F.lit(0).alias("hi"), F.lit(1).alias("lo"))
    return up.unionAll(down).groupBy("v").agg(F.min("m").alias("m"), F.sum("hi").alias("as_hi"), F.sum("lo").alias("as_lo"))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (a, b) of comparable ids, any direction, repeats allowed; returns (id, component).

    ``component`` is the smallest id reachable. Ids that only link to themselves or to nothing are
    not returned. Null ends are ignored. Raises if ``max_rounds`` do not suffice.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e, at = cut_at(e, "links")
    seen = None
    for _ in range(max_rounds):
        # A fixed point is a forest of stars; its signature no longer changes.
        sign = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if sign == seen or sign[0] == 0:
            return e.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
        seen = sign
        # Each star is a table, as its plan would be repeated at every use.
        for star in (_large, _small):
            new, new_at = cut_at(star(e, sign[0]), "stars")
            drop(e.sparkSession, at)
            e, at = new, new_at
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _large(e: DataFrame, links: int) -> DataFrame:
    """Every node hands its larger neighbours to its smallest neighbour."""
    found = skewed_lookup(e, _nodes(e).where("as_lo > 0").select(F.col("v").alias("lo"), "m", F.col("as_lo").alias("n")), "lo", "n", links)
    return found.select("hi", F.coalesce("m", "lo").alias("lo")).distinct()


def _small(e: DataFrame, links: int) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the smallest of them."""
    found = skewed_lookup(e, _nodes(e).where("as_hi > 0").select(F.col("v").alias("hi"), "m", F.col("as_hi").alias("n")), "hi", "n", links)
    rest = found.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    own = found.select("hi", F.col("m").alias("lo"))
    return rest.union(own).distinct()
