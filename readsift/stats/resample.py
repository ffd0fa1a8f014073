"""Bootstrap intervals whose draws are a table, so that any engine and any partitioning draw alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import is_finite


def drawn(seed: int, rep, draw, n):
    """A place from 1 to ``n`` for one draw of one replicate: the leading 32 bits of md5('seed|replicate|draw'), scaled."""
    text = F.concat_ws("|", F.lit(str(seed)), rep.cast("string"), draw.cast("string"))
    return F.expr("bigint(1)") + F.shiftright(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") * n, 32)


def median_intervals(diffs: DataFrame, groups: Sequence[str], d: str = "d", reps: int = 2000, conf: float = 0.95, seed: int = 1729) -> DataFrame:
    """(groups, n, median_diff, ci_lo, ci_hi): percentile interval of each group's median over ``reps`` resamples.

    A group has one value a fold and so is design-sized; its replicates are rows, spread over the tasks. Nulls, NaN
    and infinities do not count; a group without any value has n 0 and nulls, one with a single value no interval.
    """
    finite = F.when(is_finite(F.col(d)), F.col(d).cast("double"))
    g = diffs.groupBy(*groups).agg(F.array_sort(F.collect_list(finite)).alias("__v")).withColumn("__n", F.size("__v").cast("long"))
    middle = lambda v, n: (F.element_at(v, F.floor((n + 1) / 2).cast("int")) + F.element_at(v, F.floor((n + 2) / 2).cast("int"))) / 2
    level = g.select(*groups, F.col("__n").alias("n"), F.when(F.col("__n") > 0, middle(F.col("__v"), F.greatest("__n", F.lit(1)))).alias("median_diff"))
    r = g.where("__n >= 2").withColumn("__r", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    sample = F.transform(F.sequence(F.lit(1).cast("long"), F.col("__n")), lambda j: F.element_at(F.col("__v"), drawn(seed, F.col("__r"), j, F.col("__n")).cast("int")))
    r = r.select(*groups, "__n", F.array_sort(sample).alias("__s")).select(*groups, middle(F.col("__s"), F.col("__n")).alias("__m"))
    at = [F.percentile("__m", F.lit(q)).alias(c) for c, q in (("ci_lo", (1 - conf) / 2), ("ci_hi", (1 + conf) / 2))]  # over ``reps`` values
    ci = r.groupBy(*groups).agg(*at)
    on = [level[c].eqNullSafe(ci[c]) for c in groups]
    return level.join(ci, on, "left").select(*[level[c] for c in groups], "n", "median_diff", "ci_lo", "ci_hi")
