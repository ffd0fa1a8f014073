"""Running sums and exact quantiles in which no task holds a whole group.

A window over a group sorts all of it in one task, and an exact ``percentile`` keeps all its distinct
values in one state. Here rows are range-partitioned on (groups, order) and written once, so that
their places are fixed even if an executor is lost; windows then run inside the part of a group that
one range partition holds, and are shifted by the sums of the parts before. What is gathered per
group has one row for each partition that the group touches. Columns ``__pid``, ``__w*``, ``__o*``,
``__b*``, ``__l*``, ``__k``, ``__v`` and ``__c`` are reserved.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch


def ranged(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows range-partitioned on (groups, order) and written, with their partition as ``__pid``."""
    keys = [*[F.col(g) for g in groups], *order]
    d = df.repartitionByRange(*(keys or [F.lit(0)])).withColumn("__pid", F.spark_partition_id())
    path = scratch(df.sparkSession)
    d.write.parquet(path)
    return df.sparkSession.read.schema(d.schema).parquet(path)


def carried(d: DataFrame, groups: Sequence[str], order: Sequence[Column], out: str, value: Column, how: str = "sum", upto: int = 0) -> DataFrame:
    """Add to ``ranged`` rows the running sum, maximum or next value in ``order``, for each of ``groups``, as ``out``.

    ``how`` is sum or max, over the rows up to the one ``upto`` places away (0 this one, -1 the one before), or next, the
    value of the following row. Rows that ``order`` does not tell apart stand in any one order. Each range partition
    works alone; what it passes on is one value for each group that it touches. Nulls do not count; without any value
    before a row a sum is 0 and a maximum null.
    """
    agg = {"sum": F.sum, "max": F.max, "next": lambda v: F.min_by(v, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))}[how]
    over = agg if how != "next" else (lambda v: F.first(v))
    part = d.groupBy("__pid", *groups).agg(agg(value).alias("__b"))
    whole = Window.partitionBy(*groups).orderBy("__pid")
    span = whole.rowsBetween(1, 1) if how == "next" else whole.rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(F.col("__pid").alias("__o"), *[F.col(g).alias(f"__w{i}") for i, g in enumerate(groups)], over("__b").over(span).alias("__b"))
    here = Window.partitionBy("__pid", *groups).orderBy(*order)
    here = here.rowsBetween(1, 1) if how == "next" else here.rowsBetween(Window.unboundedPreceding, upto)
    own = over(F.struct(value.alias("__b")) if how == "next" else value).over(here)  # in a struct, a null that follows differs from no row
    on = [F.col("__pid") == F.col("__o"), *[F.col(g).eqNullSafe(F.col(f"__w{i}")) for i, g in enumerate(groups)]]
    joined = d.withColumn("__l", own).join(part, on)
    both = {"sum": F.coalesce("__l", F.lit(0)) + F.coalesce("__b", F.lit(0)), "max": F.greatest("__l", "__b"), "next": F.coalesce("__l", F.struct("__b"))["__b"]}[how]
    return joined.select(*[F.col(f"`{c}`") for c in d.columns], both.alias(out))


def running(df: DataFrame, groups: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """Add for each name of ``sums`` the sum up to and with the row, and as ``<name>_all`` the group's sum.

    Nulls count as 0; null groups are groups. Rows that ``order`` does not tell apart stand in any one order.
    """
    names = list(sums)
    d = df.select("*", *[F.coalesce(c.cast("long"), F.lit(0)).alias(f"__l{i}") for i, c in enumerate(sums.values())])
    d = ranged(d, groups, order)

    part = d.groupBy("__pid", *groups).agg(*[F.sum(f"__l{i}").alias(f"__b{i}") for i in range(len(names))])
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(
        F.col("__pid").alias("__o"), *[F.col(g).alias(f"__w{i}") for i, g in enumerate(groups)],
        *[F.coalesce(F.sum(f"__b{i}").over(before), F.lit(0)).alias(f"__b{i}") for i in range(len(names))],
        *[F.sum(f"__b{i}").over(whole).alias(f"{n}_all") for i, n in enumerate(names)],
    )
    here = Window.partitionBy("__pid", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *[F.sum(f"__l{i}").over(here).alias(f"__o{i}") for i in range(len(names))])
    on = [F.col("__pid") == F.col("__o"), *[F.col(g).eqNullSafe(F.col(f"__w{i}")) for i, g in enumerate(groups)]]
    kept = [F.col(f"`{c}`") for c in df.columns]
    return d.join(part, on).select(*kept, *[(F.col(f"__o{i}") + F.col(f"__b{i}")).alias(n) for i, n in enumerate(names)], *[f"{n}_all" for n in names])


def quantiles(df: DataFrame, groups: Sequence[str], wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Groups and, for each name of ``wanted``, the exact type-7 quantile (column, probability) as a double.

    Equal values are counted before they are ordered. Nulls are left out; a group with nulls only has a
    null quantile; without ``groups`` there is one row even of an empty table. NaN is the largest value.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    long = df.select(*groups, F.explode(F.array(*[F.struct(F.lit(k).alias("__k"), F.col(c).cast("double").alias("__v")) for k, c in enumerate(columns)])).alias("__s"))
    counts = long.select(*groups, "__s.*").groupBy(*groups, "__k", "__v").agg(F.count("__v").alias("__c"))
    r = running(counts, [*groups, "__k"], [F.col("__v")], {"__to": F.col("__c")})

    def at(k: int, place: Column) -> Column:
        return F.max(F.when((F.col("__k") == k) & (place < F.col("__to")) & (place >= F.col("__to") - F.col("__c")), F.col("__v")))

    found, out = [], []
    for i, (name, (c, q)) in enumerate(wanted.items()):
        k, h = columns.index(c), (F.col("__to_all") - 1) * F.lit(float(q))
        found += [at(k, F.floor(h)).alias(f"__b{i}"), at(k, F.ceil(h)).alias(f"__o{i}"), F.max(F.when(F.col("__k") == k, h)).alias(f"__l{i}")]
        low, high, h = F.col(f"__b{i}"), F.col(f"__o{i}"), F.col(f"__l{i}")
        out.append(F.when(low == high, low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high).alias(name))
    return r.groupBy(*groups).agg(*found).select(*groups, *out)
