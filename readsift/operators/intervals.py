"""Interval overlap, union of intervals, and coverage of a reference by intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import carried, ranged


def merge_intervals(df: DataFrame, key: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping and touching intervals of each key become one (gaps and islands).

    The largest end so far and the number of the island are carried over range partitions, so a key with most of
    the intervals is no task of its own.
    """
    order = [F.col(start), F.col(end)]
    same = df.groupBy(*key, start, end).agg(F.count(F.lit(1)).alias("__n"))  # repeats do not meet in one range
    d = carried(ranged(same, key, order), key, order, "__top", F.col(end), "max", -1)
    d = d.withColumn("__new", F.when(F.col("__top").isNull() | (F.col(start) > F.col("__top")), 1).otherwise(0))
    d = carried(d, key, order, "__island", F.col("__new"))
    return d.groupBy(*key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("__n").alias("n_merged")).drop("__island")


def overlap_sweep(left: DataFrame, right: DataFrame, key: str, out: str = "in_region") -> DataFrame:
    """``overlap_flag`` by one sweep over both sides: each is read once, no row is copied, no bins are chosen.

    In the order of right starts and left ends, an interval meets some right one if the largest right end so far
    reaches its start. That maximum is carried over range partitions. Rows of ``left`` need no id; null keys and
    ends meet nothing.
    """
    h = F.xxhash64(*[c for c, kind in left.dtypes if "map<" not in kind and kind != "variant"])  # spreads rows with one end, or none
    l = left.select(*[F.col(c).alias(f"l{i}") for i, c in enumerate(left.columns)], F.col(key).alias("__g"), F.col("start").alias("__s"), F.col("end").alias("__at"), F.lit(1).alias("__side"), h.alias("__h"))
    known = right.where(f"`{key}` is not null and start is not null and `end` is not null")
    r = known.groupBy(F.col(key).alias("__g"), F.col("start").alias("__at")).agg(F.max("end").alias("__to")).withColumn("__side", F.lit(0))
    order = [F.col("__at"), F.col("__side"), F.col("__h")]
    d = carried(ranged(l.unionByName(r, allowMissingColumns=True), ["__g"], order), ["__g"], order, "__top", F.col("__to"), "max")
    meets = F.col("__g").isNotNull() & F.col("__at").isNotNull() & (F.col("__top") >= F.col("__s"))
    return d.where("__side = 1").select(*[F.col(f"l{i}").alias(c) for i, c in enumerate(left.columns)], F.coalesce(meets, F.lit(False)).alias(out))


def overlap_flag(left: DataFrame, right: DataFrame, key: str, out: str = "in_region", bin_size: int | None = None, ids: Sequence[str] = ("id",)) -> DataFrame:
    """Add whether (start, end) meets any interval of ``right`` with the same key, ends included.

    The equality on ``key`` makes it a hash join with a residual. For many intervals a key, give
    ``bin_size``: both sides are cut into bins and joined on (key, bin), and ``ids`` must identify
    the rows of ``left``.
    """
    l, r = left.alias("l"), right.select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    meets = (F.col("start") <= F.col("__e")) & (F.col("end") >= F.col("__s"))
    if bin_size is None:
        hit = l.join(r, (F.col(key) == F.col("__k")) & meets, "left_semi").select(*ids).distinct()
    else:
        bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor(F.col(e) / bin_size)))
        lb = left.where("start <= end").withColumn("__b", bins("start", "end"))
        rb = r.where("__s <= __e").withColumn("__c", bins("__s", "__e"))
        hit = lb.join(rb, (F.col(key) == F.col("__k")) & (F.col("__b") == F.col("__c")) & meets, "left_semi").select(*ids).distinct()
    return left.join(hit.withColumn(out, F.lit(True)), list(ids), "left").withColumn(out, F.coalesce(out, F.lit(False)))


def coverage(df: DataFrame, key: Sequence[str], start: str = "start", end: str = "end", length: str = "glen") -> DataFrame:
    """Breadth and evenness (1 - Gini of per-position depth, gaps included) of each key's reference.

    Intervals are half-open and clamped to [0, length]; a reference without positive length gives
    nulls, one without covered positions gives (0, 0). Depth comes from a sweep over +1/-1 events that is
    carried over range partitions, evenness from a Lorenz curve over depth levels, so the only window of a
    reference sees its depth levels, not its positions.
    """
    glen = F.col(length).cast("double")
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(glen, F.col(c).cast("double")))
    d = df.select(*key, glen.alias("__g"), clamp(start).alias("__s"), clamp(end).alias("__e"))
    keys = d.groupBy(*key).agg(F.first("__g", ignorenulls=True).alias("__g"))
    ok = d.where((F.col("__g") > 0) & (F.col("__e") > F.col("__s")))
    events = ok.select(*key, "__g", F.explode(F.array(F.struct(F.col("__s").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("__e").alias("pos"), F.lit(-1).alias("d")), F.struct(F.lit(0.0).alias("pos"), F.lit(0).alias("d")))).alias("x"))
    at = events.groupBy(*key, "__g", F.col("x.pos").alias("pos")).agg(F.sum("x.d").alias("d"))
    pos = [F.col("pos")]
    seg = carried(carried(ranged(at, key, pos), key, pos, "depth", F.col("d")), key, pos, "next", F.col("pos"), "next")
    seg = seg.withColumn("len", F.coalesce("next", "__g") - F.col("pos")).where("len > 0")
    level = seg.groupBy(*key, "__g", "depth").agg(F.sum("len").alias("len"))  # one row a depth
    up = Window.partitionBy(*key).orderBy("depth")
    mass = F.col("depth") * F.col("len")
    cum = F.sum(mass).over(up.rowsBetween(Window.unboundedPreceding, 0))
    level = level.withColumn("area", F.col("len") * (2 * cum - mass) / 2)
    stats = level.groupBy(*key, "__g").agg(
        F.sum(F.when(F.col("depth") > 0, F.col("len")).otherwise(0.0)).alias("covered"),
        F.sum(mass).alias("mass"),
        F.sum("area").alias("area"),
    )
    gini = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 2 * F.col("area") / (F.col("__g") * F.col("mass"))))
    stats = stats.select(*key, (F.col("covered") / F.col("__g")).alias("genome_breadth"), (1 - gini).alias("coverage_evenness"))
    out = keys.join(stats, list(key), "left")
    none = F.when(F.col("__g") > 0, 0.0)
    return out.select(*key, F.coalesce("genome_breadth", none).alias("genome_breadth"), F.coalesce("coverage_evenness", none).alias("coverage_evenness"))


def species_coverage(contigs: DataFrame, key: Sequence[str], species: str = "species", contig: str = "tname") -> DataFrame:
    """The best-covered contig of each species: its breadth, and its evenness (first contig on ties)."""
    w = Window.partitionBy(*key, species).orderBy(F.desc_nulls_last("genome_breadth"), contig)
    top = contigs.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    return top.select(*key, species, "genome_breadth", "coverage_evenness")


def offsets(df: DataFrame, key: Sequence[str], order: str, length: str, spacer: int = 100) -> DataFrame:
    """Start of each piece when the pieces of a key are joined with a spacer."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(F.col(length) + spacer).over(w), F.lit(0)))
