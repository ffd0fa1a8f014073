"""Helpers of the training-data operators: shared folder, lineage cuts, distributed ranks, joins on skewed keys.

Nothing here keeps a machine-local file on a cluster: intermediate tables go to the folder that the
session names in ``spark.checkpoint.dir``. A local folder is used only where that setting is unset.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of ASCII white space that separate words: \x20 and \x09 to \x0D. ``bytes.split()`` uses the same set.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, taken: Sequence[str]) -> str:
    """``name``, with as many underscores before it as keep it apart from ``taken`` (case does not count)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; set to a local one only for a local master that names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='readsift-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _drop_at_end(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def drop(spark: SparkSession, df_path: str) -> None:
    """Delete a table that ``cut`` wrote and nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df_path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``cut``, with the path of the written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/readsift/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _drop_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage so that a lost executor costs a re-read and not a recomputation, and fixes
    what is not repeatable (row ids by partition). The folder goes when the session ends.
    """
    return cut_at(df, tag)[0]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, inside SQL expressions."""
    return F.transform(F.array(value), body)[0]


def materialise(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns behind a generator, which keeps the optimiser from computing them again at each use."""
    s = F.struct(*[c.alias(k) for k, c in cols.items()])
    return df.select("*", F.inline(F.array(s)))


def slices(b: pa.RecordBatch, text: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose column ``text`` has at most ``limit`` bytes, or a single row."""
    end = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + limit, "right")))
        yield b.slice(at, to - at)
        at = to


def ranked(df: DataFrame, order: Sequence[str], rank: str, within: Sequence[str] = (), tag: str = "rank") -> DataFrame:
    """Add the 0-based position of each row in ``order``, separately for each ``within``.

    No window ever holds a group: rows are range-partitioned on (within, order), numbered inside
    their partition, and the numbers are shifted by the counts of the partitions before. The only
    table gathered per group has one row for each partition the group touches. ``order`` must be a
    total order. Columns named ``__pid``/``__mid``/``__base`` are reserved.
    """
    keys = [*within, *order]
    s = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__mid", F.monotonically_increasing_id())
    s = cut(s, tag).withColumn("__pid", F.shiftright("__mid", 33))
    per = s.groupBy("__pid", *within).agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__low"))
    w = Window.partitionBy(*within).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("__pid").alias("__p"), *[F.col(c).alias(f"__w{i}") for i, c in enumerate(within)], (F.coalesce(F.sum("__n").over(w), F.lit(0)) - F.col("__low")).alias("__base"))
    on = [F.col("__pid") == F.col("__p"), *[F.col(c).eqNullSafe(F.col(f"__w{i}")) for i, c in enumerate(within)]]
    return s.join(per, on).select(*df.columns, (F.col("__mid") + F.col("__base")).alias(rank))


def skewed_lookup(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join on ``key``, where ``right`` has one row a key and its column ``rows`` counts the key's rows in ``left``.

    Keys with more than ``1/share`` of all ``total`` rows are fewer than ``share``, so they are
    broadcast; the rest are joined by a shuffle in which no key is hot.
    """
    at = max(1000, total // share)
    hot = F.broadcast(right.where(F.col(rows) > at))
    cold = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(rows) <= at), key)
    return left.join(hot, key).unionByName(cold)


def even_lookup(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Left join on ``key`` (null-safe), where ``right`` has one row a key and any key may hold any part of ``left``.

    Keys with more than ``1/share`` of ``left``'s rows are fewer than ``share``, so their rows of
    ``right`` are broadcast; the rest are joined by a shuffle in which no key is hot. ``left`` is
    read twice and counted, so it should be a table.
    """
    k = free("__key", [*left.columns, *right.columns])
    n = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = cut(n.where(F.col("n") > max(1000, left.count() // share)).select(F.col(key).alias(k)), "hot")
    of = right.withColumnRenamed(key, k)
    found = hot.join(of.withColumnRenamed(k, f"{k}r"), F.col(k).eqNullSafe(F.col(f"{k}r")), "left").drop(f"{k}r")
    same = left[key].eqNullSafe(F.col(k))
    cold = left.join(F.broadcast(hot), same, "left_anti").join(of, same, "left")
    return left.join(F.broadcast(found), same).drop(k).unionByName(cold.drop(k))
