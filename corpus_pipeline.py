"""The corpus pipeline: five stages, each working on what the one before has kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``docs``, whatever they are:
extra columns pass through unread. Order: toxic documents go; one document of each group of near
copies stays; documents that hold a benchmark item go; the rest is put in the order of the source
mixture (rows sorted by the mixture's schedule, none dropped); documents are dealt to shards, whose
slots follow the order in which the mixing stage wrote them. Read slot by slot over all shards, the corpus holds the target shares
until a source runs out.

Defined results: rows with a null text pass the filters, as no text convicts them; in the near
copy stage rows with a null id stay, of rows that repeat an id and text one stays, and rows that
share an id but not a text are one document with several texts, all of which stay or go; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readsift.llm import decontamination, mixing, near_copies, sharding, toxicity
from readsift.llm.common import cut, free, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold."""
    score = free("score", docs.columns)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, docs.columns, out=score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (5-word shingles, similarity 0.8 or more)."""
    kept = docs.join(near_copies.first_ids(docs), "doc_id", "left_semi")
    row = free("row", docs.columns)
    # Of rows that repeat an id and text the first by the other columns stays; maps have no order and do not decide.
    order = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and kind != "variant"]
    same = Window.partitionBy("doc_id", "text").orderBy(*order, "doc_id")
    once = kept.withColumn(row, F.row_number().over(same)).where(F.col(row) == 1)
    return once.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    hits = free("hits", docs.columns)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long"), "text")
    found = decontamination.matches(docs, items, docs.columns, hits=hits)
    return found.where(F.size(hits) == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted by their place in the mixture: the order of the rows that the stage writes is its result."""
    i, s, at = (free(n, docs.columns) for n in ("id_", "source_", "at"))
    place = F.min(F.struct("slot", "row_in_block")).alias(at)  # the first one of rows that repeat both
    of = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias(i), F.col("source").alias(s)).agg(place)
    placed = docs.join(of, docs["doc_id"].eqNullSafe(F.col(i)) & docs["source"].eqNullSafe(F.col(s)), "left")
    return placed.repartitionByRange(at).sortWithinPartitions(at).select(*docs.columns)


def written_order(docs: DataFrame, name: str) -> DataFrame:
    """Add the place of each row in the files it is read from, as ``name``: number of the part, file, row.

    Spark numbers the parts of a range-partitioned table in the order of their ranges. Null for rows of no file.
    """
    try:
        m = docs.metadataColumn("_metadata")
        part = F.regexp_extract(m["file_name"], r"part-(\d+)", 1).try_cast("long")
        return docs.select("*", F.struct(part.alias("part"), m["file_name"].alias("file"), m["row_index"].alias("row")).alias(name))
    except AnalysisException:  # not a table of files
        return docs.select("*", F.lit(None).cast("int").alias(name))


def deal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard, and its slot there in the order in which the mixing stage wrote the documents."""
    at = free("at", docs.columns)
    out = sharding.shard(written_order(docs, at), at=at)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", deal),
]

#: Trained classifiers, LSH and the heap are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
