"""Readers for aligner and classifier output, and sinks. Schemas are declared, never inferred."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType()}[t]) for n, t in (x.split(":") for x in spec.split())])


PAF = _schema("qname:s qlen:l qstart:l qend:l strand:s tname:s tlen:l tstart:l tend:l matches:l blocklen:l mapq:i")
BLAST = _schema("qseqid:s sseqid:s staxid:s pident:d length:l mismatch:l gapopen:l qstart:l qend:l sstart:l send:l evalue:d bitscore:d qlen:l slen:l")
KRAKEN = _schema("status:s read_id:s k2_taxid:s k2_readlen:l kmer_lca:s")
BED = _schema("tname:s start:l end:l")
SAMPLE_SHEET = _schema("library_id:s donor:s barcode:i titration_level:s concentration:d run_id:s fastq:s seq_summary:s")
ABUNDANCE = _schema("species:s rel_abundance:d")
LINEAGE = _schema("taxid:s species:s genus:s rank:s")
CONTIGS = _schema("contig:s species:s")
REQUIRED_SAMPLE_COLUMNS = ("library_id", "donor", "titration_level", "run_id")
#: Column names that quality tools use, and the canonical ones (fixed values).
QC_NAMES = {
    "#id": "read_id", "id": "read_id", "#name": "read_id", "name": "read_id",
    "length": "read_len", "avg-qual": "mean_q", "avg.qual": "mean_q", "GC": "gc",
}


def tsv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, header: bool = False) -> DataFrame:
    """Tab-separated text with a declared schema; surplus columns are dropped and every row kept."""
    return spark.read.schema(schema).options(sep="\t", header=header, quote="", mode="PERMISSIVE", enforceSchema=True).csv(path)


def with_order(df: DataFrame) -> DataFrame:
    """Add ``_ord``, the rows' place by file and position, which settles ties as file order does.

    A block of a file is read by one task from its start on, so (file, block, place in the task)
    orders rows as the files do, however they are packed into tasks.
    """
    return df.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place")).alias("_ord"))


def ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def read_paf(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Alignments with identity, coverage (half-open) and score; tags after column 12 are ignored."""
    d = with_order(tsv(spark, path, PAF))
    return d.withColumns({"identity": ratio(F.col("matches"), F.col("blocklen")), "coverage": ratio(F.col("qend") - F.col("qstart"), F.col("qlen")), "score": F.col("matches").cast("double")})


def read_blast(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Hits with aln_fraction and query_cov (1-based, inclusive)."""
    d = with_order(tsv(spark, path, BLAST))
    return d.withColumns({"aln_fraction": ratio(F.col("length"), F.col("qlen")), "query_cov": ratio(F.col("qend") - F.col("qstart") + 1, F.col("qlen"))})


def read_kraken(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return tsv(spark, path, KRAKEN)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, BED)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF features as half-open 0-based intervals."""
    g = _schema("tname:s source:s type:s start:l end:l score:s strand:s phase:s attributes:s")
    d = spark.read.schema(g).options(sep="\t", comment="#", quote="").csv(path)
    return d.select("tname", (F.col("start") - 1).alias("start"), "end", "type", "attributes")


def read_masked(spark: SparkSession, path: str) -> DataFrame:
    """Inclusive masked ranges (``>name:start-end`` lines) as half-open intervals."""
    d = spark.read.text(path).where(F.col("value").startswith(">"))
    part = lambda i: F.regexp_extract("value", r"^>(.*):(\d+)-(\d+)$", i)
    return d.select(part(1).alias("tname"), part(2).try_cast("long").alias("start"), (part(3).try_cast("long") + 1).alias("end")).where("start is not null")


def read_qc(spark: SparkSession, path: str) -> DataFrame:
    """Read statistics under canonical names; read ids end at the first white space, and gc is a share."""
    d = spark.read.options(sep="\t", header=True, inferSchema=False, quote="").csv(path)
    for old, new in QC_NAMES.items():
        if old in d.columns and new not in d.columns:
            d = d.withColumnRenamed(old, new)
    if percent := "GC(%)" in d.columns and "gc" not in d.columns:
        d = d.withColumnRenamed("GC(%)", "gc")
    out = d.withColumn("read_id", F.regexp_replace("read_id", r"\s.*$", ""))
    out = out.withColumns({c: F.col(c).try_cast("double") for c in ("read_len", "mean_q", "gc") if c in out.columns})
    return out.withColumn("gc", F.col("gc") / 100) if percent else out


def read_end_reason(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.options(sep="\t", header=True, inferSchema=False).csv(path)
    return d.select("read_id", "end_reason")


def read_sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The sample sheet, by header names; raises if a required column is missing."""
    d = spark.read.options(sep="\t", header=True, inferSchema=False).csv(path)
    missing = [c for c in REQUIRED_SAMPLE_COLUMNS if c not in d.columns]
    if missing:
        raise ValueError(f"sample sheet lacks {', '.join(missing)}")
    kind = {f.name: f.dataType for f in SAMPLE_SHEET}
    return d.select(*[F.col(c).cast(kind.get(c, T.StringType())).alias(c) for c in d.columns])


def read_fasta(spark: SparkSession, path: str, min_length: int = 0) -> DataFrame:
    """(id, seq, nchar). Records are split at '>' after a line break by the reader, so files stay splittable.

    Records shorter than ``min_length`` (such as headers that swallowed their sequence) are dropped.
    """
    d = spark.read.option("lineSep", "\n>").text(path).withColumn("value", F.regexp_replace("value", "^>", "")).where(F.length("value") > 0)
    head = F.regexp_extract("value", r"^([^\s]*)", 1)
    body = F.when(F.instr("value", "\n") > 0, F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "")).otherwise("")
    return d.select(head.alias("id"), body.alias("seq")).withColumn("nchar", F.length("seq")).where(F.col("nchar") >= min_length)


def read_lookup(spark: SparkSession, path: str | None, schema: T.StructType) -> DataFrame | None:
    """A lookup table, or None without a path: callers then use the documented fallback."""
    return None if path is None else tsv(spark, path, schema, header=True)


def read_features(spark: SparkSession, parquet: str | None = None, text: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """The feature table: parquet if given, else headered TSV with ``schema``, else an error."""
    if parquet is not None:
        return spark.read.parquet(parquet)
    if text is not None and schema is not None:
        return tsv(spark, text, schema, header=True)
    raise FileNotFoundError("no feature table given")


def summary_file(run_id: str, names: Sequence[str]) -> str | None:
    """The sequencing summary of a run: the one whose name has the id's first 8 characters, else the only one."""
    key = run_id.replace("-", "")[:8]
    hits = [n for n in names if key and key in PurePosixPath(n).name.replace("-", "")]
    return hits[0] if hits else (names[0] if len(names) == 1 else None)


def run_tag(profile: str, identity: float, coverage: float) -> str:
    return f"gt_{profile}_id{identity:.2f}_cov{coverage:.2f}"


def write_report(df: DataFrame, path: str) -> None:
    """A headered TSV directory, for people; tables for further work go to ``write_table``."""
    df.write.mode("overwrite").options(sep="\t", header=True).csv(path)


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Parquet, laid out by ``by`` so that later filters on those columns prune files."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def done(spark: SparkSession, paths: Sequence[str]) -> bool:
    """Whether all outputs of a stage exist (the resume guard), on any file system Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        q = jvm.org.apache.hadoop.fs.Path(p)
        fs = q.getFileSystem(conf)
        if not fs.exists(q) or fs.getContentSummary(q).getLength() == 0:
            return False
    return True


def collapse_contigs(seqs: DataFrame, key: str = "genome", order: str = "ord", seq: str = "seq", spacer: int = 100) -> DataFrame:
    """One sequence a genome: its contigs in order, joined by N spacers. A genome's contigs fit one row by design."""
    g = seqs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, seq))).alias("x"))
    return g.select(key, F.array_join(F.transform("x", lambda x: x[seq]), "N" * spacer).alias("seq"))


def wrap_fasta(seqs: DataFrame, id: str = "id", seq: str = "seq", width: int = 70) -> DataFrame:
    """FASTA text of each row, lines of ``width``."""
    return seqs.select(F.concat(F.lit(">"), F.col(id), F.lit("\n"), F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"))).alias("value"))


def taxid_fasta(rows: DataFrame, width: int = 70) -> DataFrame:
    """Records of (taxid, accession, seq) with a numeric non-zero taxid and a sequence, headed for a classifier build."""
    ok = rows.where(F.col("taxid").rlike(r"^\d+$") & (F.col("taxid").try_cast("long") > 0) & (F.length("seq") > 0))
    return wrap_fasta(ok.select(F.concat(F.lit("kraken:taxid|"), "taxid", F.lit("|"), "accession").alias("id"), "seq"), width=width)
